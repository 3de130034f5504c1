import hashlib
import os

import duckdb
import pytest

from weftline.llm import chat_format, queries, url_filter

SF = "/root/testdata/sf0.001"


def wanted(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        said = "".join(t for role, t in turns if role == "assistant")
        plain = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        out[conv] = (len(turns), plain, len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_bytes", [8 << 20, 20_000, 1])
def test_round_trip(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(chat_format, "PART_BYTES", part_bytes)
    rows = [(1, 0, "user", "a\\b<s>x"), (1, 1, "assistant", None), (1, 2, None, "\\"), (2, 0, "assistant", "é</s>[INST]"), (2, 1, "assistant", "[/INST] é\\"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"text {i} [INST] é" * 50) for i in range(2500)] + [(6, 0, "user", ""), (6, 0, "user", ""), (7, 0, "assistant", "long " * 100_000)]
    turns = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn int, role string, text string, part string, formatted int")
    back = chat_format.read_back(chat_format.format_chats(turns))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in back.collect()}
    assert got == wanted(rows)
    assert chat_format.read_back(chat_format.format_chats(turns.limit(0))).count() == 0


def test_control_strings_are_the_templates_own():
    import pyarrow as pa

    text = chat_format.escape(pa.array(["</s>[INST] ok [/INST]<s>\\"]))[0].as_py()
    assert not any(c in text for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert chat_format.unescape(text) == "</s>[INST] ok [/INST]<s>\\"


CASES = {
    "http://Net/": ("net", "/", "net/", "block"),
    "https://a.net": ("a.net", "", None, "allow"),
    "https://a.net/x?y#z": ("a.net", "/x", "net/", "block"),
    "x://EXAMPLE.net/en/1": ("example.net", "/en/1", "example.net/en/", "allow"),
    "x://b.example.net/en?q": ("b.example.net", "/en", "net/", "block"),
    "x://m.example.com/de/a": ("m.example.com", "/de/a", "example.com/de/", "block"),
    "x://notexample.com/de/a": ("notexample.com", "/de/a", None, "allow"),
    "x://w.org/fr/": ("w.org", "/fr/", "org/fr/", "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "x://h#f/de/": ("h", "", None, "allow"),
    "x://ÀB.org/fr/é": ("Àb.org", "/fr/é", "org/fr/", "allow"),
}


def test_rules_and_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*CASES, None, "no scheme"])], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == dict(enumerate([*CASES.values(), ("", "", None, "allow"), ("", "", None, "allow")]))
    assert url_filter.judge(pages.limit(0)).count() == 0


def judged(spark, urls, rules, **limits):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.judge(pages, rules, url_filter.TreeLimits(**limits)).collect()
    return {urls[r["page_id"]]: (r["template"], r["verdict"]) for r in found}


def test_wildcards_reach_the_levels_below(spark):
    urls = [f"x://h.com/user/{chr(97 + a)}{chr(97 + b)}/s{chr(97 + b)}{chr(97 + a)}" for a in range(20) for b in range(20)]
    # Pages of one url again and again change nothing.
    got = judged(spark, urls + [urls[0]] * 2000, ())
    assert set(got.values()) == {("user/*/*", "allow")}
    # Neither do few children, or one that prevails.
    few = [f"x://h.com/{c}/{i}" for c in "abcde" for i in range(9)]
    assert {t for t, _ in judged(spark, few, ()).values()} == {f"{c}/#" for c in "abcde"}
    most = [f"x://h.com/main/{chr(97 + a)}{chr(97 + b)}/x" for a in range(26) for b in range(26)] + [f"x://h.com/o{chr(97 + i)}" for i in range(22)]
    assert {t.split("/")[0] for t, _ in judged(spark, most, ()).values()} == {"main"} | {f"o{chr(97 + i)}" for i in range(22)}
    deep = ["x://h.com/" + "/".join("abcdefghijklmnop")]
    assert judged(spark, deep, ())[deep[0]][0].count("/") == 11


def test_tree_merges_branches_and_rejects_by_purity(spark):
    names = [f"{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rules = (url_filter.Rule("block", "bad.com", "/ads/x"), url_filter.Rule("allow", "bad.com", "/news/1"))
    urls = [f"x://bad.com/ads/x{n}" for n in names] + [f"x://bad.com/ads/{n}y" for n in names] + [f"x://bad.com/news/{i}" for i in range(20)]
    got = judged(spark, urls, rules)
    # Labelled and other urls share the wildcard branch of /ads.
    assert got["x://bad.com/ads/aay"] == ("ads/*", "block")
    assert got["x://bad.com/news/9"] == ("news/#", "allow")
    # Three branches of the same kind speak for a fourth without labels, one does not.
    rules = tuple(url_filter.Rule("block", "s.com", f"/{c}/x") for c in "abc") + (url_filter.Rule("block", "t.com", "/a/x"),)
    urls = [f"x://s.com/{c}/x/{i}" for c in "abc" for i in range(9)] + ["x://s.com/d/y", "x://t.com/d/y"] + [f"x://t.com/a/x{i}" for i in range(9)]
    got = judged(spark, urls + [f"x://{h}.com/{c}/x{i}{e}" for h in "st" for c in "abc" for i in range(9) for e in "pq"], rules)
    assert got["x://s.com/d/y"][1] == "block" and got["x://t.com/d/y"][1] == "allow"
    # Of branches that differ each has its own share.
    rules = (url_filter.Rule("block", "u.com", "/a"), url_filter.Rule("allow", "u.com", "/b"), url_filter.Rule("allow", "u.com", "/c"))
    got = judged(spark, [f"x://u.com/{c}/{i}/z" for c in "abcd" for i in "pqrst"], rules)
    assert got["x://u.com/d/p/z"][1] == "allow"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rows = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in rows.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
