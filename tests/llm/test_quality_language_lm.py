import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.common import NORMAL, no_docs, odd_docs, rows
from weftline.llm import language_id, lm_score, quality
from weftline.llm.elias_fano import EliasFano, Trie, build_shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    texts = [r[1] for r in rows()] + ["a b c d e", "a b c d e f a b c d e", "x " * 30, "a # | <>\nx\nx\n x\x0b\x0cy", "r s t u v w r s t u v\nr s t u v"]
    docs = spark.createDataFrame([(i, t, None, "c") for i, t in enumerate(texts)], "doc_id long, text string, lang string, words string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], base_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(odd_docs(spark)).count() == len(rows())
    assert quality.judge(no_docs(spark)).count() == 0


def test_divergence_rejects_junk_and_keeps_prose(spark):
    rng = np.random.default_rng(4)
    words = NORMAL.replace(",", "").replace(".", "").split() + [f"{a}{b}" for a in ("win", "rain", "stone", "leaf", "road") for b in ("ter", "ing", "ward", "y", "less")]
    prose = [" ".join(rng.choice(words, 250)) + "." for _ in range(150)]
    junk = [" ".join(w + "#*$%"[i % 4] * 3 for i, w in enumerate(rng.choice(words, 250))) for _ in range(5)]
    table = [" | ".join(rng.choice(words[-25:], 250)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk + table)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert kept == set(range(150))


def test_forward_sums_over_all_segmentations():
    v = language_id.pieces(PIECE)
    table = np.random.default_rng(0).random((v.size, 3))
    table /= table.sum(0)
    names = {v.library.id_to_piece(i): i for i in range(v.size)}

    def brute(word):
        s = "▁" + word
        a = [np.zeros(3) for _ in range(len(s) + 1)]
        a[0] = np.ones(3)
        for j in range(1, len(s) + 1):
            for i in range(j):
                p = names.get(s[i:j])
                if p is not None and not (v.library.is_byte(p) or v.library.is_control(p) or v.library.is_unknown(p)):
                    a[j] = a[j] + a[i] * table[p]
                elif j - i == 1:
                    a[j] = a[j] + a[i] * 1e-9
        return np.log(a[-1])

    words = ["the", "hello", "éère", "日本x", "a", "internationalization", "x" * 60, "ß€😀"]
    assert np.abs(language_id.forward(pa.array(words), v, table, 1e-9) - np.array([brute(w) for w in words])).max() < 1e-9


def test_a_million_bytes_without_a_blank_take_seconds():
    v = language_id.pieces(PIECE)
    table = np.full((v.size, 4), 1 / v.size)
    text = "".join(chr(0x4E00 + (i * i) % 5000) for i in range(340_000))
    begun = time.perf_counter()
    assert np.isfinite(language_id.forward(pa.array([text]), v, table, 1e-9)).all()
    assert time.perf_counter() - begun < 10


def test_more_languages_than_one_pass_takes(spark):
    rng = np.random.default_rng(3)
    data = [(i * 10 + k, " ".join(f"{chr(97 + i)}{chr(97 + i)}{w}" for w in rng.choice(["lo", "mi", "ra"], 12)), f"l{i}") for i in range(7) for k in range(10)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    one, many = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs, F.lit(False), PIECE, language_id.LanguageLimits(group=g)).collect()} for g in (64, 3))
    assert one == many and {x for x, _ in one.values()} == {f"l{i}" for i in range(7)}


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    pools = {"en": "the of and with house water there light every morning".split(), "de": "der die und nicht haus wasser dort licht jeden morgen".split(), "fr": "le la et avec maison eau chaque matin lumière où".split()}
    data = [(i, " ".join(rng.choice(pools[lang], 30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(data + [(900, None, "en"), (901, "12 34 !", "de"), (902, "", None), (None, "the house", None), (904, "WASSER UND LICHT", None)], "doc_id long, text string, lang string")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    got = {r["doc_id"]: r for r in language_id.identify(docs, held, PIECE).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in data)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in data)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, None, 904)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    unlabelled = odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled, held, PIECE).collect()} == {"und"}
    assert language_id.identify(no_docs(spark), held, PIECE).count() == 0


def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for top in (50, 10**4, 10**7):
        values = np.sort(rng.integers(0, top, 3000))
        coded, rest = EliasFano.load(memoryview(EliasFano.of(values, top).dump()))
        assert (coded.at(np.arange(3000)) == values).all() and not len(rest)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (500, 2))})
    context, word = np.array(pairs).T
    log10 = -rng.random(len(pairs)) * 5
    shards = [build_shard(context[(context >= f) & (context < f + 20)], word[(context >= f) & (context < f + 20)], log10[(context >= f) & (context < f + 20)], f, 20, 40) for f in (20, 0)]
    trie = Trie(shards, 40)
    every = np.stack(np.meshgrid(np.arange(40), np.arange(40), indexing="ij"), -1).reshape(-1, 2)
    found = trie.find(every[:, 0], every[:, 1])
    known = dict(zip(pairs, log10, strict=True))
    for (a, b), p in zip(every.tolist(), found, strict=True):
        assert math.isnan(p) if (a, b) not in known else known[a, b] - 2e-4 <= p <= known[a, b] + 1e-9
    assert len(Trie([], 40).firsts) == 0


def test_lm_score_against_plain_counts(spark):
    limits = lm_score.ScoreLimits(trie_words=6, sent_counts=12, shards=3)
    rng = np.random.default_rng(3)
    data = [(i, " ".join(rng.choice([f"w{k}" for k in range(40)], rng.integers(0, 60), p=np.arange(40, 0, -1) / 820))) for i in range(80)] + [(200, None), (201, "ZZ zz Üb"), (201, "ZZ zz Üb"), (None, "w1")]
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, hash long")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    out = lm_score.score(docs, held, limits).collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [(d, [*WORD.findall(lower(t)), "\n"]) for d, t in data]
    counts, pairs = Counter(), Counter()
    train = [t for d, t in tokens if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    for t in train:
        counts.update(t)
    n, v = sum(counts.values()), len(counts)
    top = sorted((w for w in counts if w != "\n"), key=lambda w: -counts[w])[:6]
    cls = lambda w: w if w == "\n" or w in top else "?"
    for t in train:
        pairs.update(zip(["<"] + [cls(w) for w in t[:-1]], map(cls, t), strict=True))
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == sorted(
        (len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for _, t in tokens
    )
    # The boundary of the trie's words is unambiguous here, so the model can be written out.
    if counts[top[-1]] > sorted((c for w, c in counts.items() if w != "\n"), reverse=True)[6]:
        classes = Counter()
        for w, c in counts.items():
            classes[cls(w)] += c
        size = limits.vocabulary
        uni = lambda w: (classes[w] + 0.1) / (n + 0.1 * (size - 1))
        total, kinds = Counter(), Counter()
        for (a, _), c in pairs.items():
            total[a] += c
            kinds[a] += 1

        def p(a, b):
            back = 0.75 * kinds[a] / total[a] if total[a] else 1.0
            return (max(pairs[a, b] - 0.75, 0) / total[a] if total[a] else 0) + back * uni(b)

        others = [w for w in counts if cls(w) == "?"]
        floor = sum(counts[w] for w in others) + 0.1 * (len(others) + 1)
        want = []
        for _, t in tokens:
            s = sum(math.log10(p(a, b)) for a, b in zip(["<"] + [cls(w) for w in t[:-1]], map(cls, t), strict=True))
            want.append(s + sum(math.log10((counts[w] + 0.1) / floor) for w in t if cls(w) == "?"))
        got = sorted(r["score"] for r in out)
        assert all(abs(a - b) < 0.001 * 60 for a, b in zip(got, sorted(want), strict=True))
    assert lm_score.score(no_docs(spark), held, limits).count() == 0
    assert lm_score.score(odd_docs(spark), F.lit(True), limits).count() == len(rows())


def test_trie_has_every_word_and_pair(spark, monkeypatch):
    """6,000 words, more than any fixed table of 4,094: each pair counts by itself."""
    monkeypatch.setattr(lm_score, "SCORED_BYTES", 20_000)
    rng = np.random.default_rng(5)
    data = [(i, " ".join(f"w{k}" for k in rng.integers(0, 6000, 100))) for i in range(150)] + [(150, "new w1 w2 new"), (151, None), (None, "w3 W3")]
    data += [(1000 + i, t) for i, (_, t) in enumerate(data[:20])]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    held = F.col("doc_id").isNull() | (F.col("doc_id") % 10 == 0)
    got = {r["doc_id"]: r for r in lm_score.score(docs, held).collect()}
    tokens = {d: [*(t or "").lower().split(), "\n"] for d, t in data}
    counts, pairs = Counter(), Counter()
    for d, t in tokens.items():
        if d is not None and d % 10:
            counts.update(t)
            pairs.update(zip(["<", *t], t, strict=False))
    n, v = sum(counts.values()), len(counts)
    assert v > 4094
    total, kinds = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        kinds[a] += 1

    def p(a, b):
        back = 0.75 * kinds[a] / total[a] if total[a] else 1.0
        return (max(pairs[a, b] - 0.75, 0) / total[a] if total[a] else 0) + back * (counts[b] + 0.1) / (n + 0.1 * (v + 1))

    for d, t in tokens.items():
        assert abs(got[d]["score"] - sum(math.log10(p(a, b)) for a, b in zip(["<", *t], t, strict=False))) < 0.0005 * len(t)
        assert got[d]["n_known"] == sum(counts[w] > 0 for w in t)
