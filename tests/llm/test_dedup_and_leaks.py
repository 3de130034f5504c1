import hashlib
import inspect
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.common import LONG, NORMAL, no_docs, odd_docs, rows
from weftline.llm import decontaminate, minhash, suffix_dedup
from weftline.scratch import materialize


def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("bucket_rows", [100_000, 3])
def test_repeats_against_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    base = [noise(rng.randint(50, 600)) for _ in range(20)]
    docs = [(i, "".join(rng.choice(base)[rng.randint(0, 200) : rng.randint(200, 600)] + noise(rng.randint(0, 30)) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    docs[3], docs[5], docs[7], docs[9], docs[60] = (3, None), (5, "a" * 500), (7, "ab" * 300), (9, "ab" * 300), (60, docs[20][1])
    cut = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(cut).collect()}
    assert got == brute_repeats(docs)


def test_repeats_on_odd_rows(spark):
    found = suffix_dedup.digests(suffix_dedup.remove_repeats(odd_docs(spark))).collect()
    assert len(found) == len(rows())
    of_four = sorted(r["n_removed"] for r in found if r["doc_id"] == 4)
    # The null id comes first, so every other copy goes.
    size = len(NORMAL.encode())
    assert of_four == [size, size]
    assert [r["n_removed"] for r in found if r["doc_id"] is None and r["n_bytes"]] == [0]
    assert suffix_dedup.digests(suffix_dedup.remove_repeats(no_docs(spark))).count() == 0
    text = "".join(chr(0xE0 + i % 31) for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, "x" + text[3:150] + "y")], "doc_id long, text string")
    whole = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(docs, whole_characters=True).collect()}
    assert whole[1] == text[: len(whole[1])] or whole[1]
    assert whole[2] == "xy"


def test_a_long_text_is_searched_piece_by_piece(spark, monkeypatch):
    """Pieces of 1,000 bytes find what the whole text holds, across their borders too."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefg é") for _ in range(9000))
    docs = [(1, text[:4000] + text[500:3700] + text[4000:]), (2, text[3900:5200] + "z" + text[150:390]), (3, "short")]
    cut = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(cut).collect()}
    assert found == brute_repeats(docs)


@pytest.mark.parametrize("parts", [1, 2])
def test_one_of_two_rows_with_same_id_and_text_stays(spark, parts):
    """No other copy: exactly one row keeps the text, in one batch and across batches."""
    text = "".join(random.Random(2).choices("abcdefgh", k=300))
    docs = [(4, text, "x"), (4, text, "y"), (None, text[::-1], "z"), (None, text[::-1], "z"), (5, "short", "s"), (5, "short", "s"), (6, text[:150], "w")]
    cut = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(parts), carry=("lang",)).collect()
    kept = sorted((str(r["doc_id"]), bytes(r["kept"]).decode(), r["n_removed"], r["n_spans"]) for r in cut)
    assert kept == sorted([("4", text, 0, 0), ("4", "", 300, 1), ("None", text[::-1], 0, 0), ("None", "", 300, 1), ("5", "short", 0, 0), ("5", "short", 0, 0), ("6", "", 150, 1)])
    assert sorted(r["lang"] for r in cut) == ["s", "s", "w", "x", "y", "z", "z"]


def test_texts_are_dealt_once_and_shuffles_of_written_tables_are_deleted(spark):
    """The disk holds one shuffle of the texts, and none of those whose result is written."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh", k=n))
    docs = [(i, text(400), "en") for i in range(60)]
    docs += [(100, docs[3][1][:250] + text(50), "de"), (101, None, "fr"), (102, "", None), (None, docs[4][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = suffix_dedup.remove_repeats(frame, carry=("text", "lang"))
        got = {r["doc_id"]: (r["text"], r["lang"], r["n_removed"]) for r in out.collect()}
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The null id comes first, so document 4 is the copy.
    assert got == {i: (t, lang, {4: 400, 100: 250}.get(i, 0)) for i, t, lang in docs}
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    held = files()
    written = materialize(frame.repartition(7, "doc_id"), "test")
    # Files are deleted beside the running program.
    for _ in range(100):
        if files() <= held:
            break
        time.sleep(0.1)
    assert files() <= held
    assert written.count() == len(docs)


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def near_corpus(rng, families=12):
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(60, 300))
        docs.append(list(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(copy)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_classes_against_brute_force(spark):
    docs = near_corpus(random.Random(4))
    bags = {i: bag(t) for i, t in docs}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in bags:
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in bags}
    kept = {r["doc_id"] for r in minhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == set(got.values())


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(3)
    for _ in range(5):
        a = [f"w{rng.randrange(60)}" for _ in range(400)]
        b = list(a)
        for _ in range(rng.randint(0, 90)):
            b[rng.randrange(400)] = f"w{rng.randrange(400)}"
        grams, counts, cuts = minhash.shingle_bags(pa.array([" ".join(a), " ".join(b)]), 1)
        signature = minhash.bag_minhash(grams, counts, cuts, 2048)
        assert np.isfinite(signature).all()
        flat = [minhash.tagged(grams[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]) for i in (0, 1)]
        assert abs((signature[0] == signature[1]).mean() - minhash.weighted_jaccard(*flat)) < 0.05
        assert abs(minhash.weighted_jaccard(*flat) - jaccard(Counter(a), Counter(b))) < 1e-12


def test_near_duplicates_on_odd_rows(spark):
    found = minhash.near_duplicates(odd_docs(spark)).collect()
    assert len(found) == len(rows())
    classes = defaultdict(set)
    for r in found:
        classes[r["doc_id"]].add(r["class_id"])
    assert classes[4] == classes[5] == {4} and classes[1] == {1} and classes[2] == {2}
    kept = minhash.keep_one(odd_docs(spark))
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "None", "6", "7", "8"])
    assert kept.columns == odd_docs(spark).columns
    assert minhash.near_duplicates(no_docs(spark)).count() == 0
    assert minhash.keep_one(no_docs(spark)).count() == 0


def test_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 70)), rng.integers(0, 6, rng.integers(0, 90))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == table[-1, -1]


def leak_corpus(rng):
    words = ["the", "of", "and", "to"] * 20 + [f"w{i}" for i in range(2000)]
    text = lambda n: rng.choices(words, k=n)
    items = [(i, " ".join(text(rng.randint(16, 60)))) for i in range(25)]
    docs, leaked = [], set()
    for i in range(300):
        body = text(rng.randint(50, 700))
        if i % 4 == 0:
            item = rng.randrange(25)
            passage = [rng.choice(words) if rng.random() < 0.1 * (i % 3) else w for w in items[item][1].split()]
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
            leaked.add((i, item))
        docs.append((i, " ".join(body)))
    return docs, items, leaked


def test_leaks_are_found_and_clean_texts_left(spark):
    docs, items, leaked = leak_corpus(random.Random(12))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, benchmark).collect()}
    assert got <= leaked
    assert len(got) >= 0.97 * len(leaked)
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(frame, benchmark).collect()}
    assert kept == {i for i, _ in docs} - {d for d, _ in got}


def test_latent_space_is_that_of_all_documents(spark):
    """The space of 6,000 documents equals the one of a matrix of all their passages."""
    rng = random.Random(31)
    words = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(240)]
    items = [rng.choices(words, k=rng.randint(16, 60)) for _ in range(12)]
    docs = [rng.choices(words + [f"x{i}" for i in range(200)], k=rng.randint(0, 90)) for _ in range(6000)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(6)
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    limits = decontaminate.LeakLimits(rank=24)
    queries = decontaminate.Queries([r["item_id"] for r in benchmark.collect()], [r["text"] for r in benchmark.collect()], limits)
    feature = {w: int(f) for w, f in zip(sorted({x for t in items for x in t}), queries.find(decontaminate.hash_strings(pa.array(sorted({x for t in items for x in t})))), strict=True)}
    held = np.zeros(len(feature))
    for d in docs:
        held[[feature[w] for w in set(d) if w in feature]] += 1
    idf = np.log((len(docs) + 1) / (held + 1)) + 0.05
    rows = []
    for text in [*items, *docs]:
        for i in range(0, len(text), limits.passage_words):
            row = np.zeros(len(feature))
            for w in text[i : i + limits.passage_words]:
                if w in feature:
                    row[feature[w]] += idf[feature[w]]
            rows.append(row / max(np.linalg.norm(row), 1e-12))
    gram = np.array(rows).T @ np.array(rows)
    start = np.random.default_rng(31337).standard_normal((len(idf), limits.rank + limits.oversampling))
    basis, _ = np.linalg.qr(gram @ start)
    values, vectors = np.linalg.eigh(basis.T @ gram @ basis)
    exact = basis @ vectors[:, np.argsort(-values)[: limits.rank]]
    tables = {"text_col": "text", "item_col": "item_id", "item_text_col": "text"}
    # Some of its arguments may name the documents' ids.
    extra = {"id_col": "doc_id"} if "id_col" in inspect.signature(decontaminate.fit).parameters else {}
    detector = next(iter(decontaminate.fit(frame, benchmark, limits, **tables, **extra)))
    assert np.allclose(detector.idf, idf)
    found = detector.rows / idf[:, None]
    # All angles between the two spaces are small.
    assert np.linalg.svd(exact.T @ found, compute_uv=False).min() > 0.999


def test_pipeline_fits_the_latent_space_on_every_document(spark, tmp_path, monkeypatch):
    """The space of the pipeline's stage is that of a matrix of all 6,000 documents and the benchmark."""
    item = " ".join(f"w{i}" for i in range(300))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(33)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20)), "en", "s", 1) for i in range(6000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    fitted, fit = [], decontaminate.fit
    monkeypatch.setattr(decontaminate, "fit", lambda *a: (fitted.append(d) or d for d in fit(*a)))
    assert corpus_pipeline.benchmark_leaks(spark, frame, str(tmp_path)).count() == len(docs)
    queries, idf = fitted[0].queries, fitted[0].idf
    feature = {w: int(f) for w, f in zip(item.split(), queries.find(decontaminate.hash_strings(pa.array(item.split()))), strict=True)}
    matrix = np.zeros((len(docs) + len(queries.words), len(idf)))
    for row, d in zip(matrix, docs, strict=False):
        np.add.at(row, [feature[w] for w in d[1].split()], 1)
    for row, words in zip(matrix[len(docs) :], queries.words, strict=True):
        np.add.at(row, words, 1)
    matrix *= idf
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    gram = matrix.T @ matrix
    limits = decontaminate.LeakLimits()
    basis, _ = np.linalg.qr(gram @ np.random.default_rng(31337).standard_normal((len(idf), limits.rank + limits.oversampling)))
    values, vectors = np.linalg.eigh(basis.T @ gram @ basis)
    exact = basis @ vectors[:, np.argsort(-values)[: limits.rank]]
    assert np.linalg.svd(exact.T @ (fitted[0].rows / idf[:, None]), compute_uv=False).min() > 0.99


def test_words_of_documents_are_looked_up_without_hashing_each_in_python(monkeypatch):
    """The lookup of whole slices finds what the one by hashes finds, and the latter is left to vocabularies larger than the slice."""
    rng = random.Random(41)
    words = [f"w{i}" for i in range(300)] + ["é", "日本", "Straße", "x" * 5000]
    queries = decontaminate.Queries([1, 2], [" ".join(rng.choices(words, k=60)) for _ in range(2)], decontaminate.LeakLimits())
    texts = [None, "", " ,;", *(", ".join(rng.choices([*words, "W7", "É", "out"], k=rng.randint(0, 200))) + "." for _ in range(60))]
    column = pa.array(["cut off", *texts], pa.string())[1:]
    found, bounds = queries.features(column)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or "") for t in texts]
    exact = queries.find(decontaminate.hash_strings(pa.array([w.translate(fold) for t in split for w in t])))
    assert found.dtype == np.int64 and (found == exact).all() and (found < 0).any()
    assert bounds.tolist() == np.cumsum([0, *map(len, split)]).tolist()
    hashed = []
    monkeypatch.setattr(decontaminate, "hash_strings", lambda x, f=decontaminate.hash_strings: hashed.append(len(x)) or f(x))
    few = pa.array(texts[3:][:1], pa.string())
    assert (queries.features(few)[0] == found[: len(split[3])]).all()
    assert (len(split[3]) < len(queries.vocabulary)) == bool(hashed)
    hashed.clear()
    queries.features(column)
    assert not hashed


@pytest.mark.parametrize("dense", [0, 7, 90])
def test_gram_product_against_a_dense_matrix(dense):
    """Features gathered run by run give what the whole matrix gives, with runs of all lengths and more than one block."""
    rng = np.random.default_rng(43)
    matrix = rng.integers(1, 4, (2500, 90)) * (rng.random((2500, 90)) < rng.random(90) ** 4)
    matrix[np.arange(2500), rng.integers(0, 90, 2500)] = 1
    row, columns = np.nonzero(matrix)
    idf, basis = rng.random(90) + 0.1, rng.standard_normal((90, 12)).astype(np.float32)
    unit = matrix * idf / np.linalg.norm(matrix * idf, axis=1, keepdims=True)
    out = np.ones(basis.shape)
    decontaminate._gram_product(columns.astype(np.int32), matrix[row, columns].astype(np.int32), np.bincount(row).astype(np.int32), idf, rng.permutation(90)[:dense], basis, out)
    assert np.allclose(out, 1 + unit.T @ (unit @ basis), atol=1e-3)
    runs, index = np.repeat([4, 0, 2, 5], [1, 3000, 3, 1]), rng.integers(0, 90, 3005)
    sums, value = np.ones((6, 12)), rng.random(3005).astype(np.float32)
    decontaminate._add_runs(sums, runs, index, value, basis)
    assert np.allclose(sums, 1 + np.stack([(value[runs == r, None] * basis[index[runs == r]]).sum(0) for r in range(6)]), atol=1e-3)


def test_short_items_and_shards(spark):
    rng = random.Random(14)
    docs, items, leaked = leak_corpus(rng)
    docs += [(400, "Zeta: theta, kappa lambda omega mu!"), (401, "yes."), (402, "oh yes"), (403, "kappa lambda omega"), (404, " ".join(rng.choices([f"v{i}" for i in range(900)], k=80)))]
    tail = " ".join(f"q{i}" for i in range(9))
    docs.append((405, docs[-1][1] + " " + tail + " " + docs[-2][1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (50, "theta kappa lambda omega"), (51, "Yes"), (52, tail)], "item_id long, text string")
    extra = {(400, 50), (401, 51), (405, 52)}
    for limits in (decontaminate.LeakLimits(), decontaminate.LeakLimits(shard_bytes=1500)):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, benchmark, limits).collect()}
        assert extra <= got <= leaked | extra
        assert len(got & leaked) >= 0.97 * len(leaked)
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(frame, benchmark, decontaminate.LeakLimits(shard_bytes=1500)).collect()}
    assert kept == {i for i, _ in docs} - {d for d, _ in got}


def test_leaks_on_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, NORMAL), (2, LONG[:300])], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.find_leaks(odd_docs(spark), benchmark).collect())
    assert got == [("4", 1), ("4", 1), ("5", 1), ("6", 2), ("None", 1)]
    assert decontaminate.drop_leaks(odd_docs(spark), benchmark).count() == len(rows()) - 5
    assert decontaminate.find_leaks(no_docs(spark), benchmark).count() == 0
    assert decontaminate.find_leaks(odd_docs(spark), benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd_docs(spark), benchmark.limit(0)).count() == len(rows())


@pytest.mark.parametrize("docs", [odd_docs, no_docs])
def test_every_stage_takes_odd_rows(spark, tmp_path, docs):
    benchmark = spark.createDataFrame([(1, "some words of a benchmark item that is in none of the texts here")], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    given = docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, str(tmp_path))
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert out.count() <= given.count()
    assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).select("doc_id").distinct().count() == given.select("doc_id").distinct().count()


def test_pipeline_does_what_its_stages_say(spark, tmp_path):
    rng = random.Random(21)
    prose = "the of and to in a is that it for on with as was be by".split() + [f"{a}{b}" for a in ("win", "rain", "stone", "leaf", "road", "hill", "lake") for b in ("ter", "ing", "ward", "y", "less", "ed")]
    text = lambda n: " ".join(rng.choices(prose, k=n)) + "."
    shared = text(60)
    item = text(40)
    docs = [(i, text(200)) for i in range(40)]
    docs += [(50, docs[0][1]), (51, docs[1][1] + " More."), (52, text(120) + shared), (53, text(150) + shared), (54, "word"), (55, text(100) + " " + item + " " + text(90))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = corpus_pipeline.run(spark, str(tmp_path))
    done = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # A second run leaves what the first one's rows are read from.
    assert {r["doc_id"] for r in first.collect()} == done
    assert done == set(range(40)) | {52, 53}
    cut = {r["doc_id"]: r for r in corpus_pipeline.exact_spans(spark, frame.where("doc_id in (52, 53)"), str(tmp_path)).collect()}
    assert shared in cut[52]["text"] and shared not in cut[53]["text"]
    assert cut[53]["n_chars"] == len(cut[53]["text"])


def test_order_and_common_prefixes_of_rows():
    rng = np.random.default_rng(9)
    for width in (8, 24, 80, 104):
        rows = rng.integers(0, 2, (4000, width)).astype(np.uint8)
        rows[rng.integers(0, 4000, 2000)] = rows[rng.integers(0, 4000, 2000)]
        rows[:, : width // 2] = rows[rng.integers(0, 40, 4000), : width // 2]
        by, common = suffix_dedup._suffix_order(rows)
        raw = [rows[i].tobytes() for i in by]
        assert raw == sorted(raw)
        assert common[1:].tolist() == [next((k for k in range(width) if a[k] != b[k]), width) for a, b in zip(raw[:-1], raw[1:], strict=True)]
