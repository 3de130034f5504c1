"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histograms over character classes and over common words are compared with the
reference of its language, the sums over all documents of that language, by Jensen-Shannon
distance. The common words of a language are those that make up at least ``common_share`` of all its
words, whatever the language. Documents shorter than the guards are not judged by a histogram, and
the limit of the word distance is wider for short ones by what chance alone gives.

Defined cases: a null text has no words and fails the base rules; a null language, or one
with too few words for a reference, is held against the reference of all documents;
repeated rows are judged alike, one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.scratch import materialize

# Separators besides the blank, symbols and the base limits of the rules.
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Character classes that are counted by themselves, then letters and other characters beyond ASCII;
# what remains of the words is one more class, and the separators are another.
CLASSES = ("A-Z", "0-9", r""".,;:!?'"()\-""", SYMBOLS)
N_CLASSES = len(CLASSES) + 4


@dataclass(frozen=True)
class QualityLimits:
    min_words: int = 10
    repeat_percent: int = 20
    #: Guards: shorter documents aren't held against a histogram.
    guard_chars: int = 100
    guard_words: int = 60
    #: Jensen-Shannon distances (0 to 1) from which a document is rejected.
    char_distance: float = 0.24
    word_distance: float = 0.22
    #: How many times the squared distance that chance gives a text of its length is added to the squared limit.
    chance: float = 1.25
    #: Words that a language needs for a reference of its own.
    reference_words: int = 5000
    #: Share of a language's words that makes a word common; 1 / common_share words at most.
    common_share: float = 0.005
    #: Longer words (in bytes) are never common.
    common_bytes: int = 16


def _words(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def common_words(docs: DataFrame, limits: QualityLimits, text_col: str = "text", lang_col: str = "lang", tag: str = "") -> tuple[DataFrame, DataFrame]:
    """lang, commons, ref_words (their counts and that of all other words), longest (bytes) by language, and the same of all documents (one row, names led by all_)."""
    words = docs.select(F.col(lang_col).alias("lang"), F.explode(_words(F.lower(text_col))).alias("word"))
    fits = (F.octet_length("word") <= limits.common_bytes) & ~F.contains("word", F.lit("|"))
    counted = words.withColumn("word", F.when(fits, F.col("word"))).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counted = materialize(counted, "common-words", tag)

    def lists(counts: DataFrame, by: list[str]) -> DataFrame:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("total")).where(F.col("total") >= limits.reference_words if by else F.lit(True))
        # At most 1 / common_share of them for each language.
        often = counts.where("word is not null").join(_sent(materialize(totals, "language-totals", tag)), by) if by else counts.where("word is not null").crossJoin(F.broadcast(totals))
        often = often.where(F.col("n") >= F.col("total") * limits.common_share)
        ordered = F.sort_array(F.collect_list(F.struct("n", "word")), asc=False)
        found = often.groupBy(*by).agg(ordered.alias("c"), F.first("total").alias("total"))
        others = F.col("total") - F.aggregate("c.n", F.lit(0).cast("long"), lambda a, x: a + x)
        longest = F.array_max(F.transform("c.word", lambda w: F.octet_length(w)))
        return found.select(*by, F.col("c.word").alias("commons"), F.concat(F.col("c.n"), F.array(others)).alias("ref_words"), longest.alias("longest"))

    by_lang = materialize(lists(counted.where("lang is not null"), ["lang"]), "language-words", tag)
    overall = lists(counted.groupBy("word").agg(F.sum("n").alias("n")), [])
    empty = F.array().cast
    overall = overall.agg(F.first("commons").alias("commons"), F.first("ref_words").alias("words"), F.first("longest").alias("longest"))
    overall = overall.select(F.coalesce("commons", empty("array<string>")).alias("all_commons"), F.coalesce("words", F.array(F.lit(0).cast("long"))).alias("all_words"), F.coalesce("longest", F.lit(0)).alias("all_longest"))
    return by_lang, materialize(overall, "all-words", tag)


def features(docs: DataFrame, limits: QualityLimits = QualityLimits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = (), tag: str = "") -> DataFrame:
    """Base counts and histograms of each row: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, commons, ref_words."""
    by_lang, overall = common_words(docs, limits, text_col, lang_col, tag)
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *kept)
    # One row: its size is a constant.
    df = df.join(_sent(by_lang), "lang", "left").crossJoin(F.broadcast(overall))
    df = df.withColumn("longest", F.coalesce("longest", "all_longest"))
    df = df.withColumn("ref_words", F.coalesce("ref_words", "all_words")).withColumn("common", F.coalesce("commons", "all_commons"))
    text = F.col("text")
    df = df.withColumn("words", _words(text))
    df = df.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    # Short words between bars: every count of a common word is then a plain text search.
    short = F.filter("words", lambda w: F.octet_length(w) <= F.col("longest"))
    df = df.withColumn("barred", F.concat(F.lit("|"), F.lower(F.array_join(short, "||")), F.lit("|")))
    word_chars = F.length(F.array_join("words", "")).cast("long")
    df = df.withColumn("beyond", F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    of_class = [F.length(F.regexp_replace(text, f"[^{c}]+", "")).cast("long") for c in CLASSES]
    letters = F.length(F.regexp_replace("beyond", r"\P{L}+", "")).cast("long")
    df = df.withColumn("word_chars", word_chars).withColumn("classes", F.array(*of_class, letters, F.length("beyond") - letters))
    rest = F.greatest(F.lit(0).cast("long"), F.col("word_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x))
    spaces = F.length(text) - F.col("word_chars")
    # 64-bit keys of the 5-word windows, by pairs of shorter windows; equal windows have equal keys.
    beyond_all = F.greatest(F.size("words"), F.lit(1))
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("two", F.zip_with("words", F.slice("words", 2, beyond_all), pair))
    df = df.withColumn("four", F.zip_with("two", F.slice("two", 3, beyond_all), pair))
    # zip_with pads the shorter side with nulls: the last four windows run past the text.
    full = F.slice(F.zip_with("four", F.slice("words", 5, beyond_all), pair), F.lit(1), F.greatest(F.lit(0), F.size("words") - 4))
    df = df.withColumn("keys", full)
    ranked = F.array_sort(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    df = df.withColumn("ranked", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), ranked))
    twice = F.filter("ranked", lambda x, j: (x["k"] == F.get("ranked", j - 1)["k"]) | (x["k"] == F.get("ranked", j + 1)["k"]))
    df = df.withColumn("starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")))["n"]
    each = F.transform("common", lambda w: F.floor((F.octet_length("barred") - F.octet_length(F.replace(F.col("barred"), F.concat(F.lit("|"), w, F.lit("|")), F.lit("")))) / (F.octet_length(w) + 2)))
    df = df.withColumn("counts", each)
    others = F.col("n_words") - F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        F.col("classes")[3].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.concat("classes", F.array(rest, spaces.cast("long"))).alias("chars"),
        F.concat("counts", F.array(others)).alias("commons"),
        "ref_words",
        *(f"carry_{i}" for i in range(len(carry))),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("double"), lambda a, v: a + v)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def term(a: Column, b: Column) -> Column:
        return part(a, (a + b) / 2) + part(b, (a + b) / 2)

    normal = lambda x: F.transform(x, lambda v: v / total(x))
    divergence = F.aggregate(F.zip_with(normal(p), normal(q), term), F.lit(0.0), lambda a, v: a + v) / 2
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


#: Languages whose rows are broadcast; more go by a shuffle join.
SENT = 10_000


def _sent(by_lang: DataFrame) -> DataFrame:
    """The written rows of languages, of some hundred bytes each, for a broadcast if there are few: a shuffle by language has hot keys."""
    return F.broadcast(by_lang) if by_lang.count() <= SENT else by_lang


def references(feats: DataFrame, limits: QualityLimits) -> tuple[DataFrame, DataFrame]:
    """Summed character classes: by language (only those with words enough), and of all documents (one row)."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    chars = F.array(*(F.col(f"c{i}") for i in range(N_CLASSES)))
    by_lang = feats.where("lang is not null").groupBy("lang").agg(F.sum("n_words").alias("total"), *sums).where(F.col("total") >= limits.reference_words)
    return by_lang.select("lang", chars.alias("ref_chars")), feats.agg(*sums).select(chars.alias("all_chars"))


def judge(docs: DataFrame, limits: QualityLimits = QualityLimits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = (), tag: str = "") -> DataFrame:
    """Judge every row: the base counts, base_failed, char_distance, word_distance, kept, and the columns in ``carry``.

    The histograms of a pass over the texts are written to shared scratch, so the references and the
    verdicts read numbers, not texts.
    """
    feats = materialize(features(docs, limits, id_col, text_col, lang_col, carry, tag), "quality", tag)
    by_lang, overall = references(feats, limits)
    # One row: its size is a constant.
    by_lang = _sent(materialize(by_lang, "language-classes", tag))
    scored = feats.join(by_lang, "lang", "left").crossJoin(F.broadcast(overall))
    scored = scored.withColumn("char_distance", js_distance(F.col("chars"), F.coalesce("ref_chars", "all_chars")))
    scored = scored.withColumn("word_distance", js_distance(F.col("commons"), F.col("ref_words")))
    # A sample of n words lies bins / (8 n ln 2) from its source, squared and on average.
    by_chance = limits.chance * F.size("ref_words") / (8 * math.log(2) * F.col("n_words"))
    word_limit = F.sqrt(limits.word_distance**2 + by_chance)
    base_failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    far = ((F.col("word_chars") >= limits.guard_chars) & (F.col("char_distance") > limits.char_distance)) | ((F.col("n_words") >= limits.guard_words) & (F.col("word_distance") > word_limit))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        "char_distance",
        "word_distance",
        (~base_failed & ~F.coalesce(far, F.lit(False))).alias("kept"),
        *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)),
    )


#: The base counts and verdicts in DuckDB SQL, over the view ``documents``, with the limits above.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM docs),
base AS (
  SELECT r, doc_id, lang, text, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines
  FROM split
),
placed AS (SELECT r, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM base),
windows AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) AS c FROM windows WHERE w4 IS NOT NULL),
repeated AS (
  SELECT r, sum(least(5, coalesce(i - before, 5))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice WHERE c > 1) GROUP BY r
),
lowered AS (SELECT r, lang, unnest(list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS w FROM docs),
counted AS (SELECT lang, CASE WHEN strlen(w) <= 16 AND NOT contains(w, '|') THEN w END AS w, count(*) AS n FROM lowered GROUP BY ALL),
every AS (SELECT lang, w, n FROM counted WHERE lang IS NOT NULL UNION ALL SELECT NULL, w, sum(n) FROM counted GROUP BY w),
totals AS (SELECT lang, sum(n) AS total FROM every GROUP BY lang HAVING sum(n) >= 5000 OR lang IS NULL),
often AS (SELECT e.lang, e.w, e.n FROM every e JOIN totals t ON e.lang IS NOT DISTINCT FROM t.lang WHERE e.w IS NOT NULL AND e.n >= t.total * 0.005),
others AS (SELECT t.lang, t.total - coalesce(sum(o.n), 0) AS n, count(o.w) + 1 AS bins FROM totals t LEFT JOIN often o ON o.lang IS NOT DISTINCT FROM t.lang GROUP BY t.lang, t.total),
held AS (SELECT b.*, t.lang AS ref FROM base b LEFT JOIN totals t ON b.lang = t.lang),
own AS (SELECT h.r, o.w, count(*) AS c FROM lowered l JOIN held h ON l.r = h.r JOIN often o ON o.lang IS NOT DISTINCT FROM h.ref AND o.w = l.w GROUP BY h.r, o.w),
word_bins AS (
  SELECT h.r, coalesce(x.c, 0) AS c, o.n FROM held h JOIN often o ON o.lang IS NOT DISTINCT FROM h.ref LEFT JOIN own x ON x.r = h.r AND x.w = o.w
  UNION ALL
  SELECT h.r, h.n_words - coalesce((SELECT sum(c) FROM own WHERE own.r = h.r), 0), o.n FROM held h JOIN others o ON o.lang IS NOT DISTINCT FROM h.ref
),
classes AS (
  SELECT r, lang, n_words, word_chars, length(text) - word_chars AS c8, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS c1, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS c2,
    length(regexp_replace(text, '[^.,;:!?''"()\-]+', '', 'g')) AS c3, n_symbols AS c4, length(regexp_replace(regexp_replace(text, '[\x00-\x7F]+', '', 'g'), '\P{L}+', '', 'g')) AS c5,
    length(regexp_replace(text, '[\x00-\x7F]+', '', 'g')) AS beyond
  FROM base
),
full_classes AS (SELECT *, beyond - c5 AS c6, greatest(0, word_chars - c1 - c2 - c3 - c4 - beyond) AS c7 FROM classes),
char_each AS (SELECT r, lang, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k, unnest([c1, c2, c3, c4, c5, c6, c7, c8]) AS c FROM full_classes),
char_refs AS (
  SELECT lang, k, sum(c) AS n FROM char_each WHERE lang IN (SELECT lang FROM classes GROUP BY lang HAVING sum(n_words) >= 5000) GROUP BY lang, k
  UNION ALL SELECT NULL, k, sum(c) FROM char_each GROUP BY k
),
char_bins AS (SELECT e.r, e.c, f.n FROM char_each e LEFT JOIN (SELECT DISTINCT lang FROM char_refs WHERE lang IS NOT NULL) g ON e.lang = g.lang JOIN char_refs f ON f.k = e.k AND f.lang IS NOT DISTINCT FROM g.lang),
bins AS (SELECT r, 'w' AS kind, c, n FROM word_bins UNION ALL SELECT r, 'c', c, n FROM char_bins),
shares AS (SELECT r, kind, c / sum(c) OVER x AS p, n / sum(n) OVER x AS q FROM bins WINDOW x AS (PARTITION BY r, kind)),
distances AS (
  SELECT r, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d, count(*) AS bins
  FROM shares GROUP BY r, kind
),
judged AS (
  SELECT b.r, b.doc_id, b.n_words, b.word_chars, b.n_symbols, len(b.lines) - len(list_distinct(b.lines)) AS n_dup_lines, coalesce(t.n, 0)::BIGINT AS n_repeat_words,
    cd.d AS char_distance, wd.d AS word_distance, wd.bins AS bins
  FROM base b LEFT JOIN repeated t ON b.r = t.r LEFT JOIN distances cd ON cd.r = b.r AND cd.kind = 'c' LEFT JOIN distances wd ON wd.r = b.r AND wd.kind = 'w'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT coalesce(word_chars >= 100 AND char_distance > 0.24, false)
    AND NOT coalesce(n_words >= 60 AND word_distance > sqrt(0.22 * 0.22 + 1.25 * bins / (8 * ln(2) * greatest(n_words, 1))), false) AS kept
FROM judged
"""
