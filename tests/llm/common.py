"""Documents with every odd case: nulls, empty and very long texts, repeated rows, clashing extra columns."""

LONG = " ".join(f"word{i % 9173} tail{i % 37}," for i in range(30_000))
NORMAL = "The cat sat on the mat and looked at the bird in the tree, for it was a fine day to be out of the house and in the sun."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, start int, node long, words string, ids binary, digest binary, key long, found boolean, doc_ID2 long"


def rows():
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, NORMAL), (4, NORMAL), (5, NORMAL), (None, NORMAL), (None, None), (6, LONG), (7, "é ß 日本 <s> it's"), (8, "\x00odd\x0bbytes")]
    out = []
    for i, (doc, text) in enumerate(texts):
        out.append((doc, text, None if i % 3 == 0 else "en", None, None if text is None else len(text), 7, 1, 2, "w", b"x", None, 3, None, 9))
    return out


def odd_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
