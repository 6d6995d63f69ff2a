"""Awkward rows that every operator on documents must take, with extra columns whose names clash with its own."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, labels string, score double, fp string, row string, hash string, words string"
LONG = "lorem ipsum dolor sit amet " * 40_000


def rows():
    clash = (1, "x", 0.5, "f", "r", "h", "w")
    texts = [
        (1, "All rights reserved. Licensed under the MIT License."), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "one"), (6, "one two"), (7, "One two THREE"),
        (8, "a b c d e f g a b c d e h"), (9, "same text here for the pair of them all"), (10, "same text here for the pair of them all"), (11, LONG),
        (12, "line one\nline one\n\n \nline one\nÉtÉ straße 中文 🙂 İ"), (None, "no id at all"), (9, "same text here for the pair of them all"), (13, "### $$$ %%% &&& ||| <<< >>> ***"),
        (14, "cc by cc by 4.0 cc by"), (15, "a b c\u0085d\x1ce"), (None, None),
    ]
    sources = ["src0", "src0", None, "src1", "src10", "src2", "src0"]
    return [(i, t, None if k % 5 == 0 else "en", sources[k % len(sources)], None if t is None else len(t), *clash) for k, (i, t) in enumerate(texts)]


def docs(spark, parts=3):
    return spark.createDataFrame(rows(), DOCS).repartition(parts)


def none(spark):
    return spark.createDataFrame([], DOCS)
