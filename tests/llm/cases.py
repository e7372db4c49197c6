"""Tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, rank int, "
    "text_hash long, node long, label int, spans string, repeats int, kind int, part int, sequence_id long"
)
EXTRA = (True, 1.0, 1, 5, 7, 1, "s", 3, 2, 4, 9)


def table(spark, rows):
    """Rows ``(doc_id, text)`` as documents with further columns."""
    full = [(i, t, "en", "src0", None if t is None else len(t), *EXTRA) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed, vocabulary=400):
    pick = random.Random(seed)
    return [f"w{pick.randrange(vocabulary)}" for _ in range(n)]


def prose(n, seed, vocabulary=400):
    """Words in sentences of 3 to 12 words."""
    pick, out = random.Random(seed), []
    listed = words(n, seed, vocabulary)
    while listed:
        size = pick.randrange(3, 13)
        out.append(" ".join(listed[:size]).capitalize() + ".")
        del listed[:size]
    return " ".join(out)


def odd_rows():
    """Texts that every operator must take."""
    long = prose(20_000, 1, 3_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, prose(300, 5)), (5, prose(300, 5)), (6, prose(300, 5)),
        (7, long), (None, prose(120, 7)), (9, "x" * 50_000), (10, "é ü 漢字 😀 " * 40), (11, "a a a a " * 200),
    ]
