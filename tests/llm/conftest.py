"""Small messy tables, and what the operators should say of them."""

import pytest

PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards mix a potion of jade and amber "
         "under the pale light of a distant and nearly forgotten moon that nobody in the village has ever named")
# null and empty texts, ties, repeated rows, a null id, only spaces, marks only, copies, near copies, a long text
ROWS = [
    (1, PROSE), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, PROSE), (5, PROSE), (None, PROSE), (None, None),
    (6, PROSE.replace("jade", "gold")), (7, "!!! ### $$$ ???"), (8, "Été à l'œuvre — naïve ﬁ İstanbul  STRASSE ẞ 中文 नमस्ते é"),
    (9, "a b c d e"), (10, "a  b   c\r\n\r\nd\te f   g <|endoftext|> h<|startoftext|>"), (11, "x" * 3000 + " " + "y z " * 2000),
    (12, "one word"), (13, PROSE + " " + PROSE), (14, "mail bob.smith@example.co.uk or +1 (017) 555-7713, card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.25"),
    (15, "line one is here\nline one is here\nline two | a & b\n\nline one is here"), (16, "don't we'll I'm they've 12345 1st"),
]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="session")
def messy(spark):
    """With columns whose names the operators use themselves."""
    rows = [(d, t, "en", "s", 1, 0.5, [1], "x", 7) for d, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA + ", lang string, ids string, n_tokens int, score double, spans array<int>, "
                                              "kept string, row int").repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def pairs(df):
    """(doc_id, text) of a table, null texts as empty."""
    return [(r[0], r[1] or "") for r in df.select("doc_id", "text").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
