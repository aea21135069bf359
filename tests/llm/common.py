"""Small tables with the odd cases that every operator meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata/sf0.001"

PROSE = (
    "The river runs past the old mill and turns south before it meets the road. "
    "Farmers bring grain in autumn, and in spring the children come to look for frogs along the bank. "
    "Nobody remembers who built the bridge, but everyone has a story about the winter when it froze over "
    "and the whole village walked across to the other side without wetting a single boot in the water."
)

#: doc_id, text: null and empty texts, white space only, one word, ties, repeated rows, a null id, a very long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, PROSE),
    (6, PROSE),
    (7, PROSE.replace("frogs", "newts")),
    (8, "ünïcödé 東京 naïve space \U0001f600 end"),
    (9, " ".join(f"w{i % 97}x{i}" for i in range(60_000))),
    (10, "again " * 50),
    (11, "line one\nline one\nline two"),
    (None, PROSE + " Tail."),
    (12, "twice the same row"),
    (12, "twice the same row"),
]


def odd_documents(spark: SparkSession) -> DataFrame:
    """ODD with extra columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", "web", len(t or ""), "x", 1, "k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, row int, key string").repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return odd_documents(spark).filter("false")


def words(text: str | None) -> list[str]:
    return [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", text or "") if w]
