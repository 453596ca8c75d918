"""Documents with everything that may go wrong, and none at all."""

from __future__ import annotations

LONG = "alpha beta gamma delta " * 12_000
NEAR = " ".join(f"w{i}" for i in range(300))
ODD = [
    (1, "One short line. You idiot!\nOne short line.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (None, "a text without an id", "fr", "b"),
    (None, None, None, None),
    (4, "   \t\n ", "de", "b"),
    (5, LONG, "en", "a"),
    (6, NEAR, "en", "a"),
    (7, NEAR.replace("w150 ", "W150  "), "en", "b"),
    (8, NEAR.replace("w150 ", "x150 "), "en", None),
    (9, "tie tie tie tie tie tie tie tie", "es", "a"),
    (9, "tie tie tie tie tie tie tie tie", "es", "a"),
    (10, "tie tie tie tie tie tie tie tie", "es", "a"),
    (11, "日本語 text ▁ with <|endoftext|> é é \U0001f389 \x00 end", "xx", "ü"),
    (12, "x" * 5_000, "en", "a"),
]
# Names that operators use for their own columns.
CLASHING = (
    "size score predicted held_out ids n_ids n_tokens shard slot copies taken target sketch key "
    "pivots failures kept start label __row"
).split()
SCHEMA = "doc_id bigint, text string, lang string, source string"


def odd_documents(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.selectExpr("*", *[f"'{name}' AS {name}" for name in CLASHING]).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    """Rows with a doc_id of their own, by doc_id."""
    found = [row for row in rows.collect() if row.doc_id is not None and row.doc_id != 9]
    return {row.doc_id: row for row in found}
