"""Running Arrow code over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwright.llm.texts import map_rows, utf8


def test_results_are_handed_on_by_slices(spark):
    def living():
        """A function that tells how many of its results are held."""
        held = [0]

        class Row(tuple):
            def __del__(self):
                held[0] -= 1

        def row(body: bytes) -> tuple:
            held[0] += 1
            return Row((held[0], len(body)))

        return row

    docs = spark.range(40).coalesce(1).select("id", F.expr("repeat('x', 200000)").alias("text"))
    rows = map_rows(docs, ["id"], utf8(docs["text"]), living, "held long, size long").collect()
    assert len(rows) == 40 and {r["size"] for r in rows} == {200_000}
    assert max(r["held"] for r in rows) <= 12


def test_a_text_among_the_keys(spark):
    docs = spark.createDataFrame([(1, "né\n"), (2, None), (3, "")], "id int, text string")
    rows = map_rows(docs, ["text", "id"], "text", lambda: lambda body: (body.hex(),), "hex string").collect()
    assert sorted(tuple(r) for r in rows if r["text"] is not None) == [("", 3, ""), ("né\n", 1, "6ec3a90a")]
    assert [tuple(r) for r in rows if r["text"] is None] == [(None, 2, "")]


def test_lists_and_empty_tables(spark):
    lists = spark.createDataFrame([(1, [5, 6]), (2, None)], "id int, ids array<int>")

    def make():
        return lambda x: (sum(x or ()),)

    assert {tuple(r) for r in map_rows(lists, ["id"], lists["ids"], make, "total long").collect()} == {(1, 11), (2, 0)}
    assert map_rows(lists.limit(0), ["id"], lists["ids"], make, "total long").collect() == []
