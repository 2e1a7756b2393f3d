"""Ordered tables: pages tile the order, and read only the parts that hold them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import layout


def test_pages_tile_the_order(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("rank_of_old")).repartition(13)
    table = layout.write_in_order(rows, [F.desc("v")], f"file://{tmp_path}/t", parts=7)
    want = sorted((r.v for r in rows.collect()), reverse=True)
    for first, end in ((0, 1), (0, 200), (700, 900), (4990, 5000), (4999, 6000)):
        got = layout.page(table, first, end).orderBy("rank").collect()
        assert [r.v for r in got] == want[first:end] and [r["rank"] for r in got] == list(range(first + 1, min(end, 5000) + 1))
    assert [r.v for r in layout.page(table, 100, 110, columns=5, margin=2).orderBy("rank").collect()] == want[90:120]
    assert layout.page(table, 3, 9, columns=5, margin=4).count() == 29 and layout.page(table, 5000, 5010).count() == 0
    assert {r.remaining for r in layout.more_rows(table, 4700, 200).collect()} == {100} and layout.total(table).first().total == 5000


def test_other_parts_are_not_opened(spark, tmp_path):
    table = layout.write_in_order(spark.range(8000), ["id"], f"file://{tmp_path}/t", parts=8)
    held = {r["__part"]: (r["__before"], r["__before"] + r["__n"]) for r in table.parts.collect()}
    assert len(held) == 8
    first = held[3][0] + 5
    plan = layout.page(table, first, first + 20)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    for part in set(held) - {3}:
        for file in Path(f"{tmp_path}/t/rows/__part={part}").glob("*"):
            file.write_bytes(b"no Parquet")
    again = layout.opened(spark, f"file://{tmp_path}/t", spark.range(1).schema)
    assert sorted(r.id for r in layout.page(again, first, first + 20).collect()) == list(range(first, first + 20))


def test_empty_ties_and_nulls(spark, tmp_path):
    empty = layout.write_in_order(spark.range(0), ["id"], f"file://{tmp_path}/e")
    assert layout.page(empty, 0, 10).count() == 0 and layout.total(empty).first().total == 0
    ties = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, "b"), (2, None)], "v int, rank string")
    table = layout.write_in_order(ties.withColumnRenamed("rank", "name"), ["v"], f"file://{tmp_path}/n", parts=3)
    got = layout.page(table, 0, 9).orderBy("rank").collect()
    assert [(r.v, r.name) for r in got] == [(None, "a"), (1, "b"), (1, "b"), (1, "b"), (2, None)] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
