from lexstrata.operators import annotations as notes
from pyspark.sql import functions as F


def test_ranks_survive_a_plan_that_is_run_again(spark):
    """Ties get the same places each time, in any number of tasks."""
    rows = spark.range(5000, numPartitions=7).select("id", (F.col("id") % 3).alias("k"))
    got = notes.ranked(rows, "k")
    first = {r.id: r["rank"] for r in got.collect()}
    assert sorted(first.values()) == list(range(1, 5001))
    assert [k for _, k in sorted((r, i % 3) for i, r in first.items())] == sorted(i % 3 for i in range(5000))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {r.id: r["rank"] for r in got.repartition(5).collect()} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "InMemoryTableScan" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_paths_in_the_order_of_a_locale(spark):
    names = ["Zebra", "apple", "Äpfel", "apfel", "zebra", None, "Apple", "é", "f", "e"]
    frame = spark.createDataFrame([(i, None if n is None else [n, "a"]) for i, n in enumerate(names)], "annotation_id long, paths array<string>")
    got = [r.paths[0] if r.paths else None for r in notes.by_first_path(frame).collect()]
    assert got == [None, "apfel", "Äpfel", "apple", "Apple", "e", "é", "f", "zebra", "Zebra"]
    plain = [r.paths[0] if r.paths else None for r in notes.by_first_path(frame, "UTF8_BINARY").collect()]
    assert plain == [None, "Apple", "Zebra", "apfel", "apple", "e", "f", "zebra", "Äpfel", "é"]
    assert [names[r.annotation_id] for r in notes.first_path_ranks(frame).orderBy("rank").collect()] == got
    assert notes.first_path_ranks(frame.limit(0)).count() == 0
