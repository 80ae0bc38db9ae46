"""Counts of the writing job against counts of a second pass."""

import time

from pyspark.sql import functions as F

from corpuslens.sources import observed as O
from corpuslens.sources.store import work_dir


def test_outcomes_of_a_write(spark):
    df = spark.range(1000).withColumn("outcome", F.when(F.col("id") % 4 == 0, "new").when(F.col("id") % 4 == 1, "kept")
                                      .when(F.col("id") % 4 == 2, "odd")).repartition(5)
    table, counts = O.write_observed(df, "outcomes", O.outcome_counts("outcome", ["new", "kept", "error"]))
    assert counts == {"rows": 1000, "new": 250, "kept": 250, "error": 0, "other": 500}
    assert table.count() == 1000
    table, counts = O.write_observed(df.limit(0), "outcomes", O.outcome_counts("outcome", ["new"]))
    assert (table.count(), counts) == (0, {"rows": 0, "new": 0, "other": 0})


def test_dimensions_of_a_write(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, 2.0, 3.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    _, counts = O.write_observed(df, "vectors", O.dimension_counts("v", 2))
    assert counts == {"rows": 5, "missing": 1, "mismatched": 2, "shortest": 0, "longest": 3}
    _, counts = O.write_observed(df.filter("v IS NULL"), "vectors", O.dimension_counts("v", 2))
    assert counts == {"rows": 1, "missing": 1, "mismatched": 0, "shortest": None, "longest": None}


def test_batches_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).withColumn("outcome", F.when(F.col("id") % 2 == 0, "new").otherwise("kept")) \
            .coalesce(1).write.mode("append").parquet(source)
    seen: dict = {}
    listener = O.BatchCounts("scan", seen.__setitem__)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long, outcome string").option("maxFilesPerTrigger", 1).parquet(source)
        watched = O.observe_stream(stream, "scan", O.outcome_counts("outcome", ["new", "kept"]))
        (watched.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", f"{work_dir(spark)}/observed-checkpoint").trigger(availableNow=True).start().awaitTermination())
        for _ in range(100):
            if len(seen) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [seen[i] for i in range(3)] == [{"rows": 10, "new": 5, "kept": 5, "other": 0}] * 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
