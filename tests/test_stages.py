"""Stages redo what has changed and nothing else."""

from pyspark.sql import functions as F

from tickweave.sources import stages


def test_only_changed_parts_are_redone(spark, tmp_path):
    source, store, asked = f"file://{tmp_path}/in", f"file://{tmp_path}/store", []
    rows = spark.createDataFrame([(k, i) for k in ("a", "b c", "7") for i in range(5)], "k string, v long")
    rows.write.partitionBy("k").parquet(source)

    def build(part):
        asked.append(sorted(r.k for r in part.select(F.col("k").cast("string").alias("k")).distinct().collect()))
        return part.groupBy("k").agg(F.sum("v").alias("s"))

    def run(version="1"):
        return {str(r.k): (r.s, r.run) for r in stages.staged(spark, store, "sums", version, source, "k", build).collect()}

    assert run() == {"a": (10, 1), "b c": (10, 1), "7": (10, 1)} and asked == [["7", "a", "b c"]]
    assert run() == {"a": (10, 1), "b c": (10, 1), "7": (10, 1)} and len(asked) == 1
    spark.createDataFrame([("b c", 100), ("new", 3)], "k string, v long").write.mode("append").partitionBy("k").parquet(source)
    assert run() == {"a": (10, 1), "b c": (110, 2), "7": (10, 1), "new": (3, 2)} and asked[1:] == [["b c", "new"]]
    assert run("2")["a"] == (10, 3) and asked[2:] == [["7", "a", "b c", "new"]]
    assert run("1")["a"] == (10, 1) and len(asked) == 3  # the parts of the other version are still there
    for f in (tmp_path / "in" / "k=a").iterdir():
        f.unlink()
    assert set(run()) == {"b c", "7", "new"} and len(asked) == 3


def test_an_attempt_without_commit_does_not_count(spark, tmp_path):
    source, store = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long").write.partitionBy("k").parquet(source)
    seen = []

    def broken(part):
        seen.append(1)
        return part.select("k", F.raise_error(F.lit("ended")).cast("long").alias("s"))

    try:
        stages.staged(spark, store, "sums", "1", source, "k", broken)
    except Exception as error:
        assert "ended" in str(error)
    assert seen and stages.staged(spark, store, "sums", "1", source, "k", lambda p: p.groupBy("k").agg(F.sum("v").alias("s"))).count() == 2
