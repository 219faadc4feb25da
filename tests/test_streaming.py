from __future__ import annotations

from pyspark.sql import functions as F

from tempora.streaming import views


def test_views_equal_batch_over_several_batches(spark, tmp_path):
    src = f"{tmp_path}/log"
    made = spark.range(90).select(F.col("id").alias("seq"), F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").alias("value"))
    schema = made.schema
    last, count = views.latest_value(f"{tmp_path}/last"), views.counters(f"{tmp_path}/count")
    for part in range(3):
        made.filter(f"seq % 3 = {part}").write.mode("append").parquet(src)
        views.run(spark.readStream.schema(schema).parquet(src), [last, count], f"{tmp_path}/cp").awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(last.read(spark)) == key(made.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value")))
    want = key(made.groupBy("key", "kind").agg(F.count("*").alias("n")))
    assert key(count.read(spark)) == want
    count.compact(spark, 1)
    assert key(count.read(spark)) == want


def test_rerun_of_a_batch_replaces_its_part(spark, tmp_path):
    v = views.counters(f"{tmp_path}/v")
    b = spark.createDataFrame([("a", "x")], "key string, kind string")
    v.update(b, 0)
    v.update(b, 0)
    assert [r.n for r in v.read(spark).collect()] == [1]
