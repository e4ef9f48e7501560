from pyspark.sql import functions as F

from fieldloom import EvalConfig, FieldConfig
from fieldloom.plans import typed
from fieldloom.streaming import evaluate_stream, to_files, windowed_scores

SF = "/root/testdata/sf0.001"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{SF}/orders.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    config = EvalConfig(fields={"price": FieldConfig(metrics=["numeric"])})
    pair = lambda df: df.select("o_orderkey", F.struct(F.col("o_totalprice").alias("price")).alias("expected"), F.struct((F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3 / 100)).alias("price")).alias("actual"))
    schema = spark.read.parquet(f"{SF}/orders.parquet").schema
    stream = pair(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    to_files(evaluate_stream(stream, config, sample_id="o_orderkey"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    want = typed.evaluate(pair(spark.read.parquet(f"{SF}/orders.parquet")), config, sample_id="o_orderkey")
    rows = lambda df: sorted((r.sample_id, r.score) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(want)


def test_windows_with_watermark(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_scores(stream, "ts", "value", "1 hour", "10 minutes").writeStream.format("memory").queryName("scores").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("scores").collect())) == sorted(map(tuple, windowed_scores(events, "ts", "value").collect()))
