from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.streaming.enrich import counts, in_zones

SF = "/root/testdata/sf0.001"


def test_stream_and_batch_agree(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", (F.col("event_id") * 37 % 100).cast("double").alias("x"), (F.col("event_id") * 91 % 100).cast("double").alias("y"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    zones = spark.range(25).select(F.col("id").alias("fid"), G.box(F.col("id") % 5 * 20, F.floor(F.col("id") / 5) * 20, F.col("id") % 5 * 20 + 20, F.floor(F.col("id") / 5) * 20 + 20).alias("geom"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = in_zones(stream, zones, 20.0).writeStream.format("memory").queryName("zoned").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = in_zones(events, zones, 20.0)
    key = lambda df: sorted((r["event_id"], r["zone"]) for r in df.collect())
    assert key(spark.table("zoned")) == key(batch) and batch.count() == events.count()
    q = counts(in_zones(stream, zones, 20.0), late="36500 days").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()
