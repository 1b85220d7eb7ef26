"""Streaming runs of the stateless segmentation and the running topic counts."""

import uuid

from pyspark.sql import functions as F

from gleaner.operators import segment as SEG
from gleaner.streaming import units as SU

SF = "/root/testdata/sf0.001"


def test_stream_units_equal_batch(spark):
    docs = SU.read_documents_stream(spark, SF, glob="documents.parquet")
    name = "units_" + uuid.uuid4().hex[:8]
    q = SU.stream_units(docs).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql(f"SELECT review_id, unit_pos, unit FROM {name}")
    batch = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("review_id"), "text")
    exp = SEG.segment_units(batch, "text", "mintoken", 6, 3, keep=("review_id",))
    assert got.count() == exp.count()
    assert got.exceptAll(exp.select("review_id", "unit_pos", "unit")).count() == 0


def test_stream_topic_counts(spark):
    ev = (spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, "
                                  "props string").option("pathGlobFilter", "events.parquet").parquet(SF))
    resp = ev.select(F.col("event_id").alias("doc_pos"),
                     F.concat(F.lit("[1] "), F.initcap("event_type"), F.lit(": user "),
                              F.col("user_id").cast("string")).alias("response"))
    name = "topics_" + uuid.uuid4().hex[:8]
    q = SU.stream_topic_counts(resp).writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.key: r["count"] for r in spark.sql(f"SELECT * FROM {name}").collect()}
    exp = {r.k: r.n for r in spark.read.parquet(f"{SF}/events.parquet")
           .groupBy(F.lower("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == exp
