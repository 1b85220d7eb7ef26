"""The text operators on streaming DataFrames.

The reference has no stream; its per-review work is stateless, so the same
column expressions run unchanged on ``readStream`` input.  The one piece of
state - topics seen so far - becomes a streaming aggregate keyed by the
lower-cased topic name (update mode); early stop is a batch-only notion
(it needs the global mention order) and is not offered on streams.

Checkpoints of streaming queries go under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions import text as T
from gleaner.operators import topics as TP
from gleaner.session import checkpoint_dir

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents_stream(spark: SparkSession, folder: str, schema: str = DOCUMENT_SCHEMA,
                          max_files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(folder)


def stream_units(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_tokens: int = 6,
                 drop_if_short: int = 3) -> DataFrame:
    """Streaming phrase units ``(review_id, course_id, unit_pos, unit)``."""
    return docs.select(F.col(id_col).alias("review_id"), F.col("source").alias("course_id"),
                       F.posexplode(T.segment_mintoken(text_col, min_tokens, drop_if_short))
                       .alias("unit_pos", "unit"))


def stream_topic_counts(responses: DataFrame, doc_col: str = "doc_pos", resp_col: str = "response") -> DataFrame:
    """Running topic table: count per lower-cased level-1 name and the
    first-seen (smallest doc position) casing and description."""
    parsed = TP.parse_topic_mentions(TP.explode_responses(responses, doc_col, resp_col))
    ok = parsed.filter(F.col("status") == "ok")
    return (ok.groupBy(F.lower("name").alias("key"))
              .agg(F.count(F.lit(1)).alias("count"),
                   F.min_by(F.struct("name", "desc"), F.struct(doc_col, "line_pos")).alias("_f"))
              .select("key", F.col("_f.name").alias("name"), "count", F.col("_f.desc").alias("desc")))


def start_parquet_sink(df: DataFrame, path: str, name: str, trigger_once: bool = True) -> StreamingQuery:
    """Append a stateless stream to Parquet with its checkpoint in the shared folder."""
    ckpt = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    w = df.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start(path)
