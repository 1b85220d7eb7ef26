"""Sources and sinks.

Explicit schemas everywhere (no inference); Parquet between stages; CSV,
JSON lines and text only at the edges.  Writers never ``coalesce(1)`` large
tables; ``single_file=True`` is for final small tables only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from gleaner.operators.reviews import assign_row_id, require_columns

REVIEW_SCHEMA = Ty.StructType([
    Ty.StructField("CourseId", Ty.StringType()),
    Ty.StructField("Review", Ty.StringType()),
    Ty.StructField("Label", Ty.StringType()),
])

CORPUS_SCHEMA = Ty.StructType([
    Ty.StructField("id", Ty.StringType()),
    Ty.StructField("text", Ty.StringType()),
    Ty.StructField("label", Ty.StringType()),
])


def read_reviews(spark: SparkSession, path: str, schema: Ty.StructType = REVIEW_SCHEMA) -> DataFrame:
    """Review CSV with a header and quoted multi-line text -> (course_id, review, label).

    Like the reference, ``NA``/``null`` stay text here (no NaN coercion)."""
    df = (spark.read.schema(schema)
               .option("header", True).option("multiLine", True).option("escape", '"')
               .option("enforceSchema", False).csv(path))
    require_columns(df, ["CourseId", "Review", "Label"])
    return df.select(F.col("CourseId").alias("course_id"), F.col("Review").alias("review"),
                     F.col("Label").alias("label"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False,
                partition_by=None, mode: str = "overwrite") -> None:
    """Write a result table.  ``single_file`` only for small final tables."""
    w = (df.coalesce(1) if single_file else df).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "text":
        w.text(path)
    else:
        w.parquet(path)


def write_vectors(df: DataFrame, path: str, partition_by=("model", "dim_label")) -> None:
    """Vectors keyed by id, partitioned by (model, dim) so readers prune files."""
    cols = [c for c in partition_by if c in df.columns]
    df.write.mode("overwrite").partitionBy(*cols).parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str | None = None,
                 dim_label: str | None = None) -> DataFrame:
    """Read vectors; filters on the partition columns prune directories."""
    df = spark.read.parquet(path)
    if model is not None:
        df = df.filter(F.col("model") == model)
    if dim_label is not None:
        df = df.filter(F.col("dim_label") == dim_label)
    return df


def write_corpus(corpus: DataFrame, path: str) -> None:
    """JSON lines ``{id, text, label?}``; NULL labels are omitted from records."""
    corpus.select("id", "text", F.col("label").cast("string").alias("label")) \
          .write.mode("overwrite").option("ignoreNullFields", True).json(path)


def read_corpus(spark: SparkSession, path: str, schema: Ty.StructType = CORPUS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with 1-based ``line_no`` in file order; files of a folder follow each other by name.

    Spark packs splits into partitions by size, so the order comes from each
    line's file, the start of its split and its place among the lines read.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    ordered = assign_row_id(lines.orderBy("_file", "_block", "_at"), "line_no")
    return ordered.select("line", (F.col("line_no") + 1).alias("line_no"))


def read_topic_lines(spark: SparkSession, path: str) -> DataFrame:
    from gleaner.operators.topics import parse_topic_lines
    return parse_topic_lines(read_lines(spark, path))


def write_topic_lines(lines: DataFrame, path: str, order_col: str = "path") -> None:
    """The topic file: one small final table, ordered, one file."""
    lines.orderBy(order_col).select("line").coalesce(1).write.mode("overwrite").text(path)


def write_topic_words(words: DataFrame, path: str, shape: str = "dict", setting_col: str = "setting",
                      topic_col: str = "topic") -> None:
    """Topic words as JSON, one document per setting (partition folder).

    ``shape='dict'``: ``{"1": [...], "2": [...]}`` (1-based keys by topic
    order); ``'list'``: ``[[...], ...]``; ``'topics'``:
    ``{"topics": [{"top_words": [...]}]}``.
    """
    per_topic = (words.groupBy(setting_col, topic_col)
                      .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))),
                                       lambda x: x["word"]).alias("ws")))
    per_setting = per_topic.groupBy(setting_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(topic_col).cast("string").alias("t"), "ws"))).alias("ts"))
    lists = F.transform("ts", lambda x: x["ws"])
    if shape == "dict":
        keys = F.transform("ts", lambda x, i: (i + 1).cast("string"))
        doc = F.to_json(F.map_from_arrays(keys, lists))
    elif shape == "list":
        doc = F.to_json(lists)
    elif shape == "topics":
        doc = F.to_json(F.struct(F.transform("ts", lambda x: F.struct(x["ws"].alias("top_words"))).alias("topics")))
    else:
        raise ValueError(f"unknown shape {shape!r}")
    per_setting.select(setting_col, doc.alias("value")).write.mode("overwrite") \
               .partitionBy(setting_col).text(path)


def read_topic_words(spark: SparkSession, path: str) -> DataFrame:
    """JSON topic-word files (any of the four shapes), one document per file ->
    ``(*partition columns, file, topic_id, rank, word)`` via VARIANT parsing."""
    from gleaner.operators.words import normalise_topic_words
    raw = spark.read.option("wholetext", True).text(path)
    keys = [c for c in raw.columns if c != "value"]
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    return normalise_topic_words(raw, "value", [*keys, "file"])
