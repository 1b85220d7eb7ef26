"""Projection, filter, dedup and row identity for review tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import normalize_text, whitespace_token_count

# Broadcasting an id table is only done below this many rows.
BROADCAST_ID_LIMIT = 100_000


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Fail at plan time when required columns are absent."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Found: {df.columns}")
    return df


def filter_courses(df: DataFrame, courses, course_col: str = "course_id") -> DataFrame:
    """Keep rows whose course is in ``courses``.

    ``courses`` is a Python collection (becomes an ``InSet`` literal pushed to
    the scan) or a one-column DataFrame of ids (semi join; broadcast only when
    its row count is checked to be small, else a shuffled semi join).
    """
    if isinstance(courses, DataFrame):
        ids = courses.select(F.col(courses.columns[0]).alias(course_col)).distinct()
        n = ids.limit(BROADCAST_ID_LIMIT + 1).count()
        if n <= BROADCAST_ID_LIMIT:
            ids = F.broadcast(ids)
        return df.join(ids, on=course_col, how="left_semi")
    return df.filter(F.col(course_col).isin(list(courses)))


def dedup_reviews(df: DataFrame, keys=("course_id", "review"), order_col: str = "review_id",
                  dedup: bool = True) -> DataFrame:
    """Unique rows on ``keys``, the first occurrence (smallest ``order_col``) kept.

    A grouped ``min_by`` is used (not a window): it aggregates partially on
    the map side, so a key holding a third of all rows is combined before the
    shuffle.  Grouping treats NULL keys as equal, like the reference.
    """
    if not dedup:
        return df
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_col)).alias("_first")
    # the hash comes first: groups are sorted by one number, and texts compared only where it is equal
    hashed = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)
    return hashed.agg(first).select(*keys, "_first.*").select(*df.columns)


def with_token_count(df: DataFrame, text_col: str = "review", out: str = "n_tokens") -> DataFrame:
    return df.withColumn(out, whitespace_token_count(text_col))


def review_stats(raw: DataFrame, deduped: DataFrame, text_col: str = "review") -> DataFrame:
    """Rows after filter, unique comments (rows after dedup) and whitespace tokens."""
    a = raw.agg(F.count(F.lit(1)).alias("rows_after_filter"))
    b = deduped.agg(F.count(F.lit(1)).alias("unique_comments"),
                    F.coalesce(F.sum(whitespace_token_count(text_col)), F.lit(0)).cast("long")
                    .alias("total_tokens"))
    return a.crossJoin(b)  # one row x one row


def assign_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Positional ids 0..n-1 in the DataFrame's current order.

    The DataFrame form of ``zipWithIndex``: count rows per partition (a table
    with one row per partition), prefix-sum those counts, and add each row's
    index inside its partition.  No row passes through Python and no window
    runs over the whole table; only the per-partition counts are summed on the
    driver and broadcast (their size is the partition count).
    """
    from gleaner.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    # Freeze the partition ids: the counts and the rows must see the same
    # partitioning, which two separate evaluations (AQE may coalesce
    # differently) do not guarantee.  A reliable checkpoint in the shared
    # folder also survives executor loss.
    tagged = (df.withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    ahead, before = [], 0
    for pid, n in sorted(tuple(r) for r in tagged.groupBy("_pid").count().collect()):
        ahead.append((pid, before))
        before += n
    offsets = df.sparkSession.createDataFrame(ahead, "_pid int, _off long")
    local_index = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out, (F.col("_off") + local_index).cast("long"))
                  .drop("_pid", "_mid", "_off"))


def drop_blank_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Strip text and drop rows whose text is empty or NULL."""
    return (df.withColumn(text_col, normalize_strip(text_col))
              .filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")))


def normalize_strip(col) -> F.Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    ws = r"^[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+|[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+$"
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, ws, "")


def drop_noise(df: DataFrame, label_col: str = "cluster_id") -> DataFrame:
    """Drop noise points (label -1); a plain filter, pushed to Parquet."""
    return df.filter(F.col(label_col) != -1)


def to_corpus(units: DataFrame, reviews: DataFrame | None = None, use_full_reviews: bool = False,
              unit_text: str = "unit", review_text: str = "review", label_col: str | None = "label",
              unit_order=("review_id", "unit_pos"), review_order=("review_id",)) -> DataFrame:
    """Corpus records ``(id, text, label)`` for topic generation.

    Ids are ``phrase_<i>`` / ``review_<i>`` numbered by position *before*
    blank texts are dropped (so ids have gaps), as in the reference.  The
    position is a stable key order, never an un-partitioned window.
    """
    if use_full_reviews:
        src, text, order, prefix = reviews, review_text, list(review_order), "review_"
    else:
        src, text, order, prefix = units, unit_text, list(unit_order), "phrase_"
    cols = [F.col(text).alias("text")]
    if label_col and label_col in src.columns:
        cols.append(F.col(label_col).alias("label"))
    else:
        cols.append(F.lit(None).cast("string").alias("label"))
    ordered = src.select(*order, *cols).orderBy(*order)
    numbered = assign_row_id(ordered, "pos")
    out = numbered.select(
        F.concat(F.lit(prefix), F.col("pos").cast("string")).alias("id"),
        normalize_strip("text").alias("text"), "label", "pos")
    return out.filter(F.col("text").isNotNull() & (F.col("text") != ""))
