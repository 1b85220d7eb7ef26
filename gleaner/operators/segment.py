"""Phrase segmentation operators: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T


def add_units(df: DataFrame, text_col: str = "review", out: str = "units", mode: str = "mintoken",
              min_tokens: int = 5, drop_if_short: int = 3,
              stopwords: Sequence[str] | None = None) -> DataFrame:
    """Grouped units: one row per review with an ``ARRAY<STRING>`` of units.

    ``mode='base'`` splits on stopwords only; ``mode='mintoken'`` also merges
    short fragments.  Empty lists are kept (``group_units``).
    """
    if mode == "base":
        expr = T.segment_base(text_col, stopwords)
    elif mode == "mintoken":
        expr = T.segment_mintoken(text_col, min_tokens, drop_if_short, stopwords)
    else:
        raise ValueError(f"unknown segmentation mode {mode!r}")
    return df.withColumn(out, expr)


group_units = add_units


def explode_units(grouped: DataFrame, units_col: str = "units", keep=("review_id", "course_id", "label"),
                  unit_col: str = "unit", pos_col: str = "unit_pos") -> DataFrame:
    """Flat unit rows keyed by ``(review_id, unit_pos)`` with review metadata."""
    keep = [c for c in keep if c in grouped.columns]
    return grouped.select(*keep, F.posexplode(units_col).alias(pos_col, unit_col))


def segment_units(df: DataFrame, text_col: str = "review", mode: str = "mintoken",
                  min_tokens: int = 5, drop_if_short: int = 3,
                  keep=("review_id", "course_id", "label"),
                  stopwords: Sequence[str] | None = None) -> DataFrame:
    """Reviews -> flat units in one projection (segment + posexplode).

    The input is narrowed to the kept columns and the text *before* the
    generator, so exploded rows never carry the review text (or a struct
    holding it) along - that copy dominated the cost on long documents.
    """
    keep = [c for c in keep if c in df.columns and c != text_col]
    narrow = df.select(*keep, text_col)
    if mode == "base":
        expr = T.segment_base(text_col, stopwords)
    elif mode == "mintoken":
        expr = T.segment_mintoken(text_col, min_tokens, drop_if_short, stopwords)
    else:
        raise ValueError(f"unknown segmentation mode {mode!r}")
    return narrow.select(*keep, F.posexplode(expr).alias("unit_pos", "unit"))
