"""Training-data pipeline over ``documents``: filter, deduplicate, mix, pack.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  ``run`` applies them in order; each result is
written as Parquet in the shared checkpoint folder and read again as the next
stage's ``docs``.
"""

from __future__ import annotations

from gleaner.llm import jaccard, mixing, packing, quality_rules, substring
from gleaner.llm.common import Stages, scratch


def quality(spark, docs, sf_dir):
    """Documents that the base rule and the risk-controlled rules keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, n=5, percent=80)


def repeated_passages(spark, docs, sf_dir):
    """Passages of 35 words or more that occur again are taken out of the texts."""
    return substring.remove_repeats(docs)


def mixture(spark, docs, sf_dir):
    """Sources at their target weights; repeated and shortened documents are rows of their own."""
    return mixing.mixed_rows(docs)


def packed(spark, docs, sf_dir):
    """Pieces of the mixture in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]

#: Tokenising cannot be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with scratch():  # an operator's own tables go once its result is stored
            docs = stages.put(name, stage(spark, docs, sf_dir))
        if i:
            stages.drop(STAGES[i - 1][0])
    return docs
