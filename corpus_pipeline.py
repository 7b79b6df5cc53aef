"""From documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windrow.llm import common, decontaminate, jaccard_join, packing, pii, quality

STAGES = [
    ("quality", quality.quality_stage),
    ("near_duplicates", jaccard_join.jaccard_stage),
    ("decontamination", decontaminate.decontamination_stage),
    ("pii", pii.pii_stage),
    ("packing", packing.packing_stage),
]

#: Model scores and token ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
