"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to the shared folder and gives it to the
next. Every stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm.line_dedup import line_dedup_stage
from sievelight.llm.minhash import minhash_stage
from sievelight.llm.mixing import mixing_stage
from sievelight.llm.packing import packing_stage
from sievelight.llm.quality import quality_stage
from sievelight.llm.shared import table, written

STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash", minhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor best-fit packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
