"""Pipeline over the documents table: each stage calls one operator of ``coursebeacon.llm``.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and is the next one's docs.
"""

from pyspark.sql import DataFrame, SparkSession

from coursebeacon.llm import stages
from coursebeacon.session import staged

STAGES = [
    ("language ID", stages.language_id_stage),
    ("SimHash near-dedup", stages.simhash_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("mixing sources to target weights", stages.mixing_stage),
    ("token-ID / binary output", stages.token_output_stage),
]

#: The stages train models and use tokenizers, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
