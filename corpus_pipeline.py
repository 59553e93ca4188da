"""Documents to training tokens: toxicity, quality rules, near-duplicates, benchmark contamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of docs. `run` writes each result as Parquet to the shared folder and reads it again as the next stage's docs, so a
lost executor costs at most a stage. Columns of docs beyond doc_id and text pass through, whatever their names; null,
empty and wordless texts fail the quality rules, and documents without an id are kept by the near-duplicate stage. Rows
that repeat pass or go alike and leave one row there; of rows with one id and different texts one stays, of linked
documents the one of the smallest id. A toxicity of just 0.5 is rejected, as is a share of benchmark words of just a
twentieth. Very long texts are handled whole in every stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontaminate, minhash, quality, toxicity
from lattica.llm.shared import free_name, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more, by a model of the labelled documents that are not held out."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the standard policy."""
    return quality.apply_policy(docs, "standard-1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, once if its row repeats."""
    return minhash.distinct_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    found = free_name(docs, "contamination")
    got = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), out=found)
    return got.where(~decontaminate.contaminated(found)).drop(found)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of them and of what they decode to."""
    got = bpe.digests(docs.select("doc_id", "text"), ids="ids")
    return got.select("doc_id", "ids", *(F.col(f"digests.{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")))


STAGES = [("toxicity", toxic), ("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]
#: The first, third and last stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
