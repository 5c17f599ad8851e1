"""The corpus pipeline: five stages, each working on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it back as the next stage's documents. All but the last keep the columns of their input, whatever further columns there are.

In every stage a null text counts as empty, texts of any length are read whole, repeated rows are rows of their own (one of
them stays in the near-dedup stage), and an empty table gives an empty one. A null doc_id is never learned from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.llm import bpe, decontam, nearcopies, pii, toxicity
from orrery.llm.common import cut, table, training
from orrery.llm.registry import vocabulary

HELD_OUT = 4
#: The stages have no common SQL: models, fingerprints and tokens can't be expressed.
ORACLE_SQL = None


def lean(spark):
    """Smaller Arrow batches: a worker holds fewer texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier scores at or above its threshold go; without labels every score is 0 and all stay. Ties at the threshold go."""
    lean(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(training("doc_id", HELD_OUT))
    model = toxicity.train(docs.select("doc_id", "text").filter(training("doc_id", HELD_OUT)), labels)
    return docs.filter(toxicity.score_column(spark, model) < toxicity.THRESHOLD)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of documents linked by five-word shingles of Jaccard similarity 0.8, the one with the least doc_id stays; a row with a null doc_id goes if any other document is like it."""
    lean(spark)
    return nearcopies.one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go; null and empty documents and items match nothing, so a table without items keeps all."""
    lean(spark)
    return docs.filter(~decontam.held_column(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def redact_personal_data(spark, docs, sf_dir):
    """Personal data in texts become the names of their kinds in angle brackets, overlapping spans one of them; a null text stays null, and n_chars follows the text."""
    lean(spark)
    out = docs.withColumn("text", pii.redact_column(spark, pii.train(docs.select("doc_id", "text"))))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark, docs, sf_dir):
    """Number of tokens of each document, and digests of its ids and of the text that they decode to; a row for each row."""
    lean(spark)
    return bpe.digests(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
