"""Corpus preparation: from documents to packed training sequences.

The stages, in order: documents scored as toxic go; later copies of repeated
line runs are deleted, and documents left without text go; of each group of
near-duplicate documents (distinct 5-word shingles, Jaccard similarity 0.8 or
more) the one of the smallest doc_id stays; documents with an aligned benchmark
passage go; what is left is cut into pieces and packed. Each stage gets all
that the one before it kept.

Edge cases: rows without doc_id are only ever judged by their own text; of rows
that share a doc_id but not a text each is judged by itself; of equal rows the
near-duplicate stage keeps one; null and empty texts pass the first stages as
empty documents (a document that loses all its lines goes) and are packed as one
end id; an empty table gives no sequences; extra columns are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribostrand.llm.common import fresh, stored, table
from ribostrand.llm.decontamination import decontaminate
from ribostrand.llm.jaccard import representatives
from ribostrand.llm.line_dedup import dedup_lines
from ribostrand.llm.packing import pack
from ribostrand.llm.queries import tokenizer_path
from ribostrand.llm.toxicity import fit, held_out, score

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM; labels of held-out rows are not learned from."""
    model, name = fit(docs, table(spark, sf_dir, "labels").where(~held_out())), fresh(docs, "_score")
    return score(docs, model, keep=name).where(F.col(name) < TOXIC_FROM).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents of which nothing is left go."""
    lines, deleted = fresh(docs, "_lines"), fresh(docs, "_deleted")
    out = dedup_lines(docs, counts=(lines, deleted)).where((F.col(deleted) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id."""
    return representatives(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an aligned benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), length=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: Suffix arrays, a trained classifier and alignment are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
