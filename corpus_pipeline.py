"""Corpus pipeline: toxic documents go, one of each near-duplicate group
stays, repeated passages are cut, sources are mixed to their targets, and the
result is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. Stages are written as Parquet in the
shared checkpoint folder and read again, so each starts from files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesight.llm import minhash, mixing, packing, suffix, toxicity
from tablesight.llm.queries import table, tokenizer
from tablesight.llm.shared import Scratch


#: Near-duplicate links of the stage, in percent; op1 has a contract of its own (85).
NEAR_PERCENT = 80


def whole(docs: DataFrame):
    """All columns as one struct, so that their names can't clash with results."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def unpack(df: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return df.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null, empty and short texts are judged
    like others, by what evidence they have."""
    judged = toxicity.score(docs.select("doc_id", "text", whole(docs)), table(spark, sf_dir, "labels"), columns=["_row"], text_of="_row")
    return unpack(judged.filter("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays, once. Rows with
    a null doc_id have no group and stay, as do wordless texts. Of an id with
    several texts all stay, each once, or none."""
    kept = minhash.near_duplicates(docs, percent=NEAR_PERCENT).filter("kept and doc_id is not null").select("doc_id").distinct()
    # The join leaves rows sorted by doc_id, so dropping repeated rows needs no further shuffle.
    mark = f"text_{uuid.uuid4().hex}"
    once = docs.join(kept, "doc_id", "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark])
    return once.select(docs.columns).union(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut; n_chars
    follows. What a cut leaves of a character is dropped with it. Documents
    of which nothing is left stay as empty texts; a null text stays null."""
    cut = suffix.remove_repeats(docs.select("doc_id", "text", whole(docs)), carry=["_row"])
    left = F.col("kept").cast("string")
    left = F.when(F.is_valid_utf8(left), left).otherwise(F.regexp_replace(F.make_valid_utf8(left), "\ufffd", ""))
    text = F.when(F.col("_row.text").isNotNull(), left)
    return unpack(cut, docs, text=text, n_chars=F.length(text).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks. A null source is a
    source of its own; null and empty texts count no words and go with the
    rate of their source; an empty table gives none."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, of all documents. A null or empty text is its end
    token alone; copies of a document are packed as often as they occur."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The stages learn models, hash texts and tokenize: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the files of the one before."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return docs
