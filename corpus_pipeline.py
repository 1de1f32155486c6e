"""A training-data pipeline over ``documents``: toxicity, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.llm import byte_bpe, decontaminate, jaccard_join, suffix_dedup
from logweave.llm.common import table
from logweave.llm.queries import toxicity_model
from logweave.session import work_dir

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
REPEATED_BYTES = 400


_ROW = "_whole_row"


def set_aside(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row beside them, out of reach of the names that operators add."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW), "doc_id", "text")


def brought_back(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` as they were, but for those in ``changed``."""
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"{_ROW}.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labelled documents of the input tables."""
    model = toxicity_model(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return brought_back(model.score(set_aside(docs)).filter("predicted = 0"), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles the one with the least id stays; those without words stay.

    Rows that repeat an id and its text become one row; a null id is no id, so such rows stay.
    """
    groups = jaccard_join.join(docs.select("doc_id", "text"), SIMILAR_PERCENT, SHINGLE_WORDS, key_col="_text_key")
    others = groups.filter("component_id <> doc_id").select("doc_id", "_text_key").distinct()
    keyed = set_aside(docs).withColumn("_text_key", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    rest = keyed.join(others, ["doc_id", "_text_key"], "left_anti")
    repeated = keyed.filter("doc_id IS NOT NULL").groupBy("doc_id", "_text_key").count().filter("count > 1").drop("count")
    if not repeated.isEmpty():
        once = rest.join(repeated, ["doc_id", "_text_key"], "left_semi").dropDuplicates(["doc_id", "_text_key"])
        rest = rest.join(repeated, ["doc_id", "_text_key"], "left_anti").unionByName(once)
    return brought_back(rest, docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated passages; a character cut in two goes as well. Texts of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(set_aside(docs), REPEATED_BYTES)
    changed = F.col("n_removed") > 0
    left = cut.filter(~changed | (F.octet_length("kept") > 0))
    return brought_back(left, docs, text=whole_text(), n_chars=F.char_length(whole_text()).cast("long"))


def whole_text() -> Column:
    """Kept bytes as text; null and empty texts come out empty."""
    # Replacement marks stand where a cut left part of a character; the input has its own only if the bytes had them.
    broken = F.make_valid_utf8(F.col("kept").cast("string"))
    own = F.instr(F.hex("kept"), "EFBFBD") > 0
    return F.when((F.col("n_removed") > 0) & ~own, F.translate(broken, "�", "")).otherwise(broken)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    return brought_back(decontaminate.remove_contaminated(set_aside(docs), table(spark, sf_dir, "benchmark"), 10), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text with their digests."""
    done = byte_bpe.tokenize(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(done, extra=["token_ids"])


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokens),
]

# A fitted classifier and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared working folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
