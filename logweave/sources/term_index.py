"""Words of the stored log table by file, and the stem of each distinct word.

Files of a snapshot never change, so the words of a piece are listed once. A search then looks up the forms
of its words and the files that have them: it reads those files alone and tests rows by the
forms, with built-in expressions. Each distinct word is stemmed once, however many rows have it.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import search
from . import snapshots, versions

# Beyond this many files of interest a search reads the table as a whole.
MAX_FILES = 50_000
_PLACE = r"piece=([^/]+)/(log_date=[^/]+/[^/]+)$"


def _words_path(path: str) -> str:
    return f"{path}_terms/words"


def _state_path(path: str) -> str:
    return f"{path}_terms/state"


def indexed(spark: SparkSession, path: str) -> set[str]:
    """The pieces whose words are listed."""
    stored = versions.read(spark, _state_path(path))
    return {r["piece"] for r in stored.collect()} if stored is not None else set()  # one row per piece


def refresh(spark: SparkSession, path: str) -> list[str]:
    """List the words of pieces that are new in the table; returns these pieces.

    Rows are (piece, file, word, stem), sorted by stem within files. The list of pieces is written last, so
    a run that failed is repeated from where it stood.
    """
    now = snapshots.entries(spark, path)
    done = indexed(spark, path)
    fresh = sorted({e.piece for e in now} - done)
    if fresh:
        rows = spark.read.option("basePath", f"{path}/data").parquet(*[snapshots.piece_path(path, p) for p in fresh])
        raw = F.col("raw_message") if "raw_message" in rows.columns else F.lit("")
        words = search.without_stop_words(F.array_distinct(search.tokens(search.message_text(F.col("message"), raw), keep_stop_words=True)))
        where = F.col("_metadata.file_path")
        listed = rows.select(
            F.regexp_extract(where, _PLACE, 1).alias("piece"), F.regexp_extract(where, _PLACE, 2).alias("file"), F.explode(words).alias("word")
        ).distinct()
        stems = listed.select("word").distinct().withColumn("stem", search.stemmed_word(F.col("word")))
        (
            listed.join(stems, "word").hint("rebalance", F.col("piece")).sortWithinPartitions("piece", "stem")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("piece").parquet(_words_path(path))
        )
    kept = [(p,) for p in sorted((done & {e.piece for e in now}) | set(fresh))]
    if fresh or len(kept) < len(done):
        versions.write(spark.createDataFrame(kept, "piece string"), _state_path(path))
    return fresh


def look_up(spark: SparkSession, path: str, query: str, chosen: list[snapshots.Entry]) -> tuple[dict[str, list[str]], list[str] | None]:
    """(forms of the query's stems, files that may hold matches) among indexed entries; no list of files means all."""
    groups = search.needed_stems(query)
    wanted = sorted({s for _, stems in groups for s in stems})
    if not chosen or not wanted:
        return {}, [] if not groups else None
    pieces = sorted({e.piece for e in chosen})
    terms = spark.read.schema("file string, word string, stem string, piece string").option("basePath", _words_path(path)).parquet(_words_path(path))
    terms = terms.filter(F.col("stem").isin(*wanted) & F.col("piece").isin(*pieces))
    forms: dict[str, list[str]] = defaultdict(list)
    for r in terms.select("stem", "word").distinct().collect():  # inflections of the query's words
        forms[r["stem"]].append(r["word"])
    if any(not positive for positive, _ in groups):
        return dict(forms), None
    has = terms.groupBy("piece", "file").agg(F.collect_set("stem").alias("stems"))  # stems of the query at most
    every = [F.size(F.array_intersect("stems", F.array(*[F.lit(s) for s in positive]))) == len(positive) for positive, _ in groups]
    held = has.filter(F.array_max(F.array(*every))).select("piece", "file").limit(MAX_FILES + 1).collect()
    if len(held) > MAX_FILES:
        return dict(forms), None
    days = {(e.piece, e.log_date.isoformat() if e.log_date else snapshots.NO_DAY) for e in chosen}
    counted = [r for r in held if (r["piece"], r["file"].split("/")[0].removeprefix("log_date=")) in days]
    return dict(forms), [f"{snapshots.piece_path(path, r['piece'])}/{r['file']}" for r in counted]
