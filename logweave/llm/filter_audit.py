"""Filter interaction audit by truth-table survival words.

With up to five filters a document survives a subset of them exactly if it fails none of its
members. The answers for all 32 subsets make one 32-bit word per document. Adding these words
position by position (a carry-save positional popcount) gives the survivors of every subset at
once, and every order of the filters, every step and every credit share follows from those counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

WORD_BITS = 32
MAX_FILTERS = 5
BLANK = r"[\x20\x09-\x0D]+"


def survival_word(fails: int) -> int:
    """Bit ``s`` says whether a document that fails the filters of the mask ``fails`` survives the subset ``s``."""
    return sum(1 << subset for subset in range(WORD_BITS) if not subset & fails)


def _bits(words: np.ndarray) -> np.ndarray:
    return ((words[:, None] >> np.arange(WORD_BITS, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)


def positional_popcount(words: np.ndarray, copies: np.ndarray | None = None) -> np.ndarray:
    """How many words have each bit set; ``copies`` says how many documents share a word.

    Three words of one weight make a sum word of that weight and a carry word of twice the weight,
    so a plane shrinks to two words before any bit is looked at. A word with copies enters the
    planes of the binary digits of their number.
    """
    words = words.astype(np.uint32)
    planes: list[list[np.ndarray]] = [[words]]
    if copies is not None:
        digits = int(copies.max()).bit_length() if len(copies) else 1
        planes = [[words[(copies >> d) & 1 == 1]] for d in range(max(digits, 1))]
    total = np.zeros(WORD_BITS, np.int64)
    weight = 0
    while weight < len(planes):
        plane = np.concatenate(planes[weight])
        while len(plane) > 2:
            third = len(plane) // 3
            a, b, c = plane[:third], plane[third : 2 * third], plane[2 * third : 3 * third]
            half = a ^ b
            if weight + 1 == len(planes):
                planes.append([])
            planes[weight + 1].append((a & b) | (c & half))
            plane = np.concatenate([half ^ c, plane[3 * third :]])
        total += _bits(plane) << weight
        weight += 1
    return total


def failure_mask(failures: list[Column]) -> Column:
    """Bit i is set if the i-th condition holds; a condition that is null counts as passed."""
    bits = [F.coalesce(failed.cast("int"), F.lit(0)) * (1 << i) for i, failed in enumerate(failures)]
    mask = F.lit(0)
    for bit in bits:
        mask = mask + bit
    return mask.cast("int")


def text_rules(text: Column) -> list[Column]:
    """Conditions A to D: few words, few distinct words, many capitals, symbols."""
    found = F.filter(F.split(text, BLANK), lambda w: w != "")
    n_words = F.size(found)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n_words < 200,
        F.size(F.array_distinct(found)) * 100 < n_words * 50,
        capitals * 100 > F.length(text) * 2,
        text.rlike("[#$%&*|]"),
    ]


def _flags(labels: DataFrame, id_col: str, good: Column, bad: Column) -> DataFrame:
    """One row per labelled id; of repeated labels any one that holds counts."""
    flag = lambda c: F.max(F.coalesce(c.cast("int"), F.lit(0)))
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(flag(good).alias("_good"), flag(bad).alias("_toxic"))


def failing_groups(docs: DataFrame, labels: DataFrame, rules: list[Column], part: Column, id_col: str, text_col: str) -> DataFrame:
    """Documents as (part, good, toxic, fails, n): ``fails`` has a bit per rule and the next one for repeated texts.

    Equal texts are summed up per part and label before their least id is looked for, so a text with
    any number of copies travels as a few rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(part, F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_text"), failure_mask([F.coalesce(r, F.lit(False)) for r in rules]).alias("_fails"),
    )
    slim = stored(slim, "audit")  # texts are read once
    marks = _flags(labels, id_col, F.col("quality") == 1, F.col("toxic") == 1)
    known = slim.filter("_id IS NOT NULL").join(marks, F.col("_id") == F.col("_label_id"), "left").drop("_label_id")
    nameless = slim.filter("_id IS NULL").withColumns({"_good": F.lit(0), "_toxic": F.lit(0)})
    rows = known.unionByName(nameless).withColumns({"_good": F.coalesce("_good", F.lit(0)), "_toxic": F.coalesce("_toxic", F.lit(0))})
    group = ["_text", "part", "_good", "_toxic", "_fails"]
    # Rows that repeat an id and its text share their place in the order, so they are counted together.
    ids = rows.groupBy("_id", *group).agg(F.count("*").alias("_n"))
    first = F.struct(F.col("_id").isNull().alias("_none"), F.col("_id").alias("_id"), F.col("_n").alias("_n"))
    groups = ids.groupBy(*group).agg(
        F.sum("_n").alias("_n"), F.min(first).alias("_first"),
        F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_free"),
    )
    groups = stored(groups, "audit-texts")
    least = groups.groupBy(F.col("_text").alias("_same")).agg(F.min("_first._id").alias("_least"))
    joined = groups.join(least, F.col("_text") == F.col("_same"))
    leads = F.when(F.col("_first._id") == F.col("_least"), F.col("_first._n")).otherwise(0)
    passes = F.col("_free") + leads  # a null id is not larger than any other
    repeat = 1 << len(rules)
    both = F.array(
        F.struct(F.col("_fails").alias("fails"), passes.alias("n")),
        F.struct((F.col("_fails") + repeat).alias("fails"), (F.col("_n") - passes).alias("n")),
    )
    return joined.select("part", F.col("_good").alias("good"), F.col("_toxic").alias("toxic"), F.explode(both).alias("_g")).select(
        "part", "good", "toxic", "_g.fails", "_g.n"
    ).filter("n > 0")


def survivors(groups: DataFrame) -> DataFrame:
    """Survivor counts of all subsets per part, as arrays by subset: ``counts`` of all documents, ``good`` and ``toxic`` ones."""
    table = np.array([survival_word(m) for m in range(WORD_BITS)], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            names, code = parts.dictionary, parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            good, toxic, fails, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5))
            key = code * 4 + good * 2 + toxic
            order = np.argsort(key, kind="stable")
            keys, starts = np.unique(key[order], return_index=True)
            words = table[fails]
            counts = np.concatenate([positional_popcount(words[rows], n[rows]) for rows in np.split(order, starts[1:])])
            each = np.repeat(keys, WORD_BITS)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(each // 4)), pa.array(np.tile(np.arange(WORD_BITS), len(keys))),
                 pa.array(counts), pa.array(counts * (each // 2 % 2)), pa.array(counts * (each % 2))],
                names=["part", "subset", "n", "good", "toxic"],
            )

    words = groups.select("part", F.col("good").cast("long"), F.col("toxic").cast("long"), "fails", "n")
    partial = words.mapInArrow(run, "part string, subset long, n long, good long, toxic long")
    sums = partial.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    by_subset = F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic")))  # 32 a part
    return sums.groupBy("part").agg(by_subset.alias("_c")).select(
        "part", F.col("_c.n").alias("counts"), F.col("_c.good").alias("good_counts"), F.col("_c.toxic").alias("toxic_counts")
    )


def audit(
    docs: DataFrame, labels: DataFrame, rules: list[Column] | None = None, part_col: str = "source",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``rules`` are up to four conditions that are true where a document fails (the standard ones: A
    few words, B few distinct words, C many capitals, D symbols); the last filter is always that an
    equal text stands under a smaller id anywhere in the table. Filters are lettered in turn.

    A null text is empty and equal to other empty ones; a null part is the empty string. A null id
    is smaller than no other and larger than none: such rows never fail the last filter, nor have they labels. Rows that repeat an id and
    its text do not fail on account of each other. Of repeated labels any one that holds counts. An
    empty table gives no rows. Other columns are left out.
    """
    own = text_rules(F.coalesce(F.col(text_col), F.lit(""))) if rules is None else list(rules)
    if len(own) >= MAX_FILTERS:
        raise ValueError("at most four rules and the rule of repeated texts fit a 32-bit word")
    letters = "ABCDE"[: len(own) + 1]
    parts = survivors(failing_groups(docs, labels, own, F.col(part_col), id_col, text_col))

    n = len(letters)
    orders = F.split(F.lit(",".join("".join(p) for p in itertools.permutations(letters))), ",")
    rows = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.substr("filter_order", i, F.lit(1))) - 1)
    rows = rows.withColumn("_f", bit(F.col("step"))).withColumn(
        "_after", F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda mask, i: mask.bitwiseOR(bit(i)))
    )
    f, after, full = F.col("_f"), F.col("_after"), F.lit((1 << n) - 1)
    before = after - f
    lost = lambda counts: F.get(counts, before) - F.get(counts, after)
    failing = F.get("counts", F.lit(0)) - F.get("counts", f)

    def credit(total: Column, m: Column) -> Column:
        """A subset of k others stands first in k! (n - 1 - k)! orders."""
        k = F.bit_count(m)
        share = F.factorial(k) * F.factorial(F.lit(n - 1) - k) * (F.get("counts", m) - F.get("counts", m.bitwiseOR(f)))
        return total + F.when(m.bitwiseAND(f) == 0, share).otherwise(F.lit(0).cast("long"))

    subsets = F.sequence(F.lit(0), full)
    return rows.select(
        "part", "filter_order", "step", F.get("counts", after).alias("kept"), lost("counts").alias("removed"),
        (failing - lost("counts")).alias("redundant"), (F.get("counts", full - f) - F.get("counts", full)).alias("unique_fails"),
        lost("good_counts").alias("good_lost"), lost("toxic_counts").alias("toxic_lost"),
        F.aggregate(subsets, F.lit(0).cast("long"), credit).alias("shapley"),
    )
