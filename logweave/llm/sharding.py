"""Jump consistent hashing: stable keys to shards without a ring table.

The jump sequence of a 64-bit key is a chain of growing shard numbers; the shard among ``n`` is
the last member below ``n``. A further shard therefore takes rows only into itself, an expected
1/(n+1) of them. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, without

# Multiplier of the published generator, 2862933555777941757, as 32-bit halves and 16-bit limbs.
_MULTIPLIER = 2862933555777941757
_LOW32 = 0xFFFFFFFF
_M_HI, _M_LO = _MULTIPLIER >> 32, _MULTIPLIER & _LOW32
_FIRST_STEPS = 64


def _low_product(a: Column, m: int) -> Column:
    """a * m modulo 2^32 for 32-bit values, without a 64-bit overflow."""
    return ((a * (m & 0xFFFF)) + F.shiftleft((a * (m >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW32)


def _step(state: Column, shards: int) -> Column:
    """One jump while the next shard is below ``shards``; afterwards the state stays."""
    hi, lo = state["hi"], state["lo"]
    top = lo * (_M_LO >> 16)
    low = lo * (_M_LO & 0xFFFF) + F.shiftleft(top.bitwiseAND(0xFFFF), 16) + F.lit(1)
    next_lo = low.bitwiseAND(_LOW32)
    carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(top, 16)
    next_hi = (_low_product(hi, _M_LO) + _low_product(lo, _M_HI) + carry).bitwiseAND(_LOW32)
    jump = F.floor((state["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(next_hi, 1) + 1).cast("double"))).cast("long")
    going = state["j"] < shards
    moved = F.struct(next_hi.alias("hi"), next_lo.alias("lo"), state["j"].alias("b"), jump.alias("j"))
    return F.when(going, moved).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (0 to ``shards`` - 1) of a 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    # b: last shard reached, j: the shard the next jump leads to.
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_LOW32).cast("long")).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def advance(state: Column, first: int, last: int) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, lambda s, _: _step(s, shards))

    def finish(state: Column) -> Column:
        # A chain has about ln(shards) members; the rest of the worst case runs only where it is needed.
        rest = F.aggregate(F.sequence(F.lit(_FIRST_STEPS + 1), F.lit(shards)), state, lambda s, _: _step(s, shards), lambda s: s["b"])
        return F.when(state["j"] < shards, rest).otherwise(state["b"])

    if shards <= _FIRST_STEPS:
        return advance(start, 1, shards)["b"].cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_FIRST_STEPS)), start, lambda s, _: _step(s, shards), finish
    ).cast("int")


def stable_key(df: DataFrame, column: str) -> Column:
    """64-bit key of a column: integers as they are, other types hashed; null counts as -1."""
    kind = dict(df.dtypes)[column]
    own = F.col(column).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(column).isNotNull(), F.xxhash64(column))
    return F.coalesce(own, F.lit(-1).cast("long"))


def assign(df: DataFrame, key: str, shards: int, grow_by: int = 1) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with ``grow_by`` more shards); no shuffle.

    Equal keys always meet in one shard. Null keys share the shard of key -1. Columns of these names are replaced.
    """
    kept = without(df, "shard", "grown_shard")
    own = stable_key(kept, key)
    return kept.withColumns({"shard": jump_shard(own, shards), "grown_shard": jump_shard(own, shards + grow_by)})


def with_slots(assigned: DataFrame, order: list[str], by: str = "_split") -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard.

    Rows are numbered within (shard, ``by``) and shifted by the counts of the parts before, so no
    task ever sorts a whole shard, however large or hot. ``by`` must be a stored column.
    """
    counts = assigned.groupBy("shard", by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", by).orderBy(*order)
    numbered = assigned.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", by]).withColumn("slot", (F.col("_before") + F.col("_at")).cast("long")).drop("_before", "_at")


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place documents by id: id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes: its size is 8 and its checksum 0. Repeated rows get a slot each.
    The rows (without texts) are stored once with the input split they came from, which numbers
    them afterwards; splits bound the groups even if all ids are equal.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"),
    )
    placed = assign(slim, id_col, shards).withColumn("_split", F.spark_partition_id())
    slotted = with_slots(stored(placed, "shards"), [id_col, "size", "text_crc32"])
    return slotted.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
