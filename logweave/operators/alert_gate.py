"""Threshold, window and cooldown: when matches become firings.

The gate is evaluated once per rule key and evaluation slot, as a live evaluator does once
per ingest batch: the slot adds its number of matches to the key's counter, at the time of
its newest match. Slots are counted before the shuffle, so what reaches the ordered fold is
bounded by elapsed time divided by the slot length however many rows a rule matches, and the
fold itself keeps three numbers per key.

Contract per key, over its slots in order, with ``t`` the slot's newest match:

1. no open window or ``t >= window_end``: the counter restarts and ``window_end = t + window``;
2. the counter grows by the slot's matches;
3. counter at or above the threshold and not cooling: fire, ``cooldown_end = t + cooldown``,
   the counter restarts and the window closes.

While cooling the counter keeps growing until its window ends.

A key's slots are folded by many tasks, a day each. What came before a day is unknown there, but
after two kinds of slots it no longer matters: one that follows a gap of at least window and
cooldown starts afresh, and one that holds the threshold by itself after a gap of at least the
cooldown fires in any case. From the first such slot on a day is settled on its own. The slots
before it wait for the three numbers of the last settled day; a run of days without any such
slot is folded in one go.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import severity, text
from ..session import stored
from .alert_match import AlertRule, by_rule, matched_rows, satisfied_conditions

# Fixed value: the longest a live evaluator holds a batch back.
SLOT_US = 500_000

MINUTE_US = 60_000_000

# Length of the chunks that are folded apart.
CHUNK_US = 24 * 60 * MINUTE_US

SETTINGS = ("threshold", "window_us", "cooldown_us")
GATE_COLUMNS = ("gate_key", "slot", "t_us", "matches", *SETTINGS)
STATE = ("count", "window_end", "cooldown_end")
# Kinds of rows: a firing, a slot whose state is not known yet, the state at the end of a chunk
# (only its count if it is not known yet).
FOLDED_SCHEMA = (
    "gate_key string, chunk long, kind string, slot long, t_us long, matches long, accumulated long, "
    "threshold long, window_us long, cooldown_us long, count long, window_end long, cooldown_end long"
)
_FOLDED = [c.split()[0] for c in FOLDED_SCHEMA.split(", ")]


def slots(matches: DataFrame, key: Column, slot_us: int = SLOT_US, carry: list[str] | None = None) -> DataFrame:
    """Matches and newest time per key and slot; ``carry`` names columns of the slot's newest row (by timestamp, then id)."""
    newest = [F.max_by(F.struct(*carry), F.struct("timestamp", "id")).alias("newest")] if carry else []
    micros = F.unix_micros("timestamp")
    slot = F.floor(micros / F.lit(slot_us)).cast("long") if slot_us > 1 else micros
    return (
        matches.withColumn("gate_key", key)
        .withColumn("slot", slot)
        .groupBy("gate_key", "slot")
        .agg(F.count("*").alias("matches"), F.max(micros).alias("t_us"), *newest)
    )


def gate_settings(rules: list[AlertRule], one_shot: bool = False) -> dict[str, Column]:
    """Threshold, window and cooldown columns by ``rule_id``. One-shot rules fire on the first match."""
    for rule in rules:
        if not one_shot and rule.window_minutes <= 0:
            raise ValueError(f"rule {rule.id}: the window must be positive")
    pick = lambda value: by_rule(rules, lambda r: F.lit(value(r)).cast("long"))
    return {
        "threshold": pick(lambda r: 1 if one_shot else max(r.threshold, 1)),
        "window_us": pick(lambda r: MINUTE_US * (1 if one_shot else r.window_minutes)),
        "cooldown_us": pick(lambda r: MINUTE_US * r.cooldown_minutes),
    }


def fold_step(state: list[int | None], t: int, n: int, threshold: int, window: int, cooldown: int) -> int:
    """Advance ``[count, window_end, cooldown_end]`` by one slot; the accumulated count when it fires, else 0."""
    count, window_end, cooldown_end = state
    if window_end is None or t >= window_end:
        count, window_end = 0, t + window
    count += n
    if count >= threshold and (cooldown_end is None or t >= cooldown_end):
        state[:] = 0, None, t + cooldown
        return count
    state[:] = count, window_end, cooldown_end
    return 0


def fold_slots(state: list[int | None], times: list[int], counts: list[int], threshold: int, window: int, cooldown: int) -> list[tuple[int, int]]:
    """Advance the state by many slots in order, as :func:`fold_step` does; (place, accumulated count) of those that fire.

    Each turn jumps to the next firing or to the end of the window by binary search, so the turns
    are as many as firings and windows, not as slots.
    """
    count, window_end, cooldown_end = state
    total = [0, *accumulate(counts)]
    fired, at, size = [], 0, len(times)
    while at < size:
        if window_end is None or times[at] >= window_end:
            count, window_end = 0, times[at] + window
        stop = max(at + 1, bisect_left(times, window_end, at))
        hit = max(at, bisect_left(total, threshold - count + total[at], at) - 1)
        if cooldown_end is not None:
            hit = max(hit, bisect_left(times, cooldown_end, at))
        if hit < stop:
            fired.append((hit, count + total[hit + 1] - total[at]))
            count, window_end, cooldown_end = 0, None, times[hit] + cooldown
            at = hit + 1
        else:
            count += total[stop] - total[at]
            at = stop
    state[:] = count, window_end, cooldown_end
    return fired


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_FOLDED)
    return frame.astype({c: "Int64" for c in _FOLDED if c not in ("gate_key", "kind")})


def _stretches(columns: list[list]) -> Iterator[tuple[int, int]]:
    """First and last place (exclusive) of rows in a row that are equal in all columns."""
    first, last = 0, None
    for i, row in enumerate(zip(*columns)):
        if i and row != last:
            yield first, i
            first = i
        last = row
    if last is not None:
        yield first, len(columns[0])


def _plain(values: pd.Series) -> list:
    """Python values, None for nulls."""
    return values.astype(object).where(values.notna(), None).tolist()


def _rows(frame: pd.DataFrame, heads: list[int], fired: list[tuple[int, int]], ends: list[tuple[int, tuple]]) -> Iterator[pd.DataFrame]:
    """Folded rows of a frame of slots, in order: heads and firings at their places, ends before the place they come with."""
    parts = [(heads, "head", [None] * len(heads)), ([i for i, _ in fired], "fire", [n for _, n in fired])]
    picked = [
        frame[["chunk", *GATE_COLUMNS]].iloc[at].assign(kind=kind, accumulated=pd.array(n, "Int64")).set_axis(2 * np.array(at) + 1)
        for at, kind, n in parts
        if at
    ]
    if ends:
        picked.insert(0, _frame([row for _, row in ends]).set_axis(2 * np.array([i for i, _ in ends])))
    if picked:
        found = pd.concat([p.reindex(columns=_FOLDED).astype({c: "Int64" for c in _FOLDED if c not in ("gate_key", "kind")}) for p in picked])
        yield found.sort_index(kind="stable").reset_index(drop=True)


def fold_chunks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Run the gate over slots sorted by (key, chunk, slot), each chunk without knowledge of those before."""
    current, state, previous, ends = None, None, None, []

    def end(place: int) -> None:
        if current is not None:
            ends.append((place, (*current, "open" if state is None else "exit", None, None, None, None, None, None, None, *(state or (None,) * 3))))

    for frame in frames:
        heads, fired = [], []
        names = [frame[c].tolist() for c in ("gate_key", "chunk", *SETTINGS)]
        all_times, all_counts = frame["t_us"].to_numpy(np.int64), frame["matches"].to_numpy(np.int64)
        for first, after in _stretches(names):
            key, chunk, threshold, window, cooldown = (c[first] for c in names)
            if (key, chunk) != current:
                end(first)
                current, state, previous = (key, chunk), None, None
            times, counts, at = all_times[first:after], all_counts[first:after], 0
            if state is None:
                gap = np.diff(times, prepend=times[0] if previous is None else previous)
                known = np.ones(len(times), bool)
                known[0] = previous is not None
                fresh = known & (gap >= max(window, cooldown))
                sure = (counts >= threshold) & (known & (gap >= cooldown) | (cooldown == 0))
                settling = np.flatnonzero(fresh | sure)
                at = len(times)
                if len(settling):
                    place = int(settling[0])
                    at, state = (place, [0, None, None]) if fresh[place] else (place + 1, [0, None, int(times[place]) + cooldown])
                heads.extend(range(first, first + at))
            previous = int(times[-1])
            if at < len(times):
                fired += [(first + at + i, n) for i, n in fold_slots(state, times[at:].tolist(), counts[at:].tolist(), threshold, window, cooldown)]
        yield from _rows(frame, heads, fired, ends)
        ends.clear()
    end(0)
    if ends:
        yield _frame([row for _, row in ends])


def fold_chains(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold slots that waited, sorted by (key, chain, slot) with the known state of a chain, if any, first."""
    current, state, last, ends = None, [0, None, None], None, []

    def end(place: int) -> None:
        if last is not None:  # the state at the end of a chunk that had none
            ends.append((place, (*last, "exit", None, None, None, None, None, None, None, *state)))

    for frame in frames:
        fired = []
        names = [_plain(frame[c]) for c in ("gate_key", "chain", "kind", "chunk", "open", *SETTINGS)]
        known = [_plain(frame[c]) for c in ("count_", "window_end", "cooldown_end")]
        all_times, all_counts = _plain(frame["t_us"]), _plain(frame["matches"])
        for first, after in _stretches(names):
            key, chain, kind, chunk, is_open, threshold, window, cooldown = (c[first] for c in names)
            if (key, chain) != current:
                end(first)
                current, state, last = (key, chain), [0, None, None], None
            if kind == "exit":
                state = [None if c[after - 1] is None else int(c[after - 1]) for c in known]
                continue
            if last is not None and last[1] != chunk:
                end(first)
            last = (key, chunk) if is_open else None
            times, counts = ([int(v) for v in c[first:after]] for c in (all_times, all_counts))
            fired += [(first + i, n) for i, n in fold_slots(state, times, counts, int(threshold), int(window), int(cooldown))]
        yield from _rows(frame, [], fired, ends)
        ends.clear()
    end(0)
    if ends:
        yield _frame([row for _, row in ends])


def fold(gated: DataFrame, entry: DataFrame | None = None) -> DataFrame:
    """Firings (kind ``fire``) and the state at the end of each day (kind ``exit``) of slots that carry :data:`GATE_COLUMNS`.

    ``entry`` has states (gate_key, chunk and :data:`STATE`) at the end of earlier chunks, one per key at most.
    """
    # A slot without a time is in no chunk and never fires.
    timed = gated.filter("t_us IS NOT NULL")
    chunked = timed.select(F.floor(F.col("t_us") / F.lit(CHUNK_US)).cast("long").alias("chunk"), *GATE_COLUMNS)
    ordered = chunked.repartition("gate_key", "chunk").sortWithinPartitions("gate_key", "chunk", "slot")
    # Small from here on: firings, waiting slots and a row for each key and day.
    first = stored(ordered.mapInPandas(fold_chunks, FOLDED_SCHEMA), "gate")
    ends = first.filter("kind IN ('exit', 'open')").select("gate_key", "chunk", "kind", *STATE)
    if entry is not None:
        ends = ends.unionByName(entry.select("gate_key", "chunk", F.lit("exit").alias("kind"), *STATE))
    settled = F.when(F.col("kind") == "exit", F.col("chunk"))
    before = Window.partitionBy("gate_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chains = ends.select("gate_key", "chunk", (F.col("kind") == "open").alias("open"), F.last(settled, True).over(before).alias("chain"))
    nothing = F.lit(None).cast("long")
    heads = first.filter("kind = 'head'").join(chains, ["gate_key", "chunk"]).select(
        "gate_key", "chain", "kind", "chunk", "open", "slot", "t_us", "matches", "threshold", "window_us", "cooldown_us",
        *[nothing.alias(c) for c in ("count_", "window_end", "cooldown_end")],
    )
    known = ends.filter("kind = 'exit'").join(chains.filter("chain IS NOT NULL").select("gate_key", F.col("chain").alias("chunk")).distinct(), ["gate_key", "chunk"])
    known = known.select(
        "gate_key", F.col("chunk").alias("chain"), "kind", "chunk", F.lit(False).alias("open"),
        *[nothing.alias(c) for c in ("slot", "t_us", "matches", "threshold", "window_us", "cooldown_us")],
        F.col("count").alias("count_"), "window_end", "cooldown_end",
    )
    waiting = known.unionByName(heads).repartition("gate_key", "chain").sortWithinPartitions(
        "gate_key", "chain", F.col("slot").asc_nulls_first()
    )
    return first.filter("kind IN ('fire', 'exit')").unionByName(waiting.mapInPandas(fold_chains, FOLDED_SCHEMA))


def fire(gated: DataFrame) -> DataFrame:
    """Firings of slots that carry :data:`GATE_COLUMNS`."""
    return fold(gated).filter("kind = 'fire'").select("gate_key", "slot", "t_us", "matches", "accumulated")


def threshold_firings(logs: DataFrame, rules: list[AlertRule], slot_us: int = SLOT_US) -> DataFrame:
    """Firings (rule_id, timestamp, matches in the slot, accumulated matches) of the threshold rules."""
    gated_rules = [r for r in rules if not r.fire_on_every_match and r.is_active]
    rows = matched_rows(logs, gated_rules).select("rule_id", "timestamp")
    counted = slots(rows, F.col("rule_id").cast("string"), slot_us)
    with_rule = counted.withColumn("rule_id", F.col("gate_key").cast("long"))
    fired = fire(with_rule.withColumns(gate_settings(gated_rules)))
    return fired.select(
        F.col("gate_key").cast("long").alias("rule_id"),
        "slot",
        F.timestamp_micros("t_us").alias("fired_at"),
        "matches",
        "accumulated",
    )


def firing_records(logs: DataFrame, rules: list[AlertRule], slot_us: int = SLOT_US) -> DataFrame:
    """Threshold firings with title, text, severity, the triggering row and the satisfied conditions.

    The trigger is the newest row of the firing slot (of equal times the highest id). Slots carry it
    from the start, so rows are read and matched once; firings pick theirs up by (rule, slot).
    """
    gated_rules = [r for r in rules if not r.fire_on_every_match and r.is_active]
    snapshot = ["timestamp", "hostname", "fromhost_ip", "app_name", "severity", "message"]
    carried = [*snapshot, "parsed_fields", "matched_parsers", "id"]
    rows = matched_rows(logs, gated_rules).select("rule_id", *carried)
    counted = stored(slots(rows, F.col("rule_id").cast("string"), slot_us, carried), "slots")
    with_rule = counted.withColumn("rule_id", F.col("gate_key").cast("long"))
    fired = fire(with_rule.withColumns(gate_settings(gated_rules))).select("gate_key", "slot", "accumulated")
    listed = by_rule(gated_rules, satisfied_conditions)
    flat = with_rule.join(fired, ["gate_key", "slot"]).select("rule_id", "slot", "matches", "accumulated", "newest.*")
    minutes = by_rule(gated_rules, lambda r: F.lit(r.window_minutes))
    required = by_rule(gated_rules, lambda r: F.lit(max(r.threshold, 1)))
    reached = F.format_string(
        "Threshold reached: %d matching log(s) within %d minute(s) (required: %d)", "accumulated", minutes, required
    )
    return flat.select(
        "rule_id",
        "slot",
        "id",
        F.col("timestamp").alias("fired_at"),
        "matches",
        "accumulated",
        by_rule(gated_rules, lambda r: F.lit(f"Alert: {r.name}")).alias("title"),
        F.concat(
            F.format_string("%d matching log entries in the last %d minute(s). Latest from ", "accumulated", minutes),
            "hostname",
            F.lit(": "),
            "message",
        ).alias("text"),
        severity.bucket(F.col("severity")).alias("notify_severity"),
        F.struct(*snapshot).alias("trigger_log"),
        F.array_append(listed, reached).alias("conditions"),
    )


def audit_firings(audit: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Audit rules: the first matching action fires, then the rule cools down."""
    active = [r for r in rules if r.is_active]
    wanted = [
        F.when(
            (F.col("action") == r.audit_action) if r.audit_action else F.lit(True), F.lit(r.id).cast("long")
        )
        for r in active
    ]
    rows = audit.withColumn("rule_id", F.explode(F.array_compact(F.array(*wanted)))).select(
        "rule_id", F.col("created_at").alias("timestamp")
    )
    return _one_shot(rows, active)


# Texts of the malformed-line rule.
MALFORMED_TEXT = "A syslog line failed to parse as JSON during ingestion: "
MALFORMED_CONDITION = "Malformed JSON line encountered during ingestion"
MALFORMED_SEVERITY = "warning"


def malformed_firings(malformed: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Firings of rules on undecodable lines (``timestamp`` = time of ingest, ``line``), with texts and the whole line.

    A rule fires at the newest line of a slot, subject to its cooldown only (of equal times the
    greatest line), or at every line if it says so.
    """
    active = [r for r in rules if r.is_active]
    ids = lambda every: [r.id for r in active if r.fire_on_every_match == every]
    each = malformed.select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids(True)])).alias("rule_id"), F.col("timestamp").alias("fired_at"), "line") if ids(True) else None
    gated = None
    if ids(False):
        rows = malformed.select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids(False)])).alias("rule_id"), "timestamp", "line")
        slot = F.floor(F.unix_micros("timestamp") / F.lit(SLOT_US)).cast("long")
        newest = rows.groupBy("rule_id", slot.alias("slot")).agg(F.max(F.struct("timestamp", "line")).alias("newest"))
        fired = _one_shot(rows.select("rule_id", "timestamp"), active)
        # One row per rule and slot on either side.
        at = fired.withColumn("slot", F.floor(F.unix_micros("fired_at") / F.lit(SLOT_US)).cast("long"))
        gated = at.join(newest, ["rule_id", "slot"]).select("rule_id", "fired_at", F.col("newest.line").alias("line"))
    found = each if gated is None else gated if each is None else gated.unionByName(each)
    return found.select(
        "rule_id",
        "fired_at",
        by_rule(active, lambda r: F.lit(f"Alert: {r.name}")).alias("title"),
        F.concat(F.lit(MALFORMED_TEXT), text.snippet(F.col("line"))).alias("text"),
        F.lit(MALFORMED_SEVERITY).alias("notify_severity"),
        F.array(F.lit(MALFORMED_CONDITION)).alias("conditions"),
        "line",
    )


def _one_shot(rows: DataFrame, rules: list[AlertRule]) -> DataFrame:
    counted = slots(rows, F.col("rule_id").cast("string"))
    with_rule = counted.withColumn("rule_id", F.col("gate_key").cast("long"))
    fired = fire(with_rule.withColumns(gate_settings(rules, one_shot=True)))
    return fired.select(
        F.col("gate_key").cast("long").alias("rule_id"), F.timestamp_micros("t_us").alias("fired_at"), "matches"
    )
