"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its
reply is trainable. Turn markers inside texts are escaped by a backslash after their first
character (one more where backslashes stand there already), so no text can forge a turn and
every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches

BEGIN, END = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
SYSTEM_OPEN, SYSTEM_CLOSE = "<<SYS>>", "<</SYS>>"
OTHER_OPEN, OTHER_CLOSE = "[ROLE=", "[/ROLE]"
CONTROLS = [BEGIN, END, USER_OPEN.strip(), USER_CLOSE.strip(), SYSTEM_OPEN, SYSTEM_CLOSE, OTHER_OPEN, OTHER_CLOSE]

_PLAIN = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in sorted(CONTROLS, key=len, reverse=True)))

EXAMPLE_SCHEMA = "conv_id long, example long, text string, loss_start long, loss_end long, closing boolean"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "".join(g for g in m.groups() if g is not None)[:1] + "\\" + m.group(0)[1:], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m.group(0)[0] + m.group(0)[2:] if m.group(0)[1] == "\\" else m.group(0), text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn as formatted text, with the span of the escaped text in it."""
    body = escape(text)
    if role == "assistant":
        head, tail = "", END
    elif role == "user":
        head, tail = USER_OPEN, USER_CLOSE
    elif role == "system":
        head, tail = SYSTEM_OPEN, SYSTEM_CLOSE
    else:
        head, tail = f"{OTHER_OPEN}{quote(role, safe='')}]", OTHER_CLOSE
    return f"{head}{body}{tail}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read (role, text) turns back from a formatted text."""
    turns, at = [], len(BEGIN)
    if not formatted.startswith(BEGIN):
        raise ValueError("not a formatted conversation")
    while at < len(formatted):
        if formatted.startswith(USER_OPEN, at):
            role, start, close = "user", at + len(USER_OPEN), USER_CLOSE
        elif formatted.startswith(SYSTEM_OPEN, at):
            role, start, close = "system", at + len(SYSTEM_OPEN), SYSTEM_CLOSE
        elif formatted.startswith(OTHER_OPEN, at):
            end = formatted.index("]", at)
            role, start, close = unquote(formatted[at + len(OTHER_OPEN) : end]), end + 1, OTHER_CLOSE
        else:
            role, start, close = "assistant", at, END
        end = formatted.index(close, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(close)
    return turns


def _examples(turns: Iterator[tuple[int, str, str, bool]]) -> Iterator[tuple]:
    """Examples of consecutive turns (conversation, role, text, last of it)."""
    prefix, example = BEGIN, 0
    for conv, role, text, last in turns:
        body, start, end = render(role, text)
        at, prefix = len(prefix), prefix + body
        if role == "assistant":
            yield conv, example, prefix, at + start, at + end, last
            example += 1
        elif last:
            yield conv, example, prefix, None, None, True
        if last:
            prefix, example = BEGIN, 0


def expand(conversations: DataFrame) -> DataFrame:
    """Examples (conv_id, example, text, loss_start, loss_end, closing) of rows (conv_id, turn, role, text).

    A conversation that doesn't end with an assistant turn also gives a closing example of all its
    turns with nothing trainable. Null texts and roles are empty, rows are taken by turn (nulls
    first; ties by role and text), rows of a null conv_id form one conversation, other columns are
    ignored. One shuffle by conversation; a task streams through sorted rows and holds one
    conversation's formatted prefix and a bounded batch of examples.
    """
    small_batches(conversations.sparkSession, 512)
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    marked = rows.withColumn("last", F.lead(F.lit(1)).over(by).isNull()).select("conv_id", "role", "text", "last")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "example", "text", "loss_start", "loss_end", "closing"]

        def turns():
            for batch in batches:
                ids = [None if pd.isna(c) else int(c) for c in batch["conv_id"]]
                yield from zip(ids, batch["role"], batch["text"], batch["last"].tolist())

        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

        held, size = [], 0
        for row in _examples(turns()):
            held.append(row)
            size += len(row[2])
            if size > 1 << 22:
                yield frame(held)
                held, size = [], 0
        if held:
            yield frame(held)

    # The window leaves the rows of a conversation together and in order; the streaming pass relies on that alone.
    return marked.mapInPandas(run, EXAMPLE_SCHEMA)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, their digest, the trainable text's digest, sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, loss_chars, chars = hashlib.sha256(), 0, 0
        for batch in batches:
            out = []
            for conv, text, start, end, closing in zip(batch["conv_id"], batch["text"], batch["loss_start"], batch["loss_end"], batch["closing"]):
                chars += len(text)
                if not pd.isna(start):
                    reply = unescape(text[int(start) : int(end)])
                    loss.update(reply.encode())
                    loss_chars += len(reply)
                if closing:
                    turns = parse(text)
                    whole = hashlib.sha256()
                    for role, said in turns:
                        whole.update(f"{role}\n{said}\n".encode())
                    out.append((None if pd.isna(conv) else int(conv), len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    loss, loss_chars, chars = hashlib.sha256(), 0, 0
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield frame.astype({"conv_id": "Int64"})

    # Examples of a conversation come one after another from expand(); there is no shuffle in between.
    return examples.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
