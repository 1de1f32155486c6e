"""Byte-level BPE with a local rank file: encode whole texts, decode to raw bytes."""

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches, without

# White space as the pattern's engine defines it (Unicode White_Space).
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE_CHARS = 1 << 16
LONG_RUN = 4096
_EDGE = regex.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_RUN = regex.compile(f"[{SPACE}]{{{LONG_RUN},}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tokenizer of a rank file; one per worker process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where white space follows something else.

    No match of the pattern covers such a place: white space stands only first in a match or in
    a match of nothing else. So the pieces' matches are those of the text.
    """
    start = 0
    while len(text) - start > size:
        edge = _EDGE.search(text, start + size)
        if edge is None:
            break
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]


def _plain(enc, text: str) -> list[np.ndarray]:
    return [enc.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(text)]


def encode(enc, text: str) -> np.ndarray:
    """Token ids of a whole text, of any length.

    A run of white space is one match without its last character if something follows. Very
    long runs are passed as that one match, as the regex engine would exhaust its stack on them.
    Both this and the safe places hold for the pattern of ``public_tokenizers``; with another
    pattern a text is encoded uncut.
    """
    if enc._pat_str != public_tokenizers.PATTERN:
        return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    parts: list[np.ndarray] = []
    start = 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > start:
            parts += _plain(enc, text[start : run.start()])
        parts.append(np.asarray(enc._encode_single_piece(text[run.start() : end]), dtype=np.uint32))
        start = end
    if start < len(text):
        parts += _plain(enc, text[start:])
    return np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)


def tokenize(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Add ``token_ids`` (array<int>) and ``decoded`` (the bytes the ids stand for).

    One pass without a shuffle; a null text counts as empty. Special tokens are never produced.
    Columns of these names are replaced. The rank file must exist on every executor.
    """
    small_batches(docs.sparkSession, 256)

    @pandas_udf("token_ids array<int>, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(rank_file, pattern)
        for texts in batches:
            ids = [encode(enc, t) if t else np.zeros(0, np.int32) for t in texts]
            yield pd.DataFrame({"token_ids": ids, "decoded": [enc.decode_bytes(i.tolist()) if len(i) else b"" for i in ids]})

    kept = without(docs, "token_ids", "decoded", "_bpe")
    return kept.withColumn("_bpe", run(F.col(text_col))).select(*[F.col(f"`{c}`") for c in kept.columns], "_bpe.token_ids", "_bpe.decoded")


def digests(tokenized: DataFrame, id_col: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of tokenized rows, and the columns of ``extra``."""
    return tokenized.select(
        F.col(id_col),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(extra or []),
    )
