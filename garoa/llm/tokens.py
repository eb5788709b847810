"""Token counts of whole texts: batches balanced by bytes, long texts split at safe boundaries."""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garoa.llm.shared import row_udf

BATCH_BYTES = 8 << 20
ENCODE_BYTES = 1 << 20
#: Bytes of the pieces whose lengths a worker remembers; beyond it the memory starts afresh.
REMEMBERED_BYTES = 96 << 20
#: Longer pieces rarely come again and are not remembered.
REMEMBERED_CHARS = 64
_ENTRY_BYTES = 150

#: Pieces that end before a single space between two non-space characters. A byte-level
#: pre-tokenizer always begins a word at such a space, so no token crosses it, and special strings
#: hold no space: the tokens of a text are those of its pieces. Other white space stays inside.
PIECE = re.compile(r"(?: ?\S+|\s+\S*)(?:(?! \S)\s+\S*)*")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Remembered(dict[str, int]):
    """Lengths of short pieces, bounded by their bytes and those of their entries."""

    held = 0

    def add(self, pieces: list[str], lengths: list[int]) -> None:
        if self.held > REMEMBERED_BYTES:
            self.clear()
            self.held = 0
        short = {p: n for p, n in zip(pieces, lengths, strict=True) if len(p) <= REMEMBERED_CHARS}
        self.held += sum(map(len, map(str.encode, short))) + _ENTRY_BYTES * len(short)
        self.update(short)


@cache
def _remembered(path: str) -> Remembered:
    return Remembered()


def _encode(path: str, pieces: list[str]) -> list[int]:
    """Lengths of pieces, encoded in batches of about equal bytes."""
    tokenizer, begin, size, out = _tokenizer(path), 0, 0, []
    for end, piece in enumerate(pieces, 1):
        size += len(piece.encode())
        if size >= ENCODE_BYTES or end == len(pieces):
            found = tokenizer.encode_batch_fast(pieces[begin:end], add_special_tokens=False)
            out.extend(map(len, found))
            begin, size = end, 0
    return out


def count_tokens(path: str, texts: list[str | None]) -> list[int]:
    """Tokens of each text; null is empty. Equal pieces of the texts are encoded once, short ones once a worker."""
    memory = _remembered(path)
    split = [Counter(PIECE.findall(text or "")) for text in texts]
    distinct = set().union(*split)
    known = {piece: memory[piece] for piece in distinct if piece in memory}
    new = list(distinct.difference(known))
    lengths = _encode(path, new)
    known.update(zip(new, lengths, strict=True))
    memory.add(new, lengths)
    return [sum(n * known[piece] for piece, n in pieces.items()) for pieces in split]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs(doc_id, text, ...)``.

    ``path`` is a byte-level vocabulary file of the tokenizers library, present
    on every executor. No begin, end or added special tokens, no truncation or
    padding; special strings inside texts count as the library's default has
    them. A null text is empty: 0 bytes, 0 tokens. Repeated rows are counted
    each; other columns are ignored; an empty table gives an empty result.
    """

    @row_udf(T.LongType(), BATCH_BYTES)
    def lengths(column: pa.Array) -> pa.Array:
        return pa.array(count_tokens(path, column.to_pylist()), pa.int64())

    counted = docs.select("doc_id", "text", lengths("text").alias("n_tokens"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
