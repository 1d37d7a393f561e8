"""Problem 8: token ids of every document by a public byte-level BPE vocabulary.

A text is split by the vocabulary's own pattern; each piece is encoded by merge ranks. Pieces that the pattern leaves long
(no white space for thousands of bytes) are encoded by tree concatenation: both halves are encoded on their own, in parallel
near the root of the tree, then a window that grows around the join is encoded anew until its first and last tokens are
those the halves had there. A sequence of BPE tokens is the encoding of its bytes exactly if every two neighbours stay as
they are when encoded together, so what lies outside an agreeing window is right already.

Null and empty texts have the defined ids []. Ids come as arrays of int in text order.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 2048
PARALLEL = 1 << 16


class TreeEncoder:
    """Encodes texts by the ranks in a vocabulary file."""

    def __init__(self, path: str = VOCABULARY, long: int = LONG):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._bytes = {v: k for k, v in ranks.items()}
        self._coder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(PATTERN)
        self._unsplit = regex.compile(r"\S{%d,}|\s{%d,}" % (long // 4, long // 4))
        self.long = max(2, long)

    def _piece(self, piece: bytes) -> list[int]:
        return list(self._coder._encode_single_piece(piece))

    def _text_of(self, ids: list[int]) -> bytes:
        return b"".join(self._bytes[i] for i in ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of both byte strings as one, from the ids of each."""
        if not left or not right:
            return left + right
        width = 1
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            old = left[len(left) - a :] + right[:b]
            new = self._piece(self._text_of(old))
            left_agrees = a == len(left) or (a > 1 and new[0] == old[0]) or new == old
            right_agrees = b == len(right) or (b > 1 and new[-1] == old[-1]) or new == old
            if left_agrees and right_agrees:
                return left[: len(left) - a] + new + right[b:]
            width *= 2

    def tree(self, piece: bytes, pool: ThreadPoolExecutor | None = None) -> list[int]:
        if len(piece) <= self.long:
            return self._piece(piece)
        half = len(piece) // 2
        if pool is not None and len(piece) >= PARALLEL:
            later = pool.submit(self.tree, piece[half:])
            return self.join(self.tree(piece[:half]), later.result())
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) < self.long // 4 or not self._unsplit.search(text):
            return self._coder.encode_ordinary(text)
        ids: list[int] = []
        with ThreadPoolExecutor(2) as pool:
            for m in self._split.finditer(text):
                piece = m.group().encode()
                ids += self.tree(piece, pool) if len(piece) > self.long else self._piece(piece)
        return ids


@lru_cache(2)
def encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row, in one pass without a shuffle; extra columns are left out, repeated rows stay."""
    kind = df.schema[id_column].dataType.simpleString()

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "ids": [code.encode(t) for t in b["t"]]})

    picked = df.select(F.col(id_column).alias("k"), F.col(text_column).cast("string").alias("t"))
    return picked.mapInPandas(ids, f"k {kind}, ids array<int>").select(F.col("k").alias(id_column), "ids")
