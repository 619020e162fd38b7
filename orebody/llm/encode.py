"""Encoding of a corpus with a public byte-level BPE vocabulary, by monoid tree reduction.

A text is halved until its parts are short; each part is encoded; neighbours are joined by
encoding a window around their border again and keeping the tokens outside it. The window grows
from the border, on either side, to the nearest place where the vocabulary's splitting pattern
ends a piece whatever stands further off: before white space that follows a visible character, or
between a letter or digit and a punctuation mark. Pieces are merged one by one, and the pattern
looks ahead only, so tokens outside such a window are the same in the whole text. Joining is
associative; decoding concatenates the bytes up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD = r"A-Za-z0-9À-ÖØ-öА-яぁ-ゖァ-ヺ一-龥"
_CERTAIN = re.compile(rf"(?<=[!-~{_WORD}])(?=[ \n\r\t])|(?<=[{_WORD}])(?=[.,;:!?()\"、。])")


class TreeEncoder:
    def __init__(self, vocabulary: str = VOCABULARY, leaf: int = 1024):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: word for word, rank in ranks.items()}
        self.leaf = max(2, leaf)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of the whole text; none for null and empty. Special tokens' strings are plain text."""
        if not text:
            return []
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.encoding.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of left + right from the ids of each."""
        return self._join(left + right, 0, len(left), len(left) + len(right), left_ids, right_ids)

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        a, keep = self._left_edge(text, start, middle, left)
        b, skip = self._right_edge(text, middle, end, right)
        return left[:keep] + self.encoding.encode_ordinary(text[a:b]) + right[skip:]

    def _left_edge(self, text: str, start: int, middle: int, ids: list[int]) -> tuple[int, int]:
        width = 32
        while True:
            low = max(start, middle - width)
            # a place counts only if the character it looks back at and the one it looks ahead to are both here
            places = [m.start() for m in _CERTAIN.finditer(text, low, middle) if start < m.start() < middle]
            for at in reversed(places):
                need, keep = len(text[at:middle].encode()), len(ids)
                while need > 0:
                    keep -= 1
                    need -= len(self.bytes_of[ids[keep]])
                if need == 0:
                    return at, keep
            if low == start:
                return start, 0
            width *= 2

    def _right_edge(self, text: str, middle: int, end: int, ids: list[int]) -> tuple[int, int]:
        width = 32
        while True:
            high = min(end, middle + width)
            for m in _CERTAIN.finditer(text, middle + 1, high):
                if not middle < m.start() < high:
                    continue
                need, skip = len(text[middle : m.start()].encode()), 0
                while need > 0:
                    need -= len(self.bytes_of[ids[skip]])
                    skip += 1
                if need == 0:
                    return m.start(), skip
            if high == end:
                return end, len(ids)
            width *= 2

    def decode_bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(self.bytes_of[i] for i in ids)
        half = len(ids) // 2
        return self.decode_bytes(ids[:half]) + self.decode_bytes(ids[half:])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(list(ids)).decode()


@lru_cache(maxsize=4)
def tree_encoder(vocabulary: str, leaf: int) -> TreeEncoder:
    return TreeEncoder(vocabulary, leaf)


def encode_corpus(df: DataFrame, *, key: str, text: str, vocabulary: str = VOCABULARY, leaf: int = 1024) -> DataFrame:
    """(key, ids) for every row: the ids of its whole text, an empty list for a null or empty one.

    One pass without a shuffle; repeated rows and null keys come out as they are; other columns are
    not read. The vocabulary is loaded once a worker.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_encoder(vocabulary, leaf)
        for batch in batches:
            ids = [tree.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["_key", "ids"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>").select(F.col("_key").alias(key), "ids")


def decode_corpus(df: DataFrame, *, key: str, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) back from ids; a null list gives a null text. Ids that end inside a character become U+FFFD."""
    rows = df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_encoder(vocabulary, 1024)
        for batch in batches:
            texts = [None if x is None else tree.decode_bytes(x).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_key", "text"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, text string").select(F.col("_key").alias(key), "text")
