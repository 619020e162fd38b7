"""Evaluation texts that leak into a corpus, by edit-distance embedding and bit sampling.

Passages and documents become word sequences. Every window of `window` words of a passage (the
whole passage if it is shorter) is embedded by the random walk of Chakraborty, Goldenberg and
Koucký (2016): the walk copies the symbol under its head and moves on or stays by a random bit of
step and symbol, so that windows few edits apart get outputs few positions apart. Keys sampled from
some output positions go into hash tables; windows of the corpus are embedded and looked up in the
same way; windows that meet are verified by their true edit distance. Equal windows have equal
outputs, so with no edits allowed one table finds all of them. With edits, a window of the corpus
has as many words more as may be inserted, and what counts is its best beginning. It is embedded only
where it can match at all: of a window cut into one part more than edits, one part stands unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BREAK = -2


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


class LeakIndex:
    """Windows of a block of passages in `tables` hash tables a length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, edits: int, tables: int, sampled: int, seed: int):
        rng = np.random.default_rng(seed)
        self.ids: list = []
        self.vocabulary: dict[str, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, passage in items:
            found = words_of(passage)
            if not found:
                continue
            self.ids.append(item)
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]
            n = min(window, len(codes))
            for k in range(len(codes) - n + 1):
                by_length.setdefault(n, {}).setdefault(tuple(codes[k : k + n]), set()).add(len(self.ids) - 1)
        symbols = len(self.vocabulary) + 2  # the last two: a word of no passage, the end
        self.mix = rng.integers(1, 1 << 62, window + 1, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.lengths: dict[int, dict] = {}
        for n, windows in by_length.items():
            texts = np.array(list(windows), dtype=np.int32).reshape(len(windows), n)
            owners = [np.fromiter(o, np.int64) for o in windows.values()]
            allowed = min(edits, n // 4)
            entry = {"texts": texts, "owners": np.concatenate(owners), "starts": np.cumsum([0, *map(len, owners)]), "first": np.isin(np.arange(symbols), texts[:, 0]), "tables": [], "edits": allowed}
            part = entry["part"] = n // (allowed + 1)
            if allowed:
                entry["parts"] = np.unique(np.concatenate([self._grams(texts[:, k * part : (k + 1) * part].astype(np.int64)) for k in range(allowed + 1)]))
            # with edits the walk must not pass the shorter text's end before the last sampled position
            steps = 3 * n if not allowed else max(2, 3 * (n - allowed) // 2)
            for t in range(tables if allowed else 1):
                bits = rng.integers(0, 2, (steps, symbols), dtype=np.int8)
                # position 0 is always the first word: it lets most windows be dropped before the walk
                spots = np.zeros(steps, bool)
                spots[rng.choice(np.arange(steps), min(sampled, steps), replace=False)] = True
                if not allowed:
                    spots[0] = True
                mix = rng.integers(1, 1 << 62, steps, dtype=np.int64).astype(np.uint64) | np.uint64(1)
                keys = self._keys(texts, bits, spots, mix)
                order = np.argsort(keys, kind="stable")
                entry["tables"].append((bits, spots, mix, keys[order], order))
            self.lengths[n] = entry

    def _grams(self, rows: np.ndarray) -> np.ndarray:
        """A hash of each row."""
        key = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            key += (rows[:, k] + 3).astype(np.uint64) * self.mix[k]
        return key

    @staticmethod
    def _keys(texts: np.ndarray, bits: np.ndarray, spots: np.ndarray, mix: np.ndarray) -> np.ndarray:
        """Hash of the sampled positions of each window's walk."""
        count, n = texts.shape
        end = bits.shape[1] - 1
        padded = np.hstack([texts, np.full((count, 1), end, np.int32)])
        row, head = np.arange(count), np.zeros(count, np.int64)
        key = np.zeros(count, np.uint64)
        for step in range(int(np.flatnonzero(spots)[-1]) + 1):
            symbol = padded[row, head]
            if spots[step]:
                key += (symbol.astype(np.uint64) + np.uint64(1)) * mix[step]
                key ^= key >> np.uint64(29)
            head = np.minimum(head + bits[step][symbol], n)
        return key

    def matches(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in `codes`, number of the item) of windows that lie within the allowed edits of a passage's."""
        unknown = np.concatenate([[0], np.cumsum(codes < 0)])
        other, end = len(self.vocabulary), len(self.vocabulary) + 1
        for n, entry in self.lengths.items():
            allowed, part = entry["edits"], entry["part"]
            if len(codes) < part:
                continue
            start = np.flatnonzero(unknown[part:] == unknown[:-part])  # no break and no unknown word
            if not allowed:
                start = start[entry["first"][codes[start]]]
                texts = codes[start[:, None] + np.arange(n)].astype(np.int32)
            else:
                key = np.zeros(len(start), np.uint64)
                for k in range(part):
                    key += (codes[start + k] + 3).astype(np.uint64) * self.mix[k]
                at = np.minimum(np.searchsorted(entry["parts"], key), len(entry["parts"]) - 1)
                start = start[entry["parts"][at] == key]
                # an unchanged part stands where it stood in the passage, give or take the edits before it
                start = np.unique((start[:, None] - (np.arange(allowed + 1)[:, None] * part + np.arange(-allowed, allowed + 1)).ravel()).ravel())
                start = start[(start >= 0) & (start < len(codes))]
                place = start[:, None] + np.arange(n + allowed)
                texts = np.where(place < len(codes), codes[np.minimum(place, len(codes) - 1)], _BREAK).astype(np.int32)
                over = np.cumsum(texts == _BREAK, axis=1) > 0  # what follows is another document's
                texts[over] = end
                texts[texts < 0] = other
            if not len(start):
                continue
            found: list[np.ndarray] = []
            for bits, spots, mix, keys, order in entry["tables"]:
                own = self._keys(texts, bits, spots, mix)
                low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                hit = np.flatnonzero(high > low)
                many = (high - low)[hit]
                mine = np.repeat(hit, many)
                theirs = order[np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                found.append(mine * len(entry["texts"]) + theirs)
            mine, theirs = np.divmod(np.unique(np.concatenate(found)), len(entry["texts"]))
            near = self._near(texts[mine], entry["texts"][theirs], allowed)
            mine, theirs = mine[near], theirs[near]
            count = (entry["starts"][theirs + 1] - entry["starts"][theirs]).astype(np.int64)
            at = np.repeat(entry["starts"][theirs], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield start[np.repeat(mine, count)], entry["owners"][at]

    @staticmethod
    def _near(a: np.ndarray, b: np.ndarray, allowed: int) -> np.ndarray:
        """Whether a beginning of each row of `a` is within the allowed edits of the row of `b`."""
        if not allowed:
            return (a == b).all(axis=1)
        n, m = b.shape[1], a.shape[1]
        row = np.tile(np.arange(m + 1, dtype=np.int16), (len(a), 1))
        for i in range(1, n + 1):
            new = np.minimum(row + 1, np.int16(1 << 14))
            new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (a != b[:, i - 1 : i]))
            for j in range(1, m + 1):
                new[:, j] = np.minimum(new[:, j], new[:, j - 1] + 1)
            row = new
        return row[:, n - allowed : m + 1].min(axis=1) <= allowed


def _blocks(items: DataFrame, item: str, passage: str, size: int) -> Iterator[list[Row]]:
    """Distinct items in blocks of about `size`, so that what is sent to the tasks stays bounded."""
    rows = items.where(F.col(item).isNotNull() & F.col(passage).isNotNull()).select(F.col(item).alias("i"), F.col(passage).alias("p")).distinct()
    blocks = -(-max(1, rows.count()) // size)
    for k in range(blocks):
        yield (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)).collect()


def find_leaks(documents: DataFrame, items: DataFrame, *, doc: str, text: str, item: str, passage: str, window: int = 12, edits: int = 0, tables: int | None = None, sampled: int | None = None, block: int = 20_000, seed: int = 5) -> DataFrame:
    """(doc, item) of documents that hold `window` words in a row of a passage, or all of a shorter one.

    `edits` words, and at most a quarter of them, may be inserted, dropped or replaced within a window;
    0 asks for equal words and finds every case with one table. Otherwise each of `tables` tables finds
    a window by chance, and recall is what the tests measure. Null and empty texts and passages, and passages without a word,
    match nothing; null keys are left out; repeated rows count once; other columns are not read.

    The corpus is scanned once for each block of passages, without a shuffle but for the result; whole
    texts are searched, and nothing about documents is gathered on the driver.
    """
    tables = tables or 16
    sampled = sampled or (6 if not edits else 3)
    rows = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text"))
    kinds = rows.schema["_doc"].dataType.simpleString(), items.schema[item].dataType.simpleString()
    found: DataFrame | None = None
    for some in _blocks(items, item, passage, block):
        index = rows.sparkSession.sparkContext.broadcast(LeakIndex([(r["i"], r["p"]) for r in some], window, edits, tables, sampled, seed))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            owners = pa.array(known.ids, type=None) if known.ids else None
            get = known.vocabulary.get
            for batch in batches:
                if owners is None:
                    continue
                codes: list[int] = []
                begins: list[int] = []
                for t in batch.column(1).to_pylist():
                    begins.append(len(codes))
                    codes += [get(w, -1) for w in words_of(t)]
                    codes.append(_BREAK)
                pairs = [np.stack([np.searchsorted(begins, at, "right") - 1, who]) for at, who in known.matches(np.array(codes, np.int64)) if len(at)]
                if pairs:
                    both = np.unique(np.hstack(pairs), axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both[0])), owners.take(pa.array(both[1]))], names=["_doc", "_item"])

        part = rows.mapInArrow(scan, f"_doc {kinds[0]}, _item {kinds[1]}")
        found = part if found is None else found.unionByName(part)
    return found.distinct().select(F.col("_doc").alias(doc), F.col("_item").alias(item))
