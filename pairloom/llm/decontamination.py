"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z
lower-cased.  The patterns are all windows of `window` consecutive words of the
benchmark items; an item of fewer words, but not none, is one pattern.  For each
pattern length, a table over hashed blocks of two words (one for one-word
patterns) holds how far the search may move; where it says 0, the bucket of the
block's hash holds the patterns that end so, and their words are compared one by
one.  The benchmark is read in parts of `PART_WINDOWS` windows.  One part is sent to
the tasks at a time: where there are several, the hits so far are written to the
shared folder with the rows, and the next part adds its own, so neither a task nor the
plan grows with the benchmark.  (The driver holds one part and one item's text.)

Defined results: a null or empty text or item has no words, and items of a null id
count for nothing; equal windows of several items, and several rows of one item, count
for each item once; texts of any length are searched whole; repeated rows each come
out; an empty benchmark hits nothing, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import binary, fresh, stash
from .wordhash import _STEP, ALNUM_WORDS, hash_spans, mix, spans

#: Benchmark windows that are searched for at once (some 400 bytes each in a task).
PART_WINDOWS = 400_000
_BITS = 18

FOUND = "struct<n_words:long,hit:binary,items:array<long>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.int64()))])


def words_of(text: bytes | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    data = (text or b"").lower()
    return (data, *spans(data, ALNUM_WORDS))


class WuManber:
    """Patterns of one length: tuples of words (bytes) and the items that each stands for."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block = length, min(2, length)
        self.patterns = list(patterns.items())
        text = b" ".join(b" ".join(p) for p, _ in self.patterns)
        hashes = self._blocks(hash_spans(text, *spans(text, ALNUM_WORDS)))
        self.shift = np.full(1 << _BITS, length - self.block + 1, np.uint8 if length < 250 else np.int64)
        self.buckets: dict[int, list[int]] = {}
        for k in range(len(self.patterns)):
            own = hashes[k * length : k * length + length - self.block + 1]
            slots = own & np.uint64((1 << _BITS) - 1)
            np.minimum.at(self.shift, slots.astype(np.int64), np.arange(len(own))[::-1].astype(self.shift.dtype))
            self.buckets.setdefault(int(own[-1]), []).append(k)

    def _blocks(self, words: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return words
        return mix(words[:-1] * _STEP[0] + words[1:] * _STEP[1])

    def search(self, data: bytes, start: np.ndarray, end: np.ndarray, words: np.ndarray, hit: np.ndarray, items: set[int]) -> None:
        """Mark in `hit` the words of all occurrences and add their items."""
        if len(words) < self.length:
            return
        blocks = self._blocks(words)
        shifts = self.shift[(blocks & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
        back = self.length - self.block
        if not (shifts[back:] == 0).any():
            return
        move, at, last = shifts.tolist(), back, len(shifts)
        while at < last:
            if move[at]:
                at += move[at]
                continue
            for k in self.buckets.get(int(blocks[at]), ()):
                pattern, own = self.patterns[k]
                first = at - back
                if all(data[start[first + i] : end[first + i]] == word for i, word in enumerate(pattern)):
                    hit[first : first + self.length] = True
                    items.update(own)
            at += 1


def _parts(benchmark: DataFrame, window: int) -> Iterator[list[WuManber]]:
    """Searchers for the benchmark, in parts of bounded size; at least one."""
    found: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    size = 0
    for item, text in benchmark.toLocalIterator():
        data, start, end = words_of(bytes(text) if text is not None else None)
        length = min(window, len(start))
        for k in range(len(start) - length + 1 if len(start) else 0):
            if size == PART_WINDOWS:
                yield [WuManber(n, p) for n, p in sorted(found.items())]
                found, size = {}, 0
            words = tuple(data[a:b] for a, b in zip(start[k : k + length].tolist(), end[k : k + length].tolist(), strict=True))
            owners = found.setdefault(length, {}).setdefault(words, set())
            if item not in owners:
                owners.add(item)
                size += 1
    yield [WuManber(n, p) for n, p in sorted(found.items())]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, into: str = "contamination") -> DataFrame:
    """`docs` with a column `into`: struct(n_words, hit, items).

    hit has one byte (0 or 1) for each word, items the sorted ids of the items
    with an occurring window.  A column of that name in `docs` is replaced.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long"), binary(item_text))

    def searcher(held):
        @F.arrow_udf(FOUND)
        def search(texts: pa.Array, before: pa.Array) -> pa.Array:
            sizes, hits, found = [], [], []
            for value, earlier in zip(texts, before, strict=True):
                data, start, end = words_of(value.as_py())
                hit, ids = np.zeros(len(start), bool), set()
                if earlier.is_valid:
                    hit |= np.frombuffer(earlier["hit"].as_py(), bool)
                    ids.update(earlier["items"].as_py())
                words = hash_spans(data, start, end)
                for one in held.value:
                    one.search(data, start, end, words, hit, ids)
                sizes.append(len(start))
                hits.append(hit.tobytes())
                found.append(sorted(ids))
            arrays = [pa.array(sizes, pa.int64()), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            return pa.StructArray.from_arrays(arrays, fields=list(_FOUND))

        return search

    out = docs.withColumn(into, F.lit(None).cast(FOUND))
    last = None
    for part in _parts(items, window):
        if last is not None:
            out = stash(out, "hits")
            last.destroy()
        last = spark.sparkContext.broadcast(part)
        out = out.withColumn(into, searcher(last)(binary(text), F.col(into)))
    return out


def hit_count(found: Column) -> Column:
    return F.length(F.translate(F.hex(found["hit"]), "0", "")).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that hold a benchmark window; its columns stay."""
    (into,) = fresh(docs, "_contamination")
    return benchmark_hits(docs, benchmark, into=into, **options).where(F.size(F.col(into)["items"]) == 0).drop(into)
