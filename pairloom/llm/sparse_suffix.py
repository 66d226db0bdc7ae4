"""Repeated passages by sparse suffix arrays.

Words are runs of non-space characters with A-Z lower-cased.  Of each window of
`least` words only one position is retained as the start of a suffix: the
leftmost smallest of its `gram`-word hashes (a minimiser), which equal windows
share, wherever they stand.  Suffixes whose first `gram` words occur only once are
dropped; the others, cut where no retained window needs more, are sorted, and
neighbours in the sorted order are compared and extended to the right and the
left.  A window counts as repeated when the text around its suffix agrees with
that of another document on all of its words.  Where neighbours do not settle
all windows of a suffix, the windows of the group are compared by value, so the
result is exact: it holds every word of every passage of at least `least` words
that occurs in two documents.

Equal suffixes of one text (a line that it repeats) are one row with several places.
Groups of more than `HOT` rows with equal first words are not brought into one task:
their windows are counted by a partially aggregated grouping instead.  The result is
the same either way.

Defined results: rows of one doc_id are one document (a passage repeated only
within it does not count, nor do rows with a null doc_id); null, empty and short
texts have no passages; texts of any length are read whole; repeated rows give their
passages once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BROADCAST_IDS, binary, keep_ids, stash
from .wordhash import SPACE_WORDS, gram_hashes, word_hashes

#: Rows of suffixes with equal first words that one task compares.
HOT = 2_000
#: Groups up to this size compare all pairs where neighbours do not settle a suffix.
SMALL = 12
#: Bits of a place within a cut of a text, and windows of a cut.
_PLACE, WINDOWS = 24, 1 << 23


def _least_at(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` grams the place of the leftmost smallest (by its first 40 bits) within `grams`."""
    count = len(grams) - width + 1
    place = np.uint64(_PLACE)
    value = ((grams >> place) << place) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(value) // width) * width, np.uint64(2**64 - 1))
    padded[: len(value)] = value
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def anchors(words: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, position, first window, last window) of each retained suffix; windows by their first word."""
    grams = gram_hashes(words, gram)
    width = least - gram + 1
    count = len(grams) - width + 1
    if count <= 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    cuts = range(0, count, WINDOWS)  # places within a cut fit their bits, however long the text is
    least_at = np.concatenate([a + _least_at(grams[a : min(a + WINDOWS, count) + width - 1], width) for a in cuts])
    position, first = np.unique(least_at, return_index=True)
    last = np.append(first[1:], count) - 1
    return grams[position], position, first, last


def _gram_rows(least: int, gram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.unique(anchors(word_hashes(text.as_py(), SPACE_WORDS), least, gram)[0])
                ids.append(np.full(len(found), doc, np.int64))
                keys.append(found.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys)], schema=schema)

    return run


_SUFFIX = pa.schema([("key", pa.int64()), ("right", pa.string()), ("left", pa.string()), ("doc_id", pa.int64()), ("places", pa.list_(pa.int32())), ("low", pa.int32()), ("high", pa.int32())])
_SUFFIX_SQL = "key long, right string, left string, doc_id long, places array<int>, low int, high int"


def _suffix_rows(least: int, gram: int):
    """Suffixes of the wanted keys: low and high bound how many words before it its windows start.

    Equal ones of a text (a line that it repeats) are one row with all their places.
    """

    def made(rows: dict[tuple, list[int]]) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True)] if rows else [()] * 6
        columns.insert(4, rows.values())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _SUFFIX.types, strict=True)], schema=_SUFFIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for doc, text, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                wanted = set(keys.as_py())
                grams, position, first, last = anchors(word_hashes(data, SPACE_WORDS), least, gram)
                words = data.lower().split()
                for g, p, a, b in zip(grams.view(np.int64).tolist(), position.tolist(), first.tolist(), last.tolist(), strict=True):
                    if g in wanted:
                        right = b" ".join(words[p : b + least]).decode("utf-8", "replace")
                        left = b" ".join(words[a:p][::-1]).decode("utf-8", "replace")
                        rows.setdefault((g, right, left, doc, p - b, p - a), []).append(p)
                if len(rows) > 5_000:
                    yield made(rows)
                    rows = {}
            yield made(rows)

    return run


def merged_spans(places: list[int], backs: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(first word, end) of the windows that start between back[0] and back[1] words before each place; what overlaps is one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((p - high, p - low + least) for p in places for low, high in backs):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _common(a: array, b: array) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def repeated_windows(group: list[tuple], least: int) -> list[tuple[int, int, int]]:
    """(doc_id, first word, end) of the repeated windows of suffixes with equal first words, sorted by `right`.

    A row: right, left (from the suffix backwards), doc_id, places, low, high.
    """
    numbers: dict[str, int] = {}
    coded = lambda text: array("i", [numbers.setdefault(w, len(numbers)) for w in text.split(" ")] if text else [])
    rights, lefts = [coded(r[0]) for r in group], [coded(r[1]) for r in group]
    docs = [r[2] for r in group]
    if len(set(docs)) < 2:
        return []
    out, values = [], None

    def reach(i: int, j: int) -> range:
        """How far before the suffix the windows start that i shares with j."""
        right = _common(rights[i], rights[j])
        low, high = max(group[i][4], least - right), group[i][5]
        return range(low, min(high, _common(lefts[i], lefts[j])) + 1) if low <= high else range(0)

    def value(i: int, k: int) -> int:
        """Hash of the words of the window that starts k words before suffix i."""
        return hash((k, lefts[i][:k].tobytes(), rights[i][: least - k].tobytes()))

    def compared() -> dict[int, int]:
        """Windows by value: their document, or None for several."""
        seen: dict[int, int | None] = {}
        for i, (_, _, doc, _, low, high) in enumerate(group):
            for k in range(low, high + 1):
                v = value(i, k)
                seen[v] = doc if seen.get(v, doc) == doc else None
        return seen

    for i, (_, _, doc, places, low, high) in enumerate(group):
        shared: set[int] = set()
        for j in (i - 1, i + 1):
            if 0 <= j < len(group) and docs[j] != doc:
                shared.update(reach(i, j))
        if len(shared) < high - low + 1:
            if len(group) <= SMALL:
                for j in range(len(group)):
                    if docs[j] != doc and abs(i - j) > 1:
                        shared.update(reach(i, j))
            else:
                values = compared() if values is None else values
                shared.update(k for k in range(low, high + 1) if values[value(i, k)] is None)
        runs: list[tuple[int, int]] = []
        for k in sorted(shared):
            runs = [*runs[:-1], (runs[-1][0], k)] if runs and k == runs[-1][1] + 1 else [*runs, (k, k)]
        out += [(doc, a, b) for a, b in merged_spans(places, runs, least)]
    return out


def _compare(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _SPAN.types[k]) for k in range(3)], schema=_SPAN)

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(group) > 1:
                        out += repeated_windows(group, least)
                    key, group = k, []
                group.append(tuple(row))
            if len(out) > 20_000:
                yield made()
                out = []
        if len(group) > 1:
            out += repeated_windows(group, least)
        yield made()

    return run


_SPAN = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _spans(least: int):
    """Spans of rows (doc_id, places, back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, a, b) for doc, places, back in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a, b in merged_spans(places, [(back, back)], least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _SPAN.types[k]) for k in range(3)], schema=_SPAN)

    return run


def repeated_passages(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: int = 50, gram: int = 12, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of maximal runs of words in passages of at least `least` words that other documents hold too."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), binary(text).alias("text"))
    grams = stash(rows.mapInArrow(_gram_rows(least, gram), "doc_id long, key long"), "grams")
    common = grams.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    wanted = stash(grams.join(common, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "wanted")
    ids = wanted.select("doc_id")
    held = keep_ids(rows, "doc_id", ids, ids.count()).join(wanted, "doc_id").select("doc_id", "text", "keys")
    suffixes = stash(held.mapInArrow(_suffix_rows(least, gram), _SUFFIX_SQL), "suffixes")
    many = stash(suffixes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot")
    n_many = many.count()
    few = suffixes.join(F.broadcast(many) if n_many <= BROADCAST_IDS else many, "key", "left_anti") if n_many else suffixes
    spans = few.select("key", "right", "left", "doc_id", "places", "low", "high").repartition("key").sortWithinPartitions("key", "right").mapInArrow(_compare(least), "doc_id long, start int, end int")

    if n_many:  # hot groups: each window by its words
        window = F.explode(F.sequence("low", "high")).alias("back")
        exploded = keep_ids(suffixes, "key", many, n_many).select("key", "right", "left", "doc_id", "places", window)
        value = F.expr(f"sha2(concat_ws('|', key, back, substring_index(concat(left, ' '), ' ', back), substring_index(concat(right, ' '), ' ', {int(least)} - back)), 256)")
        windows = exploded.select(value.alias("value"), "doc_id", "places", "back")
        several = windows.groupBy("value").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("value")
        # written first: a shuffled join of two plain sides is one that adaptive execution can split where a window is hot
        several = stash(several, "several")
        several = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
        spans = spans.union(windows.join(several, "value", "left_semi").select("doc_id", "places", "back").mapInArrow(_spans(least), "doc_id long, start int, end int"))

    spans = stash(spans.distinct(), "spans")
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.withColumn("opens", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    merged = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
