"""Exact Jaccard join of word-shingle sets with signature trees.

Documents link when 100 * |A n B| >= percent * |A u B|, the sets holding
distinct n-word shingles (A-Z lower-cased; a text of fewer words is one
shingle; a null text or one without words has an empty set and no links).

1. Equal sets are one class (grouped by a 128-bit digest of the set).
2. Signature trees find the links of close families.  Classes meet in the cells of
   their minima under a few hash orders; a cell is dealt by a hash into blocks of
   bounded size, and each block has a signature tree: every node holds the OR of its
   members' token bitmaps and its size range, and a dual traversal of the tree with
   itself drops node pairs whose largest possible overlap is too small.  Of the pairs
   that are left a forest over the block, the likeliest first, is compared on whole
   sets.  Each order deals a family anew, so its blocks grow together, at a cost that
   is linear in the rows however large a family is.
3. Signature trees find exactly what is still apart.  Classes meet in the cells of
   their prefix shingles (two sets that link share one); cells, blocks and block pairs
   within one component need no search, nor do sizes out of reach of each other.  In
   large cells (near copies by the hundred) the bitmaps come from the whole sets and
   have a bit for each shared token, so a leaf pair that is left is a link; of these
   only as many go on as join the cell's components.  What the hashed bitmaps of small
   cells leave is compared on whole sets.
4. All links are closed to connected components.
5. Steps 2 and 3 find as many links as join the components.  All links lie within
   components, so those of each document are counted there, on whole sets: block
   against block of a component, by exact bitmaps, with counts as the only output.

The order of the shingles, which decides prefixes, puts the most frequent ones
last; they are found by counts within each task and bounded to `FREQUENT`
values, and any choice of them gives the same links.  Cells of shingles that such
counts show to be hot are cut into blocks by their counts of each size, so that no
task ever sorts all rows of one.  Blocks are bounded in rows and in shingles.

Defined results: repeated rows each come out; rows of one doc_id with different
texts count as one node, which joins whatever any of them links with; a null doc_id
comes out with its own n_shingles and a null component_id; ties need no rule, links
being symmetric; texts of any length are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import BROADCAST_IDS, binary, released, stash
from .wordhash import _STEP, mix, shingle_set

#: Hash orders whose minima make the cells of step 2, and rows of one block of these.
ORDERS, FAMILY = 3, 128
#: Rows and shingles of one block of a cell.
BLOCK, BLOCK_SHINGLES = 1024, 524_288
#: A shingle that the tasks' counts show this often has its cell cut by counts.
HOT_CELL = 1024
#: At most so many shingles are moved to the end of the order (8 bytes each, sent to every task).
FREQUENT = 262_144
#: A task reports shingles that it saw this often.
SEEN = 2
#: In the choice of `FREQUENT` shingles, numbers of times below this are told apart; larger ones by 64 steps for each doubling.
PLAIN_TIMES = 1024
#: Documents of one block of a unit in which pairs are compared on whole sets.
UNIT = 256
#: Children of a tree node.
FAN = 4
#: Cells of more rows are searched on whole sets in place, smaller ones by hashed bitmaps and a comparison of what these leave.
LARGE = 64


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Prefix of a set of n as the larger and as the smaller of a linked pair."""
    return n - _ceil(percent * n, 100) + 1, n - _ceil(2 * percent * n, 100 + percent) + 1


def least_overlap(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection at which sets of these sizes link."""
    return -((-percent * (na + nb)) // (100 + percent))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Token bitmap of a power of two of bits, two to four for each token: a node's spare counts what collides."""
    bits = 64
    while bits < 2 * len(tokens):
        bits *= 2
    flags = np.zeros(bits, bool)
    flags[tokens & np.uint64(bits - 1)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (one per row) ORed down to `size` 64-bit words."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


class SignatureTree:
    """Nodes level by level over rows in the order given; level 0 has a node for each row."""

    def __init__(self, sizes: np.ndarray, groups: np.ndarray, maps: np.ndarray, exact: bool = False):
        """`exact`: each token that two rows share has a bit of its own, so none is to spare for collisions."""
        ones = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        level = {"map": maps, "low": sizes, "high": sizes, "spare": sizes - sizes if exact else sizes - ones, "group": groups}
        self.levels = [level]
        while len(level["low"]) > FAN:
            cut = np.arange(0, len(level["low"]), FAN)
            first = np.minimum.reduceat(level["group"], cut)
            level = {
                "map": np.bitwise_or.reduceat(level["map"], cut, axis=0),
                "low": np.minimum.reduceat(level["low"], cut),
                "high": np.maximum.reduceat(level["high"], cut),
                "spare": np.maximum.reduceat(level["spare"], cut),
                "group": np.where(first == np.maximum.reduceat(level["group"], cut), first, -1),
            }
            self.levels.append(level)


def dual_traversal(left: SignatureTree, right: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, largest possible overlap) of the pairs that the bounds on overlap and size leave.

    Pairs within one group are left out (group -1: mixed); of a tree with itself each pair comes once.
    """
    same = left is right
    depth = max(len(left.levels), len(right.levels)) - 1
    at = lambda tree, d: tree.levels[min(d, len(tree.levels) - 1)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(at(left, depth)["low"])), np.arange(len(at(right, depth)["low"])), indexing="ij"))
    while True:
        x, y = at(left, depth), at(right, depth)
        keep = (x["group"][a] < 0) | (x["group"][a] != y["group"][b])
        keep &= (100 * x["high"][a] >= percent * y["low"][b]) & (100 * y["high"][b] >= percent * x["low"][a])
        if same:
            keep &= a <= b
        a, b = a[keep], b[keep]
        bound = np.zeros(len(a), np.int64)
        for cut in range(0, len(a), 4096):
            i, j = a[cut : cut + 4096], b[cut : cut + 4096]
            bound[cut : cut + 4096] = np.bitwise_count(x["map"][i] & y["map"][j]).sum(axis=1) + np.minimum(x["spare"][i], y["spare"][j])
        keep = bound >= least_overlap(x["low"][a], y["low"][b], percent)
        a, b, bound = a[keep], b[keep], bound[keep]
        if depth == 0:
            return a, b, bound
        depth -= 1

        def children(nodes: np.ndarray, tree: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
            if depth >= len(tree.levels) - 1:
                return nodes[:, None], np.ones((len(nodes), 1), bool)
            down = nodes[:, None] * FAN + np.arange(FAN)
            return down, down < len(tree.levels[depth]["low"])

        (ca, oka), (cb, okb) = children(a, left), children(b, right)
        ok = (oka[:, :, None] & okb[:, None, :]).ravel()
        shape = (len(a), ca.shape[1], cb.shape[1])
        a = np.broadcast_to(ca[:, :, None], shape).ravel()[ok]
        b = np.broadcast_to(cb[:, None, :], shape).ravel()[ok]


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Which pairs (a, b) make a spanning forest of them, the heaviest first (each part takes its best pair in turn)."""
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, -weight))] = np.arange(len(a))
    label, chosen, left = np.arange(rows), np.zeros(len(a), bool), np.arange(len(a))
    by_rank = np.argsort(rank)
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return chosen
        best = np.full(rows, len(a))
        np.minimum.at(best, x, rank[left])
        np.minimum.at(best, y, rank[left])
        own = by_rank[np.unique(best[best < len(a)])]
        chosen[own] = True
        for p, q in zip(label[a[own]].tolist(), label[b[own]].tolist(), strict=True):
            while label[p] != p:
                p = int(label[p])
            while label[q] != q:
                q = int(label[q])
            label[max(p, q)] = min(p, q)
        while (label[label] != label).any():
            label = label[label]


def _profiles(n: int, percent: int):
    """Rows for each document (kind 0) and for shingles that one task saw often (kind 1)."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64())), ("map", pa.binary())])
    factors = np.array([_STEP[k] for k in range(ORDERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0
        often: dict[int, int] = {}

        def count() -> None:
            if seen:
                values, counts = np.unique(np.concatenate(seen), return_counts=True)
                for v, c in zip(values[counts >= SEEN].tolist(), counts[counts >= SEEN].tolist(), strict=True):
                    often[v] = often.get(v, 0) + c
                seen.clear()

        for batch in batches:
            ids, sizes, sigs, keys, maps = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingle_set(text.as_py(), n)
                ids.append(doc)
                sizes.append(len(tokens))
                if len(tokens):
                    sigs.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    keys.append([int(mix(tokens * f).min().view(np.int64)) for f in factors])
                    maps.append(bitmap(tokens).tobytes())
                    part = tokens[: prefix_lengths(len(tokens), percent)[0]]
                    seen.append(part)
                    held += len(part)
                else:
                    sigs.append(None)
                    keys.append([])
                    maps.append(None)
                if held > 2_000_000:
                    count()
                    held = 0
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int8()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary())], schema=schema)
        count()
        if often:
            values = np.fromiter(often, np.uint64, len(often)).view(np.int64)
            k = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int8()), pa.array(values), pa.array(np.minimum(list(often.values()), 2**31 - 1).astype(np.int32)), pa.array([None] * k, pa.binary()), pa.array([None] * k, pa.list_(pa.int64())), pa.array([None] * k, pa.binary())], schema=schema)

    return run


def _prefixes(n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]):
    """(doc_id, n, shingles of the prefix, how many of them serve as the smaller set's)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("first", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingle_set(text.as_py(), n)
                if doc is None or not len(tokens):
                    continue
                rank = np.full(len(tokens), -1)
                if len(frequent[0]):
                    at = np.minimum(np.searchsorted(frequent[0], tokens), len(frequent[0]) - 1)
                    rank = np.where(frequent[0][at] == tokens, frequent[1][at], -1)
                larger, smaller = prefix_lengths(len(tokens), percent)
                order = tokens[np.argsort(rank, kind="stable")][:larger]
                rows.append((doc, len(tokens), order.view(np.int64), smaller))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.types[k]) for k in range(4)], schema=schema)

    return run


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, times) of tokens that this task reads `SEEN` times or more, by stretches of two million."""
    seen: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(values[counts >= SEEN]), pa.array(counts[counts >= SEEN], pa.int64())], ["token", "times"])

    for batch in batches:
        seen.append(batch.column(0).to_numpy())
        if sum(map(len, seen)) > 2_000_000:
            yield counted()
    yield counted()


def _fitting(sizes: list[tuple[int, int]], room: int) -> tuple[int | None, int]:
    """The first of (value, rows) that no longer fits into the room (None: all fit), and the room that is left before it."""
    for value, rows in sizes:
        if rows > room:
            return value, room
        room -= rows
    return None, room


def _most_frequent(profiles: DataFrame, limit: int) -> np.ndarray:
    """At most `limit` of the shingles that tasks reported, the most frequent last.

    Where they end is found by numbers of rows: of each step of times, then of each part of the last step.
    So the driver gets the chosen ones only, not `limit` of them from each task.
    """
    times = F.col("times")
    step = F.when(times < PLAIN_TIMES, times).otherwise(PLAIN_TIMES + F.floor(64 * F.log2(times / PLAIN_TIMES)))
    often = profiles.where("kind = 1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("n").alias("times"))
    often = stash(often.select("token", "times", step.cast("int").alias("step"), F.shiftright("token", 52).cast("int").alias("part")), "often")
    last, room = _fitting(sorted(often.groupBy("step").count().collect(), reverse=True), limit)
    if last is not None:
        end, _ = _fitting(sorted(often.where(F.col("step") == last).groupBy("part").count().collect()), room)
        often = often.where((F.col("step") > last) | (F.col("step") == last) & (F.col("part") < end))
    found = often.select("token", "times").toArrow()
    token, seen = (found[k].to_numpy() for k in ("token", "times"))
    return token[np.lexsort((token, -seen))[::-1]].view(np.uint64)


def _sets(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), n).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=schema)

    return run


def _verified(n: int, percent: int):
    """Links of each unit, from rows sorted by unit: its texts (kind 0), then its pairs (kind 1)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, {}
        for batch in batches:
            good = []
            for *k, kind, a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, sets = k, {}
                if kind == 0:
                    sets.setdefault(a, []).append(shingle_set(text, n))
                    continue
                for x, y in ((x, y) for x in sets.get(a, ()) for y in sets.get(b, ())):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        good.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], schema=schema)

    return run


def _families(percent: int):
    """(o, key, block, a, b): a forest over each block of rows (o, key, block, rep, n, map) sorted by block, by its signature tree."""
    schema = pa.schema([("o", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def find(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (r[1], r[0]))
        sizes = np.array([r[1] for r in rows], np.int64)
        width = min(len(r[2]) for r in rows) // 8
        tree = SignatureTree(sizes, np.arange(len(rows)), np.stack([fold(np.frombuffer(r[2], np.uint64), width) for r in rows]))
        a, b, bound = dual_traversal(tree, tree, percent)
        keep = forest(a, b, bound / np.maximum(sizes[a] + sizes[b] - bound, 1), len(rows))
        return [(rows[i][0], rows[j][0]) for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, out = None, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            for *u, rep, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit:
                    if len(rows) > 1:
                        out += [(*unit, min(p), max(p)) for p in find(rows)]
                    unit, rows = u, []
                rows.append((rep, n, words))
            if len(out) > 10_000:
                yield made()
                out = []
        if len(rows) > 1:
            out += [(*unit, min(p), max(p)) for p in find(rows)]
        yield made()

    return run


def _units(find):
    """Applies `find` (rows of one unit to pairs) to rows sorted by unit (token, left block, right block)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], set()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *k, side, n, rep, component, words, first in zip(*columns, strict=True):
                if k != key:
                    if len(rows) > 1:
                        out |= find(rows)
                    key, rows = k, []
                rows.append((side, n, rep, component, words, first))
            if len(out) > 10_000:
                yield made()
                out = set()
        if len(rows) > 1:
            out |= find(rows)
        yield made()

    return run


def _sides(rows: list[tuple]) -> list[list[tuple]]:
    return [sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1], r[2])) for s in (0, 1)]


def _met(x: tuple, y: tuple) -> bool:
    """Whether two rows of a cell are a pair of it: of two components, the smaller set with this token in its own prefix."""
    small = min(x, y, key=lambda r: r[1])
    return x[2] != y[2] and x[3] != y[3] and (small[5] or x[1] == y[1] and (x[5] or y[5]))


def _search_small(percent: int):
    """All pairs that the trees of hashed bitmaps leave."""

    def find(rows: list[tuple]) -> set[tuple[int, int]]:
        size = min(len(r[4]) for r in rows) // 8
        side = _sides(rows)[0]
        maps = np.stack([fold(np.frombuffer(r[4], np.uint64), size) for r in side])
        tree = SignatureTree(np.array([r[1] for r in side], np.int64), np.array([r[3] for r in side], np.int64), maps)
        found = ((side[i], side[j]) for i, j in zip(*dual_traversal(tree, tree, percent)[:2], strict=True))
        return {(min(x[2], y[2]), max(x[2], y[2])) for x, y in found if _met(x, y)}

    return _units(find)


def _search_large(percent: int):
    """Links by trees of exact bitmaps, from whole sets: as many as join the unit's components, not all pairs."""

    def find(rows: list[tuple]) -> set[tuple[int, int]]:
        rows = [(r[0], len(r[4]) // 8, *r[2:]) for r in rows]  # a document of several texts has rows with each of their sets
        values, counts = np.unique(np.concatenate([np.frombuffer(r[4], np.uint64) for r in rows]), return_counts=True)
        values = values[counts > 1]
        sides = _sides(rows)
        if not sides[0] or not len(values):
            return set()

        def tree(side: list[tuple]) -> SignatureTree:
            maps = _bitmaps([np.frombuffer(r[4], np.uint64) for r in side], values)
            return SignatureTree(np.array([r[1] for r in side], np.int64), np.array([r[3] for r in side], np.int64), maps, exact=True)

        first = tree(sides[0])
        second = tree(sides[1]) if sides[1] else first
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = set()
        for i, j in zip(*dual_traversal(first, second, percent)[:2], strict=True):
            x, y = sides[0][i], (sides[1] or sides[0])[j]
            if _met(x, y) and root(x[3]) != root(y[3]):
                parent[root(x[3])] = root(y[3])
                out.add((min(x[2], y[2]), max(x[2], y[2])))
        return out

    return _units(find)


def _bitmaps(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each set, with a bit for each of the sorted `values`."""
    width = 64 * max(1, -(-len(values) // 64))
    maps = np.zeros((len(sets), width // 64), np.uint64)
    for k, own in enumerate(sets):
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        flags = np.zeros(width, bool)
        flags[at[values[at] == own]] = True
        maps[k] = np.packbits(flags, bitorder="little").view(np.uint64)
    return maps


def _linked(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> tuple[list[int], list[int], np.ndarray]:
    """Documents of both sides of (document, set) rows, and which of them link; a document does not link with itself."""
    ids = [list(dict.fromkeys(d for d, _ in side)) for side in (left, right)]
    place = [{d: k for k, d in enumerate(side)} for side in ids]
    found = np.zeros((len(ids[0]), len(ids[1])), bool)
    values, counts = np.unique(np.concatenate([t for _, t in left] + ([] if right is left else [t for _, t in right])), return_counts=True)
    values = values[counts > 1]
    if not len(values):
        return *ids, found
    first = _bitmaps([t for _, t in left], values)
    second = first if right is left else _bitmaps([t for _, t in right], values)
    sizes = np.array([len(t) for _, t in right], np.int64)
    at = np.array([place[1][d] for d, _ in right])
    for (doc, tokens), own in zip(left, first, strict=True):
        common = np.zeros(len(right), np.int64)
        for cut in range(0, len(own), 4096):
            common += np.bitwise_count(second[:, cut : cut + 4096] & own[cut : cut + 4096]).sum(axis=1, dtype=np.int64)
        hits = at[100 * common >= percent * (len(tokens) + sizes - common)]
        found[place[0][doc], hits] = True
        if doc in place[1]:
            found[place[0][doc], place[1][doc]] = False
    return *ids, found


def _counts(n: int, percent: int):
    """(rep, n_links) of each unit, from texts sorted by unit (component, blocks i and j) and side."""
    schema = pa.schema([("rep", pa.int64()), ("n_links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ({}, {}), []

        def count() -> None:
            left, right = ([(d, t) for d, sets in side.items() for t in sets.values()] for side in sides)
            if key and left and (right or key[1] == key[2]):
                a, b, found = _linked(left, right or left, percent)
                out.extend(zip(a, found.sum(axis=1).tolist(), strict=True))
                if right:
                    out.extend(zip(b, found.sum(axis=0).tolist(), strict=True))

        def made() -> pa.RecordBatch:
            rows = [r for r in out if r[1]]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            for *k, side, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    count()
                    key, sides = k, ({}, {})
                tokens = shingle_set(text, n)
                if len(tokens):
                    sides[side].setdefault(doc, {})[tokens.tobytes()] = tokens
            if len(out) > 10_000:
                yield made()
        count()
        yield made()

    return run


def _degrees(label: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(rep, n_links): with how many other nodes of `label` (node, component) each node links."""
    sized = label.groupBy("component").agg(F.count("*").alias("size"))
    placed = label.join(sized, "component").withColumn("blocks", F.ceil(F.col("size") / UNIT)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    two = placed.where("size = 2").select(F.col("node").alias("rep"), F.lit(1).cast("long").alias("n_links"))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    units = placed.where("size > 2").select(F.col("node").alias("doc_id"), "component", "block", partner)
    wanted = units.select("doc_id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    held = _texts(docs, wanted).select("component", "i", "j", "side", "doc_id", "text")
    parts = held.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "doc_id").mapInArrow(released(_counts(n, percent)), "rep long, n_links long")
    return two.union(parts.groupBy("rep").agg(F.sum("n_links").alias("n_links")))


def _apart(cells: DataFrame, percent: int) -> DataFrame:
    """Rows of cells that have a row of another component in reach of their size."""
    cell = Window.partitionBy("token")
    mixed = cells.withColumns({"low": F.min("component").over(cell), "high": F.max("component").over(cell), "any": F.max("first").over(cell)}).where("low <> high and any")
    # the nearest row of another component lies just beyond the run of rows of the own one, on either side in the order of sizes
    for side in (F.asc, F.desc):
        order = cell.orderBy(side("n"), side("rep"))
        turn = F.when(F.lag("component").over(order) != F.col("component"), F.lag("n").over(order))
        mixed = mixed.withColumn("turn", turn).withColumn(f"near_{side.__name__}", F.last("turn", ignorenulls=True).over(order))
    reach = f"100 * near_asc >= {percent} * n or 100 * n >= {percent} * near_desc"
    return mixed.where(reach).select("token", "n", "rep", "component", "first")


#: What a row takes of a block: its shingles, or the block's share of them for a row if that is more.
_SHARE = "greatest(n, {least})"


def _share() -> str:
    return _SHARE.format(least=max(1, BLOCK_SHINGLES // BLOCK))


def _hot_units(cells: DataFrame, percent: int) -> DataFrame:
    """Units (token, i, j, side, n, rep, component, first) of hot cells.

    As `_apart` and `_cut` do it, but from the counts of each size: only these are sorted by cell.
    """
    sizes = cells.groupBy("token", "n").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("first").alias("any"), F.count("*").alias("rows"))
    cell = Window.partitionBy("token")
    sizes = sizes.withColumns({"cell_low": F.min("low").over(cell), "cell_high": F.max("high").over(cell), "cell_any": F.max("any").over(cell)}).where("cell_low <> cell_high and cell_any")
    for side in (F.asc, F.desc):
        order = cell.orderBy(side("n"))
        other = (F.lag("low").over(order) != F.col("low")) | (F.lag("high").over(order) != F.col("high")) | (F.lag("low").over(order) != F.lag("high").over(order))
        sizes = sizes.withColumn("turn", F.when(other, F.lag("n").over(order))).withColumn(f"near_{side.__name__}", F.last("turn", ignorenulls=True).over(order))
    sizes = sizes.where(f"low <> high or 100 * near_asc >= {percent} * n or 100 * n >= {percent} * near_desc")
    share = F.expr(_share()).cast("long")
    before = F.coalesce(F.sum(F.col("rows") * share).over(cell.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stash(sizes.select("token", "n", "rows", before.alias("before")), "sizes")
    placed = cells.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, ["token", "n"])
    placed = placed.withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("rep"), "rows") * share) / BLOCK_SHINGLES).cast("int"))
    placed = stash(placed.select("token", "n", "rep", "component", "first", "block"), "placed")
    blocks = placed.groupBy("token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("first").alias("any"))
    left, right = blocks.alias("l"), blocks.alias("r")
    both = (F.col("l.token") == F.col("r.token")) & (F.col("l.block") <= F.col("r.block")) & (100 * F.col("l.most") >= percent * F.col("r.least"))
    apart = (F.col("l.low") != F.col("r.low")) | (F.col("l.high") != F.col("r.high")) | (F.col("l.low") != F.col("l.high"))
    pairs = stash(left.join(right, both & apart & (F.col("l.any") | F.col("r.any"))).select("l.token", F.col("l.block").alias("i"), F.col("r.block").alias("j")), "pairs")
    sides = [(placed.withColumnRenamed("block", "i"), pairs, ["token", "i"], 0), (placed.withColumnRenamed("block", "j"), pairs.where("i < j"), ["token", "j"], 1)]
    first, second = (rows.join(own, on).select("token", "i", "j", F.lit(side).alias("side"), "n", "rep", "component", "first") for rows, own, on, side in sides)
    return first.union(second)


def _cut(cells: DataFrame) -> DataFrame:
    """Units (token, i, j, side, n, rep, component, first): the pairs of a cell's blocks, which hold rows in the order of their sizes."""
    cell = Window.partitionBy("token")
    before = F.sum(F.expr(_share()).cast("long")).over(cell.orderBy("n", "rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    blocked = cells.withColumn("block", F.floor(before / BLOCK_SHINGLES).cast("int")).withColumn("blocks", F.max("block").over(cell))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("other")
    units = blocked.select("token", "n", "rep", "component", "first", "block", partner)
    return units.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "n", "rep", "component", "first")


def _by_unit(units: DataFrame, payload: DataFrame, search) -> DataFrame:
    """(a, b) that `search` finds in the units; payload (rep, map)."""
    rows = units.join(payload, "rep").select("token", "i", "j", "side", "n", "rep", "component", "map", "first")
    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(released(search), "a long, b long").distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` with each row that `ids` (doc_id, and numbers) has for them: by broadcast when these are few, else by a shuffle."""
    ids = stash(ids, "ids")
    return docs.where("doc_id is not null").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")


def _verify(asked: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of `asked` (component, i, j, a, b) whose whole sets link.

    The texts of a unit's documents travel once for the unit, not for each of its pairs.
    """
    unit = ["component", "i", "j"]
    asked = stash(asked, "asked")
    wanted = asked.select(*unit, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = _texts(docs, wanted).select(*unit, F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = held.unionByName(asked.select(*unit, F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("text")))
    return rows.repartition(*unit).sortWithinPartitions(*unit, "kind", "a", "b").mapInArrow(released(_verified(n, percent)), "a long, b long").distinct()


def _grouped(pairs: DataFrame) -> DataFrame:
    """(component, i, j, a, b): pairs by connected group and blocks of its documents."""
    group = components(pairs)
    blocks = group.groupBy("component").agg(F.ceil(F.count("*") / UNIT).alias("blocks"))
    placed = group.join(blocks, "component").select("node", "component", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    left, right = placed.toDF("a", "component", "x"), placed.select(F.col("node").alias("b"), F.col("block").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("component", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b")


def ngram_jaccard_join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80, large_cell: int = LARGE, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of `docs`.

    n_links is the number of all other classes that the document's class links
    with (a class by its smallest doc_id and all texts of that); documents of one
    class (equal sets) are linked as such.  Without `count_links` it is left out.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), binary(text).alias("text"))
    schema = "kind byte, doc_id long, n int, sig binary, keys array<long>, map binary"
    profiles = stash(docs.mapInArrow(released(_profiles(n, percent)), schema), "profiles")
    rows = profiles.where("kind = 0")
    filled = rows.where("n > 0 and doc_id is not null")
    one = F.min(F.struct("doc_id", "n", "keys", "map")).alias("one")
    classes = stash(filled.groupBy("sig").agg(one).select("sig", F.col("one.doc_id").alias("rep"), "one.n", "one.keys", "one.map"), "classes")

    # 2. trees of families
    keyed = classes.select("rep", "n", "map", F.posexplode("keys").alias("o", "key"))
    cells = keyed.groupBy("o", "key").agg(F.count("*").alias("g")).where("g > 1")
    block = F.pmod(F.xxhash64("rep", "o"), F.ceil(F.col("g") / FAMILY))
    dealt = keyed.join(cells, ["o", "key"]).select("o", "key", block.alias("block"), "rep", "n", "map")
    pairs = dealt.repartition("o", "key", "block").sortWithinPartitions("o", "key", "block").mapInArrow(released(_families(percent)), "o int, key long, block long, a long, b long")
    asked = pairs.groupBy("a", "b").agg(F.min(F.struct(F.col("key").alias("component"), F.col("o").cast("long").alias("i"), F.col("block").alias("j"))).alias("u")).select("u.*", "a", "b")
    links = stash(_verify(asked, docs, n, percent), "links")
    found = components(links)

    # 3. the rest, exactly
    found_often = _most_frequent(profiles, FREQUENT)
    by_value = np.argsort(found_often)
    frequent = found_often[by_value], by_value
    prefixes = docs.mapInArrow(released(_prefixes(n, percent, frequent)), "doc_id long, n int, tokens array<long>, first int")
    members = stash(classes.select("rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component")), "members")
    prefixes = prefixes.join(members.withColumnRenamed("rep", "doc_id"), "doc_id")
    cells = prefixes.select(F.posexplode("tokens").alias("at", "token"), "n", F.col("doc_id").alias("rep"), "component", "first").select("token", "n", "rep", "component", (F.col("at") < F.col("first")).alias("first"))
    cells = stash(cells, "cells")
    often = cells.select("token").mapInArrow(released(_often), "token long, times long")
    hot = stash(often.groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= HOT_CELL).select("token"), "hot")
    n_hot = hot.count()
    few = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
    apart = stash(_apart(cells.join(few, "token", "left_anti") if n_hot else cells, percent), "apart")
    sized = apart.withColumn("size", F.count("*").over(Window.partitionBy("token")))
    large = _cut(sized.where(F.col("size") > large_cell).drop("size"))
    large = stash(large.union(_hot_units(cells.join(few, "token", "left_semi"), percent)) if n_hot else large, "large")
    sets = _texts(docs, large.select(F.col("rep").alias("doc_id")).distinct()).select("doc_id", "text").mapInArrow(released(_sets(n)), "doc_id long, tokens binary").toDF("rep", "map")
    more = stash(_by_unit(large, sets, _search_large(percent)), "links")
    merged = components(more.join(members.toDF("a", "ca"), "a").join(members.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("component", "merged")
    small = sized.where(F.col("size") <= large_cell).join(merged, "component", "left").select("token", "n", "rep", F.coalesce("merged", "component").alias("component"), "first")
    small = stash(_apart(small, percent), "small")
    candidates = stash(_by_unit(_cut(small), classes.select("rep", "map"), _search_small(percent)), "candidates")

    # texts of one doc_id are one node
    several = filled.groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y").select("doc_id")
    reps = filled.join(several, "doc_id").select("doc_id", "sig").distinct().join(classes.select("sig", "rep"), "sig")
    own = reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    all_links = links.union(more).union(stash(_verify(_grouped(candidates), docs, n, percent), "links")).union(own)

    # 4. components of all links
    label = components(all_links).withColumnRenamed("node", "rep")
    known = rows.where("sig is not null").join(classes.select("sig", "rep"), "sig", "left").join(label, "rep", "left")
    bare = rows.where("sig is null").select("doc_id", "n", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("component"))
    known = known.select("doc_id", "n", "rep", "component").union(bare)
    nearest = F.coalesce("component", "rep", "doc_id")
    out = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), nearest).alias("component_id")]
    if not count_links:
        return known.select(*out)

    # 5. all links within the components
    degree = _degrees(label.withColumnRenamed("rep", "node"), docs, n, percent)
    return known.join(degree, "rep", "left").select(*out, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` less all but one document of each component: that of the smallest doc_id.

    Rows with a null doc_id stay.  Of rows that share the kept doc_id, all stay.
    """
    found = ngram_jaccard_join(docs, text=text, doc_id=doc_id, n=n, percent=percent, count_links=False)
    rest = stash(found.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct(), "others")
    if rest.count() <= BROADCAST_IDS:
        rest = F.broadcast(rest)
    return docs.join(rest, doc_id, "left_anti")
