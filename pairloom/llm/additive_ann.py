"""Approximate nearest neighbours by additive quantisation.

Codebooks of full-dimensional codewords are fitted on a bounded sample: k-means
on the residuals, codebook after codebook.
A vector is first divided by a power of two (its largest component then lies between 1 and 2), whose
exponent is stored, so vectors of any magnitude are coded alike.
Every vector is encoded by a beam search over the codebooks; its code (one byte
for each book) and the norm of its reconstruction are stored.  A query's inner
products with all codewords make a lookup table, sums over which score all codes
(squared distance needs the stored norm besides); the best `rerank` of each part
of the codes are compared exactly on the original vectors in double precision, and the
best `k` of each part go on.

Codes and vectors are dealt out once, into parts whose number follows from the number of rows alone (its
root over 8, more where a part would pass `CODE_BLOCK`); the queries, a stated
set that is smaller than the table, are sent to every part and pass through it in
batches: the shuffle grows as the rows to the power of 1.5, and beyond 300 million rows as their square.  `rerank` bounds the candidates of a query in a part (it is an approximate
search) and is at least `k`; what recall it leaves is measured in the tests.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, or are not of the sample's most frequent length, take no part; ties
go to the smaller id; inner products that overflow are infinite, those of no value (infinity less infinity) are
nearest to nothing; the query's own id is no candidate; of rows with one id the
nearest counts, and a query's rows of one id count as one query by the first of its
vectors; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stash

#: Documented bound of the sample that fits the codebooks (vectors).
SAMPLE = 16_384
BOOKS, WORDS, BEAM = 32, 256, 4
#: Vectors in a part of the codes at most.
CODE_BLOCK = 65_536
#: Queries that are scored at a time.
AT_ONCE = 64


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * x @ words.T).argmin(axis=1)


class AdditiveQuantiser:
    def __init__(self, sample: np.ndarray, *, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.beam = beam
        x = sample.astype(np.float32)
        words = max(1, min(words, len(x)))
        self.books = np.zeros((books, words, x.shape[1]), np.float32)
        rest = x.copy()
        for b in range(books):
            centres = rest[rng.permutation(len(rest))[:words]].copy()
            for _ in range(8):
                near = _nearest(rest, centres)
                count = np.bincount(near, minlength=words)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, rest)
                centres[count > 0] = sums[count > 0] / count[count > 0, None]
            self.books[b] = centres
            rest -= centres[_nearest(rest, centres)]

    def encode(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        """Codes (rows x books) by beam search: the `beam` best partial sums go on from book to book."""
        x = x.astype(np.float32)
        out = np.zeros((len(x), len(self.books)), np.uint8)
        for cut in range(0, len(x), block):
            rest = x[cut : cut + block][:, None, :]  # rows, beams, dimensions
            codes = np.zeros((len(rest), 1, 0), np.uint8)
            for words in self.books:
                cost = (rest**2).sum(axis=2)[:, :, None] + (words**2).sum(axis=1) - 2 * rest @ words.T
                flat = cost.reshape(len(rest), -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                beam, word = best // len(words), best % len(words)
                rest = np.take_along_axis(rest, beam[:, :, None], axis=1) - words[word]
                codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
            least = (rest**2).sum(axis=2).argmin(axis=1)
            out[cut : cut + block] = codes[np.arange(len(codes)), least]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, b]] for b, book in enumerate(self.books))

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """Squared norms of the reconstructions."""
        return (self.decode(codes) ** 2).sum(axis=1)

    def scores(self, queries: np.ndarray, exponents: np.ndarray, codes: np.ndarray, norms: np.ndarray, powers: np.ndarray, metric: str) -> np.ndarray:
        """Approximate nearness (larger is nearer) from lookup tables, queries x codes, each query's by a factor of its own.

        Queries and codes are scaled; `exponents` and `powers` are the exponents of their scales.
        """
        tables = np.einsum("bwd,qd->qbw", self.books, queries.astype(np.float32), optimize=True)
        total = tables[:, 0, :][:, codes[:, 0]]
        for b in range(1, len(self.books)):
            total += tables[:, b, :][:, codes[:, b]]
        top = int(powers.max(initial=0))
        if metric == "l2":
            # by 2 ** -2m, m the larger of the two exponents
            high = np.maximum(exponents, top)[:, None]
            return 2 * np.ldexp(total.astype(np.float64), exponents[:, None] + powers - 2 * high) - np.ldexp(norms.astype(np.float64)[None, :], 2 * (powers - high))
        return np.ldexp(total.astype(np.float64), powers - top) if (powers != top).any() else total


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by a power of two so that their largest component lies between 1 and 2, and the exponents."""
    powers = np.frexp(np.abs(x).max(axis=1, initial=0))[1] - 1
    # in two steps: 2 ** -powers may pass what a double holds
    half = powers // 2
    return np.ldexp(np.ldexp(x, -half[:, None]), -(powers - half)[:, None]), powers


def _encoded(held):
    schema = pa.schema([("id", pa.int64()), ("code", pa.binary()), ("norm", pa.float32()), ("exact", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = model.encode(scaled(_matrix(batch.column(1), batch.num_rows))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(model.norms(codes).astype(np.float32)), batch.column(1).cast(schema.types[3])], schema=schema)

    return run


def _best(held, k: int, rerank: int, metric: str):
    """The k nearest of one part for each query, from rows (part, id, code, norm, exact) sorted by part: its codes, then the queries (without code)."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scored(model: AdditiveQuantiser, names: np.ndarray, queries: np.ndarray, held_part: tuple) -> tuple[list, list, list]:
        ids, codes, norms, vectors, powers = held_part
        near = model.scores(*scaled(queries), codes, norms, powers, metric)
        q, v, s = [], [], []
        for name, query, line in zip(names.tolist(), queries, near, strict=True):
            line[ids == name] = -np.inf
            if len(line) > rerank:
                edge = -np.partition(-line, rerank - 1)[rerank - 1]
                above = np.flatnonzero(line > edge)
                chosen = np.concatenate([above, np.flatnonzero(line == edge)[: rerank - len(above)]])  # the smaller ids
            else:
                chosen = np.arange(len(line))
            chosen = chosen[ids[chosen] != name]
            with np.errstate(over="ignore", invalid="ignore"):
                if metric == "l2":
                    exact = -((vectors[chosen] - query) ** 2).sum(axis=1)
                else:
                    exact = (vectors[chosen] * query).sum(axis=1)  # row by row alike: equal vectors get equal scores
            first = np.lexsort((ids[chosen], -np.nan_to_num(exact, nan=-np.inf, posinf=np.inf, neginf=-np.inf)))
            first = first[np.sort(np.unique(ids[chosen][first], return_index=True)[1])][:k]  # the nearest of each id
            q.append(np.full(len(first), name))
            v.append(ids[chosen][first])
            s.append(exact[first])
        return q, v, s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        part, gathered, held_part = None, [], None
        for batch in batches:
            places, is_code = batch.column(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(places) != 0) | np.diff(is_code)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
                if a == b:
                    continue
                if places[a] != part:
                    part, gathered, held_part = places[a], [], None
                own = batch.slice(a, b - a)
                vectors = _matrix(own.column(4), b - a)
                if is_code[a]:
                    codes = np.frombuffer(b"".join(own.column(2).to_pylist()), np.uint8).reshape(b - a, -1)
                    gathered.append((own.column(1).to_numpy(), codes, own.column(3).to_numpy(), vectors))
                    continue
                if held_part is None and gathered:
                    held_part, gathered = tuple(np.concatenate(x) for x in zip(*gathered, strict=True)), []
                    held_part = (*held_part, scaled(held_part[3])[1])
                if held_part is None:  # a part without codes
                    continue
                names = own.column(1).to_numpy()
                for cut in range(0, len(names), AT_ONCE):
                    found = scored(model, names[cut : cut + AT_ONCE], vectors[cut : cut + AT_ONCE], held_part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(found, schema.types, strict=True)], schema=schema)

    return run


def valid_vectors(vectors: DataFrame, *, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, exact array<double>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("exact", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("exact", lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0)).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("exact"))
    return rows.where(F.coalesce(fine, F.lit(False)))


def nearest_neighbours(vectors: DataFrame, is_query, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, rerank: int = 200, metric: str = "inner", code_block: int = CODE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row for which the column expression `is_query` (over vec_id) holds.

    metric: "inner" (largest inner product) or "l2" (score: minus the squared distance).
    """
    spark = vectors.sparkSession
    rerank = max(rerank, k)
    rows = valid_vectors(vectors, vec_id=vec_id, vector=vector)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "exact").limit(SAMPLE).select("exact").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.bincount([len(r[0]) for r in sample])
    size = int(lengths.argmax())
    model = AdditiveQuantiser(scaled(np.array([r[0] for r in sample if len(r[0]) == size], np.float64))[0])
    held = spark.sparkContext.broadcast(model)
    rows = rows.where(F.size("exact") == size)
    codes = stash(rows.select("vec_id", "exact").mapInArrow(_encoded(held), "id long, code binary, norm float, exact array<double>"), "codes")
    count = codes.count()
    parts = max(1, -(-count // code_block), math.isqrt(count) // 8)
    dealt = codes.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", "code", "norm", "exact")
    queries = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("exact").alias("exact"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    asked = queries.select(every, F.col("vec_id").alias("id"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("norm"), "exact")
    units = dealt.union(asked).repartition(parts, "part").sortWithinPartitions("part", F.col("code").isNull(), "id")
    found = units.mapInArrow(_best(held, k, rerank, metric), "query_id long, vec_id long, score double")
    rank = lambda c: F.when(F.isnan(c), float("-inf")).otherwise(F.col(c))
    scored = found.groupBy("query_id", "vec_id").agg(F.max_by("score", rank("score")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(rank("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
