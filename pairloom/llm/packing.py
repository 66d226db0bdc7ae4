"""Packing token pieces into sequences by minimum bin slack.

Lengths are at most the capacity, so all that a packing needs is a histogram of
at most `capacity` counts, whatever the number of documents.  For each bin the
largest remaining length is set and a bitset dynamic programme over the
available lengths (with their counts) finds the fullest feasible combination;
it is applied as often as the counts allow, at one go, and removed.  A pattern
therefore uses up at least one length (to below its need), which bounds the
number of patterns by a multiple of the capacity.  Pieces then take places by their rank
within (length, salt); a length has as many salts as its count asks for, so that a task
ranks about `PER_SALT` pieces, or a `SALT_SHARE`-th of all, however many there are of
one length.

Defined results: a null or empty text is the end id alone; a very long one is cut,
whole, into pieces; rows of one doc_id and repeated rows are packed each for itself;
a null doc_id stays null; equal lengths take places by a hash of the row, which ties
leave free; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BROADCAST_IDS, released, stash

#: Pieces of one length and salt that one task ranks: so many, or this share of all pieces if that is more (which bounds the salts).
PER_SALT, SALT_SHARE = 1_000, 100_000
#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies of this kind.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenBytes:
    """Ids of whole texts as little-endian 32-bit bytes: what `tokenizers` gives by default without
    adding special tokens; a special token's string in a text gets that token's id.

    A byte-level BPE file whose merges stand in the order of their ids is run by
    the faster of the two public BPE libraries, on ranks read from that same
    file; any other tokenizer file by the library whose format it has.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        found = self._ranks(made)
        self.fast = self.tokenizer = None
        if found:
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=found[0], special_tokens=found[1])
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    @staticmethod
    def _ranks(made: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
        """Ranks and added tokens, where the file asks for nothing else that the faster library does not do."""
        model, before, added = made.get("model", {}), made.get("pre_tokenizer") or {}, made.get("added_tokens", [])
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model.get("type", "BPE") != "BPE" or not plain or made.get("normalizer") or made.get("truncation") or made.get("padding"):
            return None
        if any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            return None
        symbols, special = byte_symbols(), {t["content"]: t["id"] for t in added}
        if any(a != b and a in b for a in special for b in special):  # which of two that overlap is taken differs
            return None
        try:
            ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        except KeyError:
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in merges]
        fits = ids == sorted(set(ids)) and len(ids) == len(ranks) - 256 and min(ids, default=256) >= 256
        return (ranks, special) if fits else None

    def __call__(self, text: str) -> bytes:
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens(text.as_py() or "") + end
                size = len(ids) // 4
                first = size % capacity or capacity
                cuts = [0, *range(first, size + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _PIECE.types[k]) for k in range(5)], schema=_PIECE)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, longer ones cut, the first piece taking what is over."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(released(_pieces(tokenizer, capacity, end_id)), _PIECE_SQL)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, as far as counts go) of the largest sum that is at most `room`.

    A bitset holds the reachable sums; lengths join in falling order, and the
    search stops as soon as `room` itself is reached.
    """
    limit = (1 << (room + 1)) - 1
    states: list[tuple[int, int]] = []
    reach = 1
    for length in sorted((x for x in counts if counts[x] > 0 and x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reach | (reach << length)) & limit
            if more == reach:
                break
            states.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for length, before in reversed(states):
        if not before >> best & 1:
            out.append(length)
            best -= length
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins), largest length first."""
    left = {k: v for k, v in counts.items() if v > 0}
    while left:
        seed = max(left)
        left[seed] -= 1
        pattern = (seed, *fullest(left, capacity - seed))
        left[seed] += 1
        times = min(left[x] // pattern.count(x) for x in set(pattern))
        for x in set(pattern):
            left[x] -= times * pattern.count(x)
            if not left[x]:
                del left[x]
        yield pattern, times


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset), ranks ascending from 0."""
    used = dict.fromkeys(counts, 0)
    rows: dict[int, list[tuple[int, int, int]]] = {k: [] for k in counts}
    sequence = 0
    for pattern, times in minimum_bin_slack(counts, capacity):
        offset = 0
        for length in pattern:
            rows[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _placed(places: dict[int, np.ndarray]):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            bounds = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, bounds) if len(order) else []:
                rows = places[int(lengths[own[0]])]
                at = np.searchsorted(rows[:, 0], ranks[own], "right") - 1
                sequence[own] = rows[at, 1] + ranks[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:5]), pa.array(sequence), pa.array(offset)], schema=schema)

    return run


def pack(pieces: DataFrame, *, capacity: int = 2048, per_salt: int = PER_SALT) -> DataFrame:
    """`pieces` with sequence_id and offset.  Equal rows take different places; no rows: no sequences."""
    spark = pieces.sparkSession
    # a row's own number is written down with it, so that it is the same whenever the row is read again
    held_pieces = stash(pieces.withColumn("own", F.monotonically_increasing_id()), "pieces")
    counts = {int(r[0]): int(r[1]) for r in held_pieces.groupBy("length").agg(F.count("*")).collect()}  # at most capacity rows
    places = plan(counts, capacity)
    per_salt = max(per_salt, sum(counts.values()) // SALT_SHARE)
    many = {k: -(-n // per_salt) for k, n in counts.items() if n > per_salt}  # at most capacity values
    salts = F.coalesce(F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("length").cast("int")], F.lit(1)) if many else F.lit(1)
    salted = held_pieces.withColumn("salt", F.pmod(F.xxhash64("own"), salts).cast("int"))
    counted = stash(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")  # a row for each length and each per_salt pieces
    before = counted.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("own")
    before = F.broadcast(before) if sum(many.values()) + len(counts) <= BROADCAST_IDS else before
    ranked = salted.withColumn("within", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    held = spark.sparkContext.broadcast(places)

    def run(batches):
        yield from _placed(held.value)(batches)

    return ranked.mapInArrow(released(run), f"{_PIECE_SQL}, sequence_id long, offset long")
