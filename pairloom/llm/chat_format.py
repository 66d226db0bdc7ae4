"""Chat formatting by columnar byte assembly.

Rows of a sorted partition come in Arrow batches.  For each run of rows the lengths of all
segments (header, role, content, end mark) give cumulative offsets, and these give, for each
byte of the Arrow buffers of roles and texts, its place in one preallocated buffer: numpy
copies all contents and headers there at once, and the buffer becomes the text column.

A turn is written `### ROLE: TEXT</turn>` and a line feed.  In texts and roles a backslash stands
before each backslash and before each place where `###` or `</turn>` begins, overlaps included (and
in roles before each colon), so that no control string is left in them; `read_turns` undoes it.
The loss mask is the list of code point spans of what assistants say, escapes included, without
header and end mark.

Rows are dealt by ranges of (conversation, turn, role, text), so one conversation of any length is
spread over tasks.  A conversation is one output row, unless its rows lie in two tasks or
exceed `PIECE_ROWS` or `PIECE_BYTES`: then it is several, which in the order of `piece` follow one
another.  A digest (`digests`) of a conversation in several pieces is made by one task, piece by
piece, as a hash is sequential; its memory holds one piece.

Defined results: turns are ordered by turn, nulls first, then by role and text (bytes); a null text
or role is empty; rows without a conversation are one conversation of their own (null); repeated
rows are turns of their own; roles are kept as they stand, and only `assistant` is under the loss
mask; other columns take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, END = b"### ", b": ", b"</turn>\n"
_TAIL = b"</turn>"
BACKSLASH, HASH, LESS, COLON = 92, 35, 60, 58
#: A conversation beyond these bounds, or a batch of several, goes on in another piece.
PIECE_ROWS, PIECE_BYTES = 1_000, 1 << 21
#: Bytes whose places are computed at a time.
_STEP = 1 << 20

_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_LOSS_DDL = "array<struct<start:int,end:int>>"


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[cuts[0] : cuts[-1]], cuts - cuts[0]


def _starts(data: np.ndarray, word: bytes, cuts: np.ndarray) -> np.ndarray:
    """Places where `word` begins and ends within one row."""
    if len(data) < len(word):
        return np.zeros(0, np.int64)
    found = np.flatnonzero(data[: len(data) - len(word) + 1] == word[0])
    for k in range(1, len(word)):
        found = found[data[found + k] == word[k]]
    return found[found + len(word) <= cuts[np.searchsorted(cuts, found, "right")]]


def _marks(data: np.ndarray, cuts: np.ndarray, role: bool) -> np.ndarray:
    """Sorted places before which an escape stands."""
    marks = (data == BACKSLASH) | (data == COLON) if role else data == BACKSLASH
    marks[_starts(data, b"###", cuts)] = True
    marks[_starts(data, _TAIL, cuts)] = True
    return np.flatnonzero(marks)


def _scatter(out: np.ndarray, data: np.ndarray, cuts: np.ndarray, marks: np.ndarray, places: np.ndarray) -> None:
    """Copy the rows of `data` to `places` in `out`, with a backslash before each mark."""
    before = np.searchsorted(marks, cuts[:-1])  # marks of earlier rows
    shift = places - cuts[:-1] - before
    for low in range(0, len(data), _STEP):
        high = min(low + _STEP, len(data))
        first, last = np.searchsorted(cuts, low, "right") - 1, np.searchsorted(cuts, high, "left")
        lengths = np.minimum(cuts[first + 1 : last + 1], high) - np.maximum(cuts[first:last], low)
        at = np.arange(low, high) + np.repeat(shift[first:last], lengths)
        a, b = np.searchsorted(marks, (low, high))
        escaped = np.zeros(high - low, np.int64)
        escaped[marks[a:b] - low] = 1
        at += np.cumsum(escaped) + a
        out[at] = data[low:high]
        out[at[marks[a:b] - low] - 1] = BACKSLASH


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, offsets of the turns and its end, start and end of each content) of one formatted text of all rows."""
    role, role_cuts = _buffer(roles)
    text, text_cuts = _buffer(texts)
    role_marks, text_marks = _marks(role, role_cuts, True), _marks(text, text_cuts, False)
    length = lambda cuts, marks: np.diff(cuts) + np.diff(np.searchsorted(marks, cuts))
    role_length, text_length = length(role_cuts, role_marks), length(text_cuts, text_marks)
    fixed = len(HEAD) + len(AFTER_ROLE) + len(END)
    turns = np.concatenate([[0], np.cumsum(role_length + text_length + fixed)])
    begin = turns[:-1] + len(HEAD) + role_length + len(AFTER_ROLE)
    made = pa.allocate_buffer(int(turns[-1]))
    out = np.frombuffer(made, np.uint8)
    for word, places in ((HEAD, turns[:-1]), (AFTER_ROLE, begin - len(AFTER_ROLE)), (END, begin + text_length)):
        out[places[:, None] + np.arange(len(word))] = np.frombuffer(word, np.uint8)
    _scatter(out, role, role_cuts, role_marks, turns[:-1] + len(HEAD))
    _scatter(out, text, text_cuts, text_marks, begin)
    return made, turns, begin, begin + text_length


def _points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each of the sorted byte places."""
    heads = (data & 0xC0) != 0x80
    if not len(places):
        return np.zeros(0, np.int64)
    cuts = np.concatenate([[0], places])
    counts = np.array([np.count_nonzero(heads[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.int64)
    return np.cumsum(counts)


def _pieces(rows: pa.RecordBatch, first: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """(texts, loss spans, turns) of the pieces that begin at rows `first`, and their code points."""
    made, turns, begin, end = assemble(rows.column("role"), rows.column("text"))
    bounds = np.append(first, rows.num_rows)
    data = np.frombuffer(made, np.uint8)
    spoken = np.flatnonzero(pc.fill_null(pc.equal(rows.column("role"), "assistant"), False).to_numpy(zero_copy_only=False))
    places = np.concatenate([turns[bounds], begin[spoken], end[spoken]])
    order = np.argsort(places, kind="stable")
    points = np.empty(len(places), np.int64)
    points[order] = _points(data, places[order])
    heads, opens, closes = points[: len(bounds)], points[len(bounds) : len(bounds) + len(spoken)], points[len(bounds) + len(spoken) :]
    owner = np.searchsorted(first, spoken, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array((x - heads[owner]).astype(np.int32)) for x in (opens, closes)], fields=list(_LOSS.value_type))
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(bounds)), "left").astype(np.int32)), spans, type=_LOSS)
    texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(turns[bounds].astype(np.int32)), made)
    return texts, loss, pa.array(np.diff(bounds), pa.int64()), np.diff(heads)


def _formatted(key_type: pa.DataType):
    schema = pa.schema([("conv_id", key_type), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", _LOSS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        seen_other = False  # a row of another conversation came before the held rows
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.RecordBatch, opened: bool, closed: bool) -> Iterator[pa.RecordBatch]:
            """Pieces of consecutive conversations; `opened`, `closed`: the first began, the last ended within this task."""
            nonlocal number
            codes = pc.dictionary_encode(rows.column("conv_id"), null_encoding="encode").indices.to_numpy()
            runs = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [rows.num_rows]])
            sizes = sum(pc.fill_null(pc.binary_length(rows.column(c)), 0).to_numpy() for c in ("role", "text")).astype(np.int64)
            size = np.concatenate([[0], np.cumsum(sizes)])
            firsts, whole, start, last = [], [], 0, len(runs) - 2
            cuts = []  # (row, is the conversation whole)
            for k in range(len(runs) - 1):
                low, high = int(runs[k]), int(runs[k + 1])
                complete = (k > 0 or opened) and (k < last or closed)
                at = low
                while at < high:  # rows up to the bounds, one at least
                    to = min(high, at + PIECE_ROWS, max(at + 1, int(np.searchsorted(size, size[at] + PIECE_BYTES, "right")) - 1))
                    cuts.append((at, to, complete and at == low and to == high))
                    at = to
            for k, (at, to, fine) in enumerate(cuts):
                firsts.append(at - start)
                whole.append(fine)
                if k == len(cuts) - 1 or size[cuts[k + 1][1]] - size[start] > PIECE_BYTES or cuts[k + 1][1] - start > PIECE_ROWS:
                    part = rows.slice(start, to - start)
                    first = np.array(firsts)
                    texts, loss, turns, _ = _pieces(part, first)
                    numbers = pa.array(np.arange(number, number + len(first)))
                    yield pa.RecordBatch.from_arrays([part.column("conv_id").take(pa.array(first)), numbers, pa.array(whole), turns, texts, loss], schema=schema)
                    number += len(first)
                    firsts, whole, start = [], [], to

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        key = lambda batch, k: batch.column("conv_id")[k].as_py()
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = pc.dictionary_encode(batch.column("conv_id"), null_encoding="encode").indices.to_numpy()
            changes = np.flatnonzero(np.diff(codes)) + 1
            goes_on = bool(held) and key(held[0], 0) == key(batch, 0)
            if held and not goes_on:
                yield from emit(joined(held), seen_other, True)
                held, seen_other = [], True
            if len(changes):
                yield from emit(joined([*held, batch.slice(0, int(changes[-1]))]), seen_other, True)
                held, seen_other = [batch.slice(int(changes[-1]))], True
            else:
                held.append(batch)
            if sum(x.num_rows for x in held) >= PIECE_ROWS or sum(x.get_total_buffer_size() for x in held) >= 4 * PIECE_BYTES:
                yield from emit(joined(held), False, False)
                held, seen_other = [], False
        if held:
            yield from emit(joined(held), seen_other, False)

    return run


def format_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(conv_id, piece, whole, n_turns, text, loss): formatted conversations; `whole` marks rows that certainly hold all turns of theirs."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    key = rows.schema["conv_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key.simpleString()]
    return dealt.mapInArrow(_formatted(arrow), f"conv_id {key.simpleString()}, piece long, whole boolean, n_turns long, text string, loss {_LOSS_DDL}")


# Reading back


_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; ValueError if it is none."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


class _Digest:
    """Counts and hashes of one conversation, fed piece by piece."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        found = read_turns(text)
        self.turns += len(found)
        self.chars += len(text)
        for role, said in found:
            self.all.update(f"{role}\n{said}\n".encode())
        for span in loss:
            said = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_FIGURES = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_FIGURES_DDL = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_whole(key_type: pa.DataType):
    """Digests of whole conversations; the pieces of the others go on as they are."""
    schema = pa.schema([("conv_id", key_type), ("piece", pa.int64()), *_FIGURES, ("text", pa.string()), ("loss", _LOSS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch.column("whole").to_pylist()
            figures = []
            for fine, text, loss in zip(whole, batch.column("text").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                digest = _Digest()
                if fine:
                    digest.add(text, loss)
                figures.append(digest.row() if fine else (None,) * len(_FIGURES))
            rest = [pc.if_else(batch.column("whole"), pa.scalar(None, batch.schema.field(c).type), batch.column(c)) for c in ("text", "loss")]
            columns = [pa.array([f[k] for f in figures], t) for k, (_, t) in enumerate(_FIGURES)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), *columns, rest[0], rest[1].cast(_LOSS)], schema=schema)

    return run


def _read_pieces(key_type: pa.DataType):
    """One row for each conversation, from digests and from pieces sorted by conversation and piece."""
    schema = pa.schema([("conv_id", key_type), *_FIGURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((current, *digest.row()), schema.types, strict=True)], schema=schema)

        for batch in batches:
            done = batch.column("n_turns").is_valid()
            ready = batch.filter(done)
            if ready.num_rows:
                yield ready.select(schema.names)
            open_ = batch.filter(pc.invert(done))
            for key, text, loss in zip(*(open_.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if digest is not None and key != current:
                    yield closed()
                    digest = None
                if digest is None:
                    current, digest = key, _Digest()
                digest.add(text, loss)
        if digest is not None:
            yield closed()

    return run


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts and their loss mask.

    The first hash is of role, line feed, text, line feed of all turns, the second of all texts under the mask.
    """
    key = formatted.schema["conv_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key]
    read = formatted.mapInArrow(_read_whole(arrow), f"conv_id {key}, piece long, {_FIGURES_DDL}, text string, loss {_LOSS_DDL}")
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return dealt.mapInArrow(_read_pieces(arrow), f"conv_id {key}, {_FIGURES_DDL}")
