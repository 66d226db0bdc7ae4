"""Mining of phrase collocations by sketch, automata and exact scores.

1. Sketch: each task hashes all words, and phrases of two to `longest` words, of its texts into the cells of a
   count-min sketch (`ROWS` rows) and sends, block by block, the gaps between touched cells and the counts of
   those touched twice or more.  The blocks are summed by Spark; what is kept of a cell is the
   bit "at least `least`", an upper bound's verdict on every word or phrase that falls into it.
2. Shards: the stretches of text in which phrases lie whose cells all have the bit are dealt to shards by the hash
   of a phrase's first two words; words are counted on the way.
3. Automata: each shard compiles its candidates (phrases of its stretches with the bit) into pyahocorasick
   automata, each word between delimiters (a space on either side; a line feed parts stretches), and scans
   its stretches, overlapping matches counted.  Spark sums the counts.
4. Thresholds: only now, on exact counts, come the least count, the scores of all cuts, the rule on
   longer candidates and the first `top` of each language.

A place where a candidate begins is kept in one stretch of one shard (stretches that overlap are merged), and a shard
counts all its candidates, so the sums are exact whatever the sketch lets through and however stretches are
dealt.  The hash of the first two words brings the occurrences of a phrase together, so that few automata hold it;
a shard that gets far more of a batch than others (a very common pair of words) is spread over all shards, batch by batch.
The sketch's width follows the number of phrases, up to `MOST_CELLS` (its bits are broadcast: `ROWS` times 64 MB); beyond some 2e9
phrases it lets more and more of them through, and the cost approaches that of a plain count of phrases.

Defined results: a null text is empty, a null language is `und`; phrases do not cross the marks
`. , ; : ! ?` and line ends; repeated rows count each for itself; other columns take no part,
whatever their names; an empty table gives no rows.  Words and phrases are told apart within a batch of texts by
64-bit hashes (a collision there could hide one).
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stash
from .wordhash import gram_hashes, hash_spans, mix

ROWS = 2
#: Cells of a row of the sketch at most; cells of a block that is summed by itself.
MOST_CELLS, BLOCK = 1 << 29, 1 << 18
#: Bytes of text that are worked on together.
BATCH_BYTES = 1 << 20
#: Distinct words whose counts a task keeps before it sends them.
KEPT_WORDS = 200_000
#: Patterns of one automaton; bytes of text in a shard (a task goes through more in parts of twice as many).
PATTERNS, SHARD_BYTES = 150_000, 1 << 24
#: A batch's stretches for one shard are spread where they have so many bytes and so many times the mean.
SPREAD_BYTES, SPREAD_TIMES = 1 << 14, 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: inside a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Words:
    """Words of a batch of texts of one language: byte spans, pieces and hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = _KIND[self.data]
        inside = np.zeros(len(kind) + 2, np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        marks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(marks, self.start)
        self.hash = hash_spans(self.data.tobytes(), self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the phrases of n words within one piece."""
        last = len(self) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:last] == self.piece[n - 1 :])
        return at, gram_hashes(self.hash, n)[at]

    def copied(self, index: np.ndarray, before: np.ndarray) -> bytes:
        """The words of `index`, each with a space behind it; where `before` says so, with a line feed and a space ahead."""
        lengths = self.end[index] - self.start[index]
        whole = lengths + 1 + 2 * before
        stop = np.cumsum(whole)
        out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
        begin = stop - 1 - lengths
        out[begin[before] - 2] = 0x0A
        ahead = np.cumsum(lengths) - lengths
        offset = np.arange(int(lengths.sum()))
        out[np.repeat(begin - ahead, lengths) + offset] = self.data[np.repeat(self.start[index] - ahead, lengths) + offset]
        return out.tobytes()

    def text(self, at: int, n: int) -> str:
        if n == 1:
            return self.data[self.start[at] : self.end[at]].tobytes().decode()
        return " ".join(self.data[self.start[k] : self.end[k]].tobytes().decode() for k in range(at, at + n))


def _by_language(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[tuple[str, Words]]:
    """Words of about `batch_bytes` of text of one language."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            total += len(text) + 1
            if sizes[lang] >= batch_bytes:
                yield lang, Words(held.pop(lang))
                total -= sizes.pop(lang)
            elif total >= 4 * batch_bytes or len(held) > 1_000:  # many languages
                for name in list(held):
                    yield name, Words(held.pop(name))
                sizes.clear()
                total = 0
    for name in held:
        yield name, Words(held[name])


def cells_of(lang: str, hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each phrase in a row of the sketch."""
    salt = np.uint64((zlib.crc32(lang.encode()) << 8 | row) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(hashes ^ salt) & np.uint64(width - 1)).astype(np.int64)


def gaps_of(places: np.ndarray) -> bytes:
    """Sorted different places as gaps of one byte each; 255 stands for 255 places and another byte to follow."""
    gaps = np.diff(places, prepend=-1) - 1
    long_ = gaps // 255
    out = np.full(len(gaps) + int(long_.sum()), 255, np.uint8)
    out[np.cumsum(long_ + 1) - 1] = gaps % 255
    return out.tobytes()


def places_of(gaps: bytes) -> np.ndarray:
    steps = np.frombuffer(gaps, np.uint8).astype(np.int64)
    return (np.cumsum(steps) + np.cumsum(steps < 255) - 1)[steps < 255]


def _sketched(width: int, longest: int, batch_bytes: int):
    """Blocks of the sketch: (row, block, gaps of the touched cells, gaps of those touched again, how often more)."""
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("again", pa.binary()), ("more", pa.binary())])
    block = min(BLOCK, width)

    def blocks(row: int, cells: np.ndarray) -> pa.RecordBatch:
        cells, counts = np.unique(cells, return_counts=True)
        cuts = np.searchsorted(cells, np.arange(0, width + 1, block))
        out = []
        for b in np.flatnonzero(np.diff(cuts)):
            own, n = cells[cuts[b] : cuts[b + 1]].astype(np.int64) - b * block, np.minimum(counts[cuts[b] : cuts[b + 1]], 255)
            out.append((row, int(b), gaps_of(own), gaps_of(own[n > 1]), (n[n > 1] - 1).astype(np.uint8).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        size = 0
        for lang, words in _by_language(batches, batch_bytes):
            hashes = np.concatenate([words.grams(n)[1] for n in range(1, longest + 1)])
            for row in range(ROWS):
                held[row].append(cells_of(lang, hashes, row, width).astype(np.uint32))
            size += len(hashes)
            if size >= 1 << 22:
                for row in range(ROWS):
                    yield blocks(row, np.concatenate(held[row]))
                held, size = [[] for _ in range(ROWS)], 0
        if size:
            for row in range(ROWS):
                yield blocks(row, np.concatenate(held[row]))

    return run


def _summed(width: int, least: int):
    """(row, block, bits): cells of at least `least`, from rows sorted by row and block."""
    block = min(BLOCK, width)
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(block, np.uint16)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*current, np.packbits(total >= least).tobytes()), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for row, number, once, again, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, number) != current:
                    if current is not None:
                        yield closed()
                    current, total = (row, number), np.zeros(block, np.uint16)
                total[places_of(once)] += 1
                total[places_of(again)] += np.frombuffer(more, np.uint8)
                np.minimum(total, 0x7FFF, out=total)
        if current is not None:
            yield closed()

    return run


def sketch_bits(texts: DataFrame, width: int, least: int, longest: int) -> np.ndarray:
    """The packed bits of each row of the sketch; texts (lang, text) without nulls."""
    if least > 255:
        least = 255  # counts of one batch are cut there: a lower bar lets more through, never less
    found = texts.mapInArrow(_sketched(width, longest, BATCH_BYTES), "row int, block int, once binary, again binary, more binary")
    parts = max(1, min(ROWS * width // BLOCK, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = found.repartition(parts, "row", "block").sortWithinPartitions("row", "block")
    bits = np.zeros((ROWS, width // 8), np.uint8)
    step = min(BLOCK, width) // 8
    # collected: a bit for each cell, ROWS * MOST_CELLS / 8 bytes at most
    for r in dealt.mapInArrow(_summed(width, least), "row int, block int, bits binary").toLocalIterator():
        bits[r["row"], r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _passes(bits: np.ndarray, lang: str, hashes: np.ndarray, width: int) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for row in range(ROWS):
        cell = cells_of(lang, hashes[ok], row, width)
        ok[ok] = (bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return ok


def owners(pairs: np.ndarray, shards: int) -> np.ndarray:
    """The shard that counts the phrases that begin with these pairs of words."""
    return (mix(pairs ^ np.uint64(0xB0C7)) % np.uint64(shards)).astype(np.int64)


def _stretches(held, width: int, longest: int, shards: int, batch_bytes: int):
    """(shard, lang, owner, text, n): words that may be frequent with their counts, the number of all words (with an empty text), and stretches (n null) of the `owner` among the shards."""
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("owner", pa.int32()), ("text", pa.string()), ("n", pa.int64())])

    def rows(lang: str, shard, owner, text: list[str], n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([lang] * len(text), pa.string()), pa.array(owner, pa.int32()), pa.array(text, pa.string()), pa.array(n, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        counted: dict[str, Counter] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for name, counter in counted.items():
                yield rows(name, [zlib.crc32(w.encode()) % shards for w in counter], [-1] * len(counter), list(counter), list(counter.values()))
            counted.clear()

        for number, (lang, words) in enumerate(_by_language(batches, batch_bytes)):
            if not len(words):
                continue
            _, first, counts = np.unique(words.hash, return_index=True, return_counts=True)
            own = counted[lang]
            fine = _passes(bits, lang, gram_hashes(words.hash, 1)[first], width)
            for k, n in zip(first[fine].tolist(), counts[fine].tolist(), strict=True):
                own[words.text(k, 1)] += n
            own[""] += len(words)
            if sum(map(len, counted.values())) > KEPT_WORDS:
                yield from flushed()
            at, hashes = words.grams(2)
            shard = np.full(len(words), -1, np.int64)
            shard[at] = owners(hashes, shards)
            pairs = []
            for n in range(2, longest + 1):
                place, hashes = words.grams(n)
                place = place[_passes(bits, lang, hashes, width)]
                pairs += [shard[place] * len(words) + place + k for k in range(n)]
            pairs = np.unique(np.concatenate(pairs))
            if not len(pairs):
                continue
            owner, index = np.divmod(pairs, len(words))
            before = np.ones(len(index), bool)
            before[1:] = (owner[1:] != owner[:-1]) | (index[1:] != index[:-1] + 1) | (words.piece[index[1:]] != words.piece[index[:-1]])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
            texts = [words.copied(index[a:b], before[a:b]).decode() + "\n" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            to = owner[cuts[:-1]]
            sizes = np.array([len(t) for t in texts])
            large = (sizes >= SPREAD_BYTES) & (sizes >= SPREAD_TIMES * sizes.sum() / shards)
            salt = zlib.crc32(texts[0].encode()) + number
            yield rows(lang, np.where(large, (to + salt) % shards, to), to, texts, [None] * len(texts))
        yield from flushed()

    return run


def compile_automaton(phrases: list[str]):
    """Automaton of the phrases between delimiters; its values are their numbers."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for number, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", number)
    automaton.make_automaton()
    return automaton


def _scanned(held, width: int, longest: int, shards: int, most_patterns: int, shard_bytes: int):
    """(lang, phrase, n) from rows (shard, lang, owner, text, n) sorted by shard: words pass, the candidates that are an owner's are counted in its stretches."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def candidates(lang: str, owner: int, texts: list[str]) -> list[str]:
        words = Words([t.encode() for t in texts])
        found, mine = [], np.zeros(len(words), bool)
        at, hashes = words.grams(2)
        mine[at] = owners(hashes, shards) == owner
        for n in range(2, longest + 1):
            place, hashes = words.grams(n)
            place, hashes = place[mine[place]], hashes[mine[place]]
            fine = _passes(held.value, lang, hashes, width)
            _, first = np.unique(hashes[fine], return_index=True)
            found += [words.text(k, n) for k in place[fine][first].tolist()]
        return found

    def counted(lang: str, owner: int, texts: list[str]) -> Iterator[pa.RecordBatch]:
        known: dict[str, None] = {}
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= 1 << 20:
                known.update(dict.fromkeys(candidates(lang, owner, part)))
                part, size = [], 0
        if part:
            known.update(dict.fromkeys(candidates(lang, owner, part)))
        phrases = list(known)
        for cut in range(0, len(phrases), most_patterns):
            own = phrases[cut : cut + most_patterns]
            automaton = compile_automaton(own)
            n = np.zeros(len(own), np.int64)
            for text in texts:
                n += np.bincount(np.fromiter((v for _, v in automaton.iter(text)), np.int64), minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.string()), pa.array(n)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, texts, size = None, {}, 0

        def closed() -> Iterator[pa.RecordBatch]:
            for (lang, owner), parts in texts.items():
                yield from counted(lang, owner, parts)

        for batch in batches:
            words = batch.column(4).is_valid()
            if pc.any(words).as_py():
                own = batch.filter(words)
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(3), own.column(4)], schema=schema)
            for number, lang, owner, text in zip(*(c.to_pylist() for c in batch.filter(pc.invert(words)).columns[:4]), strict=True):
                if number != shard or size >= 2 * shard_bytes:  # the latter bounds memory, whatever the hashes did
                    yield from closed()
                    shard, texts, size = number, {}, 0
                texts.setdefault((lang, owner), []).append(text)
                size += len(text)
        yield from closed()

    return run


def phrase_counts(texts: DataFrame, *, least: int = 10, longest: int = 3) -> DataFrame:
    """(lang, phrase, n): words, phrases of 2 to `longest` words with n >= least, and with an empty phrase the number of all words; texts (lang, text) without nulls."""
    spark = texts.sparkSession
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    phrases = max(1, chars // 6 * longest)
    width = min(MOST_CELLS, max(1 << 16, 1 << (phrases // 8).bit_length()))
    held = spark.sparkContext.broadcast(sketch_bits(texts, width, least, longest))
    # smaller ones where there would be fewer than partitions
    shards = max(1, -(-chars // SHARD_BYTES), min(-(-16 * chars // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    lines = texts.mapInArrow(_stretches(held, width, longest, shards, BATCH_BYTES), "shard int, lang string, owner int, text string, n long")
    dealt = lines.repartition(shards, "shard").sortWithinPartitions("shard")
    counts = dealt.mapInArrow(_scanned(held, width, longest, shards, PATTERNS, SHARD_BYTES), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stash(counts.where((F.col("n") >= least) | (F.col("phrase") == "")), "frequent")


def whole_score(a, part, rest):
    """floor(1,000,000 a a / (l r)) in whole numbers: exact for counts below 10**15."""
    wide = lambda c: c.cast("decimal(15,0)")
    above = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    below = (wide(part) * wide(rest)).cast("decimal(31,0)")
    return F.call_function("div", above, below)


def mine_collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by their weakest cut.

    A phrase is dropped if a longer candidate that holds it has at least `share` percent of its count.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = phrase_counts(texts, least=least, longest=longest)
    sizes = known.where("phrase = ''").select("lang", "n")
    frequent = known.where(F.col("phrase").contains(" "))
    words = F.split("phrase", " ")
    cut = lambda w, k: F.array_join(F.slice(w, 1, k), " ")
    rest = lambda w, k: F.array_join(F.slice(w, k + 1, F.size(w)), " ")
    cuts = frequent.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", cut(F.col("w"), F.col("k")).alias("first"), rest(F.col("w"), F.col("k")).alias("rest"))
    with_l = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    with_r = with_l.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    scored = with_r.withColumn("score", whole_score(F.col("a"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda s: F.array_join(F.slice("w", s, n), " "))))
    longer = frequent.withColumn("w", words).where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n")
    above = longer.groupBy("lang", "phrase").agg(F.max("n").alias("above"))
    kept = weakest.join(above, ["lang", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
