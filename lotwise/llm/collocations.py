"""Phrases of two and three words that stand together more often than their parts would.

A phrase can be frequent only if all its parts are (Apriori). So the keys of words and pairs are counted first, then those of triples over frequent pairs; what reaches the
threshold is a candidate. The candidates, in blocks of a bounded size, get a minimal perfect hash whose slots store the keys. Mappers go over the texts with it: every run of
words is looked up, the stored key tells whether it is a candidate, and occurrences are counted by slot (``bincount``) in one array for each task. The arrays are added up in a tree, a range of slots
at a time; beside each count stands the least mark of an occurrence, and a last pass reads the phrase where that one stands, so no task names the phrases it only counts. Scores need the counts of both sides of each cut; they are read from the summed array at the slots of the sides' keys.

Keys are 64 bits of hash of language and words. Whatever a task holds is bounded by ``block`` and ``filter_bits``; more candidates mean more blocks, each of which is two more passes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import common as C
from lotwise.llm import textnp as T
from lotwise.llm.perfect_hash import PerfectHash

#: Bytes that end a piece, and those that part words.
CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = CUT.copy()
GAP[[0x20, 0x09]] = True
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
LONGEST = 3
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
#: Keys that a task gathers before it counts them, rows of an Arrow batch, slots of a piece of an array, arrays that one step of the tree adds.
_FLUSH, _ROWS, _RANGE, _FAN = 1 << 22, 1 << 18, 1 << 16, 16
#: Shares of a language that are ranked apart first.
_SHARES = 64
_BUCKET = 1 << 15


@dataclass(frozen=True)
class PhraseParams:
    """min_count: occurrences of a candidate. contained_percent: a phrase goes if a longer candidate with it has so many of its occurrences. top: phrases returned of each
    language. block: most slots of a perfect hash. filter_bits: most bits, as a power of two, of the filter of frequent pairs; a full filter only lets more triples be counted."""

    min_count: int = 10
    contained_percent: int = 50
    top: int = 2000
    block: int = 1 << 22
    filter_bits: int = 27


class Runs:
    """The words of some texts and the keys of their runs of one to three words."""

    def __init__(self, rows: pa.RecordBatch):
        self.langs = ["und" if x is None else x for x in rows.column("lang").to_pylist()]
        self.words = T.words(rows.column("text"), lower=True, space=GAP)
        w = self.words
        salts = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in set(self.langs)}
        self.text = np.repeat(np.arange(len(self.langs)), w.counts)
        pieces = np.cumsum(CUT[w.data])[w.starts] + self.text
        hashes = w.hashes()
        self.keys = [T.mix(hashes ^ np.array([salts[x] for x in self.langs], np.uint64)[self.text])]
        self.whole = [np.ones(len(hashes), bool)]
        for n in range(1, LONGEST):
            k = max(len(hashes) - n, 0)
            self.keys.append(T.mix(self.keys[-1][:k] * _ODD + hashes[n : n + k]))
            self.whole.append(pieces[:k] == pieces[n : n + k])

    def phrase(self, at: int, n: int) -> str:
        w = self.words
        return b" ".join(w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(at, at + n)).decode("utf-8", "replace")

    def marks(self, at: np.ndarray) -> np.ndarray:
        """A number for each of some places, from what stands there, the place and the length of the text: the same whichever task reads it."""
        text = self.text[at]
        place = at - self.words.first[text]
        return (T.mix(self.keys[0][at] + place.astype(np.uint64) * _ODD + (self.words.counts[text].astype(np.uint64) << np.uint64(32))) >> np.uint64(33)).astype(np.uint32)

    def sides(self, at: np.ndarray, n: int) -> np.ndarray:
        """A row for each run of ``n`` words: its own key, then the keys of both sides of each cut."""
        cols = [self.keys[n - 1][at]]
        for k in range(1, n):
            cols += [self.keys[k - 1][at], self.keys[n - k - 1][at + k]]
        return np.stack(cols, 1)


def runs(batch: pa.RecordBatch) -> Iterator[Runs]:
    for rows in T.pieces(batch):
        yield Runs(rows)


def _counted(docs: DataFrame, picked) -> DataFrame:
    """(key, n): occurrences of the keys that ``picked`` takes from runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from (pa.record_batch([keys[i : i + _ROWS].view(np.int64), counts[i : i + _ROWS]], ["key", "n"]) for i in range(0, len(keys), _ROWS))

        for batch in batches:
            for r in runs(batch):
                held += picked(r)
                n += sum(map(len, held[-LONGEST:]))
                if n >= _FLUSH:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    return docs.select("lang", "text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _bit_filter(keys: DataFrame, most_bits: int) -> np.ndarray:
    """Bits of the cells that keys fall into: at most 2**most_bits of them, whatever the number of keys."""
    size = 1 << int(min(most_bits, max(16, np.ceil(np.log2(16 * keys.count() + 1)))))
    cell = F.pmod("key", F.lit(size)) + 1
    rows = keys.select(F.bitmap_bucket_number(cell).alias("bucket"), F.bitmap_bit_position(cell).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros((size // _BUCKET, _BUCKET // 8), np.uint8)
    for r in rows.collect():
        bits[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def _in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def candidates(docs: DataFrame, params: PhraseParams) -> DataFrame:
    """(key): keys of the words and phrases that occur ``min_count`` times or more; a cut table."""
    frequent = lambda counted: counted.where(F.col("n") >= params.min_count).select("key")
    short = C.cut(frequent(_counted(docs, lambda r: [k[w] for k, w in zip(r.keys[:2], r.whole[:2])])))
    sc = docs.sparkSession.sparkContext
    pairs = sc.broadcast(_bit_filter(short, params.filter_bits))

    def triples(r: Runs) -> list[np.ndarray]:
        if len(r.keys[2]) == 0:
            return []
        known = _in_filter(pairs.value, r.keys[1])
        return [r.keys[2][r.whole[2] & known[:-1] & known[1:]]]

    every = C.cut(short.union(frequent(_counted(docs, triples))))
    C.drop(short)
    return every


_ARRAYS = "node int, at int, slots binary, counts binary, least binary"
_PHRASES = "key long, lang string, phrase string, sides array<long>"
_NONE = np.uint32(2**32 - 1)


def _hits(r: Runs, table: PerfectHash) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of one, two and three words: how many, where those that are candidates begin, and their slots."""
    for n, (keys, whole) in enumerate(zip(r.keys, r.whole), 1):
        at = np.flatnonzero(whole)
        slots = table.find(keys[at])
        yield n, at[slots >= 0], slots[slots >= 0]


def _by_slot(docs: DataFrame, found) -> DataFrame:
    """The tasks' arrays over the slots of a perfect hash, in sparse pieces (node, at, slots, counts, least): occurrences of the slot's key, and the least number that marks one of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: PerfectHash = found.value
        counts, least, node = np.zeros(len(table), np.int64), np.full(len(table), _NONE, np.uint32), TaskContext.get().partitionId()
        for batch in batches:
            for r in runs(batch):
                hits = []
                for n, at, slots in _hits(r, table):
                    hits.append(slots)
                    if n > 1:
                        np.minimum.at(least, slots, r.marks(at))
                counts += np.bincount(np.concatenate(hits), minlength=len(table))
        for low in range(0, len(table), _RANGE):
            piece = _sparse(counts[low : low + _RANGE], least[low : low + _RANGE])
            yield pa.record_batch([pa.array([node], pa.int32()), pa.array([low // _RANGE], pa.int32()), *[pa.array([x], pa.binary()) for x in piece]], ["node", "at", "slots", "counts", "least"])

    return docs.select("lang", "text").mapInArrow(scan, _ARRAYS)


def _sparse(counts: np.ndarray, least: np.ndarray) -> tuple[bytes, bytes, bytes]:
    some = np.flatnonzero(counts)
    return some.astype("<u2").tobytes(), counts[some].astype("<i8").tobytes(), least[some].astype("<u4").tobytes()


def _add(table: pa.Table) -> pa.Table:
    """The sum of sparse pieces of one range of slots, as one."""
    counts, least = np.zeros(_RANGE, np.int64), np.full(_RANGE, _NONE, np.uint32)
    for slots, n, low in zip(*[table.column(c).to_pylist() for c in ("slots", "counts", "least")]):
        at = np.frombuffer(slots, "<u2")
        counts[at] += np.frombuffer(n, "<i8")
        least[at] = np.minimum(least[at], np.frombuffer(low, "<u4"))
    one = table.slice(0, 1)
    return pa.table([one.column("node"), one.column("at"), *[pa.array([x], pa.binary()) for x in _sparse(counts, least)]], ["node", "at", "slots", "counts", "least"])


def _tree_sum(arrays: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and least marks over all tasks' arrays; each step adds up to ``_FAN`` of them, a range of slots at a time. Both have ``size`` numbers."""
    nodes = arrays.agg(F.max("node")).first()[0] or 0
    while nodes:
        arrays = arrays.withColumn("node", (F.col("node") / _FAN).cast("int")).groupBy("at", "node").applyInArrow(_add, _ARRAYS)
        nodes //= _FAN
    whole = -(-size // _RANGE) * _RANGE
    counts, least = np.zeros(whole, np.int64), np.full(whole, _NONE, np.uint32)
    for r in arrays.collect():  # one row for each range
        at = r["at"] * _RANGE + np.frombuffer(r["slots"], "<u2").astype(int)
        counts[at], least[at] = np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["least"], "<u4")
    return counts[:size], least[:size]


def _spelled(docs: DataFrame, found) -> DataFrame:
    """(key, lang, phrase, sides): the phrases of a hash, read where their occurrence with the least mark stands; ``found`` is a broadcast (hash, least marks)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, least = found.value
        seen = np.zeros(len(table), bool)
        for batch in batches:
            for r in runs(batch):
                for n, at, slots in _hits(r, table):
                    if n == 1 or not len(at):
                        continue
                    here = (r.marks(at) == least[slots]) & ~seen[slots]
                    new, first = np.unique(slots[here], return_index=True)
                    where = at[here][first]
                    seen[new] = True
                    if len(new):
                        sides = r.sides(where, n).view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * sides.shape[1], pa.int32()), pa.array(sides.ravel()))
                        yield pa.record_batch([pa.array(sides[:, 0]), pa.array([r.langs[t] for t in r.text[where]], pa.string()), pa.array([r.phrase(i, n) for i in where.tolist()], pa.string()), lists], ["key", "lang", "phrase", "sides"])

    return docs.select("lang", "text").mapInArrow(read, _PHRASES)


def _read_slots(phrases: DataFrame, read) -> DataFrame:
    """``phrases`` with the counts of those sides whose keys are in the hash of ``read``, a broadcast (hash, counts)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = read.value
        for batch in batches:
            sides = batch.column("sides")
            slots = table.find(sides.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            old = batch.column("got").flatten().to_numpy(zero_copy_only=False)
            got = np.where(slots >= 0, counts[slots] if len(counts) else 0, old)
            lengths = np.concatenate([[0], np.cumsum(sides.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.record_batch([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(got))], batch.schema.names)

    return phrases.mapInArrow(fill, phrases.schema)


def counted_phrases(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """(key, lang, phrase, sides, got): every candidate phrase; ``got`` are the counts of itself and of both sides of each cut."""
    sc = docs.sparkSession.sparkContext
    keys = candidates(docs, params)
    blocks = max(1, -(-keys.count() // params.block))
    reads, parts = [], []
    for b in range(blocks):
        mine = keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow().column("key").to_numpy()
        table = PerfectHash(mine.view(np.uint64))
        sent = sc.broadcast(table)
        arrays = C.cut(_by_slot(docs, sent))
        counts, least = _tree_sum(arrays, len(table))
        C.drop(arrays)
        marks = sc.broadcast((table, least))
        parts.append(C.cut(_spelled(docs, marks).groupBy("key").agg(F.min(F.struct("lang", "phrase", "sides")).alias("it")).select("key", "it.*")))
        reads.append(sc.broadcast((table, counts)))
        sent.unpersist()
        marks.unpersist()
    phrases = reduce(DataFrame.union, parts).withColumn("got", F.transform("sides", lambda x: F.lit(0).cast("long")))
    for read in reads:  # a task holds one block at a time
        phrases = C.cut(_read_slots(phrases, read))
    C.drop(keys, *parts)
    return phrases


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases by score, then a, then the bytes of the phrase.

    a, l, r: occurrences of the phrase and of both sides of its lowest-scoring cut; n: words of the language; score: floor(1000000 a a / (l r)), in whole numbers throughout. Of cuts with equal scores
    (ties) the one after fewer words counts. A null or empty text has no words; a null lang is "und", as is a lang of that name. Repeated rows and repeated ids count each. Very long texts and words are
    read whole. An empty table gives an empty result. Columns other than lang and text are not looked at.
    """
    own = docs.select(F.coalesce(C.quoted("lang").cast("string"), F.lit("und")).alias("lang"), C.quoted("text").cast("string").alias("text"))
    phrases = counted_phrases(own, params)
    words = own.groupBy("lang").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).cast("bigint").alias("n"))
    size = F.shiftright(F.size("sides"), 1) + 1
    whole = lambda x: x.cast("decimal(15,0)")

    def cut_at(k: int):
        l, r = F.get("got", F.lit(2 * k - 1)), F.get("got", F.lit(2 * k))
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole(F.col("a")) * whole(F.col("a")), whole(l) * whole(r))
        return F.when(F.size("sides") > 2 * k, F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))

    longer = phrases.where(F.size("sides") == 5).select(F.explode(F.array(F.get("sides", F.lit(2)), F.get("sides", F.lit(3)))).alias("key"), F.get("got", F.lit(0)).alias("of_longer"))
    longer = longer.where(F.col("of_longer") >= params.min_count).groupBy("key").agg(F.max("of_longer").alias("of_longer"))
    scored = phrases.withColumn("a", F.get("got", F.lit(0))).where(F.col("a") >= params.min_count).withColumn("low", F.array_min(F.array_compact(F.array(*[cut_at(k) for k in range(1, LONGEST)])))).withColumn("words", size)
    alone = scored.join(longer, "key", "left").where(F.col("of_longer").isNull() | (F.col("words") == LONGEST) | (100 * F.col("of_longer") < params.contained_percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= params.top)
    named = alone.select("lang", "phrase", "a", "low.l", "low.r", "low.score", F.pmod("key", F.lit(_SHARES)).alias("share"))
    best = ranked(ranked(named, "lang", "share").drop("rank", "share"), "lang")  # the best of each share of a language first, so none of its rows meet in one task before
    return best.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
