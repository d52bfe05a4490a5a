"""Passage dedup with a sparse suffix array.

A suffix (document, word position) is retained where the half-length word gram that starts there is the least-hashed one of some window of
``width`` words; the choice depends on content alone, so every passage of ``width`` words that two documents share retains a suffix at the same
place in both. Suffixes whose first ``width // 2`` words stand in one document only cannot be part of a match and leave by a fingerprint of those words.

The others are written with their words: up to ``width`` to the right, up to half as many to the left. They are sorted by their words, over
all partitions, and compared with their neighbours in that order: the words a neighbour shares bound the run of suffixes that agree so far to the right. Inside each run
matches are extended to the left, word by word, and a suffix loses the words of all matches of ``width`` words with a document of a smaller id.
Suffixes of a beginning that very many documents share would all be neighbours in one task; these alone are matched by the windows over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common as C
from lotwise.llm import passages as P
from lotwise.llm import textnp as T

SUFFIXES = "id long, body int, keys array<long>, ats array<int>"
CONTEXTS = "hot boolean, before string, after string, id long, body int, at long"
PARTS = "id long, body int, lo long, hi long"
#: Longer words stand in a suffix by a digest, so that suffixes over a very long word stay short.
LONGEST = 64


def _anchors(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``width`` words: the word index of its retained suffix (the first place of its least gram) and that gram's hash; the windows'
    bounds."""
    half = width // 2
    grams, _, inner = T.windows(hashes, first, half)
    least, at, bounds = T.sampled(hashes, first, width)
    if not len(at):
        return at, least, bounds
    owner = np.repeat(np.arange(len(first) - 1), np.diff(bounds))
    start = at - first[owner] + inner[owner]  # of the window's first gram among all grams
    # the least gram's place: the first gram at or after the window's start that equals the least one
    order = np.lexsort((np.arange(len(grams)), grams))
    ranked = grams[order]
    # places of equal grams ascend inside their run; step to the first that is not before the window
    lo = np.searchsorted(ranked, least, "left")
    place = order[lo]
    behind = np.flatnonzero(place < start)
    if len(behind):
        run_end = np.searchsorted(ranked, least[behind], "right")
        a, b = lo[behind], run_end
        while True:  # binary search inside each run
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) // 2
            low = order[np.minimum(mid, len(order) - 1)] < start[behind]
            a = np.where(open_ & low, mid + 1, a)
            b = np.where(open_ & ~low, mid, b)
        place[behind] = order[a]
    return place - inner[owner] + first[owner], least, bounds


def suffixes(docs: DataFrame, width: int) -> DataFrame:
    """(id, body, keys, ats): where each document's retained suffixes start, and the hashes of their first ``width // 2`` words; documents without any are left out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in T.rows(batch):
                place, least, bounds = _anchors(w.hashes(), w.first, width)
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                place, least, owner = place[new], least[new], owner[new]
                edges = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                keys = pa.ListArray.from_arrays(edges, pa.array(least.view(np.int64)))
                ats = pa.ListArray.from_arrays(edges, pa.array((place - w.first[owner]).astype(np.int32)))
                some = pa.record_batch([part.column("id"), part.column("body"), keys, ats], ["id", "body", "keys", "ats"])
                yield some.filter(pa.array(np.diff(edges.to_numpy()) > 0))

    return docs.select("id", "body", "text").mapInArrow(emit, SUFFIXES)


def contexts(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """Rows of CONTEXTS: each wanted suffix (``places``: id, body, anchors as structs of at and hot) with the words around its start."""
    back = width - width // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body, text, anchors in zip(*(batch.column(c) for c in ("id", "body", "text", "anchors"))):
                words = text.as_py().encode().split()
                words = [x if len(x) <= LONGEST else b"\x00" + hashlib.blake2b(x, digest_size=16).hexdigest().encode() for x in words]
                edge = np.concatenate([[0], np.cumsum([len(x) + 1 for x in words])]).tolist()
                joined = b" ".join(words) + b" "
                at = anchors.values.field("at").to_pylist()
                hot = anchors.values.field("hot")
                n = len(words)
                for k in range(0, len(at), 4000):
                    some = at[k : k + 4000]
                    before = pa.array([joined[edge[max(a - back, 0)] : edge[a]] for a in some], pa.binary()).cast(pa.string())
                    after = pa.array([joined[edge[a] : edge[min(a + width, n)]] for a in some], pa.binary()).cast(pa.string())
                    m = len(some)
                    yield pa.record_batch([hot.slice(k, m), before, after, pa.array([i.as_py()] * m, pa.int64()), pa.array([body.as_py()] * m, pa.int32()), pa.array(some, pa.int64())], ["hot", "before", "after", "id", "body", "at"])

    return docs.select("id", "body", "text").join(places.hint("merge"), ["id", "body"]).mapInArrow(emit, CONTEXTS)


def _words_of(texts: pa.Array, most: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text as a row of ``most`` columns (the nearest word first), and how many there are."""
    w = T.words(texts)
    out = np.zeros((len(texts), most), np.uint64)
    n = w.counts
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(w.starts)) - w.first[owner]
    out[owner, n[owner] - 1 - at if backwards else at] = w.hashes()
    return out, n


@dataclass
class Ordered:
    """Suffixes in the order of their words. common: words shared with the one before; sides: hashes of the nearest 0, 1, 2, ... words to the left; the others: words
    there are to either side, and whose they are."""

    common: np.ndarray
    sides: np.ndarray
    n_right: np.ndarray
    n_left: np.ndarray
    ids: np.ndarray
    body: np.ndarray
    at: np.ndarray

    def __getitem__(self, some: slice) -> Ordered:
        return Ordered(*[getattr(self, f.name)[some] for f in fields(self)])

    def __len__(self) -> int:
        return len(self.ids)

    @staticmethod
    def joined(parts: list[Ordered]) -> Ordered:
        return Ordered(*[np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Ordered)])


def ordered_rows(part: pa.RecordBatch, width: int, last: tuple | None = None) -> tuple[Ordered, tuple]:
    """The suffixes of a batch, and what the next batch needs of the last one."""
    back = width - width // 2
    right, n_right = _words_of(part.column("after"), width, False)
    left, n_left = _words_of(part.column("before"), back, True)
    before, n_before = (np.zeros((1, width), np.uint64), np.zeros(1, n_right.dtype)) if last is None else last
    before, n_before = np.concatenate([before, right[:-1]]), np.concatenate([n_before, n_right[:-1]])
    unequal = np.concatenate([right != before, np.ones((len(right), 1), bool)], axis=1)
    sides = np.zeros((len(right), back + 1), np.uint64)
    for o in range(back):
        sides[:, o + 1] = T.mix(sides[:, o] * np.uint64(T._ODD[0]) + left[:, o])
    whose = [part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "body", "at")]
    return Ordered(np.minimum(unequal.argmax(1), np.minimum(n_right, n_before)).astype(np.int32), sides, n_right, n_left, *whose), (right[-1:], n_right[-1:])


def matches(rows: Ordered, width: int) -> pa.RecordBatch:
    """Rows of PARTS: what each suffix loses to documents of smaller ids among the rows."""
    most, least = np.full(len(rows), -1), np.full(len(rows), -1)
    for o in range(width - width // 2 + 1):
        whole = np.flatnonzero((rows.n_right >= width - o) & (rows.n_left >= o))
        if not len(whole):
            continue
        run = np.cumsum(rows.common < width - o).astype(np.uint64)
        group = T.mix(rows.sides[whole, o] + T.mix(run[whole]))
        order = np.argsort(group, kind="stable")
        ranked, own = group[order], rows.ids[whole][order]
        begin = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
        lowest = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.concatenate([begin, [len(own)]])))
        hit = whole[order[lowest < own]]
        most[hit] = o
        least[hit[least[hit] < 0]] = o
    found = np.flatnonzero(most >= 0)
    return pa.record_batch([rows.ids[found], rows.body[found], rows.at[found] - most[found], rows.at[found] - least[found] + width], ["id", "body", "lo", "hi"])


def neighbours(ordered: DataFrame, width: int, rows: int = 1 << 11) -> DataFrame:
    """Rows of PARTS from suffixes sorted within partitions of whole beginnings; a task holds some ``rows`` suffixes and, in short form, those of the beginning that is open."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Ordered] = []
        last = None
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                now, last = ordered_rows(batch.slice(k, rows), width, last)
                new = np.flatnonzero(now.common < width // 2)
                if len(new) and (new[-1] or held):  # all before the last beginning is complete
                    held.append(now[: new[-1]])
                    yield matches(Ordered.joined(held), width)
                    held, now = [], now[new[-1] :]
                held.append(now)
        if held:
            yield matches(Ordered.joined(held), width)

    return ordered.mapInArrow(compare, PARTS)


def _hot_windows(hot: DataFrame, width: int) -> DataFrame:
    """Rows of passages.WINDOWS: the windows over suffixes with a very common beginning."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                before = T.words(part.column("before")).counts
                w = T.words(pa.array([a + b for a, b in zip(part.column("before").to_pylist(), part.column("after").to_pylist())], pa.string()))
                hashes = w.hashes()
                _, at, bounds = T.windows(hashes, w.first, width)
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                shift = part.column("at").to_numpy(zero_copy_only=False) - before
                yield P.window_rows(part, hashes, w.first, at, owner, width, shift)

    return hot.mapInArrow(emit, P.WINDOWS)


def suffix_dedup(docs: DataFrame, width: int = 50, most_broadcast: int = 2_000_000, most_neighbours: int = 200_000, texts: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (null unless ``texts``), kept_sha256, spans (word ranges removed).

    A word is removed if a passage of ``width`` words over it also occurs in a document with a smaller doc_id. Null and empty texts have no
    words; repeated rows give repeated results; rows of one id and different texts are never held against each other; a null id counts as
    larger than all others. Very long texts and texts of fewer than ``width`` words need no case of their own. Of equal passages (ties) the one in the smallest id
    stays, all its occurrences there with it. An empty table gives an empty result. Columns other than doc_id and text are not looked at, whatever their names.
    ``most_neighbours``: suffixes of one beginning that are compared in one task (some 300 bytes each); more frequent beginnings are matched by the windows over them, with the same result.
    """
    own = P.keyed(docs)
    copied = P.copies(own)
    # copies leave by their suffixes, which are short; the texts are shuffled twice in all: to their anchors, and to what they lose
    fresh = C.cut(suffixes(own, width).join(copied, ["id", "body"], "left_anti"))
    found = fresh.select("id", "body", F.explode(F.arrays_zip("keys", "ats")).alias("x")).select("id", "body", F.col("x.keys").alias("key"), F.col("x.ats").alias("at"))
    counts = found.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    shared = C.cut(counts.where("least < most").select("key", (F.col("n") > most_neighbours).alias("hot")))
    places = found.join(shared, "key").groupBy("id", "body").agg(F.collect_set(F.struct(F.col("at").cast("long").alias("at"), "hot")).alias("anchors"))
    array = C.cut(contexts(own, places, width))
    C.drop(fresh, shared)

    # so many letters lie within the first half of a window, so no beginning is dealt to two tasks
    ordered = array.where("not hot").drop("hot").repartitionByRange(F.substring("after", 1, 2 * (width // 2))).sortWithinPartitions("after", "id")
    parts = neighbours(ordered, width)
    hot = array.where("hot")
    if hot.limit(1).count():
        late = P.later(_hot_windows(hot, width))
        parts = parts.unionByName(late.select("id", "body", F.col("start").alias("lo"), (F.col("start") + width).alias("hi")))
    every = copied.select("id", "body", F.lit(0).cast("long").alias("lo"), F.lit(P.NO_ID).alias("hi"))
    spans = C.cut(P.gathered(parts.unionByName(every)))
    C.drop(array, copied)
    return P.settle(own.withColumn("copied", F.lit(False)), spans.hint("merge"), lambda part, w: w.counts >= width, width, texts, most_broadcast)
