"""Near-duplicate documents by SetSketch signatures.

A document's set holds the hashes of its distinct shingles of ``k`` words. Its sketch has one register for each of ``bands * rows`` hash
functions: the least hash over the set as an exponential variate, kept as a truncated logarithm to ``base``. Registers merge by
maximum and are equal about as often as the sets are similar. Documents with equal sets form one class at once. Classes that agree on all
registers of a band share a bucket; each bucket's members are linked to its hub, the member with the most bucket mates, never to one
another. A pair's joint maximum-likelihood similarity sorts out chance hits, and the full sets decide. What the hubs leave apart is searched once more by the
rarest shingles of each set, which finds every pair above the threshold among documents that met in a bucket; of those the likelihood puts one aside with a probability below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import common as C
from lotwise.llm import textnp as T
from lotwise.llm.components import components

NO_ID = 2**63 - 1
SETS = "id long, body int, n long, key long, sketch binary"


@dataclass(frozen=True)
class NearParams:
    """Documents are linked if 100 * intersection >= percent * union. slack: how many standard deviations below the threshold a likelihood estimate may lie."""

    k: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    base: float = 1.1
    slack: float = 5.0
    most_broadcast: int = 2_000_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _sets(w: T.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the texts' bounds among them. A text of fewer than ``k`` words has one: all its words."""
    hashes = w.hashes()
    grams, _, bounds = T.windows(hashes, w.first, k)
    counts = w.counts
    few = np.flatnonzero((counts > 0) & (counts < k))
    owner = np.repeat(np.arange(len(counts)), np.diff(bounds))
    if len(few):
        grams = np.concatenate([grams, T._runs(T.mix(hashes), w.first[few], w.first[few + 1], T._ODD[1])])
        owner = np.concatenate([owner, few])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(counts) + 1))


def _sketches(grams: np.ndarray, bounds: np.ndarray, params: NearParams) -> np.ndarray:
    """Registers (uint8) of every non-empty set, one row each."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    low = np.empty((params.registers, len(starts)), np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    factors = np.random.Generator(np.random.PCG64(7)).integers(0, 2**31, params.registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    for j, factor in enumerate(factors):
        low[j] = np.minimum.reduceat(short * factor, starts)
    variate = -np.log1p(-(low.T + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(variate) / np.log(params.base)) + 24, 0, 255).astype(np.uint8)


def sketched(docs: DataFrame, params: NearParams) -> DataFrame:
    """(id, body, n, key, sketch): each document's set size, a hash of its whole set and its registers (null for an empty set)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch):
                grams, bounds = _sets(T.words(part.column("text"), lower=True), params.k)
                n = np.diff(bounds)
                full = np.flatnonzero(n > 0)
                key, regs = np.zeros(len(n), np.uint64), [None] * len(n)
                if len(full):
                    starts = bounds[:-1][full]
                    key[full] = T.mix(np.add.reduceat(T.mix(grams), starts) ^ T.mix(np.bitwise_xor.reduceat(T.mix(grams + np.uint64(11)), starts)))
                    for i, row in zip(full, _sketches(grams, bounds, params)):
                        regs[i] = row.tobytes()
                yield pa.record_batch([part.column("id"), part.column("body"), pa.array(n, pa.int64()), pa.array(key.view(np.int64)), pa.array(regs, pa.binary())], ["id", "body", "n", "key", "sketch"])

    return docs.mapInArrow(emit, SETS)


def _bucketed(classes: DataFrame, params: NearParams) -> DataFrame:
    """(bucket, key): one row for each class and band."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                regs = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, params.bands, params.rows).astype(np.uint64)
                mixed = np.zeros(regs.shape[:2], np.uint64) + np.arange(params.bands, dtype=np.uint64)
                for j in range(params.rows):
                    mixed = T.mix(mixed * np.uint64(T._ODD[0]) + regs[:, :, j])
                yield pa.record_batch([pa.array(mixed.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column("key").to_numpy(zero_copy_only=False), params.bands))], ["bucket", "key"])

    return classes.select("key", "sketch").mapInArrow(emit, "bucket long, key long")


def likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches from the counts of larger, smaller and equal registers, given the set sizes."""
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    share = np.linspace(0, 1, 101)[None, :] * (np.minimum(n_a, n_b) / np.maximum(n_a, n_b))[:, None]
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base), 1e-12, 1)
    up, down = p(u[:, None] - v[:, None] * share), p(v[:, None] - u[:, None] * share)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (m - more - less)[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(share, fit.argmax(1)[:, None], 1)[:, 0]


def _likely(pairs: DataFrame, classes: DataFrame, params: NearParams) -> DataFrame:
    """Of pairs (a, b) those whose estimate is not far below the threshold."""
    t = params.percent / 100
    least = t - params.slack * (t * (1 - t) / params.registers) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("sa", "sb"))
                n_a, n_b = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
                yes = likelihood(a, b, n_a, n_b, params.base) >= least
                yield part.select(["a", "b"]).filter(pa.array(yes))

    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    return sized.where(100 * F.least("na", "nb") >= params.percent * F.greatest("na", "nb")).mapInArrow(keep, "a long, b long")


def _full_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, params: NearParams) -> DataFrame:
    """(key, shingles): the whole set of each wanted class, read again from the text of one of its documents."""
    wanted = C.cut(classes.join(keys, "key").select("key", F.col("first.id").alias("id"), F.col("first.body").alias("body")))
    wanted = F.broadcast(wanted) if C.small(wanted, params.most_broadcast) else wanted

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch):
                grams, bounds = _sets(T.words(part.column("text"), lower=True), params.k)
                raw = grams.tobytes()
                yield pa.record_batch([part.column("key"), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds, bounds[1:])], pa.binary())], ["key", "shingles"])

    return docs.join(wanted, ["id", "body"]).select("key", "text").mapInArrow(emit, "key long, shingles binary").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, params: NearParams) -> DataFrame:
    """Of pairs (a, b) those that the full sets link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                yes.append(100 * both >= params.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    side = lambda x: sets.select(F.col("key").alias(x), F.col("shingles").alias(f"x{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(keep, "a long, b long")


#: Ratio of the set sizes in one size class, and how many rows of the larger side one task of the search holds of a shingle and class.
_CLASS = 1.02
_HELD = 500


def _rare_pairs(sets: DataFrame, labels: DataFrame, params: NearParams) -> DataFrame:
    """Pairs of classes with different labels that share one of their rarest shingles.

    With all sets in one order of shingles, linked sets of x and y shingles, which share at least o = t / (1 + t) * (x + y), share one that is among the first
    x - o + 1 and y - o + 1. Rarest first, what a whole group of copies has in common comes last and is seldom among them. The smaller set of a pair is found under
    its size class; the larger one looks into all classes that its partner may have, into each only as deep as that class needs. In each group of a shingle and a class
    the most common label is only ever on one side, so that a large connected group is not paired with itself.
    """
    t = params.percent / 100

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
                n = np.array([len(x) for x in raw])
                yield pa.record_batch([pa.array(np.concatenate(raw)), pa.array(np.repeat(part.column("key").to_numpy(zero_copy_only=False), n)), pa.array(np.repeat(part.column("label").to_numpy(zero_copy_only=False), n)), pa.array(np.repeat(n, n))], ["s", "key", "label", "n"])

    held = sets.join(labels, "key").mapInArrow(emit, "s long, key long, label long, n long")
    seen = held.groupBy("s").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "s"))
    n = F.col("n")
    first = held.join(seen, "s").withColumn("r", rank).where((F.col("r") <= n - F.ceil(n * t - 1e-9) + 1) & (F.col("df") > 1))
    first = C.cut(first.select("s", "key", "label", "n", "r"))
    size_class = lambda x: F.floor(F.log(x) / float(np.log(_CLASS)))
    least = lambda x, y: F.ceil((x + y) * (t / (1 + t)) - 1e-9)
    smaller = first.where(F.col("r") <= n - least(n, n) + 1).withColumn("c", size_class(n)).withColumn("probe", F.lit(False))
    low = F.greatest(size_class(n * t) - 1, F.lit(0))
    larger = first.withColumn("c", F.explode(F.sequence(low, size_class(n))))
    smallest = F.greatest(F.ceil(n * t - 1e-9), F.floor(F.pow(F.lit(_CLASS), F.col("c"))))
    larger = larger.where(F.col("r") <= n - least(n, smallest) + 1).withColumn("probe", F.lit(True))
    sides = smaller.unionByName(larger)
    # only groups in which several components meet can bring them together
    main = sides.groupBy("s", "c", "label").agg(F.count_if(~F.col("probe")).alias("k"), F.count_if("probe").alias("m"))
    main = main.groupBy("s", "c").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("k").alias("k"), F.sum("m").alias("m"))
    main = C.cut(main.where("low < high and k > 0 and m > 0").select("s", "c", "main", F.ceil(F.col("m") / _HELD).alias("parts")))
    placed = C.cut(sides.join(main, ["s", "c"]))
    part = F.pmod(F.xxhash64("key"), "parts")
    x = placed.where("probe").select("s", "c", part.alias("part"), F.col("key").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("r").alias("ra"), "main")
    y = placed.where("not probe").select("s", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("key").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("main").alias("mb"))
    o = least(F.col("na"), F.col("nb"))
    fits = (F.col("la") != F.col("lb")) & (F.col("nb") <= F.col("na")) & (F.col("ra") <= F.col("na") - o + 1) & (F.col("rb") <= F.col("nb") - o + 1)
    on = ["s", "c", "part"]
    both = x.where("la <> main").join(y, on).where(fits).select("a", "b").union(x.where("la = main").join(y.where("lb <> mb"), on).where(fits).select("a", "b"))
    pairs = C.cut(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    C.drop(first, main, placed)
    return pairs


def near_dedup(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """Per row of ``docs``: doc_id, body (hash of the text), n_shingles, component_id (the least doc_id reachable over links), kept (doc_id = component_id).

    Null and empty texts and texts without words have an empty set, are linked with nothing and are kept. Repeated rows have equal results. A null
    doc_id comes after all others: such a row is kept only in a component without any id. Very long texts have sets of all their shingles. A pair exactly at the threshold (a tie) is
    linked. An empty table gives an empty result. Columns other than doc_id and text are not looked at, whatever their names.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.shiftright(F.xxhash64("text"), 33).cast("int").alias("body"), F.coalesce("text", F.lit("")).alias("text"))
    rows = C.cut(sketched(own, params))
    classes = C.cut(rows.where("n > 0").groupBy("key").agg(F.min(F.struct("id", "body")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    placed = _bucketed(classes, params)
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = C.cut(placed.join(sizes, "bucket"))
    scores = met.groupBy("key").agg(F.sum("size").alias("score"))
    hubs = met.join(scores, "key").groupBy("bucket").agg(F.max_by("key", F.struct("score", "key")).alias("hub"))
    stars = met.join(hubs, "bucket").where("key <> hub").select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct()
    pairs = C.cut(_likely(stars, classes, params))
    ends = lambda df: df.select(F.col("a").alias("key")).union(df.select(F.col("b").alias("key"))).distinct()
    linked = C.cut(_verified(pairs, _full_sets(own, classes, ends(pairs), params), params))
    grouped = components(linked)

    # buckets that the hubs have not made one component
    label = F.coalesce("label", F.col("key"))
    labelled = met.select("bucket", "key").join(grouped.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", label.alias("label"))
    apart = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    open_keys = C.cut(labelled.join(apart, "bucket", "left_semi").select("key", "label").distinct())
    sets = C.cut(_full_sets(own, classes, open_keys.select("key"), params))
    near = C.cut(_likely(_rare_pairs(sets, open_keys, params), classes, params))
    more = C.cut(_verified(near, sets, params))
    final = components(linked.union(more)) if more.limit(1).count() else grouped
    C.drop(met, pairs, open_keys, sets, near)

    named = classes.select("key", F.col("first.id").alias("low")).join(final.withColumnRenamed("node", "key"), "key", "left").select("key", "low", label.alias("label"))
    lowest = named.groupBy("label").agg(F.min("low").alias("lowest"))
    answer = named.join(lowest, "label").select("key", "lowest")
    out = rows.drop("sketch").join(answer, "key", "left").withColumn("component", F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known("id").alias("doc_id"), "body", F.col("n").alias("n_shingles"), known("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
