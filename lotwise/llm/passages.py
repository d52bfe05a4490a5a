"""Exact removal of passages that an earlier document holds, from candidate windows.

Shared by the two passage operators: each finds, in its own way, windows of ``width`` words that may occur in several documents and
misses none that does. Here they are grouped exactly, by 96 bits of hash; each word covered by a window that also starts in a
document with a smaller id is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common as C
from lotwise.llm import textnp as T

#: A null id counts as larger than all others.
NO_ID = 2**63 - 1
WINDOWS = "h1 long, h2 int, id long, spot long"
SLIM = "id long, body int, text string, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:long,end:long>>"
FULL = "id long, body int, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<struct<start:long,end:long>>"


def keyed(docs: DataFrame) -> DataFrame:
    """(id, body, text): a row's key is its id and 32 bits of its text's hash, for ids that occur with several texts."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.shiftright(F.xxhash64("text"), 33).cast("int").alias("body"), F.coalesce("text", F.lit("")).alias("text"))


def copies(docs: DataFrame) -> DataFrame:
    """(id, body), written once: the documents whose whole text also stands under a smaller id. They need no windows, so groups of copies count once."""
    marks = docs.select("id", "body", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    groups = marks.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    return C.cut(marks.join(groups, ["a", "b"]).where("id > least").select("id", "body").distinct())


def window_rows(part: pa.RecordBatch, hashes: np.ndarray, first: np.ndarray, at: np.ndarray, owner: np.ndarray, width: int, shift: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of WINDOWS for the windows that start at the words ``at``; ``owner``: the row of ``part`` each belongs to; ``shift``: the place of a row's first word in its document."""
    if not len(at):
        return pa.record_batch([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], ["h1", "h2", "id", "spot"])
    h1 = T._runs(T.mix(hashes), at, at + width, T._ODD[1])
    h2 = T._runs(T.mix(hashes + np.uint64(1)), at, at + width, T._ODD[2])
    ids = part.column("id").to_numpy(zero_copy_only=False)[owner]
    body = part.column("body").to_numpy(zero_copy_only=False)[owner].astype(np.int64)
    spot = (body << 32) | (at - first[owner] + (0 if shift is None else shift[owner]))
    return pa.record_batch([h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), ids, spot], ["h1", "h2", "id", "spot"])


def later(windows: DataFrame) -> DataFrame:
    """(id, body, start): where windows start that also start in a document with a smaller id.

    Windows are aggregated first; the few that several documents hold are written and joined back, so that Spark may split a hot window's rows over tasks.
    """
    known = windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    late = windows.join(C.cut(known), ["h1", "h2"]).where("id > least")
    return late.select("id", F.shiftright("spot", 32).cast("int").alias("body"), F.col("spot").bitwiseAND(0xFFFFFFFF).alias("start"))


def few(table: DataFrame, array: str, most: int) -> bool:
    """True if the rows of a cut table and the items of its array column are at most ``most`` together, so that it may be broadcast."""
    return sum(table.agg(F.count("*"), F.coalesce(F.sum(F.size(array)), F.lit(0))).first()) <= most


def gathered(parts: DataFrame) -> DataFrame:
    """(id, body, lo, hi): of each document the word ranges (id, body, lo, hi) as two ascending arrays, ranges that touch made one: about as many as it has passages."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            los, his = [], []
            for ranges in batch.column("p"):
                lo, hi = (ranges.values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                first = np.concatenate([[True], lo[1:] > reach[:-1]])
                los.append(lo[first])
                his.append(reach[np.concatenate([first[1:], [True]])])
            kind = pa.list_(pa.int64())
            yield pa.record_batch([batch.column("id"), batch.column("body"), pa.array(los, kind), pa.array(his, kind)], ["id", "body", "lo", "hi"])

    both = parts.groupBy("id", "body").agg(F.collect_list(F.struct("lo", "hi")).alias("p"))
    return both.mapInArrow(merge, "id long, body int, lo array<long>, hi array<long>")


def _result(text: bytes, n: int, gone: np.ndarray | None) -> dict:
    kept = text.split()
    if gone is not None:
        kept = [w for w, g in zip(kept, gone) if not g]
    joined = b" ".join(kept)
    edges = [] if gone is None else np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
    return {"n_words": n, "n_removed": 0 if gone is None else int(gone.sum()), "kept_text": joined.decode(), "kept_sha256": hashlib.sha256(joined).hexdigest(), "spans": [{"start": a, "end": b} for a, b in edges]}


def settle(docs: DataFrame, spans: DataFrame, touched: Callable, width: int, texts: bool, most_broadcast: int) -> DataFrame:
    """The final row of each document. ``spans``: a cut table as ``gathered`` makes it. If it is short it meets the documents where they are; else the texts of
    those documents are shuffled that may lose words, by ``touched(part, words)``."""
    slim = pa.schema([("id", pa.int64()), ("body", pa.int32()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    full = slim.remove(2)

    def finished(text: str, n: int, gone: np.ndarray | None) -> dict:
        row = _result(text.encode(), n, gone)
        return row if texts else row | {"kept_text": None}

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in T.rows(batch):
                may, copied = touched(part, w), part.column("copied").to_pylist()
                out = []
                for i, (doc, body, text, n) in enumerate(zip(part.column("id").to_pylist(), part.column("body").to_pylist(), part.column("text").to_pylist(), w.counts.tolist())):
                    row = {"id": doc, "body": body, "text": None}
                    if copied[i] and n >= width:
                        row |= finished(text, n, np.ones(n, bool))
                    elif may[i]:
                        row["text"] = text
                    else:
                        row |= finished(text, n, None)
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, slim)

    def gone(n: int, lo: pa.Scalar, hi: pa.Scalar) -> np.ndarray:
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, lo.values.to_numpy(zero_copy_only=False), 1)
        np.add.at(step, np.minimum(hi.values.to_numpy(zero_copy_only=False), n), -1)
        return np.cumsum(step[:-1]) > 0

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in T.rows(batch):
                los, his = part.column("lo"), part.column("hi")
                copied = part.column("copied").to_pylist() if "copied" in part.schema.names else [False] * part.num_rows
                done = part.select([c for c in full.names if c in part.schema.names]).to_pylist()
                for i, (row, text, n) in enumerate(zip(done, part.column("text").to_pylist(), w.counts.tolist())):
                    if text is not None:
                        mask = np.ones(n, bool) if copied[i] and n >= width else gone(n, los[i], his[i]) if los[i].is_valid and n >= width else None
                        row |= finished(text, n, mask)
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in full.names} for r in done], full)

    if few(spans, "lo", most_broadcast):
        met = docs.join(F.broadcast(spans), ["id", "body"], "left")
    else:
        met = docs.mapInArrow(first_pass, SLIM).join(spans, ["id", "body"], "left")
    done = met.mapInArrow(last_pass, FULL)
    return done.withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id"))).drop("id", "body")
