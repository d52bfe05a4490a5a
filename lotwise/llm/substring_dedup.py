"""Substring dedup with a count-min prefilter.

A window of ``width`` words is counted under the least-hashed half-length part inside it; equal windows share that part. The parts of each document, each once, are
written as one short row; exact copies of a smaller id's text leave there. Each task sketches its share of them: for
each of ``depth`` hash functions the counts of the cells that its parts fall into. The sketches are merged by adding
cells, as a table dealt over the cluster by cell, so no task and not the driver ever holds a whole sketch. A part's estimate is the least of its cells' counts: never
below the number of its documents, so a window that stands in two documents is never missed. A second pass emits the windows whose part is estimated repeated and groups them exactly; a window that the
sketch lets through by mistake finds no partner there.

The texts themselves are shuffled twice in all, by the same joins at every size: to their repeated parts, and to the ranges that they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common as C
from lotwise.llm import passages as P
from lotwise.llm import textnp as T

#: Bytes of text hashed at once: a worker keeps what its largest arrays took, and these take some 45 times the text.
_PIECE = 1 << 18
PARTS = "id long, body int, parts array<long>"


def _cell(part: Column, row: int, bits: int) -> Column:
    """Cell number of a hash function; those of different functions differ."""
    return F.shiftrightunsigned(F.xxhash64(part, F.lit(row)), 64 - bits).bitwiseOR(F.lit(row << bits).cast("long"))


def _parts(part: pa.RecordBatch, w: T.Words, width: int) -> pa.RecordBatch:
    """A row of PARTS for each text of at least ``width`` words."""
    values, _, bounds = T.sampled(w.hashes(), w.first, width)
    owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])  # neighbours mostly share theirs
    values, owner = values[new], owner[new]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    edges = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
    parts = pa.ListArray.from_arrays(pa.array(edges), pa.array(values.view(np.int64)))
    return pa.record_batch([part.column("id"), part.column("body"), parts], ["id", "body", "parts"]).filter(pa.array(np.diff(edges) > 0))


def parts_of(docs: DataFrame, width: int) -> DataFrame:
    """Rows of PARTS: of each document the parts under which its windows are counted, each once; documents shorter than a window are left out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in T.rows(batch, most=_PIECE):
                yield _parts(part, w, width)

    return docs.select("id", "body", "text").mapInArrow(emit, PARTS)


def sketch(parts: DataFrame, bits: int, depth: int = 2) -> DataFrame:
    """(cell, n): the merged sketch; cells without a count are left out."""
    part = parts.select(F.explode("parts").alias("part"))
    return part.select(F.explode(F.array(*[_cell(F.col("part"), row, bits) for row in range(depth)])).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def estimated_repeated(parts: DataFrame, bits: int, depth: int = 2) -> DataFrame:
    """(id, body, parts), written once: of each document the parts whose estimate is two or more."""
    crowded = C.cut(sketch(parts, bits, depth).where("n > 1").select("cell"))
    found = parts.select("id", "body", F.explode("parts").alias("part"))
    for row in range(depth):
        cells = crowded.where(F.shiftright("cell", bits) == row).hint("merge")
        found = found.withColumn("cell", _cell(F.col("part"), row, bits)).join(cells, "cell", "left_semi").drop("cell")
    out = C.cut(found.groupBy("id", "body").agg(F.collect_set("part").alias("parts")))
    C.drop(crowded)
    return out


def sketch_bits(parts: DataFrame) -> int:
    """Cells of a hash function, as a power of two: at least eight for each part."""
    n = parts.agg(F.sum(F.size("parts"))).first()[0] or 0
    return int(min(48, max(16, np.ceil(np.log2(8 * n + 1)))))


def substring_dedup(docs: DataFrame, width: int = 50, bits: int | None = None, most_broadcast: int = 2_000_000, texts: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (null unless ``texts``), kept_sha256, spans (word ranges removed).

    A word is removed if a window of ``width`` words over it also starts in a document with a smaller doc_id, judged on the input. Null and empty texts
    have no words and stay as empty texts. Rows of one id and different texts are judged apart and never against each other; repeated rows give repeated
    results. A null id counts as larger than all others. Of equal windows (ties) those of the smallest id stay. Very long texts are worked on whole. An empty table gives an
    empty result. Columns other than doc_id and text are not looked at, whatever their names. ``bits``: size of the sketch (from the corpus if None); a smaller one lets more windows into
    the exact pass and changes no result.
    """
    own = P.keyed(docs)
    copied = P.copies(own)
    parts = C.cut(parts_of(own, width).join(copied.hint("merge"), ["id", "body"], "left_anti"))
    repeated = estimated_repeated(parts, bits or sketch_bits(parts))
    C.drop(parts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in T.rows(batch, most=_PIECE):
                hashes = w.hashes()
                values, at, bounds = T.sampled(hashes, w.first, width)
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                yes = np.zeros(len(values), bool)
                for i, parts in enumerate(part.column("parts")):
                    mine = slice(bounds[i], bounds[i + 1])
                    yes[mine] = np.isin(values[mine], parts.values.to_numpy(zero_copy_only=False).view(np.uint64))
                yield P.window_rows(part, hashes, w.first, at[yes], owner[yes], width)

    near = F.broadcast(repeated) if P.few(repeated, "parts", most_broadcast) else repeated.hint("merge")
    windows = C.cut(own.join(near, ["id", "body"]).mapInArrow(emit, P.WINDOWS))
    C.drop(repeated)
    late = P.later(windows).select("id", "body", F.col("start").alias("lo"), (F.col("start") + width).alias("hi"))
    every = copied.select("id", "body", F.lit(0).cast("long").alias("lo"), F.lit(P.NO_ID).alias("hi"))
    spans = C.cut(P.gathered(late.unionByName(every)))
    C.drop(windows, copied)
    return P.settle(own.withColumn("copied", F.lit(False)), spans.hint("merge"), lambda part, w: w.counts >= width, width, texts, most_broadcast)
