"""Token ids in seekable binary shards.

A shard is a run of documents in ascending doc_id order: zstandard frames that can be decompressed on their own, each with whole
documents of about ``frame_bytes`` of ids, then a skippable frame with the documents' index, then the seek table of the zstandard seekable format
(a skippable frame too) with each frame's sizes and checksum. Any zstandard decoder reads a shard as one stream; ``Shard`` reads single
documents and decompresses only the frame that holds them.

Tasks hand each finished shard to Spark's text writer as one value, so shards land in any store that Spark writes to. The seek table's last four bytes
are the writer's line separator.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm import common as C

#: Fixed values of the formats.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
HEAD, ENTRY, FRAME = struct.Struct("<4sIIIIB"), struct.Struct("<qqIII"), struct.Struct("<III")
MAGIC, HAS_CHECKSUMS = b"LWT1", 0x80
#: Letters that the byte-level pattern below knows as such, of those up to U+00FF.
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Cuts a text only where a byte-level pre-tokenizer cuts it too; a piece may still hold several of its tokens' words.
_PIECE = re.compile(
    rf" ?[{_LETTER}]+| ?[^ \n{_LETTER}]+(?:(?<=')[{_LETTER}]+)?|\n(?![ \n])|[ \n]{{2,}}(?:[{_LETTER}]+|[^ \n{_LETTER}]+(?:(?<=')[{_LETTER}]+)?)?| "
)
_WORD = re.compile(rf" ?[{_LETTER}]+")
#: Texts with other white space, other scripts or a special token's opening are encoded whole.
_OTHER = re.compile(r"[^\S \n]|[^\x00-\xff]|<\|")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces, as little-endian unsigned 32-bit numbers; a new piece is encoded when it is first asked for.

    Bounded, as workers outlive their tasks: when the young pieces are many they become the old ones, and the former old ones that were not asked for again go.
    """

    MOST = 450_000

    def __init__(self, tokenizer):
        self.old: dict[str, bytes] = {}
        self.encode, self.model, self.letters = tokenizer.encode, tokenizer.model, _byte_letters()

    def age(self) -> None:
        if len(self) > self.MOST:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        if piece in self.old:
            self[piece] = packed = self.old[piece]
            return packed
        if _WORD.fullmatch(piece):  # one word for the model, which needs no further cutting
            if piece.isascii():
                letters = "\u0120" + piece[1:] if piece[0] == " " else piece  # the space's stand-in
            else:
                letters = piece.encode().decode("latin-1").translate(self.letters)
            ids = [x.id for x in self.model.tokenize(letters)]
        else:
            ids = self.encode(piece, add_special_tokens=False).ids
        self[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The tokenizer of a file, and its memo of pieces if it is of the plain byte-level kind."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    how = json.loads(tokenizer.to_str())
    before = how["pre_tokenizer"] or {}
    plain = how["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and how["model"]["type"] == "BPE" and not how["model"].get("dropout")
    if plain:
        _MEMOS.append(_Pieces(tokenizer))
    return tokenizer, _MEMOS[-1] if plain else None


#: The memos of this worker.
_MEMOS: list[_Pieces] = []


def forget() -> None:
    """Frees what a worker has kept of the pieces that it encoded longer ago, for work that needs none of it."""
    for memo in _MEMOS:
        memo.old = {}


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit numbers. With a byte-level vocabulary each distinct piece of the texts is encoded once per worker."""
    tokenizer, pieces = _tokenizer(path)
    if pieces is None:
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    out = []
    for text in texts:
        pieces.age()
        if _OTHER.search(text):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        else:
            out.append(b"".join(map(pieces.__getitem__, _PIECE.findall(text))))
    return out


def pack(documents: list[tuple[int, bytes]], part: int, seq: int, frame_bytes: int, level: int = 1) -> bytes:
    """A shard of (doc_id, ids as bytes), without the seek table's last four bytes."""
    packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
    frames, table, index = [], [], []
    held: list[bytes] = []
    size = 0

    def close() -> None:
        nonlocal held, size
        raw = b"".join(held)
        frames.append(packer.compress(raw))
        table.append((len(frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held, size = [], 0

    start = 0
    for doc, ids in documents:
        index.append(ENTRY.pack(doc, start, len(ids) // 4, len(table), size))
        held.append(ids)
        size += len(ids)
        start += len(ids) // 4
        if size >= frame_bytes:
            close()
    if held:
        close()
    body = HEAD.pack(MAGIC, part, seq, len(index), len(table), 1) + b"".join(index)
    directory = struct.pack("<II", SKIPPABLE, len(body)) + body
    seek = b"".join(FRAME.pack(*x) for x in table) + struct.pack("<IB", len(table), HAS_CHECKSUMS)
    return b"".join(frames) + directory + struct.pack("<II", SEEK_TABLE, len(seek) + 4) + seek


class Shard:
    """One shard's documents; frames are decompressed when asked for and their checksums compared."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        n, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError("not a seekable shard")
        table_at = len(data) - 9 - n * FRAME.size
        self.table = list(FRAME.iter_unpack(self.data[table_at : len(data) - 9]))
        self.offsets = np.concatenate([[0], np.cumsum([x[0] for x in self.table], dtype=np.int64)])
        at = int(self.offsets[-1])
        kind, size = struct.unpack("<II", self.data[at : at + 8])
        if kind != SKIPPABLE:
            raise ValueError("a shard without its index")
        magic, self.part, self.seq, docs, _, _ = HEAD.unpack(self.data[at + 8 : at + 8 + HEAD.size])
        if magic != MAGIC:
            raise ValueError("another index")
        self.index = list(ENTRY.iter_unpack(self.data[at + 8 + HEAD.size : at + 8 + HEAD.size + docs * ENTRY.size]))

    def frame(self, k: int) -> bytes:
        size, raw_size, check = self.table[k]
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.offsets[k] : self.offsets[k] + size], max_output_size=raw_size)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(doc_id, ids before it in this shard, its ids as bytes), of all or of the wanted documents."""
        k, raw = -1, b""
        for doc, start, n, frame, at in self.index:
            if wanted is None or doc in wanted:
                if frame != k:
                    k, raw = frame, self.frame(frame)
                yield doc, start, raw[at : at + 4 * n]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int = 1 << 23, frame_bytes: int = 1 << 16) -> None:
    """Writes the ids of every text, with ``end_id`` after each, as shards of about ``shard_bytes`` of ids below ``path``.

    A null text is empty and has the end id alone. Rows without a doc_id come last under the largest number; rows of one id are ordered by their text, repeated rows (ties) are
    written as often as they come. Very long texts are encoded whole; a shard then has a frame of their size. An empty table gives no shard. Columns other than doc_id and text are not looked
    at, whatever their names.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", end_id)
        part, seq, size, held = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                for doc, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist(), tokenizer)):
                    held.append((doc, ids + end))
                    size += len(ids) + 4
                    if size >= shard_bytes:
                        yield pa.record_batch([pa.array([pack(held, part, seq, frame_bytes)], pa.binary())], ["shard"])
                        seq, size, held = seq + 1, 0, []
        if held:
            yield pa.record_batch([pa.array([pack(held, part, seq, frame_bytes)], pa.binary())], ["shard"])

    ordered = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # ranges go on within an id, so repeated or missing ids spread by their texts
    ordered = ordered.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(shards, "shard binary").select(F.col("shard").cast("string").alias("value"))
    made.write.option("encoding", "ISO-8859-1").option("lineSep", struct.pack("<I", SEEKABLE).decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read(spark: SparkSession, path: str, wanted: list[int] | None = None, each: Callable[[bytes], tuple] | None = None) -> DataFrame:
    """(part, seq, doc_id, local, n_tokens, ids): the documents of the shards below ``path``; with ``wanted`` only those, whose frames alone are decompressed."""
    want = set(wanted) if wanted is not None else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                rows = [(shard.part, shard.seq, doc, local, len(ids) // 4, ids, zlib.crc32(ids)) for doc, local, ids in shard.documents(want)]
                for at in range(0, len(rows), 1000):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 1000]), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["part", "seq", "doc_id", "local", "n_tokens", "ids", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "part long, seq long, doc_id long, local long, n_tokens long, ids binary, ids_crc32 long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the shards below ``path``; start counts the ids of all documents before it in doc_id order."""
    docs = C.cut(read(spark, path).drop("ids"))
    shards = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    # first over the partitions that wrote, of which there are few, then over the shards of each
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    inner = shards.withColumn("inner", F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = inner.join(parts, "part").select("part", "seq", (F.coalesce("base", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("before"))
    out = docs.join(offsets, ["part", "seq"])
    return out.select(F.when(F.col("doc_id") != 2**63 - 1, F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
