"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of labelled texts, one on toxic and one on ordinary texts. Most of a toxic text is ordinary, so a dictionary trained on
all of its windows would hold ordinary text; it is therefore trained on the windows that compress badly with a large reference of other ordinary texts and stand in several
texts of their class. The ordinary dictionary is trained in the same way on ordinary texts that the reference has not seen, so that what is new but harmless (numbers,
addresses) is known to both. A common dictionary, trained on plain ordinary windows, stands behind each of them.

Each window of a text is compressed with both. What the toxic dictionary saves against the ordinary one says how much of the window it alone knows. Windows come with every
byte doubled, so that a known word saves clearly more than chance matches do, and with a fixed known tail, so that no window is stored raw. A logistic regression over the
savings of a text's windows, fitted on labelled texts that no dictionary has seen, calibrates the threshold: its probability is the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import textnp as T

_SCRAMBLED = bytes((b * 167 + 91) % 256 for b in range(256))


@dataclass(frozen=True)
class ToxicityParams:
    """n_toxic, n_ordinary: the most labelled texts that are learned from (those with the least hash of their id); they are learned from whole.
    window, step: of the windows that are compared, in bytes of text. own_bytes, common_bytes: sizes of the trained dictionaries; segment: of a piece that
    training picks. word: longest training window, in bytes of text. novel, power: a window of compressed share s counts (s - novel) / (1 - novel) to the power as
    often as it stands in texts. repeats: texts that it must stand in."""

    n_toxic: int = 2000
    n_ordinary: int = 4000
    window: int = 64
    step: int = 48
    own_bytes: int = 6144
    common_bytes: int = 24_000
    segment: int = 32
    word: int = 14
    novel: float = 0.4
    power: float = 4.0
    repeats: int = 3
    tail: int = 48


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def _plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().split())


def _doubled(data: bytes) -> bytes:
    out = np.empty(2 * len(data), np.uint8)
    out[::2] = np.frombuffer(data, np.uint8)
    out[1::2] = np.frombuffer(data.translate(_SCRAMBLED), np.uint8)
    return out.tobytes()


def _compressor(dictionary: bytes, window_log: int = 17, table_log: int = 18) -> zstd.ZstdCompressor:
    how = zstd.ZstdCompressionParameters(
        window_log=window_log, hash_log=table_log, chain_log=table_log, search_log=9, min_match=6, target_length=999, strategy=zstd.STRATEGY_LAZY2, format=zstd.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    data = zstd.ZstdCompressionDict(dictionary, zstd.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(compression_params=how, dict_data=data)


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary of at most ``size`` bytes; samples that are too few to train on are taken as they are."""
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Reference:
    """How badly short windows compress with a large body of ordinary text."""

    def __init__(self, texts: list[bytes], params: ToxicityParams):
        body = _doubled(b"".join(texts).rjust(params.tail, b"\x00"))[-(1 << 23) :]
        self.compress, self.tail = _compressor(body, 24, 21).compress, body[-2 * params.tail :]
        self.empty, self.known, self.params = len(self.compress(self.tail)), {}, params

    def _novelty(self, window: bytes) -> float:
        """The window's compressed share, as a weight from 0 (no more than ``novel``) to 1."""
        if window not in self.known:
            share = (len(self.compress(_doubled(window) + self.tail)) - self.empty) / (2 * len(window))
            self.known[window] = min(1.0, max(0.0, (share - self.params.novel) / (1 - self.params.novel)))
        return self.known[window]

    def samples(self, texts: list[bytes]) -> list[bytes]:
        """The windows (words, long ones in pieces) that stand in several of the texts, the more often the worse the reference compresses them, in a fixed mixed order."""
        held, size = Counter(), self.params.word
        for text in texts:
            held.update({b" " + w[i : i + size] for w in text.split() for i in range(0, len(w), size) if len(w) - i >= 4})
        often = [(w, round(n * self._novelty(w) ** self.params.power)) for w, n in sorted(held.items()) if n >= self.params.repeats]
        chosen = [_doubled(w) for w, n in often for _ in range(n)]
        return [chosen[i] for i in np.random.Generator(np.random.PCG64(3)).permutation(len(chosen))]


class Savings:
    """What the toxic dictionary saves on each window of a text, and the figures made of it."""

    def __init__(self, toxic: bytes, ordinary: bytes, params: ToxicityParams):
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress
        self.tail, self.params = toxic[-2 * params.tail :], params

    def windows(self, text: str) -> np.ndarray:
        data, tail = _doubled(_plain(text)), self.tail
        width, step = 2 * self.params.window, 2 * self.params.step
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in (data[i : i + width] + tail for i in range(0, max(1, len(data) - 16), step))], float)

    def figures(self, text: str) -> tuple[float, ...]:
        """The largest saving, the mean of the two largest and of all, how many windows there are, and how many save or lose so many bytes."""
        saved = self.windows(text)
        beyond = [np.log1p((saved >= k).sum()) for k in (2, 4, 5, 6, 7, 8, 10)] + [np.log1p((saved <= -k).sum()) for k in (3, 5, 7)]
        return tuple(map(float, (saved.max(), np.sort(saved)[-2:].mean(), saved.mean(), np.log1p(len(saved)), *beyond)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[int, str]], share: float, params: ToxicityParams = ToxicityParams()) -> ToxicityModel | None:
    """A model from (class, text) rows, of which ``share`` are toxic where they come from; None unless both classes have at least four texts.

    Every third text of a class is kept for the calibration; of the ordinary others every second one is the reference.
    """
    texts = {c: list(dict.fromkeys(t for k, t in rows if k == c)) for c in (0, 1)}
    if min(map(len, texts.values())) < 4:
        return None
    held = {c: [t for i, t in enumerate(x) if i % 3 == 0] for c, x in texts.items()}
    seen = {c: [_plain(t) for i, t in enumerate(x) if i % 3] for c, x in texts.items()}
    reference, fresh = Reference(seen[0][::2], params), seen[0][1::2]
    own = {1: _trained(params.own_bytes, reference.samples(seen[1]), params.segment), 0: _trained(params.own_bytes, reference.samples(fresh), params.segment)}
    doubled, size = [_doubled(t) for t in fresh], 2 * params.window
    common = _trained(params.common_bytes, [d[i : i + size] for d in doubled for i in range(0, len(d), size)], 48).rjust(2 * params.tail, b"\x00")
    longest = max(map(len, own.values()))
    toxic, ordinary = (own[c].rjust(longest, b"\x00") + common for c in (1, 0))
    savings = Savings(toxic, ordinary, params)
    x = np.array([savings.figures(t) for c in (0, 1) for t in held[c]])
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, bias = _logistic((x - mean) / scale, y, weight)
    return ToxicityModel(toxic, ordinary, tuple(mean), tuple(scale), tuple(w), bias)


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel | None:
    """A model from the labelled rows that are not held out. The most toxic of several labels of an id holds."""
    known = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(params.n_toxic).union(known.where("toxic = 0").orderBy(*order).limit(params.n_ordinary))  # a bounded number of ids
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").distinct()
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in texts.collect())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return fit([(c, t) for _, c, t in rows], counts.get(1, 0) / max(1, sum(counts.values())), params)


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out (its labels were not learned from), score (0 to 1), predicted.

    Null and empty texts are scored like any text without a known word; very long ones are scored by all their windows. Without enough labels to learn from, every
    score is 0. A score of exactly 0.5 counts as toxic. A row with a null id is held out. Repeated rows give repeated results; other columns are not looked at,
    whatever their names. An empty table gives an empty result.
    """
    model = train(docs, labels, params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = Savings(model.toxic, model.ordinary, params) if model else None
        for batch in batches:
            for part in T.pieces(batch):
                if model:
                    x = np.array([savings.figures(t) for t in part.column("text").to_pylist()])
                    z = ((x - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.weights) + model.bias
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                else:
                    p = np.zeros(part.num_rows)
                yield pa.record_batch([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
