"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of tokens. Each step scales the cells' weights, their expected tokens, so that one dimension's totals meet its goals, by sums over the cells and a join of the
few totals back to them; the steps repeat until all dimensions fit. A document's sampling probability is its cell's weight over its tokens.

What was asked to be kept is kept. No document is drawn twice, so a value whose target is more than it has cannot reach it: all its documents stay, and the others take up the rest in the ratios of
their targets (its goal is softened). ``mix_report`` tells targets, softened goals and what is expected. The driver sees the cells if they are few enough to be broadcast, else single numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common as C

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixParams:
    """temper: targets are the present shares to this power where none are given. keep_share: of the tokens, how much is kept. tolerance: the relative misfit to the softened goals at which the steps end,
    after most_rounds at last."""

    temper: float = 0.7
    keep_share: float = 0.75
    tolerance: float = 1e-4
    most_rounds: int = 60
    seed: int = 17
    most_broadcast: int = 200_000


#: Steps in which the softened goals of a dimension are found; each settles at least one value that cannot reach its goal.
_SETTLING = 40


def topic_of(text: Column) -> Column:
    """A coarse topic by form: table, symbols, note (under 50 words), book (over 1000 words) or prose."""
    body = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(body), F.lit(1))
    words = F.regexp_count(body, F.lit(C.WORD))
    return (
        F.when(F.regexp_count(body, F.lit(r"\|")) * 50 > n, "table")
        .when(F.regexp_count(body, F.lit("[#*$%&<>]")) * 25 > n, "symbols")
        .when(words < 50, "note")
        .when(words > 1000, "book")
        .otherwise("prose")
    )


def tempered_targets(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """(dimension, target): present shares to a power, made to sum to 1."""
    share = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).select(dimension, F.pow("t", F.lit(temper)).alias("p"))
    return share.crossJoin(F.broadcast(share.agg(F.sum("p").alias("all")))).select(dimension, (F.col("p") / F.col("all")).alias("target"))


class FrameCells:
    """Raking of any number of cells by DataFrame operations. A weighting is a frame (dimensions, tokens, weight). ``targets``: by dimension (dimension, target)."""

    def __init__(self, cells: DataFrame, targets: dict[str, DataFrame], share: float):
        self.cells, self.share = cells, share
        self.total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
        self.goals = {d: self._softened(d, t) for d, t in targets.items()}
        self.weights, self.off = cells.withColumn("weight", F.col("tokens") * F.lit(float(share))), 0.0

    def _softened(self, d: str, targets: DataFrame) -> DataFrame:
        """(dimension, target, has, goal): goals in the ratios of the targets, but none above the tokens that are there, ``share`` of all tokens together."""
        own = C.cut(self.cells.groupBy(d).agg(F.sum("tokens").alias("has")).join(targets, d).select(d, "has", "target"))
        wanted, by = self.share * self.total, 0.0
        for _ in range(_SETTLING):
            full = F.col("has") <= F.col("target") * F.lit(by)
            sums = own.agg(F.sum(F.when(full, F.col("has")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("target"))).alias("open")).first()
            new = (wanted - (sums["full"] or 0)) / sums["open"] if sums["open"] else by
            if new <= by * (1 + 1e-12):
                break
            by = new
        return C.cut(own.withColumn("goal", F.least(F.col("has").cast("double"), F.col("target") * F.lit(by))))

    def rake(self, rounds: int, tolerance: float) -> None:
        """Weights whose totals over each dimension are near to its goals, none above its cell's tokens."""
        now = self.weights
        for _ in range(rounds):
            for d, goal in self.goals.items():
                has = now.groupBy(d).agg(F.sum("weight").alias("now"))
                factor = has.join(goal, d).select(d, F.coalesce(F.col("goal") / F.nullif(F.col("now"), F.lit(0.0)), F.lit(0.0)).alias("by"))
                now = now.join(factor, d).withColumn("weight", F.least(F.col("weight") * F.col("by"), F.col("tokens").cast("double"))).drop("by")
            last, now = self.weights, C.cut(now)
            self.weights, self.off = now, self._misfit(now)
            if hasattr(last, "_cut"):
                C.drop(last)
            if self.off <= tolerance:
                break
        self._fill()

    def _misfit(self, now: DataFrame) -> float:
        off = F.abs(F.coalesce("now", F.lit(0.0)) / F.col("goal") - 1)
        by = [goal.where("goal > 0").join(now.groupBy(d).agg(F.sum("weight").alias("now")), d, "left").select(off.alias("off")) for d, goal in self.goals.items()]
        return reduce(DataFrame.union, by).agg(F.max("off")).first()[0] or 0.0

    def _fill(self) -> None:
        """Scales the cells that have room so that the sum is what is to be kept."""
        free = (F.col("weight") > 0) & (F.col("weight") < F.col("tokens"))
        by = 1.0
        for _ in range(_SETTLING):
            now = F.least(F.col("weight") * F.lit(by), F.col("tokens").cast("double"))
            sums = self.weights.agg(F.sum(F.when(free & (F.col("weight") * F.lit(by) < F.col("tokens")), F.col("weight")).otherwise(0.0)).alias("open"), F.sum(now).alias("now")).first()
            gap = self.share * self.total - (sums["now"] or 0)
            if not sums["open"] or abs(gap) <= 1e-9 * self.total:
                break
            by += gap / sums["open"]
        self.weights = self.weights.withColumn("weight", F.least(F.col("weight") * F.lit(by), F.col("tokens").cast("double")))

    def chances(self) -> DataFrame:
        return self.weights.select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("probability"))


class ArrayCells:
    """The same on arrays, for so few cells that they may be broadcast: a round costs no Spark job."""

    def __init__(self, cells: DataFrame, targets: dict[str, DataFrame], share: float):
        self.spark, self.rows, self.share = cells.sparkSession, cells.collect(), share
        self.tokens = np.array([r["tokens"] for r in self.rows], float)
        self.total, self.off, self.weights = float(self.tokens.sum()), 0.0, self.tokens * share
        self.at, self.goals = {}, {}
        for d, frame in targets.items():
            target = {r[d]: r["target"] for r in frame.collect()}
            place = {v: i for i, v in enumerate(dict.fromkeys(r[d] for r in self.rows))}
            self.at[d] = np.array([place[r[d]] for r in self.rows], int)
            self.goals[d] = self._softened(self._totals(d, self.tokens, len(place)), np.array([target.get(v, 0.0) for v in place]))

    def _totals(self, d: str, now: np.ndarray, n: int | None = None) -> np.ndarray:
        return np.bincount(self.at[d], now, len(self.goals[d]) if n is None else n)

    def _softened(self, has: np.ndarray, target: np.ndarray) -> np.ndarray:
        by = 0.0
        for _ in range(_SETTLING):
            full = has <= target * by
            new = (self.share * self.total - has[full].sum()) / target[~full].sum() if target[~full].sum() > 0 else by
            if new <= by * (1 + 1e-12):
                break
            by = new
        return np.minimum(has, target * by)

    def rake(self, rounds: int, tolerance: float) -> None:
        now = self.weights
        for _ in range(rounds):
            for d, goal in self.goals.items():
                has = self._totals(d, now)
                now = np.minimum(now * np.divide(goal, has, out=np.zeros(len(goal)), where=has > 0)[self.at[d]], self.tokens)
            self.off = max((float(np.abs(self._totals(d, now)[g > 0] / g[g > 0] - 1).max(initial=0.0)) for d, g in self.goals.items()), default=0.0)
            if self.off <= tolerance:
                break
        by = 1.0
        for _ in range(_SETTLING):
            room = (now > 0) & (now < self.tokens) & (now * by < self.tokens)
            gap = self.share * self.total - np.minimum(now * by, self.tokens).sum()
            if not room.any() or abs(gap) <= 1e-9 * self.total:
                break
            by += gap / now[room].sum()
        self.weights = np.minimum(now * by, self.tokens)

    def chances(self) -> DataFrame:
        some = [(*(r[d] for d in DIMENSIONS), float(p)) for r, p in zip(self.rows, self.weights / self.tokens)]
        return self.spark.createDataFrame(some, ", ".join(f"{d} string" for d in DIMENSIONS) + ", probability double")


def _cells(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """``docs`` with topic, n_tokens and the names of its cell; the cells (dimensions, tokens), cut; the columns with those names."""
    own = docs.drop("n_tokens", "probability", "kept").withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("bigint"))
    own = own if "topic" in docs.columns else own.withColumn("topic", topic_of(F.col("text")))
    names = dict(zip(DIMENSIONS, C.fresh(own, *[f"cell_{d}" for d in DIMENSIONS])))
    own = own.withColumns({names[d]: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS})
    cells = C.cut(own.groupBy(*[F.col(names[d]).alias(d) for d in DIMENSIONS]).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    return own, cells, names


def _raked(cells: DataFrame, params: MixParams, targets: dict[str, DataFrame] | None) -> tuple[FrameCells | ArrayCells, dict[str, DataFrame]]:
    given = {d: (targets or {}).get(d) for d in DIMENSIONS}
    given = {d: C.cut(t if t is not None else tempered_targets(cells, d, params.temper)) for d, t in given.items()}
    few = all(C.small(x, params.most_broadcast) for x in (cells, *given.values()))
    out = (ArrayCells if few else FrameCells)(cells, given, params.keep_share)
    out.rake(params.most_rounds, params.tolerance)
    return out, given


def mix_report(docs: DataFrame, params: MixParams = MixParams(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(dimension, value, tokens, target, expected, misfit): for each value of each dimension its tokens, its target and its expected share of what is kept, and the latter over the target less 1; and a row with
    dimension "all", whose ``expected`` is the share of all tokens that is kept."""
    _, cells, _ = _cells(docs)
    raked, given = _raked(cells, params, targets)
    met = cells.join(raked.chances(), list(DIMENSIONS)).withColumn("weight", F.col("tokens") * F.col("probability"))
    met = C.cut(met)
    sums = met.agg(F.sum("weight").alias("w"), F.sum("tokens").alias("t")).first()
    kept = F.nullif(F.lit(float(sums["w"] or 0)), F.lit(0.0))
    parts = [met.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"), (F.sum("weight") / kept).alias("expected")).join(given[d].withColumnRenamed(d, "value"), "value") for d in DIMENSIONS]
    every = met.groupBy().agg(F.sum("tokens").alias("tokens"), (F.sum("weight") / F.sum("tokens")).alias("expected")).select(F.lit("all").alias("dimension"), F.lit("").alias("value"), "tokens", "expected", F.lit(float(params.keep_share)).alias("target"))
    cols = ["dimension", "value", "tokens", "target", "expected"]
    return reduce(DataFrame.unionByName, [p.select(cols) for p in (*parts, every)]).withColumn("misfit", F.col("expected") / F.col("target") - 1)


def mix(docs: DataFrame, params: MixParams = MixParams(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """All columns of ``docs`` and topic (unless there), n_tokens, probability, kept.

    Null dimensions count as the value "". A document without words has no tokens, does not weigh and is not kept. The draw depends on doc_id and text alone: repeated rows
    are kept or dropped together. Input columns n_tokens, probability and kept are replaced, all others pass whatever their names. Very long texts weigh by all their words. A draw
    that equals the probability (a tie) is not kept. An empty table gives an empty result. Targets given must name every value; cells of a value without a target
    are dropped, as their weight is 0.
    """
    own, cells, names = _cells(docs)
    raked, _ = _raked(cells, params, targets)
    chances = C.cut(raked.chances().select(*[F.col(d).alias(names[d]) for d in DIMENSIONS], "probability"))
    chances = F.broadcast(chances) if C.small(chances, params.most_broadcast) else chances
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(params.seed), "doc_id", "text"), 11) / float(2**53)
    out = own.join(chances, list(names.values()), "left").drop(*names.values())
    chance = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("probability", chance).withColumn("kept", draw < F.col("probability"))
