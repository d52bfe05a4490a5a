"""Exact quantiles of columns of any length, by counting and narrowing ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equal parts that a range is counted in.
PARTS = 4096
#: Accuracy of the estimates that bracket a rank, and different values of a bracket that may reach the driver.
ACCURACY, MOST_VALUES = 10_000, 200_000


def _ranked(long: DataFrame, wanted: dict[tuple, tuple[float, float, int]]) -> dict[tuple, float]:
    """The value of each rank: ``wanted`` maps (group, name, rank) to least value, greatest value and how many values lie below them."""
    spark, kind = long.sparkSession, dict(long.dtypes)["g"]
    out = {k: lo for k, (lo, hi, _) in wanted.items() if lo == hi}
    open_ = {k: v for k, v in wanted.items() if k not in out}
    while open_:
        keys = list(open_)
        rows = [(k[0], k[1], i, *open_[k][:2]) for i, k in enumerate(keys)]
        ranges = spark.createDataFrame(rows, f"rg {kind}, rname string, i int, lo double, hi double")
        met = long.join(F.broadcast(ranges), F.col("g").eqNullSafe(F.col("rg")) & (F.col("name") == F.col("rname"))).where("v between lo and hi")
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1)).cast("int")
        # a part's own least and greatest value bound it exactly and lie in different parts of it, so every pass narrows the range
        found: dict[int, list] = {}
        for r in met.groupBy("i", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            found.setdefault(r["i"], []).append((r["part"], r["n"], r["lo"], r["hi"]))
        left = {}
        for i, k in enumerate(keys):
            below = open_[k][2]
            for _, n, lo, hi in sorted(found[i]):
                if below + n > k[2]:
                    if lo == hi:
                        out[k] = lo
                    else:
                        left[k] = (lo, hi, below)
                    break
                below += n
        open_ = left
    return out


def _long(df: DataFrame, values: dict[str, Column], by: Column | None = None) -> DataFrame:
    """(g, name, v): the values that are there, one a row."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, v in values.items()])
    return df.select((F.lit(None).cast("string") if by is None else by).alias("g"), F.explode(pairs).alias("p")).select("g", "p.name", "p.v").where("v is not null and not isnan(v)")


def _bracketed(df: DataFrame, values: dict[str, Column], qs: tuple[float, ...]) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """How many values each column has, and the value of the ranks that its quantiles need, in two passes over ``df`` (or one more for each factor of a thousand beyond half a billion rows).

    A pass estimates values a little below and above each rank, all columns side by side. The last one counts what lies below a bracket and its different values. A rank that an estimate missed is left to the narrowing of ranges.
    """
    # the values are computed once a row: behind an explode no pass repeats their expressions
    df = df.select(F.explode(F.array(F.struct(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())]))).alias("r")).select("r.*")
    own = {n: F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")) for i, n in enumerate(values)}
    first = df.agg(*[x for i, v in enumerate(own.values()) for x in (F.count(v).alias(f"n{i}"), F.percentile_approx(v, _places(qs), F.lit(ACCURACY)).alias(f"e{i}"))]).first()
    counts = {n: first[f"n{i}"] for i, n in enumerate(own)}
    brackets = {(n, q): (first[f"e{i}"][2 * k], first[f"e{i}"][2 * k + 1]) for i, n in enumerate(own) if counts[n] for k, q in enumerate(qs)}
    within = {n: counts[n] for n in own}
    while max(within.values(), default=0) * 8 // ACCURACY > MOST_VALUES:
        inner = {k: F.when(own[k[0]].between(*b), own[k[0]]) for k, b in brackets.items()}
        below = {k: F.count_if(own[k[0]] < b[0]) for k, b in brackets.items()}
        row = df.agg(*[F.struct(below[k].alias("below"), F.count(v).alias("n")).alias(f"c{i}") for i, (k, v) in enumerate(inner.items())]).first()
        aims = {k: [r for r in _ranks(k[1], counts[k[0]])] for k in brackets}
        at = {k: [min(1.0, max(0.0, (r + d - row[f"c{i}"]["below"]) / max(1, row[f"c{i}"]["n"]) + e / ACCURACY)) for r, d, e in ((aims[k][0], 0, -2), (aims[k][1], 1, 2))] for i, k in enumerate(inner)}
        new = df.agg(*[F.percentile_approx(v, F.array(*map(F.lit, at[k])), F.lit(ACCURACY)).alias(f"e{i}") for i, (k, v) in enumerate(inner.items())]).first()
        smaller = {k: tuple(new[f"e{i}"] or b) for i, (k, b) in enumerate(brackets.items())}
        if smaller == brackets:
            break
        within = {k: row[f"c{i}"]["n"] // (ACCURACY // 8) for i, k in enumerate(inner)}
        brackets = smaller
    marked = [F.struct(F.lit(f"{n}|{q!r}").alias("name"), F.when(own[n] >= lo, own[n]).alias("v"), (own[n] <= hi).alias("near")) for (n, q), (lo, hi) in brackets.items()]
    out: dict[tuple[str, int], float] = {}
    if not marked:
        return counts, out
    tally: dict[str, list] = {}
    for r in df.select(F.explode(F.array(*marked)).alias("p")).where("p.near").groupBy("p.name", "p.v").count().collect():
        tally.setdefault(r["name"], []).append((r["v"], r["count"]))
    for n, q in brackets:
        some = tally.get(f"{n}|{q!r}", [])
        at = sum(c for v, c in some if v is None)
        wanted = [r for r in _ranks(q, counts[n]) if r >= at]
        for v, c in sorted((v, c) for v, c in some if v is not None):
            out |= {(n, r): v for r in wanted if at <= r < at + c}
            at += c
    return counts, out


def _places(qs: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(min(1.0, max(0.0, q + d))) for q in qs for d in (-2 / ACCURACY, 2 / ACCURACY)])


def _ranks(q: float, n: int) -> tuple[int, int]:
    x = q * (n - 1)
    return int(x), min(int(x) + 1, n - 1)


def quantiles(df: DataFrame, values: dict[str, Column], qs: tuple[float, ...], by: Column | None = None) -> dict:
    """{(group, name, q): the linear-interpolated quantile of the non-null values}, all columns, quantiles and groups at once; without ``by`` the group is null.

    Without groups estimates bracket each rank and the values of the brackets are counted. With them one pass takes counts and ranges, and each further pass counts the values in equal parts of the open
    ranges and goes on with the part around each wanted rank, until it holds one value. Only counts reach the driver: a few thousand for each open range. Groups are few.
    """
    if by is None:
        counts, at = _bracketed(df, values, qs)
        at = {(None, n, r): v for (n, r), v in at.items()}
        stats = {(None, n): c for n, c in counts.items() if c}
        missed = {(None, n, r) for (_, n), c in stats.items() for q in qs for r in _ranks(q, c)} - set(at)
        if missed:
            long = _long(df, {n: values[n] for _, n, _ in missed})
            ends = {(r["g"], r["name"]): (r["lo"], r["hi"], 0) for r in long.groupBy("g", "name").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
            at |= _ranked(long, {k: ends[k[:2]] for k in missed})
    else:
        long = _long(df, values, by)
        rows = long.groupBy("g", "name").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        stats = {(r["g"], r["name"]): r["n"] for r in rows}
        at = _ranked(long, {(r["g"], r["name"], k): (r["lo"], r["hi"], 0) for r in rows for q in qs for k in _ranks(q, r["n"])})

    def between(key: tuple, q: float) -> float:
        low, high = (at[*key, r] for r in _ranks(q, stats[key]))
        return low + (high - low) * (q * (stats[key] - 1) % 1.0)

    return {(*key, q): between(key, q) for key in stats for q in qs}


def quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """Linear-interpolated quantile of one column; null without a value."""
    return quantiles(df, {"v": value}, (q,)).get((None, "v", q))
