"""Auto- and cross-correlation of series (series, t, id, v), with error estimates.

Rows are dealt by ranges of (series, t, id), so one series may lie in many tasks. Each batch of rows becomes a segment: sums of products
at every lag, and its first and last `lags` values, from which the products across a border follow. Segments merge in order, a few
numbers each, so no task ever holds a series. Null values are left out before lags are counted.

Only series longer than `lags` enter the products, as many-series averages have it, but every series counts in mean and deviation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


class Segment:
    """Sums over v_i * u_(i - h) of a stretch of a series."""

    def __init__(self, lags: int, v: np.ndarray, u: np.ndarray, totals: tuple[float, float] | None = None, n: int | None = None, sums: np.ndarray | None = None):
        self.lags, self.n = lags, len(v) if n is None else n
        self.totals = (float(v.sum()), float(u.sum())) if totals is None else totals
        self.sums = np.array([v[h:] @ u[: len(u) - h] if h < len(v) else 0.0 for h in range(lags)]) if sums is None else sums
        self.first_v, self.first_u, self.last_v, self.last_u = v[:lags], u[:lags], v[-lags:], u[-lags:]

    def then(self, other: Segment) -> Segment:
        sums = self.sums + other.sums
        for h in range(1, self.lags):
            back = self.last_u[-h:]  # the value h before other's b-th is back[b] if back is full
            front = other.first_v[:h]
            shift = h - len(back)
            k = min(len(front), h) - shift
            if k > 0:
                sums[h] += front[shift : shift + k] @ back[:k]
        out = Segment(self.lags, np.zeros(0), np.zeros(0), (self.totals[0] + other.totals[0], self.totals[1] + other.totals[1]), self.n + other.n, sums)
        out.first_v, out.first_u = (np.concatenate(x)[: self.lags] for x in ((self.first_v, other.first_v), (self.first_u, other.first_u)))
        out.last_v, out.last_u = (np.concatenate(x)[-self.lags :] for x in ((self.last_v, other.last_v), (self.last_u, other.last_u)))
        return out


ENDS = ["first_v", "first_u", "last_v", "last_u"]


def lagged(series: DataFrame, lags: int, other: str = "v") -> DataFrame:
    """series, h, s (sum of v_i * u_(i-h)), later (of v_i), earlier (of u_(i-h)), n (products): a row per lag 0 .. lags - 1."""
    rows = series.where(F.col("v").isNotNull() & F.col(other).isNotNull()).select(F.col("series").cast("string").alias("series"), "t", "id", F.col("v").cast("double").alias("v"), F.col(other).cast("double").alias("u"))
    dealt = rows.repartitionByRange("series", "t", "id").sortWithinPartitions("series", "t", "id")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("t", "id")}
    schema = f"series string, t {kinds['t']}, id {kinds['id']}, n long, sums array<double>, " + ", ".join(f"{c} array<double>" for c in ENDS) + ", totals array<double>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = np.array(["\0" if x is None else "=" + x for x in batch.column(0).to_pylist()], object)
            edges = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True]) if len(name) else np.zeros(0, int)
            v, u = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            got = [Segment(lags, v[a:b], u[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            at = pa.array(edges[:-1])
            lists = lambda f: pa.array([list(f(g)) for g in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array([g.n for g in got], pa.int64()), lists(lambda g: g.sums), *(lists(lambda g, c=c: getattr(g, c)) for c in ENDS), lists(lambda g: g.totals)], ["series", "t", "id", "n", "sums", *ENDS, "totals"])

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        whole: Segment | None = None
        for r in t.sort_by([("t", "ascending"), ("id", "ascending")]).to_pylist():
            g = Segment(lags, np.zeros(0), np.zeros(0), tuple(r["totals"]), r["n"], np.array(r["sums"]))
            for c in ENDS:
                setattr(g, c, np.array(r[c], float))
            whole = g if whole is None else whole.then(g)
        h = np.arange(min(lags, whole.n))
        heads, tails = np.concatenate([[0], np.cumsum(whole.first_v)]), np.concatenate([[0], np.cumsum(whole.last_u[::-1])])
        return pa.table([pa.array([key[0].as_py()] * len(h), pa.string()), pa.array(h, pa.int32()), whole.sums[h], whole.totals[0] - heads[h], whole.totals[1] - tails[h], pa.array(whole.n - h, pa.int64())], ["series", "h", "s", "later", "earlier", "n"])

    return dealt.mapInArrow(cut, schema).groupBy("series").applyInArrow(merged, "series string, h int, s double, later double, earlier double, n long")


def autocorrelation(series: DataFrame, lags: int, mean: float | None = None, deviation: float | None = None) -> DataFrame:
    """h, acf over all series together: sum over i >= h of (v_i - mu)(v_(i-h) - mu) / (n - h) of each, normalised by the variance;
    an exact mean or deviation replaces the one of the data. With an exact mean alone the value at lag 0 normalises."""
    size = series.groupBy("series").agg(F.count("*").alias("len"))
    whole = series.agg(F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("m2"))
    mu = F.col("m") if mean is None else F.lit(mean)
    long = size.where(F.col("len") > lags)
    totals = size.agg(F.sum(F.when(F.col("len") > lags, F.col("len"))).alias("points"), F.count("*").alias("many"))
    used = lagged(series.join(long.select("series"), "series", "left_semi"), lags)
    each = used.groupBy("h").agg(F.sum("s").alias("s"), F.sum("later").alias("later"), F.sum("earlier").alias("earlier"), F.sum("n").alias("n"))
    out = each.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(totals))
    # the definition divides by points - h * series and adds mu^2 at the end
    value = (F.col("s") - mu * (F.col("later") + F.col("earlier"))) / (F.col("points") - F.col("h") * F.col("many")) + mu * mu
    out = out.select("h", value.alias("c"), "m", "m2")
    if deviation is not None:
        scale = F.lit(deviation**2)
    elif mean is None:
        scale = F.col("m2") - F.col("m") * F.col("m")
    else:
        out = out.crossJoin(F.broadcast(out.where("h = 0").select(F.col("c").alias("c0"))))
        scale = F.col("c0")
    return out.select("h", (F.col("c") / scale).alias("acf"))


def correlation_time(acf: DataFrame, dt: float = 1.0, squared: bool = False) -> DataFrame:
    """One row: (sum of acf - half of acf at 0) * dt, of the squared function if asked."""
    a = F.col("acf") * F.col("acf") if squared else F.col("acf")
    return acf.agg(((F.sum(a) - F.sum(F.when(F.col("h") == 0, a)) / 2) * dt).alias("time"))


def analysis(acf: DataFrame, points: int, dt: float = 1.0) -> DataFrame:
    """h, t, acf, block (error of block averages), acf_error (Zwanzig and Ailawadi 1969), block_error. One row per lag: the lags are few."""
    act2 = correlation_time(acf, dt, True).select(F.sqrt(F.greatest(F.lit(0.0), F.col("time") * 2 / (points * dt))).alias("act"))
    before = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    weighted = F.coalesce(F.sum(F.col("acf") * F.col("h")).over(before), F.lit(0.0))
    first = F.coalesce(F.sum(F.when(F.col("h") > 0, F.col("acf"))).over(before), F.lit(0.0))
    zero = F.max(F.when(F.col("h") == 0, F.col("acf"))).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    block = F.when(F.col("h") == 0, 0.0).otherwise((zero / 2 + first - weighted / F.col("h")) * 2 * dt)
    return acf.withColumn("block", block).crossJoin(F.broadcast(act2)).select("h", (F.col("h") * dt).alias("t"), "acf", "block", (F.col("act") * (1 - F.col("acf"))).alias("acf_error"), (F.col("act") * F.abs(F.col("block") - F.col("h") * dt / 2)).alias("block_error"))


def moments(series: DataFrame) -> DataFrame:
    """One row: mean, mean2, deviation (of the population)."""
    return series.agg(F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("mean2")).select("mean", "mean2", F.sqrt(F.col("mean2") - F.col("mean") * F.col("mean")).alias("deviation"))


def cross_correlation(pairs: DataFrame, lags: int) -> DataFrame:
    """h, ccf of v_i with u_(i-h) in each series (series, t, id, v, u), centred on the means of all and normalised by both deviations."""
    rows = lagged(pairs, lags, "u")
    each = rows.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("s", "later", "earlier", "n")))
    m = pairs.agg(F.avg("v").alias("mv"), F.avg("u").alias("mu"), F.stddev_pop("v").alias("sv"), F.stddev_pop("u").alias("su"))
    c = (F.col("s") - F.col("mu") * F.col("later") - F.col("mv") * F.col("earlier")) / F.col("n") + F.col("mv") * F.col("mu")
    return each.crossJoin(F.broadcast(m)).select("h", (c / (F.col("sv") * F.col("su"))).alias("ccf"))


def acf_fft(x: np.ndarray, lags: int) -> np.ndarray:
    """Normalised autocorrelation of one array by Fourier transform, padded so that its ends don't meet."""
    c = np.asarray(x, float) - np.mean(x)
    f = np.fft.rfft(c, 2 * len(c))
    return np.fft.irfft(f * f.conj())[:lags] / (len(c) - np.arange(lags)) / c.var()


#: Values of a series that one transform takes; longer series are cut, with the lags before each part.
TRANSFORM = 1 << 20


def autocorrelation_fft(series: DataFrame, lags: int) -> DataFrame:
    """series, h, acf: each series on its own, centred on its mean and normalised by its variance. Parts of TRANSFORM values are correlated by
    Fourier transforms with themselves and the `lags` values before them, so that no task holds a series."""
    rows = numbered_series(series)
    whole = rows.groupBy("series").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s2"), F.count("*").alias("n"))
    centred = rows.join(whole.select("series", "m"), "series").select("series", "r", (F.col("v") - F.col("m")).alias("v"))
    part = F.floor(F.col("r") / TRANSFORM)
    # a value belongs to its own part, and to the next one as one of those before it
    own = F.struct(part.alias("part"), F.lit(True).alias("own"))
    also = F.struct((part + 1).alias("part"), F.lit(False).alias("own"))
    dealt = centred.withColumn("p", F.explode(F.when(F.col("r") % TRANSFORM >= TRANSFORM - lags, F.array(own, also)).otherwise(F.array(own)))).select("series", "p.part", "p.own", "r", "v")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("r")
        v, here = t["v"].to_numpy(), t["own"].to_numpy(zero_copy_only=False)
        size = 1 << (2 * len(v) - 1).bit_length()
        products = np.fft.irfft(np.fft.rfft(np.where(here, v, 0), size) * np.fft.rfft(v, size).conj(), size)[:lags]
        h = np.arange(lags)
        return pa.table([pa.array([key[0].as_py()] * lags, pa.string()), pa.array(h, pa.int32()), products], ["series", "h", "s"])

    sums = dealt.groupBy("series", "part").applyInArrow(run, "series string, h int, s double").groupBy("series", "h").agg(F.sum("s").alias("s"))
    return sums.join(whole, "series").where("h < n").select("series", "h", (F.col("s") / (F.col("n") - F.col("h")) / F.col("s2")).alias("acf"))


def numbered_series(series: DataFrame) -> DataFrame:
    """series, r (0, 1, ... within each), v, in order of t and id."""
    rows = series.where(F.col("v").isNotNull()).select(F.col("series").cast("string").alias("series"), "t", "id", F.col("v").cast("double").alias("v"))
    placed = numbered(rows, "series", "t", "id", name="at")
    first = placed.groupBy("series").agg(F.min("at").alias("first"))
    return placed.join(first, "series").select("series", (F.col("at") - F.col("first")).alias("r"), "v")
