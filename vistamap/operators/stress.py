"""Stress of a layout: mismatch of transformed distances in the high-dimensional space and in the layout.

chi = sum over pairs of W * ((1 - m) * (F(D) - f(d))^2 + m * (D - d)^2) / sum of W, with W the product of the two weights, F and f
transfer functions and m the mix. Blocked over tiles: nothing is made for a pair."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistamap.functions.metrics import Metric
from vistamap.functions.transfer import Transfer

from .pairs import matrix, self_tiles


@dataclass(frozen=True)
class Terms:
    metric: Metric = field(default_factory=Metric)
    high: Transfer = field(default_factory=Transfer)
    low: Transfer = field(default_factory=Transfer)
    mix: float = 0.0

    def error(self, hd: np.ndarray, ld: np.ndarray) -> np.ndarray:
        return (1 - self.mix) * (self.high.f(hd) - self.low.f(ld)) ** 2 + self.mix * (hd - ld) ** 2

    def slope(self, hd: np.ndarray, ld: np.ndarray) -> np.ndarray:
        """Minus half of the derivative of the error by ld."""
        return (1 - self.mix) * (self.high.f(hd) - self.low.f(ld)) * self.low.df(ld) + self.mix * (hd - ld)


def stress(points: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """One row: n pairs, weight, stress. points: id, x, y (layout), w."""
    def run(a: pa.Table, b: pa.Table, on: np.ndarray) -> pa.Table:
        hd, ld = terms.metric.matrix(matrix(a["x"]), matrix(b["x"])), Metric().matrix(matrix(a["y"]), matrix(b["y"]))
        w = np.where(on, a["w"].to_numpy()[:, None] * b["w"].to_numpy()[None], 0)
        return pa.table([[int(on.sum())], [float(w.sum())], [float((w * np.where(on, terms.error(hd, ld), 0)).sum())]], ["n", "weight", "s"])

    t = self_tiles(points.select("id", "x", "y", "w"), run, "n long, weight double, s double")
    return t.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.sum("s").alias("s")).select("n", "weight", (F.col("s") / F.col("weight")).alias("stress"))


def point_terms(points: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """id, own (w), s (sum over others of error * w_j), weight (sum of the others' w), pulls array (sum over others of
    w_j * slope / d * (y_i - y_j)); pairs at layout distance 0 pull nowhere."""
    def run(a: pa.Table, b: pa.Table, on: np.ndarray) -> pa.Table:
        ya, yb = matrix(a["y"]), matrix(b["y"])
        hd, ld = terms.metric.matrix(matrix(a["x"]), matrix(b["x"])), Metric().matrix(ya, yb)
        if len(ya) and len(yb) and on.any():
            e = np.where(on, terms.error(hd, ld), 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(on & (ld > 0), terms.slope(hd, ld) / np.where(ld > 0, ld, 1), 0)
        else:
            e = g = np.zeros(on.shape)
        rows = []
        for t, other, y, z, m, k, o in ((a, b, ya, yb, e, g, on), (b, a, yb, ya, e.T, g.T, on.T)):
            w = other["w"].to_numpy()
            gw = k * w[None]
            pulls = gw.sum(1)[:, None] * y - gw @ z if len(y) and len(z) else np.zeros_like(y)
            rows.append(pa.table([t["id"].combine_chunks(), t["w"].combine_chunks(), m @ w, o @ w, pa.array(pulls.tolist(), pa.list_(pa.float64()))], ["id", "own", "s", "weight", "pulls"]))
        return pa.concat_tables(rows)

    t = self_tiles(points.select("id", "x", "y", "w"), run, "id long, own double, s double, weight double, pulls array<double>")
    parts = t.select("id", "own", "s", "weight", F.posexplode_outer("pulls").alias("k", "v"))
    each = parts.groupBy("id", "k").agg(F.max("own").alias("own"), F.sum("s").alias("s"), F.sum("weight").alias("weight"), F.sum("v").alias("v"))
    out = each.groupBy("id").agg(F.max("own").alias("own"), F.max("s").alias("s"), F.max("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"))
    return out.select("id", "own", "s", "weight", F.transform("kv", lambda x: x["v"]).alias("pulls"))


def point_error(points: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """id, error: the weighted mean over the others of a point's pair errors."""
    return point_terms(points, terms).select("id", (F.col("s") / F.col("weight")).alias("error"))


def gradient(points: DataFrame, terms: Terms = Terms()) -> DataFrame:
    """id, gradient array: derivative of the stress by the layout coordinates of each point."""
    whole = stress(points, terms)
    return point_terms(points, terms).crossJoin(F.broadcast(whole.select(F.col("weight").alias("all")))).select("id", F.transform("pulls", lambda v: -2 * F.col("own") * v / F.col("all")).alias("gradient"))


def point_stress(points: DataFrame, place: list[float], hd: DataFrame, terms: Terms = Terms(), skip: int | None = None) -> DataFrame:
    """One row: stress of one point at `place` against all others, given its distances hd (id, d); points at distance 0 from it
    are left out with their weight."""
    y = F.array(*map(F.lit, map(float, place)))
    rows = points.join(hd, "id").where(F.lit(True) if skip is None else F.col("id") != skip).withColumn("ld", Metric().column(F.col("y"), y)).where("ld > 0")
    plain, mixed = terms.high.value(F.col("d")) - terms.low.value(F.col("ld")), F.col("d") - F.col("ld")
    return rows.agg((F.sum(F.col("w") * ((1 - terms.mix) * plain * plain + terms.mix * mixed * mixed)) / F.sum("w")).alias("stress"))


def point_gradient(points: DataFrame, place: list[float], hd: DataFrame, terms: Terms = Terms(), skip: int | None = None) -> DataFrame:
    """One row: stress of one point at `place` and its gradient there, an array; as `point_stress` otherwise."""
    y = F.array(*map(F.lit, map(float, place)))
    rows = points.join(hd, "id").where(F.lit(True) if skip is None else F.col("id") != skip).withColumn("ld", Metric().column(F.col("y"), y)).where("ld > 0")
    plain, mixed = terms.high.value(F.col("d")) - terms.low.value(F.col("ld")), F.col("d") - F.col("ld")
    error = (1 - terms.mix) * plain * plain + terms.mix * mixed * mixed
    pull = ((1 - terms.mix) * plain * terms.low.slope(F.col("ld")) + terms.mix * mixed) / F.col("ld") * F.col("w")
    gradient = F.array(*(2 * F.sum(pull * (F.col("y")[k] - v)) / F.sum("w") for k, v in enumerate(map(float, place))))
    return rows.agg((F.sum(F.col("w") * error) / F.sum("w")).alias("stress"), gradient.alias("gradient"))


def grid_stress(landmarks: DataFrame, distances: DataFrame, axis: list[float], terms: Terms = Terms()) -> DataFrame:
    """gx, gy, stress of a new point at each node of a square grid; distances: id, d to each landmark (id, y, w)."""
    nodes = landmarks.sparkSession.range(len(axis) ** 2).select(
        F.element_at(F.array(*map(F.lit, axis)), (F.floor(F.col("id") / len(axis)) + 1).cast("int")).alias("gx"), F.element_at(F.array(*map(F.lit, axis)), (F.col("id") % len(axis) + 1).cast("int")).alias("gy")
    )
    rows = landmarks.join(distances, "id").crossJoin(F.broadcast(nodes))
    ld = F.sqrt(F.pow(F.col("y")[0] - F.col("gx"), F.lit(2.0)) + F.pow(F.col("y")[1] - F.col("gy"), F.lit(2.0)))
    e = terms.high.value(F.col("d")) - terms.low.value(ld)
    return rows.groupBy("gx", "gy").agg((F.sum(F.col("w") * e * e) / F.sum("w")).alias("stress"))


def local_stress(hd: np.ndarray, y: np.ndarray, w: np.ndarray, terms: Terms, pair_weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Stress and gradient of a small layout from its matrix of distances."""
    ld = Metric().matrix(y, y)
    ww = w[:, None] * w[None] * (1 if pair_weight is None else pair_weight)
    ww = ww * (1 - np.eye(len(y)))
    whole = ww.sum() or 1.0
    safe = np.where(ld > 0, ld, 1e-100)
    g = np.where(ld > 0, ww * terms.slope(hd, ld) / safe, 0)
    return float((ww * terms.error(hd, ld)).sum() / whole), -4 / whole * (g.sum(1)[:, None] * y - g @ y)
