"""Layouts by stress minimisation, and projection of further points onto a fixed layout of landmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vistamap.functions.interpolation import Bicubic
from vistamap.functions.metrics import Metric

from . import optimizers
from .embedding import gathered, layout, scaling
from .landmarks import BROADCAST
from .pairs import matrix
from .stress import Terms, local_stress


def node_stress(hd: np.ndarray, y: np.ndarray, w: np.ndarray, nodes: np.ndarray, terms: Terms, slopes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Stress (and gradient) of a point with distances hd to landmarks y, at each of the nodes."""
    ld = Metric().matrix(nodes, y)
    whole = w.sum()
    value = (terms.error(hd[None], ld) * w).sum(1) / whole
    if not slopes:
        return value, np.zeros((0, 2))
    g = np.where(ld > 0, w * terms.slope(hd[None], ld) / np.where(ld > 0, ld, 1), 0)
    return value, -2 / whole * (g.sum(1)[:, None] * nodes - g @ y)


def project_rows(x: np.ndarray, lx: np.ndarray, ly: np.ndarray, lw: np.ndarray, terms: Terms, width: float, coarse: int, fine: int, temperature: float = 0.0, steps: int = 0) -> np.ndarray:
    """y1, y2, interpolated error, true error and distance to the nearest landmark of each row of x.

    The stress on a coarse grid of [-width, width]^2 is interpolated by bicubic patches to a fine one, whose minimum is taken (the last
    of equal ones), or the Boltzmann mean at a temperature; conjugate gradients may follow."""
    g1, g2 = np.linspace(-width, width, coarse), np.linspace(-width, width, fine)
    nodes = np.stack(np.meshgrid(g1, g1, indexing="ij"), -1).reshape(-1, 2)
    out = np.zeros((len(x), 5))
    for k, row in enumerate(x):
        hd = terms.metric.matrix(row[None], lx)[0]
        value, slope = node_stress(hd, ly, lw, nodes, terms, True)
        surface = Bicubic(g1, g1, value.reshape(coarse, coarse), slope[:, 0].reshape(coarse, coarse), slope[:, 1].reshape(coarse, coarse))(g2, g2)
        if temperature > 0:
            p = np.exp(-(surface - surface.min()) / temperature)
            y = np.array([(p.sum(1) * g2).sum(), (p.sum(0) * g2).sum()]) / p.sum()
            guess = float((p * surface).sum() / p.sum())
        else:
            at = surface.size - 1 - int(surface.ravel()[::-1].argmin())
            y, guess = np.array([g2[at // fine], g2[at % fine]]), float(surface.flat[at])
        if steps:
            def objective(z: np.ndarray) -> tuple[float, np.ndarray]:
                v, s = node_stress(hd, ly, lw, z[None], terms, True)
                return float(v[0]), s[0]

            y, guess = optimizers.conjugate_gradient(objective, y, steps)
        out[k] = *y, guess, node_stress(hd, ly, lw, y[None], terms)[0][0], hd.min()
    return out


def surface_rows(x: np.ndarray, lx: np.ndarray, ly: np.ndarray, lw: np.ndarray, terms: Terms, width: float, coarse: int, fine: int) -> np.ndarray:
    """The interpolated stress surface of each row of x: fine values a side, flat."""
    g1, g2 = np.linspace(-width, width, coarse), np.linspace(-width, width, fine)
    nodes = np.stack(np.meshgrid(g1, g1, indexing="ij"), -1).reshape(-1, 2)
    out = np.zeros((len(x), fine * fine))
    for k, row in enumerate(x):
        value, slope = node_stress(terms.metric.matrix(row[None], lx)[0], ly, lw, nodes, terms, True)
        out[k] = Bicubic(g1, g1, value.reshape(coarse, coarse), slope[:, 0].reshape(coarse, coarse), slope[:, 1].reshape(coarse, coarse))(g2, g2).ravel()
    return out


def path_rows(x: np.ndarray, lx: np.ndarray, ly: np.ndarray, scale: float, metric: Metric) -> np.ndarray:
    """Mean of the landmarks' places, weighted by exp(-distance / scale)."""
    d = metric.matrix(x, lx)
    p = np.exp(-(d - d.min(1)[:, None]) / scale)
    return (p @ ly) / p.sum(1)[:, None]


def _known(landmarks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Landmarks on the driver in order of ids; they go to every task and are therefore bounded."""
    n = landmarks.count()
    dims = landmarks.selectExpr("max(size(x) + size(y))").first()[0] or 0
    if n * dims > BROADCAST:
        raise ValueError(f"{n} landmarks of {dims} numbers: more than {BROADCAST} numbers are not broadcast")
    t = landmarks.select("id", "x", "y", "w").toArrow().sort_by("id")
    return matrix(t["x"]), matrix(t["y"]), t["w"].to_numpy()


def _mapped(points: DataFrame, landmarks: DataFrame, function, columns: list[str]) -> DataFrame:
    known = points.sparkSession.sparkContext.broadcast(_known(landmarks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = function(matrix(pa.chunked_array([part.column(1)])), *known.value)
                y = pa.array(got[:, :2].tolist() if columns else got.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), y, *(pa.array(got[:, 2 + k]) for k in range(len(columns)))], ["id", "y", *columns])

    return points.select("id", "x").mapInArrow(run, "id long, y array<double>" + "".join(f", {c} double" for c in columns))


def project(points: DataFrame, landmarks: DataFrame, terms: Terms = Terms(), width: float = 1.0, coarse: int = 21, fine: int = 201, temperature: float = 0.0, steps: int = 0) -> DataFrame:
    """id, y, error (as interpolated, or of the refined place), true_error, nearest for each point (id, x), batch or streaming. landmarks: id, x, y (two
    coordinates), w. A map without a shuffle."""
    return _mapped(points, landmarks, lambda x, lx, ly, lw: project_rows(x, lx, ly, lw, terms, width, coarse, fine, temperature, steps), ["error", "true_error", "nearest"])


def interpolants(points: DataFrame, landmarks: DataFrame, terms: Terms = Terms(), width: float = 1.0, coarse: int = 21, fine: int = 201) -> DataFrame:
    """id, gx, gy, f: the surface that `project` takes the minimum of, a row for each node and point."""
    from pyspark.sql import functions as F

    flat = _mapped(points, landmarks, lambda x, lx, ly, lw: surface_rows(x, lx, ly, lw, terms, width, coarse, fine), [])
    at = lambda k: -width + k * (2 * width / (fine - 1))
    return flat.select("id", F.posexplode("y").alias("k", "f")).select("id", at(F.floor(F.col("k") / fine)).alias("gx"), at(F.col("k") % fine).alias("gy"), "f")


def path_project(points: DataFrame, landmarks: DataFrame, scale: float, metric: Metric = Metric()) -> DataFrame:
    """id, y of each point on the path of landmarks."""
    return _mapped(points, landmarks, lambda x, lx, ly, lw: path_rows(x, lx, ly, scale, metric), [])


def warped(hd: np.ndarray, terms: Terms) -> np.ndarray:
    """Distances whose plain layout distance has the right transformed value."""
    s, c, d = terms.low.pars
    y = np.clip(terms.high.f(hd), 0, 1 - 1e-15)
    return s * (((1 - y) ** (-c / d) - 1) / (2 ** (c / d) - 1)) ** (1 / c)


def pair_weights(hd: np.ndarray, terms: Terms) -> np.ndarray:
    """Weights that make the stress of warped distances like that of transformed ones: |F - f|^2 over |warped D - D|^2 at the
    layout distance D."""
    w = warped(hd, terms)
    return (terms.high.f(hd) - terms.low.f(hd)) ** 2 / np.maximum((w - hd) ** 2, 1e-300)


def refine_points(hd: np.ndarray, y: np.ndarray, w: np.ndarray, terms: Terms, width: float, coarse: int, fine: int, rounds: int = 1, steps: int = 20) -> np.ndarray:
    """One point after the other is moved to the best place of the whole grid if that lowers its own stress; then all together
    follow the gradient."""
    y = y.copy()
    g1, g2 = np.linspace(-width, width, coarse), np.linspace(-width, width, fine)
    nodes = np.stack(np.meshgrid(g1, g1, indexing="ij"), -1).reshape(-1, 2)
    for _ in range(rounds):
        for k in range(len(y)):
            rest = np.arange(len(y)) != k
            value, slope = node_stress(hd[k, rest], y[rest], w[rest], nodes, terms, True)
            surface = Bicubic(g1, g1, value.reshape(coarse, coarse), slope[:, 0].reshape(coarse, coarse), slope[:, 1].reshape(coarse, coarse))(g2, g2)
            at = int(surface.argmin())
            both = node_stress(hd[k, rest], y[rest], w[rest], np.array([y[k], [g2[at // fine], g2[at % fine]]]), terms)[0]
            if both[1] < both[0]:
                y[k] = g2[at // fine], g2[at % fine]
        y = minimise(hd, y, w, terms, "conjgrad", steps)[0]
    return y


def minimise(hd: np.ndarray, y: np.ndarray, w: np.ndarray, terms: Terms, mode: str = "conjgrad", steps: int = 100, weights: np.ndarray | None = None, temperatures: tuple[float, float] | None = None, seed: int = 12345) -> tuple[np.ndarray, float]:
    """Stress of a small layout minimised by one of conjgrad, simplex, anneal, paratemp, nested."""
    shape = y.shape
    full = lambda z: (lambda v: (v[0], v[1].ravel()))(local_stress(hd, z.reshape(shape), w, terms, weights))
    value = lambda z: full(z)[0]
    x = y.ravel()
    if mode == "conjgrad":
        got = optimizers.conjugate_gradient(full, x, steps)
    elif mode == "simplex":
        got = optimizers.nelder_mead(value, optimizers.simplex_around(x, float(np.std(x)) or 1.0), optimizers.Stop(steps))
    elif mode in ("anneal", "paratemp"):
        if temperatures is None:
            raise ValueError("temperatures (hot, cold) are required")
        got = optimizers.anneal(value, x, *temperatures, steps, float(np.std(x)) or 1.0, seed) if mode == "anneal" else optimizers.parallel_tempering(full, x, np.geomspace(temperatures[1], temperatures[0], 4), steps, seed=seed)
    elif mode == "nested":
        rng = np.random.default_rng(seed)
        walkers = x + rng.normal(0, float(np.std(x)) or 1.0, (10, len(x)))
        walkers[0] = x
        got = optimizers.nested_sampling(value, walkers, steps, seed=seed)
    else:
        raise ValueError(mode)
    return got[0].reshape(shape), got[1]


def embed(points: DataFrame, terms: Terms = Terms(), d: int = 2, steps: int = 100, initial: DataFrame | None = None, randomize: float = 0.0, mode: str = "conjgrad", grid: tuple[float, int, int] | None = None, grid_rounds: int = 0, centre: bool = False, seed: int = 12345) -> tuple[DataFrame, float]:
    """(id, y, error) and the stress of points (id, x, w), a bounded number of them. Starts from `initial` (id, y), with Gaussian noise if asked, or
    from classical scaling."""
    ids, x = gathered(points)
    w = points.select("id", "w").toArrow().sort_by("id")["w"].to_numpy()
    hd = terms.metric.matrix(x, x) * (1 - np.eye(len(x)))
    y = scaling(hd, d)[0] if initial is None else matrix(initial.select("id", "y").toArrow().sort_by("id")["y"])
    if randomize:
        y = y + np.random.default_rng(seed).normal(0, randomize, y.shape)
    if steps:
        y, _ = minimise(hd, y, w, terms, mode, steps)
    if grid and grid_rounds:
        y = refine_points(hd, y, w, terms, *grid, rounds=grid_rounds)
    if centre:
        y = y - y.mean(0)
    value, _ = local_stress(hd, y, w, terms)
    ww = w[None] * (1 - np.eye(len(y)))
    error = (terms.error(hd, Metric().matrix(y, y)) * ww).sum(1) / np.maximum(ww.sum(1), 1e-300)
    from pyspark.sql import functions as F

    spark = points.sparkSession
    out = layout(spark, ids, np.column_stack([y, error]))
    return out.select("id", F.slice("y", 1, d).alias("y"), F.element_at("y", d + 1).alias("error")), value
