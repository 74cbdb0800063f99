"""Parts that the registered queries don't reach: splits of large inputs, refusals, odd inputs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vistamap.functions import matrix_functions as mf
from vistamap.functions import tensors
from vistamap.functions.generators import Drand48
from vistamap.functions.timers import Timers
from vistamap.functions.transfer import Tabulated, Transfer
from vistamap.operators import columns, embedding, histogram, landmarks, matrices, neighbors, numbering, optimizers, series
from vistamap.sources import options


def test_draws_are_the_same_in_parts(spark, monkeypatch):
    draw = Drand48(99)
    draw()
    expected = [int(draw() * 1000) for _ in range(500)]
    monkeypatch.setattr(landmarks, "DRAWS", 64)
    got = landmarks.draws(spark, 500, 1000, 99).orderBy("k").toArrow()
    assert got["id"].to_pylist() == expected
    points = spark.range(60).select("id", F.array(F.lit(1.0)).alias("x"), F.lit(1.0).alias("w"))
    got = landmarks.random(points, 60, 99, unique=True).orderBy("rank").toArrow()["id"].to_pylist()
    assert sorted(got) == list(range(60))
    draw = Drand48(99)
    draw()
    assert got[:3] == [*dict.fromkeys(int(draw() * 60) for _ in range(60))][:3]
    with pytest.raises(ValueError, match="more distinct"):
        landmarks.random(points, 61, unique=True)


def test_relation_with_missing_pairs(spark):
    pairs = [(0, 1, 1.0), (0, 2, 5.0), (2, 3, 2.0), (3, 4, 9.0)]
    got = landmarks.minmax_of_pairs(spark.createDataFrame(pairs, "i long, j long, d double"), 10)
    assert [tuple(r) for r in got.collect()] == [(0, 0, 0.0), (1, 2, 5.0), (2, 3, 2.0), (3, 4, 9.0), (4, 1, 1.0)]


def test_numbering(spark):
    rows = spark.createDataFrame([((k * 37) % 101, "x") for k in range(101)], "v long, t string").repartition(7)
    assert sorted((r.v, r.rank) for r in numbering.numbered(rows, "v").collect()) == [(k, k) for k in range(101)]
    assert numbering.numbered(rows.limit(0), "v").count() == 0


def test_compressed_graph(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 3)
    points = spark.range(10).select("id")
    edges = [(i, j, float((i * j) % 5)) for i in range(10) for j in range(10) if i != j and (i + j) % 3 == 0 and i != 4]
    got = sorted(map(tuple, neighbors.compressed(points, spark.createDataFrame(edges, "i long, j long, d double")).select("id", "row", "begin", "end", "neighbours").collect()))
    at = 0
    for i, row, begin, end, near in got:
        assert (row, begin) == (i, at)
        assert near == [j for _, j in sorted((d, j) for a, j, d in edges if a == i)]
        at = end
        assert end - begin == len(near)


def test_dense_columns_are_split(spark, monkeypatch):
    monkeypatch.setattr(matrices, "DENSE", 7)
    monkeypatch.setattr(matrices, "SMALL_BYTES", 0)
    r = np.random.default_rng(1)
    a, b = r.integers(-2, 3, (30, 4)).astype(float), r.integers(-2, 3, (4, 9)).astype(float)
    frame = lambda m: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v double")
    got = np.zeros((30, 9))
    for x in matrices.multiply(frame(a), frame(b)).collect():
        got[x.i, x.j] = x.v
    assert (got == a @ b).all()
    assert matrices.multiply(frame(a).limit(0), frame(b)).count() == 0


def test_fourier_correlation_in_parts(spark, monkeypatch):
    monkeypatch.setattr(series, "TRANSFORM", 16)
    r = np.random.default_rng(2)
    data = {"a": r.standard_normal(101).tolist(), "b": r.standard_normal(16).tolist(), "c": [1.0, 2.0, 4.0]}
    rows = [(s, t, 0, v) for s, vs in data.items() for t, v in enumerate(vs)] + [("a", 500, 0, None)]
    got = {(x.series, x.h): x.acf for x in series.autocorrelation_fft(spark.createDataFrame(rows, "series string, t long, id long, v double").repartition(5), 8).collect()}
    expected = {}
    for s, v in data.items():
        c = np.array(v) - np.mean(v)
        expected |= {(s, h): (c[h:] * c[: len(c) - h]).sum() / (len(c) - h) / c.var() for h in range(min(8, len(c)))}
    assert got == pytest.approx(expected)


def test_consecutive_rows_of_whole_tables(spark):
    rows = spark.createDataFrame([(k, float(k * k), -k) for k in range(40)], "frame long, x double, y long").repartition(5)
    got = sorted(map(tuple, columns.segments(rows, "x", "y").collect()))
    assert got == [(k, float((k - 1) ** 2), 1 - k, float(k * k), -k) for k in range(1, 40)]
    got = sorted(map(tuple, columns.steps(rows, "x", "y").collect()))
    assert got[0] == (0.0, 1.0, 0) and got[-1] == (1521.0, 2 * 1521.0 - 1444.0, -39) and len(got) == 40


def test_frames_around(spark):
    points = [5, 1, 2, 5, 3, 9, 3, 1, 9, 4, 2]
    frames = spark.createDataFrame(list(enumerate(points)), "frame long, point long")
    got = sorted(map(tuple, columns.around(frames, 5, 4, 3).collect()))
    assert got == [("after", 1, 3), ("after", 2, 1), ("before", 1, 5), ("before", 2, 2)]
    assert columns.around(frames, 99, 4, 3).count() == 0


def test_sparse_solver(spark):
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((60, 60)))[0]
    m = (q * np.r_[0.0, 1e-3, 2e-3, 5e-3, np.linspace(0.1, 2, 56)]) @ q.T
    values, vectors = embedding.smallest(lambda x: m @ x, 60, 4)
    assert values == pytest.approx([0, 1e-3, 2e-3, 5e-3], abs=1e-8)
    assert np.abs(m @ vectors - vectors * values).max() < 1e-6


def test_large_lle_is_lle(spark, monkeypatch):
    r = np.random.default_rng(4)
    t = r.uniform(0, 3, (80, 2))
    x = np.column_stack([np.cos(t[:, 0]), np.sin(t[:, 0]), t[:, 1]])
    points = spark.createDataFrame([(k, v.tolist(), 1.0) for k, v in enumerate(x)], "id long, x array<double>, w double")
    edges = neighbors.knn(points, 9)
    one, report = embedding.lle(points, edges, smooth=-1e-3)
    monkeypatch.setattr(embedding, "MOST", 50)
    two, large = embedding.lle(points, edges, smooth=-1e-3)
    a, b = (np.array(y.orderBy("id").toArrow()["y"].to_pylist()) for y in (one, two))
    assert large["eigenvalues"] == pytest.approx(report["eigenvalues"], abs=1e-7)
    gap = np.diff(report["eigenvalues"])
    assert np.abs(np.abs(a) - np.abs(b)).max() < 1e-2 or gap.min() < 1e-7
    monkeypatch.setattr(embedding, "SPARSE", 10)
    with pytest.raises(ValueError, match="weights"):
        embedding.lle(points, edges)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 16, 17])
def test_polynomials_of_matrices(n):
    r = np.random.default_rng(n)
    a, c = r.standard_normal((4, 4)) / 4, r.standard_normal(n).tolist()
    exact = sum(x * np.linalg.matrix_power(a, k) for k, x in enumerate(c))
    for got in (mf.halved(a, c), mf.evaluated(a, c), mf.polynomial(a, c, "blocks")):
        assert got == pytest.approx(exact)
    for size in (None, 1, 2, 5):
        assert mf.chebyshev_blocks(a, c, -2.0, 1.5, size) == pytest.approx(mf.chebyshev(a, c, -2.0, 1.5))


def test_brent_finds_minima():
    for f, at in ((lambda x: (x - 2) ** 4, 2.0), (lambda x: abs(x + 1), -1.0), (lambda x: -math.exp(-((x - 0.3) ** 2)), 0.3), (lambda x: x * x - x + math.sin(3 * x) / 5, 0.4)):
        x, v = optimizers.brent(f, *optimizers.bracket(f, at + 1.0, at + 0.9))
        assert v <= min(f(at + d) for d in np.linspace(-0.5, 0.5, 2001)) + 1e-8, (x, at)
    assert optimizers.vertex((0.0, 1.0), (1.0, 0.0), (2.0, 1.0)) == pytest.approx(1.0)
    assert optimizers.vertex((0.0, 0.0), (1.0, 1.0), (2.0, 2.0)) is None


def test_timers():
    now = iter(range(100))
    timers = Timers(lambda: next(now))
    for _ in range(3):
        with timers("outer"), timers("inner"):
            pass
    assert timers.report() == [("outer", 3, 9, 3.0), ("inner", 3, 3, 1.0)]
    with pytest.raises(ZeroDivisionError), timers("bad"):
        1 / 0
    assert timers.known["bad"].calls == 1


def test_options(spark):
    lines = ["-n 3 -v 1 2.5 3 -w -x -4e-1", "-v -w", "-n -3 -name -odd", "", "-vv 9 -n x", None]
    c = F.col("line")
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").select(
        "k", options.whole(c, "n", 7).alias("n"), options.number(c, "x").alias("x"), options.vector(c, "v").alias("v"), options.flag(c, "w").alias("w"), options.text(c, "name", "none").alias("t")
    )
    assert [tuple(r)[1:] for r in rows.orderBy("k").collect()] == [
        (3, -0.4, [1.0, 2.5, 3.0], True, "none"), (7, None, None, True, "none"), (7, None, None, False, "-odd"), (7, None, None, False, "none"), (None, None, None, False, "none"), (7, None, None, None, "none"),
    ]
    got = options.hill_arguments(3, {1: "2pi", 3: "pi"}, 100, 2.494, "HILLS", only=[1, 3])
    assert " ".join(got) == "-ndim 3 -ndw 1 3 -2pi 1 -pi 3 -stride 100 -kt 2.494 -file HILLS -out fes.dat"
    for bad in ({"only": [1, 2, 3]}, {"only": [4]}, {"kt": 0}):
        with pytest.raises(ValueError):
            options.hill_arguments(**{"variables": 3, "periodic": {}, "stride": 1, "kt": 1.0, "hills": "H", "only": [1]} | bad)


def test_tabulated_function():
    f = Transfer("xsigmoid", (1.2, 6.0, 8.0))
    t, x = Tabulated(f, 4.0), np.linspace(0, 6, 999)
    assert t.f(x) == pytest.approx(f.f(x), abs=1e-8) and t.df(x) == pytest.approx(f.df(x), abs=1e-4)


@pytest.mark.parametrize("n", [2.0, 6.0, 3.0])
def test_gamma_in_spark(spark, n):
    f, x = Transfer("gamma", (1.3, n)), np.linspace(0.01, 6, 50)
    got = spark.createDataFrame(pa.table([x], ["x"])).select(f.value(F.col("x")).alias("f"), f.slope(F.col("x")).alias("df")).toArrow()
    assert got["f"].to_numpy() == pytest.approx(f.f(x)) and got["df"].to_numpy() == pytest.approx(f.df(x))


def test_tensors(spark):
    rows = spark.range(24).select(F.col("id").alias("place"), F.col("id").cast("double").alias("v"))
    i = tensors.indices(F.col("place"), (2, 3, 4))
    got = rows.select("place", i.alias("i"), tensors.place([i[0], i[1], i[2]], (2, 3, 4)).alias("again"), tensors.place([i[0], i[1], i[2] + 4], (2, 3, 4)).alias("out")).collect()
    assert all(tuple(r.i) == np.unravel_index(r.place, (2, 3, 4)) and r.again == r.place and r.out is None for r in got)
    a = np.arange(24).reshape(2, 3, 4)[:, :2, :3]
    assert sorted(map(tuple, tensors.resized(rows, (2, 3, 4), (2, 2, 3)).collect())) == [(k, float(v)) for k, v in enumerate(a.ravel())]


def test_axis_lines():
    got = histogram.axis_lines([histogram.Axis(0.0, 2.0, 4), histogram.Axis(1.0, 2.0, 2, "box", 0.5)])
    assert got == ["# x(0): 0 0.5 1 1.5 2", "# w(0): 0 0 0 0", "# x(1): 1 1.5 2", "# w(1): 0.5 0.5"]
