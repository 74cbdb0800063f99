"""Metrics, transfer functions, pairs, histograms, landmarks, graphs, layouts."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistamap.functions import generators
from vistamap.functions.metrics import Metric, half_away, rounded
from vistamap.functions.transfer import Transfer, upper_gamma
from vistamap.operators import embedding, histogram, landmarks, neighbors, optimizers, pairs, projection, stress
from vistamap.operators.histogram import Axis
from vistamap.plans import schedules

TERMS = stress.Terms(Metric(), Transfer("xsigmoid", (1.5, 4.0, 3.0)), Transfer("xsigmoid", (1.0, 2.0, 3.0)), 0.2)


@pytest.fixture(scope="module")
def cloud():
    r = np.random.default_rng(2)
    x = r.normal(size=(130, 4))
    return x, r.uniform(0.5, 2, 130), r.normal(size=(130, 2))


@pytest.fixture(scope="module")
def frame(spark, cloud):
    x, w, y = cloud
    return spark.createDataFrame([(i, x[i].tolist(), float(w[i]), y[i].tolist()) for i in range(len(x))], "id long, x array<double>, w double, y array<double>").repartition(3).cache()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs.self_tiles, "__defaults__", (37,))


METRICS = [Metric(), Metric("torus", 1.5), Metric("sphere", 2 * math.pi), Metric("dot"), Metric("null")]


@pytest.mark.parametrize("metric", METRICS, ids=lambda m: m.kind)
def test_metric_forms_agree(frame, cloud, metric):
    x = cloud[0]
    a = frame.select("id", "x")
    near = a.join(a.select((F.col("id") - 1).alias("id"), F.col("x").alias("z")), "id")
    if metric.kind == "dot":
        near = near.where(F.aggregate(F.zip_with("x", "z", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) > 0)
    got = {r.id: r.d for r in near.select("id", metric.column(F.col("x"), F.col("z")).alias("d")).collect()}
    rows, whole = metric.rows(x[:-1], x[1:]), metric.matrix(x, x)
    for i, d in got.items():
        assert d == pytest.approx(rows[i], abs=1e-9) == whole[i, i + 1]


def test_metric_cases():
    one = np.array([[0.0]])
    assert Metric("torus", 3.0).matrix(one, np.array([[2.9]]))[0, 0] == pytest.approx(0.1)
    assert Metric("sphere", 2 * math.pi).matrix(one, np.array([[math.pi / 2]]))[0, 0] == pytest.approx(math.pi / 2)
    assert half_away(np.array([-0.5, 2.5, 1.4])).tolist() == [-1, 3, 1]
    assert Metric.of() == Metric() and Metric.of(2.0) == Metric("torus", 2.0) and Metric.of(0, 3.0) == Metric("sphere", 3.0)
    with pytest.raises(ValueError):
        Metric.of(1.0, dot=True)
    same = np.full((3, 5), 0.3)
    assert (Metric().matrix(same, same) == 0).all()


KINDS = [Transfer(), Transfer("sigmoid", (1.3,)), Transfer("compress", (1.3,)), Transfer("xsigmoid", (1.3, 4.0, 2.0)), Transfer("gamma", (1.3, 5.0)), Transfer("warp", (1.3, 4.0, 2.0, 2.0, 3.0))]


@pytest.mark.parametrize("f", KINDS, ids=lambda f: f.kind)
def test_transfer(spark, f):
    x = np.linspace(0.05, 4, 60)
    assert f.df(x) == pytest.approx((f.f(x + 1e-6) - f.f(x - 1e-6)) / 2e-6, abs=1e-6)
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", f.value(F.col("x")).alias("f"), f.slope(F.col("x")).alias("d")).collect()
    assert [r.f for r in got] == pytest.approx([f.f(np.array([r.x]))[0] for r in got])
    assert [r.d for r in got] == pytest.approx([f.df(np.array([r.x]))[0] for r in got], rel=1e-6)


def test_transfer_cases():
    for a, b in itertools.product((1.0, 2.5, 6.0), repeat=2):
        assert Transfer("xsigmoid", (0.7, a, b)).f(np.array([0.7]))[0] == pytest.approx(0.5)
    y = np.array([0.0, 0.1, 1, 3, 10, 50])
    assert upper_gamma(2.0, y) == pytest.approx(np.exp(-y) * (1 + y))
    assert upper_gamma(0.5, y) == pytest.approx([math.erfc(math.sqrt(v)) for v in y])
    assert (Transfer.of(()).kind, Transfer.of((1, 2)).kind, Transfer.of((1, 2, 3)).kind) == ("identity", "gamma", "xsigmoid")
    with pytest.raises(ValueError):
        Transfer.of((1,))


def test_pairs_over_several_blocks(frame, cloud, small_blocks):
    x, w, y = cloud
    d = Metric().matrix(x, x)
    got = pairs.pair_join(frame).collect()
    assert sorted((r.i, r.j) for r in got) == [(i, j) for i in range(130) for j in range(i)]
    assert all(r.d == pytest.approx(d[r.i, r.j]) for r in got)
    low = d[np.tril_indices(130, -1)]
    e = pairs.extremes(frame, low=Metric()).first()
    assert (e.n, e.d_max, e.d_min) == (len(low), pytest.approx(low.max()), pytest.approx(low.min()))
    each = {r.id: r for r in pairs.per_point(frame).collect()}
    assert all(each[i].sum == pytest.approx(d[i].sum()) and each[i].n == 129 for i in range(130))


@pytest.mark.parametrize("axis", [Axis(0.5, 4.0, 9), Axis(0.5, 4.0, 9, "box", 0.7), Axis(0.5, 4.0, 9, "triangle", 0.6)], ids=lambda a: a.window)
def test_histograms(spark, frame, cloud, small_blocks, axis):
    x, w, y = cloud
    i, j = np.tril_indices(130, -1)
    d, ww, ld = Metric().matrix(x, x)[i, j], w[i] * w[j], Metric().matrix(y, y)[i, j]
    h = histogram.pair_histogram(frame, axis)
    got = {r.bin: r.mass for r in h.collect()}
    assert [got.get(k, 0) for k in range(-1, 10)] == pytest.approx(histogram.masses(axis, d, ww))
    assert sum(got.values()) == pytest.approx(ww.sum())
    dens, out = histogram.density(h, axis).agg(F.sum(F.col("density") * F.col("width")).alias("s")).first(), histogram.outliers(h, axis).first()
    assert dens.s + out.above + out.below == pytest.approx(1)
    values = spark.createDataFrame([(float(a), float(b)) for a, b in zip(d[:500], ww[:500])], "v double, w double")
    column = {r.bin: r.mass for r in histogram.value_histogram(values, F.col("v"), axis, F.col("w")).collect()}
    assert [column.get(k, 0) for k in range(-1, 10)] == pytest.approx(histogram.masses(axis, d[:500], ww[:500]), abs=1e-9)
    two = histogram.pair_histogram_2d(frame, axis, Axis(0.0, 3.0, 5, axis.window, axis.width)).collect()
    assert sum(r.mass for r in two) == pytest.approx(ww.sum())


def test_histogram_edges(spark):
    axis = Axis(0.0, 10.0, 10)
    values = [1.0, 0.0, 10.0, 10.1, -0.1, float("nan")]
    assert axis.place(np.array(values)).tolist() == [0, 0, 9, 10, -1, -1]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(axis.column(F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 9, 10, -1, -1]
    # a narrow triangle at a bin's middle stays in the bin
    assert histogram.masses(Axis(0.0, 10.0, 10, "triangle", 0.5), np.array([4.5]), np.ones(1)).tolist() == [0] * 5 + [1] + [0] * 6


def test_farthest_points(frame, spark, monkeypatch):
    line = spark.createDataFrame([(0, [0.0], 1.0), (1, [1.0], 1.0), (2, [10.0], 1.0)], "id long, x array<double>, w double")
    assert [r.id for r in landmarks.minmax(line, 2).orderBy("rank").collect()] == [0, 2]
    one = landmarks.minmax(frame, 25).orderBy("rank").collect()
    monkeypatch.setattr(landmarks, "SAVED", 4)
    two = landmarks.minmax_distributed(frame, 25, 0).orderBy("rank").collect()
    assert [(r.id, pytest.approx(r.distance)) for r in one] == [(r.id, r.distance) for r in two]
    assert [r.distance for r in one[1:]] == sorted((r.distance for r in one[1:]), reverse=True)


def test_farthest_points_among_repeated_ones(spark):
    points = spark.createDataFrame([(k, [float(k % 3), 1.0], 1.0) for k in range(8)], "id long, x array<double>, w double")
    for n in (3, 6, 12):
        one, two = (f.orderBy("rank").collect() for f in (landmarks.minmax(points, n), landmarks.minmax_distributed(points, n, 0)))
        assert one == two and len(one) == min(n, 8)


def test_selections(frame, spark):
    assert [r.id for r in landmarks.stride(frame, 10).orderBy("rank").collect()] == [13 * k for k in range(10)]
    unique = [r.id for r in landmarks.random(frame, 130, unique=True).collect()]
    assert sorted(unique) == list(range(130))
    assert landmarks.random(frame, 7).collect() == landmarks.random(frame, 7).collect()
    assert 0 <= landmarks.first_point(130) < 130
    for gamma in (0.5, 1.0):
        assert landmarks.resample(frame, 12, gamma).count() == 12
    s = landmarks.staged(frame, 12, 0.5, 0.5)
    assert s.select("id").distinct().count() == 12 and s.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    marks = landmarks.placed(frame, landmarks.stride(frame, 10))
    assert landmarks.voronoi_weights(frame, marks).agg(F.sum("weight")).first()[0] == pytest.approx(1)
    radii = [landmarks.coverage_radius(frame, landmarks.placed(frame, landmarks.minmax(frame, n).select("rank", "id"))).first().radius for n in (2, 10, 40)]
    assert radii == sorted(radii, reverse=True)
    with pytest.raises(ValueError):
        landmarks.random(frame, 131, unique=True)


def test_generators():
    draw = generators.Drand48(12345)
    x = (12345 << 16) | 0x330E
    for _ in range(5):
        x = (0x5DEECE66D * x + 0xB) % 2**48
        assert draw() == x / 2**48
    assert np.mean([generators.Twister(1)() for _ in range(3)]) <= 1
    g = generators.Gaussian(generators.Drand48(7), 2.0, 3.0)
    v = np.array([g() for _ in range(20000)])
    assert v.mean() == pytest.approx(2, abs=0.1) and v.std() == pytest.approx(3, abs=0.1)
    acf = np.exp(-np.arange(40) / 5)
    z = generators.correlated(generators.Gaussian(generators.Drand48(9)), acf, 40000)
    assert (z[1:] * z[:-1]).mean() / (z * z).mean() == pytest.approx(acf[1], abs=0.03)


@pytest.mark.parametrize(("k", "cutoff"), [(5, 0.0), (8, 1.4), (0, 1.0)])
def test_graphs(frame, cloud, small_blocks, k, cutoff):
    d = Metric().matrix(cloud[0], cloud[0])
    edges = neighbors.knn(frame, k, cutoff)
    expected = set()
    for i in range(130):
        order = [j for j in np.lexsort((np.arange(130), d[i])) if j != i and (not cutoff or d[i, j] < cutoff)]
        expected |= {(i, int(j)) for j in order[: k or None]}
    got = {(r.i, r.j) for r in edges.collect()}
    assert got == expected
    assert {(r.i, r.j) for r in neighbors.greedy(edges).collect()} == got | {(j, i) for i, j in got}
    assert {(r.i, r.j) for r in neighbors.liberal(edges).collect()} == {(i, j) for i, j in got if (j, i) in got}
    kept = sorted({i for i, _ in got})
    assert {r.id: r.new_id for r in neighbors.without_lonesome(frame.select("id", "x"), edges).select("id", "new_id").collect()} == {i: n for n, i in enumerate(kept)}
    assert {r.id for r in neighbors.lonesome(frame, edges).collect()} == set(range(130)) - set(kept)
    plain = {(r.i, r.j) for r in neighbors.deformed(frame, neighbors.knn(frame, 6), 0.0, 6).collect()}
    assert plain == {(r.i, r.j) for r in neighbors.knn(frame, 6).collect()}


def test_stress(frame, cloud, small_blocks):
    x, w, y = cloud
    hd = Metric().matrix(x, x)
    value, slope = stress.local_stress(hd, y, w, TERMS)
    assert stress.stress(frame, TERMS).first().stress == pytest.approx(value)
    got = {r.id: r.gradient for r in stress.gradient(frame, TERMS).collect()}
    assert np.array([got[i] for i in range(130)]) == pytest.approx(slope, abs=1e-12)
    z = y.copy()
    for k in (0, 1):
        z[5, k] += 1e-6
        up = stress.local_stress(hd, z, w, TERMS)[0]
        z[5, k] -= 2e-6
        assert (up - stress.local_stress(hd, z, w, TERMS)[0]) / 2e-6 == pytest.approx(slope[5, k], abs=1e-7)
        z[5, k] += 1e-6
    f = optimizers.partial_objective(frame.select("id", "x", "w", "y"), TERMS)
    assert f(y.ravel())[0] == pytest.approx(value) and f(y.ravel())[1] == pytest.approx(slope.ravel(), abs=1e-12)
    one = stress.point_stress(frame, y[3].tolist(), frame.select("id", Metric().column(F.col("x"), F.array(*map(F.lit, x[3].tolist()))).alias("d")), TERMS, 3).first().stress
    rest = np.arange(130) != 3
    assert one == pytest.approx(projection.node_stress(hd[3, rest], y[rest], w[rest], y[3:4], TERMS)[0][0])


def test_scaling(frame, cloud, small_blocks, spark):
    x = cloud[0]
    y, report = embedding.mds(frame, 4)
    d = {(r.i, r.j): r.d for r in pairs.pair_join(y.withColumnRenamed("y", "x")).collect()}
    full = Metric().matrix(x, x)
    assert all(v == pytest.approx(full[k]) for k, v in d.items())
    assert report["explained"] == pytest.approx(1) and report["residual"] == pytest.approx(0, abs=1e-12)
    m = -0.5 * full**2
    m = m - m.mean(0)
    m = m - m.mean(1)[:, None]
    assert all(r.m == pytest.approx(m[r.i, r.j]) for r in embedding.centred(frame).collect())
    angles = np.random.default_rng(1).uniform(-1, 1, (40, 2))
    torus = Metric("torus", 2.0)
    arcs = np.sqrt(sum((torus.matrix(angles[:, k : k + 1], angles[:, k : k + 1]) * math.pi) ** 2 for k in (0, 1)))
    assert embedding.toroidal(arcs, 2).shape == (40, 2)
    ring = Metric("torus", 2.0).matrix(angles[:, :1], angles[:, :1]) * math.pi
    got, r = embedding.spherical(ring, 1)
    assert Metric("torus", 2.0).matrix(got, got) * math.pi * r == pytest.approx(ring, abs=0.15)


@pytest.mark.parametrize("mode", ["lle", "llte", "hlle"])
def test_locally_linear(spark, mode):
    r = np.random.default_rng(4)
    t = r.uniform(0, 1, (220, 2))
    x = np.column_stack([t, 0.1 * t[:, 0] + 0.2 * t[:, 1]])  # a plane in space: the layout must be an affine image of it
    p = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, x array<double>, w double")
    y, _ = embedding.lle(p, neighbors.knn(p, 12), 2, mode, smooth=1e-9)
    z = np.array([row.y for row in y.orderBy("id").collect()])
    a = np.column_stack([t, np.ones(len(t))])
    left = z - a @ np.linalg.lstsq(a, z, rcond=None)[0]
    assert np.abs(left).max() < 0.05 * np.abs(z).max()
    w = embedding.local_weights(p, neighbors.knn(p, 12)).groupBy("i").agg(F.sum("v").alias("s")).collect()
    assert all(v.s == pytest.approx(1) for v in w)


def test_embedding_and_projection(frame, cloud, spark):
    part = frame.where("id < 40").select("id", "x", "w")
    start, before = projection.embed(part, TERMS, steps=0)
    done, after = projection.embed(part, TERMS, steps=30, centre=True)
    assert after < before
    assert done.agg(F.avg(F.col("y")[0]).alias("m")).first().m == pytest.approx(0, abs=1e-9)
    moved, least = projection.embed(part, TERMS, steps=10, grid=(4.0, 9, 33), grid_rounds=1)
    assert least <= projection.embed(part, TERMS, steps=10)[1] + 1e-12
    for mode, extra in (("simplex", {}), ("nested", {})):
        assert projection.embed(part, TERMS, steps=20, mode=mode, **extra)[1] <= before + 1e-12
    with pytest.raises(ValueError):
        projection.embed(part, TERMS, mode="anneal")
    marks = part.join(done.select("id", "y"), "id")
    got = projection.project(part, marks, TERMS, width=5.0, coarse=21, fine=101, steps=5).collect()
    assert all(r.nearest == pytest.approx(0, abs=1e-6) and r.true_error < 0.2 for r in got)
    mean = projection.project(part, marks, TERMS, width=5.0, coarse=9, fine=33, temperature=1e6).collect()
    assert all(abs(v) < 0.2 for r in mean for v in r.y)


def test_pair_weights_make_warped_stress_alike():
    terms = stress.Terms(Metric(), Transfer("xsigmoid", (1.5, 4.0, 3.0)), Transfer("xsigmoid", (1.5, 2.0, 3.0)))
    d = np.linspace(0.3, 3, 20)
    w = projection.warped(d, terms)
    assert terms.low.f(w) == pytest.approx(terms.high.f(d))
    assert projection.pair_weights(d, terms) * (w - d) ** 2 == pytest.approx((terms.high.f(d) - terms.low.f(d)) ** 2)


def test_schedules(frame):
    part = frame.where("id < 25").select("id", "x", "w")
    plain = stress.Terms(TERMS.metric, TERMS.high, TERMS.low)
    start = projection.embed(part, plain, steps=0)[1]
    for run in (lambda: schedules.interactive(part, plain, 5, 7, 21), lambda: schedules.scheduled(part, plain, 10, 5, 7, 21, 2, 1, 1)):
        y, value = run()
        assert y.count() == 25 and value < start
    known, got = schedules.landmark_map(frame.select("id", "x", "w"), 20, schedules.Options(high=(1.5, 4.0, 3.0), low=(1.0, 2.0, 3.0), steps=10), coarse=7, fine=21)
    assert (known.count(), got.count()) == (20, 130)


def test_classical_scaling_of_many_points(frame, cloud, monkeypatch):
    """Beyond MOST points classical scaling goes by principal axes: layout, signs and report are those of the matrix of distances."""
    expected, known = embedding.scaling(Metric().matrix(cloud[0], cloud[0]) * (1 - np.eye(130)), 3)
    monkeypatch.setattr(embedding, "MOST", 100)
    for d in (3, 6):  # more dimensions than the points have are 0
        y, report = embedding.mds(frame, d)
        got = np.array([r.y for r in y.orderBy("id").collect()])
        assert got[:, :3] == pytest.approx(expected, abs=1e-9) and (got[:, 4:] == 0).all()
        assert report["eigenvalues"][:3] == pytest.approx(known["eigenvalues"])
    _, report = embedding.mds(frame, 3)
    assert (report["explained"], report["residual"]) == (pytest.approx(known["explained"]), pytest.approx(known["residual"]))
    with pytest.raises(ValueError):
        embedding.mds(frame, 2, Metric("torus", 1.5))


def test_plane_keeps_distances_of_many_points(frame, cloud, monkeypatch):
    monkeypatch.setattr(embedding, "MOST", 100)
    y, _ = embedding.mds(frame.select("id", F.col("y").alias("x")))
    got = np.array([r.y for r in y.orderBy("id").collect()])
    assert Metric().matrix(got, got) == pytest.approx(Metric().matrix(cloud[2], cloud[2]), abs=1e-9)


@pytest.mark.parametrize("orders", ["one", "both"])
def test_scaling_of_a_large_relation(spark, frame, cloud, monkeypatch, orders):
    """Beyond MOST points, products of the relation with columns give what the matrix gives: of few dimensions, and of many."""
    for metric, d in ((Metric(), 7), (Metric("torus", 1.5), 3)):
        expected, known = embedding.scaling(metric.matrix(cloud[0], cloud[0]) * (1 - np.eye(130)), d)
        relation = pairs.pair_join(frame.withColumn("id", 3 * F.col("id") + 5), metric)
        if orders == "both":
            relation = relation.union(relation.select("j", "i", "d"))
        with monkeypatch.context() as m:
            m.setattr(embedding, "MOST", 100)
            y, report = embedding.mds_of_pairs(relation, d)
        rows = y.orderBy("id").collect()
        got = np.array([r.y for r in rows])
        assert [r.id for r in rows] == list(range(5, 395, 3))
        assert Metric().matrix(got, got) == pytest.approx(Metric().matrix(expected, expected), abs=1e-6)
        assert report["eigenvalues"][:3] == pytest.approx(known["eigenvalues"][:3])
        assert (report["explained"], report["residual"]) == (pytest.approx(known["explained"]), pytest.approx(known["residual"]))


def test_torus_goes_by_strips():
    """Temporary arrays stay small beside the matrix of distances."""
    import tracemalloc

    a = np.random.default_rng(3).normal(size=(700, 5))
    tracemalloc.start()
    got = Metric("torus", 1.5).matrix(a, a)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    u = (a[None] - a[:, None]) / 1.5
    assert got == pytest.approx(np.sqrt((((u - half_away(u)) * 1.5) ** 2).sum(2)))
    assert peak < 1.3 * got.nbytes


def test_tiles_copy_rows_a_bounded_number_of_times(frame, cloud, monkeypatch):
    """Small blocks make many tiles, not many copies of a row in the shuffle."""
    monkeypatch.setattr(pairs.self_tiles, "__defaults__", (3,))
    met = pairs.meetings(frame.select("id"), 3)
    assert met.groupBy("id").count().agg(F.max("count")).first()[0] <= 16
    d = Metric().matrix(cloud[0], cloud[0])
    got = {(r.i, r.j): r.d for r in pairs.pair_join(frame).collect()}
    assert len(got) == 130 * 129 / 2 == pairs.pair_join(frame).count()
    assert all(v == pytest.approx(d[k]) for k, v in got.items())
    m = {(r.i, r.j): r.m for r in embedding.centred(frame).collect()}
    b = -0.5 * d * d * (1 - np.eye(130))
    b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    assert len(m) == 130 * 131 / 2 and all(v == pytest.approx(b[k], abs=1e-9) for k, v in m.items())


def test_centring_goes_over_pairs_once_more(frame):
    """Row means are kept in a file, so the plan of the result has one pass over pairs."""
    plan = embedding.centred(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMap") == 1


def test_selection_reads_rows_of_a_relation(frame):
    """Nothing but the landmarks' rows of a relation is made, and nothing of it written."""
    asked, row = [], pairs.relation(frame)

    def counted(i):
        asked.append(i)
        return row(i)

    got = landmarks.minmax_of_pairs(counted, 8).orderBy("rank").collect()
    assert [(r.rank, r.id) for r in got] == [(r.rank, r.id) for r in landmarks.minmax(frame, 8).orderBy("rank").collect()]
    assert asked == [r.id for r in got][:7]
    assert {(r.j, round(r.d, 9)) for r in row(5).collect()} == {(r.i + r.j - 5, round(r.d, 9)) for r in pairs.pair_join(frame).where("i = 5 or j = 5").collect()}


@pytest.mark.parametrize("most", [10_000_000, 100])
def test_tiles_of_rows_that_are_sent(frame, cloud, small_blocks, monkeypatch, most):
    """Few numbers are sent to the tasks and not shuffled, more are; pairs are the same, those of an id that occurs twice too."""
    monkeypatch.setattr(pairs, "BROADCAST", most)
    both = frame.union(frame.where("id < 50"))
    found = pairs.pair_join(both)
    assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == (most == 100)
    got = sorted((r.i, r.j) for r in found.collect())
    ids = [*range(130), *range(50)]
    assert got == sorted((max(a, b), min(a, b)) for k, a in enumerate(ids) for b in ids[:k] if a != b)
    d = Metric().matrix(cloud[0], cloud[0])
    m = -0.5 * d * d
    m = m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    centred = embedding.centred(frame)
    plan = centred._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning(i" in plan) == (most == 100)
    rows = centred.collect()
    assert len(rows) == 130 * 131 // 2 and [r.m for r in rows] == pytest.approx([m[r.i, r.j] for r in rows])


def test_staged_selection_makes_cells_by_blocks(spark):
    seen = []

    class Watched(Metric):
        def matrix(self, a, b):
            seen.append(len(a) * len(b))
            return super().matrix(a, b)

    x = np.random.default_rng(6).normal(size=(3000, 3))
    p = spark.createDataFrame([(i, x[i].tolist(), 1.0) for i in range(len(x))], "id long, x array<double>, w double")
    got = landmarks.staged(p, 9, metric=Watched()).orderBy("rank").collect()
    centers = int((9 * 3000) ** 0.5)
    assert len(got) == 9 and sum(r.weight for r in got) == pytest.approx(1)
    assert max(seen) <= 1024 * centers


def test_rows_of_a_relation_as_pairs(spark, cloud, monkeypatch):
    """Rows of the square matrix are made and read back without a shuffle, in any batch size."""
    spaced = spark.createDataFrame([(7 * i - 9, cloud[0][i].tolist()) for i in np.random.default_rng(1).permutation(130).tolist()], "id long, x array<double>")
    d = Metric().matrix(cloud[0], cloud[0]) * (1 - np.eye(130))
    rows = pairs.similarity_rows(spaced)
    assert np.array([r.x for r in rows.orderBy("id").collect()]) == pytest.approx(d)
    out = pairs.similarity_pairs(rows)
    assert {((r.i + 9) // 7, (r.j + 9) // 7): round(r.d, 9) for r in out.collect()} == {(i, j): round(d[i, j], 9) for i in range(130) for j in range(i)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pairs, "BROADCAST", 100)
    assert np.array([r.x for r in pairs.similarity_rows(spaced).orderBy("id").collect()]) == pytest.approx(d)


def test_neighbours_are_found_once(spark, frame, cloud, monkeypatch):
    """A locally linear embedding uses its edges several times and makes them once, dense or sparse."""
    edges, made = neighbors.knn(frame, 8).select("i", "j").cache(), spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    watched = edges.mapInArrow(run, "i long, j long")
    for k, most in enumerate((6000, 100), 1):
        monkeypatch.setattr(embedding, "MOST", most)
        y, _ = embedding.lle(frame, watched)
        assert y.count() == 130 and made.value == k * 130 * 8


def test_distances_are_rounded_as_sql_rounds_them(spark):
    duckdb = pytest.importorskip("duckdb")
    from vistamap.plans import queries

    x = [0.0, *((k + 0.5) / 1e6 for k in range(1_000_001, 1_000_400)), 1e308, float("nan")]
    expected = [r[0] for r in duckdb.sql(f"select round(x, 6)::double from (select unnest({x[1:-2]}::double[]) x)").fetchall()]
    got = {r.i: r.d for r in pairs.pair_join(spark.createDataFrame([(k, [v]) for k, v in enumerate(x)], "id long, x array<double>"), digits=6).where("j = 0").collect()}
    assert [got[k] for k in range(1, len(x) - 2)] == expected and got[len(x) - 1] is None
    assert rounded(np.array([-0.0000005, 2.5e-7, 1e305, -np.inf]), 6).tolist() == [-1e-6, 0.0, 1e305, -math.inf]
    assert "round" not in queries.QUERIES["pair_dump"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_distances_of_a_plane_are_rounded_in_the_tile(spark):
    from vistamap.plans import queries

    assert "round" not in queries.QUERIES["mds_plane"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_distances_of_classical_scaling_are_rounded_in_the_tile(spark):
    from vistamap.plans import queries

    assert "round" not in queries.QUERIES["mds_embed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_centred_values_are_finished_in_the_tile(frame, cloud, small_blocks):
    hd = Metric().matrix(cloud[0], cloud[0])
    m = -0.5 * hd**2
    m = m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    t = embedding.centred(frame, digits=3)
    assert {(r.i, r.j): r.m for r in t.collect()} == pytest.approx({(i, j): round(m[i, j], 3) for i in range(130) for j in range(i + 1)}, abs=1e-9)
    assert all(math.copysign(1, r.m) > 0 for r in t.where("m = 0").collect())
    assert "NestedLoop" not in t._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_matrix_are_cut_in_the_task_that_makes_them(spark, frame, monkeypatch):
    monkeypatch.setattr(pairs, "PART", 1000)
    t = pairs.similarity_cut(frame, digits=6)
    assert t._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and t.rdd.getNumPartitions() > 4
    got = sorted(map(tuple, t.collect()))
    alike = lambda rows: np.allclose(np.array(sorted(map(tuple, rows))), np.array(got), atol=2e-6, rtol=0)
    assert alike(pairs.pair_join(frame, digits=6).collect())
    monkeypatch.setattr(pairs, "BROADCAST", 10)
    assert alike(pairs.similarity_cut(frame, digits=6).collect())
    odd = spark.createDataFrame([(3, [math.nan]), (1, [0.0]), (2, [1.0])], "id long, x array<double>")
    monkeypatch.undo()
    assert sorted(map(tuple, pairs.similarity_cut(odd).collect())) == [(2, 1, 1.0), (3, 1, None), (3, 2, None)]
    assert pairs.similarity_cut(odd.where("id > 5")).collect() == []


def test_scaling_of_distances_makes_no_rows_of_them(frame, cloud, monkeypatch):
    """Products of the relation of points are made by tiles; they give what the matrix gives."""
    joined, whole = [], pairs.pair_join
    monkeypatch.setattr(embedding, "pair_join", lambda *a, **b: joined.append(a) or whole(*a, **b))
    monkeypatch.setattr(embedding, "BLOCK", 37)
    monkeypatch.setattr(embedding, "MOST", 100)
    for metric, d in ((Metric(), 7), (Metric("torus", 1.5), 3)):
        expected, known = embedding.scaling(metric.matrix(cloud[0], cloud[0]) * (1 - np.eye(130)), d)
        y, report = embedding.mds_of_distances(frame.withColumn("id", 3 * F.col("id") + 5), d, metric)
        rows = y.orderBy("id").collect()
        got = np.array([r.y for r in rows])
        assert [r.id for r in rows] == list(range(5, 395, 3)) and not joined
        assert Metric().matrix(got, got) == pytest.approx(Metric().matrix(expected, expected), abs=1e-6)
        assert (report["explained"], report["residual"]) == (pytest.approx(known["explained"]), pytest.approx(known["residual"]))
        joined.clear()


def test_meetings_send_the_nearest_alone(frame, cloud, spark, monkeypatch):
    """k neighbours a point and meeting, however many tiles it has; equal distances go to smaller ids, also where they are cut off."""
    monkeypatch.setattr(pairs, "GROUPS", 2)
    monkeypatch.setattr(pairs, "MERGED", 300)
    monkeypatch.setattr(pairs.self_tiles, "__defaults__", (10,))
    sent, ranked = [], neighbors._ranked
    monkeypatch.setattr(neighbors, "_ranked", lambda edges, k: sent.append(edges.count()) or ranked(edges, k))
    d = Metric().matrix(cloud[0], cloud[0])
    expected = {(i, j) for i in range(130) for j in sorted(set(range(130)) - {i}, key=lambda j: (d[i, j], j))[:4]}
    assert {(r.i, r.j) for r in neighbors.knn(frame, 4).collect()} == expected and sent == [130 * 2 * 4]
    alike = spark.createDataFrame([(3 * k, [float(k % 2)]) for k in range(60)], "id long, x array<double>")
    got = {(r.i, r.j) for r in neighbors.knn(alike, 5).collect()}
    assert got == {(3 * i, 3 * j) for i in range(60) for j in [j for j in range(i % 2, 60, 2) if j != i][:5]}
