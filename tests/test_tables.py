"""Series, column tables, surfaces, matrices, sources, streams, optimisers' parts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistamap.functions import interpolation
from vistamap.functions import matrix_functions as mf
from vistamap.functions.transfer import Transfer
from vistamap.operators import columns, matrices, optimizers, series, surfaces
from vistamap.sources import definitions, text
from vistamap.streaming import live


def test_autocorrelation(spark):
    r = np.random.default_rng(1)
    data = {"a": r.normal(size=50).cumsum(), "b": r.normal(size=80), "short": r.normal(size=4)}
    rows = [(s, i, i, float(v)) for s, x in data.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "series string, t long, id long, v double")
    whole = np.concatenate(list(data.values()))
    mu, var = whole.mean(), whole.var()
    long = [x for x in data.values() if len(x) > 8]
    # the short series gives no products, but counts among those that lose values to the lag
    expected = [sum((x[h:] * x[: len(x) - h]).sum() - mu * (x[h:].sum() + x[: len(x) - h].sum()) for x in long) / (sum(map(len, long)) - 3 * h) + mu * mu for h in range(8)]
    got = [row.acf for row in series.autocorrelation(frame, 8).orderBy("h").collect()]
    assert got == pytest.approx(np.array(expected) / var)
    exact = [row.acf for row in series.autocorrelation(frame, 8, mean=0.0).orderBy("h").collect()]
    assert exact[0] == pytest.approx(1)
    assert series.autocorrelation(frame, 3, mean=mu, deviation=var**0.5).orderBy("h").first().acf == pytest.approx(sum((x * x).sum() for x in [v - mu for v in data.values()]) / len(whole) / var)
    same = frame.withColumn("u", F.col("v"))
    assert series.cross_correlation(same, 5).orderBy("h").first().ccf == pytest.approx(1)


def test_segments_merge(spark):
    r = np.random.default_rng(6)
    v, u = r.normal(size=90), r.normal(size=90)
    whole = series.Segment(6, v, u)
    for cuts in ([30], [1, 2, 3, 50], list(range(1, 90)), [2, 3, 88]):
        parts = [series.Segment(6, a, b) for a, b in zip(np.split(v, cuts), np.split(u, cuts))]
        got = parts[0]
        for part in parts[1:]:
            got = got.then(part)
        assert got.sums == pytest.approx(whole.sums) and got.n == 90 and got.totals == pytest.approx(whole.totals)
        assert all(getattr(got, c) == pytest.approx(getattr(whole, c)) for c in series.ENDS)
    frame = spark.createDataFrame([("s", i // 3, i, float(v[i]), float(u[i])) for i in range(90)] + [(None, 0, 1, 2.0, 3.0), ("s", 5, 1000, None, 1.0)], "series string, t long, id long, v double, u double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = {r.h: r for r in series.lagged(frame, 6, "u").where("series = 's'").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for h in range(6):
        assert (rows[h].s, rows[h].later, rows[h].earlier, rows[h].n) == pytest.approx((v[h:] @ u[: 90 - h], v[h:].sum(), u[: 90 - h].sum(), 90 - h))


def test_online_equals_batch():
    x = np.random.default_rng(5).normal(size=500).cumsum()
    online = live.Online(7)
    for part in np.split(x, [1, 4, 5, 90, 300]):
        online.add(part)
        online = live.Online(7, online.state())
    c = x - x.mean()
    assert online.acf() == pytest.approx([(c[h:] * c[: len(c) - h]).sum() / (len(c) - h) / x.var() for h in range(7)])
    assert live.Online(3).acf() == [None] * 3


def test_columns(spark):
    t = spark.createDataFrame([(i, 10.0 * i, float(i % 3), float(i)) for i in range(6)], "frame long, time double, a double, b double")
    other = spark.createDataFrame([(i, i * i) for i in range(6)], "frame long, c long")
    assert {r.frame: r.c for r in columns.add_column(t, other, "c").collect()} == {i: i * i for i in range(6)}
    for bad in ((t, t, "a"), (t, other.limit(3), "c")):
        with pytest.raises(ValueError):
            columns.add_column(*bad)
    with pytest.raises(ValueError):
        columns.select_columns(t, ["a", "zz"])
    assert columns.get_row(t, 2).collect()[0].asDict() == {"frame": 2, "a": 2.0, "b": 2.0}
    frames = spark.createDataFrame([(0, 4), (1, 1), (2, 4)], "pos long, frame long")
    assert [(r.frame, r.b) for r in columns.clone_frames(t, frames).orderBy("frame").collect()] == [(0, 4.0), (1, 1.0), (2, 4.0)]
    assert {r.frame for r in columns.lasso(t, "a", "b", (0, 0, 1, 4)).collect()} == {0, 1, 3, 4}
    assert columns.padded_range(t, "a").first().asDict() == pytest.approx({"low": -0.1, "high": 2.1})
    assert columns.padded_range(t.where("frame = 1"), "a").first().asDict() == {"low": 0.0, "high": 2.0}
    assert {r.size for r in columns.point_sizes(t.where("frame = 1"), "a", 2, 5).collect()} == {2.0}
    assert {r.share for r in columns.point_sizes(t, None, 2, 5).collect()} == {1.0}
    assert [r.color for r in columns.color_index(t, "b", 5).orderBy("frame").collect()] == [0, 1, 2, 3, 4, 5]
    assert {r.color for r in columns.color_index(t.where("frame = 1"), "b", 5).collect()} == {0}
    assert columns.segments(t, "a", "b").count() == 5
    assert [r.x1 for r in columns.steps(t, "b", "a").orderBy("x0").collect()] == [1, 2, 3, 4, 5, 6]
    assert columns.row_range(t, 2, 3).count() == 2 and columns.dataset(t, "a", "b", size="time").columns == ["x", "y", "size"]
    assert [r.value for r in columns.frame_values(t, 2, ["a", "b"]).collect()] == [2.0, 2.0]
    assert columns.tics(0, 10) == [0, 2, 4, 6, 8, 10]
    assert spark.range(1).select(columns.map_to(F.lit(5.0), 0, 10, 100, 200).alias("p")).first().p == 150
    shown = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "t double").select(*(columns.colors(k, F.col("t")).alias(k) for k in ("grey", "cool", "hot", "jet", "hsv"))).collect()
    assert [r.grey for r in shown] == ["#000000", "#808080", "#ffffff"] and shown[0].hot == "#000000" and shown[2].hot == "#ffffff" and shown[0].hsv == shown[2].hsv == "#ff0000"


def test_surfaces(spark):
    s = spark.createDataFrame([(float(x), float(y), float(x * y)) for x in range(4) for y in range(3)], "x double, y double, z double")
    kt = surfaces.thermal_energy(300)
    assert surfaces.integrate(s, kt).first().free_energy == pytest.approx(-kt * np.log(sum(np.exp(-x * y / kt) for x in range(4) for y in range(3))))
    one, two = {"x": (0, 3), "y": (0, 3)}, {"x": (-1, 1)}
    part = lambda keep: -kt * np.log(sum(np.exp(-x * y / kt) for x in range(4) for y in range(3) if keep(x, y)))
    assert surfaces.box_difference(s, kt, one).first().free_energy == pytest.approx(part(lambda x, y: 0 < x < 3 and 0 < y))
    assert surfaces.box_difference(s, kt, one, two).first().free_energy == pytest.approx(part(lambda x, y: 0 < x < 3 and 0 < y) - part(lambda x, y: x < 1))
    assert surfaces.difference(s, s).agg(F.max(F.abs("z")).alias("m")).first().m == 0
    with pytest.raises(ValueError):
        surfaces.difference(s, s.where("x < 2"))
    grid = surfaces.indexed(s)
    assert surfaces.cells(grid, 0.5, 3.0, 4).count() == 6
    assert surfaces.clipped(grid, (1, 2), (0, 1)).count() == 4
    with pytest.raises(ValueError):
        surfaces.clipped(grid, (0, 3), (0, 3), 2)
    with pytest.raises(ValueError):
        surfaces.thermal_energy(300, "furlong")


def dense(m, shape):
    out = np.zeros(shape)
    for r in m.collect():
        out[r.i, r.j] += r.v
    return out


def test_matrices(spark):
    r = np.random.default_rng(3)
    a, b = (np.where(r.random((6, 6)) < 0.4, r.normal(size=(6, 6)), 0) for _ in range(2))
    to = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")
    x, y = to(a), to(b)
    for got, expected in (
        (matrices.transpose(x), a.T), (matrices.multiply(x, y), a @ b), (matrices.add(x, y, 2.0), a + 2 * b), (matrices.negative(x), -a), (matrices.mapped(x, F.abs), np.abs(a)),
        (matrices.add_diagonal(x, 3.0, 6), a + 3 * np.eye(6)), (matrices.truncate(x, 0.5), np.where(np.abs(a) > 0.5, a, 0)), (matrices.insert(x, y), np.where(b != 0, b, a)),
        (matrices.remove(x, y), np.where(b != 0, 0, a)), (matrices.slices(x, F.col("i") < 2), a * (np.arange(6) < 2)[:, None]),
    ):
        assert dense(got, (6, 6)) == pytest.approx(expected)
    n = matrices.norms(x).first()
    assert (n.one, n.inf, n.frobenius, n.trace) == pytest.approx((np.abs(a).sum(0).max(), np.abs(a).sum(1).max(), np.linalg.norm(a), np.trace(a)))
    assert matrices.equal(x, x) and not matrices.equal(x, y)
    v = spark.createDataFrame([(i, float(i)) for i in range(6)], "i long, v double")
    assert {r.i: r.v for r in matrices.apply(x, v).collect()} == pytest.approx({i: (a @ np.arange(6))[i] for i in range(6) if a[i].any()})
    assert {(r.i, r.j): r.found for r in matrices.exists(x, y).collect()} == {(int(i), int(j)): bool(a[i, j]) for i, j in zip(*np.nonzero(b))}
    rows = matrices.to_rows(x, 6)
    assert matrices.equal(matrices.from_rows(rows, "i", "row"), x)


def test_matrix_functions():
    a = np.random.default_rng(8).normal(size=(5, 5))
    s = a @ a.T / 5
    q, v = mf.eigen_symmetric(s, 1, 4)
    assert s @ v == pytest.approx(v * q)
    assert mf.cholesky(s) @ mf.cholesky(s).T == pytest.approx(s) == mf.cholesky_stable(s) @ mf.cholesky_stable(s).T
    assert mf.function_general(a, lambda z: z * z) == pytest.approx(a @ a)
    assert mf.pseudo_inverse(a[:, :3]) == pytest.approx(np.linalg.pinv(a[:, :3]))
    assert mf.exponential(np.zeros((2, 2))) == pytest.approx(np.eye(2))
    assert mf.polynomial(s, [2.0], "blocks") == pytest.approx(2 * np.eye(5))
    assert mf.newton_inverse(a) == pytest.approx(np.linalg.inv(a))
    u, right, inverse = mf.eigen(a)
    assert (right * u) @ inverse == pytest.approx(a)


def test_interpolation_is_exact_for_its_own_kind():
    x = np.array([0.0, 1.0, 3.0, 4.0])
    s = interpolation.Spline(x, 2 * x + 1)
    assert s(np.array([0.5, 2.0, 5.0])) == pytest.approx([2, 5, 11]) and s.slope(np.array([2.0])) == pytest.approx([2])
    b = interpolation.Bicubic(x, x, x[:, None] + 2 * x[None])
    assert b(np.array([0.5, 2.0]), np.array([1.5])) == pytest.approx(np.array([[3.5], [5.0]]))


def test_optimiser_parts():
    assert optimizers.brent(lambda z: (z - 2) ** 2, *optimizers.bracket(lambda z: (z - 2) ** 2, 0.0, 0.5))[0] == pytest.approx(2)
    x = np.array([1.0, 1.0])
    up = optimizers.line_search(lambda z: -float(np.exp(-z @ z)), x * 0, x, -1.0)
    assert up[1] <= -1.0
    assert optimizers.Stop(5).reached(5, 1, 1) and not optimizers.Stop(5, 1e-3, 1e-3).reached(1, 0, 1) and optimizers.Stop(5, 1e-3, 1e-3, both=False).reached(1, 0, 1)


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# a comment\n1 2 3 0.5\n\n 4e0\t5  6 1.5\n7 8 9 2")
    got = text.read_points(spark, str(tmp_path / "p.txt"), 3, weighted=True).orderBy("id").collect()
    assert [(r.id, r.x, r.w) for r in got] == [(0, [1, 2, 3], 0.5), (1, [4, 5, 6], 1.5), (2, [7, 8, 9], 2.0)]
    with pytest.raises(Exception, match="fewer than 5"):
        text.read_points(spark, str(tmp_path / "p.txt"), 5).collect()
    (tmp_path / "c.txt").write_text("#! FIELDS time phi\n#! SET x 1\n0.0 1.5\n0.1 2.5\n")
    assert [r.asDict() for r in text.read_columns(spark, str(tmp_path / "c.txt")).orderBy("frame").collect()] == [{"frame": 0, "time": 0.0, "phi": 1.5}, {"frame": 1, "time": 0.1, "phi": 2.5}]
    for k, name in enumerate(("f", "f.1", "f.2")):
        (tmp_path / name).write_text(f"0 {k}\n\n1 {k + 1}\n")
    s = text.read_surface(spark, str(tmp_path / "f*"))
    assert {(r.frame, r.x, r.z) for r in s.collect()} == {(k, float(x), float(k + x)) for k in range(3) for x in range(2)}
    assert text.count_surfaces(spark, str(tmp_path / "f*")) == 3
    m = text.read_similarity(spark, str(tmp_path / "c2")) if (tmp_path / "c2").write_text("0 1\n1 0\n") else None
    assert {(r.i, r.j, r.d) for r in m.collect()} == {(0, 0, 0.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0)}
    with pytest.raises(ValueError):
        text.read_layout(spark, str(tmp_path / "c2"), 3)
    with pytest.raises(ValueError):
        text.read_landmarks(spark, str(tmp_path / "p.txt"), str(tmp_path / "c2"), 3)
    rows = spark.createDataFrame([(0, "a"), (1, "label: x"), (2, "b")], "id long, value string")
    assert [r.value for r in text.after_label(rows, "label").collect()] == ["b"]
    p = spark.createDataFrame([(0, [1.0, 2.0], 0.5)], "id long, x array<double>, w double")
    line = text.record_lines(spark.createDataFrame([(0, [3.0])], "id long, y array<double>"), p).first().value
    assert line.splitlines()[0].startswith("REMARK WEIGHT=5.0") and "d.1,d.2" in line and line.endswith("END")


def test_definitions():
    d = definitions.Definition([[1.0, 2.0], [3.0, 4.0]], [[0.5], [1.5]], [0.25, 0.75], Transfer("xsigmoid", (6.0, 8.0, 8.0)), Transfer("xsigmoid", (6.0, 2.0, 8.0)))
    assert definitions.read_definition(definitions.written(d)) == d
    assert definitions.function_of("X TYPE sigmoid SIGMA 2".split()) == Transfer("xsigmoid", (2.0, 2.0, 2.0))
    assert definitions.function_of("X TYPE compress SIGMA 2".split()) == Transfer("xsigmoid", (2.0, 1.0, 1.0))
    for bad in ("HIGH_D>\n1 2\n", "HIGH_D>\n1\nHIGH_D<\n", "WHAT 1\n"):
        with pytest.raises(ValueError):
            definitions.read_definition(bad)
    got, warnings = definitions.read_parameters("a 1 # x\nb { c 2 d { e 3 } }\na 4 z", {"a", "b"})
    assert got == {"a": "4", "b": {"c": "2", "d": {"e": "3"}}}
    assert warnings == ["a is given more than once", "z has no value"]


def test_the_optional_subpackage_is_optional(spark):
    """Without it everything else still imports."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['vistamap.llm'] = None; import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n in ('vistamap.llm', 'corpus_pipeline') else f(n, *a); import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op1') or n == 'pipeline' for n in e.queries()); assert e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
    assert pd is not None


def test_numbers_are_written_as_c_writes_them(spark):
    """Halves of the last digit go to even by the double's exact value."""
    values = [102850.0, 102750.0, 12345.0, 12355.0, 1.0005, 0.00012345, -102850.0, 0.0, 2.5e-5, 1e300, 9.9995e9]
    rows = spark.createDataFrame([(float(k), v) for k, v in enumerate(values)], "k double, v double")
    got = text.grid_lines(rows.select(F.lit(1).alias("g"), "k", "v"), "g", "k", ["v"], 3).first()["value"]
    assert got.split("\n") == [f"{v:.3e}" for v in values] + [""]
    line = text.layout_lines(spark.createDataFrame([(0, values[:4])], "id long, y array<double>"), digits=3).first()["value"]
    assert line == "1.028e+05 1.028e+05 1.234e+04 1.236e+04"
