"""Atoms, matrix files, similarity relations, surfaces of projections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistamap.functions import geometry
from vistamap.functions.metrics import Metric
from vistamap.operators import embedding, landmarks, pairs, projection, series, stress, structures
from vistamap.sources import matrix_text, text


def test_torsions_and_angles(spark):
    corner = [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    atoms = [(0, k, x) for k, x in enumerate([*corner, [0.0, 1.0, 1.0]])] + [(1, k, x) for k, x in enumerate([*corner, [-1.0, 0.0, 1.0]])]
    frame = spark.createDataFrame(atoms, "frame long, atom long, x array<double>")
    names = spark.createDataFrame([("t", 0, 1, 2, 3)], "name string, a long, b long, c long, d long")
    got = {r.frame: r.angle for r in structures.torsions(frame, names).collect()}
    assert got == {0: pytest.approx(math.pi / 2), 1: pytest.approx(math.pi)} or got == {0: pytest.approx(-math.pi / 2), 1: pytest.approx(math.pi)}
    a = [F.array(*map(F.lit, x)) for x in corner]
    assert spark.range(1).select(geometry.angle(*a).alias("a")).first().a == pytest.approx(math.pi / 2)
    assert geometry.orthorhombic((1, 2, 3, 90, 90, 90)) == (1, 2, 3)
    with pytest.raises(ValueError):
        geometry.orthorhombic((1, 2, 3, 90, 80, 90))


@pytest.mark.parametrize("metric", [Metric(), Metric("torus", 3.0)], ids=lambda m: m.kind)
def test_contacts(spark, metric):
    x = np.random.default_rng(1).uniform(0, 3, (2, 60, 3))
    frame = spark.createDataFrame([(f, k, x[f, k].tolist()) for f in (0, 1) for k in range(60)], "frame long, atom long, x array<double>")
    expected = {(f, i, j) for f in (0, 1) for i in range(60) for j in range(i) if metric.matrix(x[f, i : i + 1], x[f, j : j + 1])[0, 0] < 0.7}
    rows = structures.contacts(frame, 0.7, metric).collect()
    assert len(rows) == len(expected) and {(r.frame, r.i, r.j) for r in rows} == expected
    assert structures.radial_distribution(frame, 0.7, 5, metric).agg(F.sum("pairs")).first()[0] == len(expected)


def test_structure_files(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("REMARK x\nATOM      1  CA  ALA A  12      11.104   6.134  -6.504  1.00  0.00\nEND\n")
    r = text.read_atoms(spark, str(tmp_path / "a.pdb")).first()
    assert (r.atom, r.name, r.residue, r.chain, r.number, r.x) == (1, "CA", "ALA", "A", 12, [11.104, 6.134, -6.504])
    rows = spark.createDataFrame([("TORSION LIST 1 2 3 4 SIGMA 0.5",), ("HILLS HEIGHT 1",), ("UPPER KAPPA=2.0,4e1",)], "value string")
    got = [x.value for x in text.rescaled(rows, {"SIGMA": 2.0, "KAPPA": 10.0}, ["hills"]).collect()]
    assert got == ["TORSION LIST 1 2 3 4 SIGMA 1.0", "UPPER KAPPA=20.0,400.0"]


@pytest.mark.parametrize("kind", ["full", "coo", "crs"])
def test_matrix_text(spark, tmp_path, kind):
    entries = [(0, 1, 1.5), (2, 0, -2.0), (2, 2, 0.25)]
    out = matrix_text.written(3, 3, entries, kind)
    assert [e for e in matrix_text.parse(out, kind)[2] if e[2]] == entries
    (tmp_path / "m").write_text(out)
    assert matrix_text.read_matrix(spark, str(tmp_path / "m"), kind).where("v <> 0").count() == 3
    with pytest.raises(ValueError):
        matrix_text.parse("rows 1 cols 1 data 3 5 0 1.0", "coo")


def test_similarity_relations(spark):
    x = np.random.default_rng(2).normal(size=(30, 3))
    p = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, x array<double>, w double")
    relation = pairs.pair_join(p)
    y, _ = embedding.mds_of_pairs(relation, 3)
    back = {(r.i, r.j): r.d for r in pairs.pair_join(y.withColumnRenamed("y", "x")).collect()}
    assert all(back[r.i, r.j] == pytest.approx(r.d) for r in relation.collect())
    one, two = (f.orderBy("rank").collect() for f in (landmarks.minmax(p, 8), landmarks.minmax_of_pairs(relation, 8)))
    assert [r.id for r in one] == [r.id for r in two]
    a = embedding.linear_map(x, 2 * x[:, :2] + 1)
    assert np.column_stack([x, np.ones(30)]) @ a == pytest.approx(2 * x[:, :2] + 1)


def test_projection_surface(spark):
    r = np.random.default_rng(3)
    marks = spark.createDataFrame([(i, r.normal(size=3).tolist(), r.normal(size=2).tolist(), 1.0) for i in range(12)], "id long, x array<double>, y array<double>, w double")
    one = marks.where("id = 4").select("id", "x")
    got = projection.interpolants(one, marks, stress.Terms(), 3.0, 7, 25)
    assert got.count() == 625
    low, best = got.orderBy("f").first(), projection.project(one, marks, stress.Terms(), 3.0, 7, 25).first()
    assert (low.gx, low.gy, low.f) == pytest.approx((*best.y, best.error))


def test_fourier_autocorrelation():
    x = np.random.default_rng(4).normal(size=200).cumsum()
    c = x - x.mean()
    assert series.acf_fft(x, 9) == pytest.approx([(c[h:] @ c[: 200 - h]) / (200 - h) / x.var() for h in range(9)])
