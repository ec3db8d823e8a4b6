import numpy as np
from pyspark.sql import functions as F

from pointmill.operators import map_fit, pairs, residues, rigid, symmetry
from pointmill.plans import profile_fit
from tests.test_points import cloud, counts


def moves():
    return [(0, np.eye(3), np.zeros(3)), (1, symmetry.rotation((0, 0, 1), 0.7), np.array([1.0, 2, 3])), (2, symmetry.rotation((1, 1, 0), -0.4), np.array([0.0, -4, 0]))]


def by_move(h):
    out = {}
    for r in h.collect():
        out.setdefault(r["move"], {})[r["bin"]] = (r["value"], r["cnt"])
    return out


def test_moves_equal_whole_histograms(spark, monkeypatch):
    p = cloud(spark, 90, 4)
    found = by_move(rigid.move_histograms(p, moves()))
    for k, (body, r, t) in enumerate(moves()):
        poses = {b: (r, t) if b == body else (np.eye(3), np.zeros(3)) for b in range(3)}
        assert found[k] == counts(pairs.pair_histogram(rigid.place(p, poses)))
    monkeypatch.setattr(pairs, "BROADCAST_POINTS", 0)
    monkeypatch.setattr(pairs, "TILE", 25)
    assert by_move(rigid.move_histograms(p, moves())) == found


def test_penalties_of_moves(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0), (1, 3.0, 0.0, 0.0, 1.0, 1)], "id long, x double, y double, z double, w double, body long")
    wanted = spark.createDataFrame([(0, 1, 3.0, "bond")], "id_a long, id_b long, rest double, kind string")
    tried = [(1, np.eye(3), np.zeros(3)), (1, np.eye(3), np.array([1.0, 0, 0])), (0, np.eye(3), np.array([-2.0, 0, 0]))]
    assert {r["move"]: r["penalty"] for r in rigid.penalties(p, tried, wanted).collect()} == {0: 0.0, 1: 10.0, 2: 160.0}


def test_refinement_never_rises(spark):
    p = cloud(spark, 40, 5)
    truth = rigid.place(p, {0: (np.eye(3), np.zeros(3)), 1: (np.eye(3), np.array([6.0, 0, 0])), 2: (np.eye(3), np.zeros(3))})
    out = rigid.refine(p, profile_fit.simulate(truth, 20), rounds=2, tries=3, fixed=(0,))
    assert len(out.history) == 3 and out.history == sorted(out.history, reverse=True)


def test_cutoffs_of_a_map(spark):
    r = np.random.default_rng(6)
    v = spark.createDataFrame([(int(x), int(y), int(z), float(r.uniform(0, 10))) for x, y, z in np.ndindex(5, 5, 4)], "x int, y int, z int, val double")
    p = map_fit.banded_points(v, 4, 2.0, 10.0)
    found = {}
    for row in map_fit.cutoff_histograms(p, 4).collect():
        found.setdefault(row["level"], {})[row["bin"]] = (row["value"], row["cnt"])
    for level in range(1, 5):
        assert found[level] == counts(pairs.pair_histogram(p.where(F.col("band") >= level)))


def test_hydrogens(spark):
    atoms = spark.createDataFrame([("GLY", "N", "N"), ("GLY", "CA", "C"), ("GLY", "C", "C"), ("GLY", "O", "O"), ("GLY", "HA2", "H")], "residue string, atom string, element string")
    bonds = spark.createDataFrame([("GLY", "N", "CA", "SING"), ("GLY", "CA", "C", "SING"), ("GLY", "C", "O", "DOUB"), ("GLY", "CA", "HA2", "SING")], "residue string, atom_a string, atom_b string, kind string")
    table = residues.hydrogens_from_bonds(atoms, bonds)
    assert {r["atom"]: r["hydrogens"] for r in table.collect()} == {"N": 2, "CA": 2, "C": 1, "O": 0}
    found = spark.createDataFrame([("GLY", "ca", "C", 6.0), ("XXX", "CA", "C", 6.0)], "resName string, name string, element string, w double")
    assert {r["resName"]: r["w"] for r in residues.with_implicit_hydrogens(found, table).collect()} == {"GLY": 8.0, "XXX": 6.0}
    own = found.union(spark.createDataFrame([("GLY", "HA2", "H", 1.0)], found.schema))
    assert {r["w"] for r in residues.with_implicit_hydrogens(own, table).collect()} == {6.0, 1.0}
    assert residues.unknown_atoms(found, table).collect() == [("XXX", "CA", 1)]
    assert residues.hydrogens_from_bonds(atoms.where("false"), bonds).count() == 0


def test_thinning_by_body(spark):
    p = cloud(spark, 600, 7)
    kept = residues.thin_by_body(p, 300, {0: 0.0})
    n = {r["body"]: r["count"] for r in kept.groupBy("body").count().collect()}
    assert 0 not in n and 220 < sum(n.values()) < 380
