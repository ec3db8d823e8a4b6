"""Displaced volume, fits over several parameters, symmetric assemblies and hydration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import hydration, pairs, profiles, symmetry
from pointmill.plans import parameter_fit
from pointmill.plans.inputs import points
from tests.test_points import cloud, counts


def test_parameters_of_a_simulated_curve_are_found_again(spark, sf_dir):
    p = points(spark, sf_dir)
    known = {"water": 2.7, "exv": 1.0, "debye_waller": 1.4}
    wide = parameter_fit.terms(p).withColumnRenamed("q", "x")
    data = wide.withColumn("y", 3.0 * parameter_fit.model(F.col("x"), {n: F.lit(v) for n, v in known.items()}) + 5.0).withColumn("yerr", F.lit(1e-5) * F.abs("y") + 1e-3).select("x", "y", "yerr").cache()
    found = parameter_fit.fit(p, data, ("water",), rounds=2)
    assert found["dof"] == data.count() - 3
    found = parameter_fit.search(parameter_fit.at_data(parameter_fit.terms(p), data), {"water": (0.0, 5.0), "debye_waller": (0.0, 3.0)})
    assert found["dof"] == data.count() - 4
    assert {n: round(found[n], 1) for n in ("water", "debye_waller")} == {"water": 2.7, "debye_waller": 1.4} and abs(found["a"] - 3) < 0.05, found
    with pytest.raises(ValueError):
        parameter_fit.search(data, ("other",))


@pytest.mark.parametrize("name", ["c1", "c2", "c3", "c4", "d2", "d3", "t"])
def test_symmetric_histogram_equals_that_of_all_copies(spark, name):
    rotations = symmetry.group(name)
    p = cloud(spark, 30, 1)
    every = symmetry.copies(p.withColumn("body", F.lit(0).cast("long")), symmetry.transforms(spark, {0: rotations}, (1.0, 2.0, 3.0)))
    every = every.withColumn("id", F.col("copy") * 1_000_000 + F.col("id"))
    want = pairs.merge(pairs.pair_histogram(every))
    got = symmetry.histogram(p, rotations, (1.0, 2.0, 3.0))
    a, b = ({r["bin"]: r["cnt"] for r in h.collect()} for h in (got, want))
    # a distance on the edge between bins may fall to either side
    assert sum(a.values()) == sum(b.values()) == (30 * len(rotations)) ** 2
    assert sum(abs(a.get(k, 0) - b.get(k, 0)) for k in a.keys() | b.keys()) <= 0.002 * sum(b.values())
    if name == "c1":
        assert counts(got) == counts(want)


def test_asked_q_inside_and_outside_the_axis(spark):
    h = pairs.pair_histogram(cloud(spark, 60, 2))
    q = spark.createDataFrame([(v,) for v in (0.0101, 0.0333, 0.2, 0.411, 0.5, 0.9)], "q double")
    a = {r["q"]: r["intensity"] for r in profiles.transform_at(h, q).collect()}
    b = {r["q"]: r["intensity"] for r in profiles.transform(h, q).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 * max(b.values()) for k in a)


def test_waters_keep_their_distance(spark):
    p = cloud(spark, 80, 1).withColumn("kind", F.lit("a"))
    out = hydration.hydrate(p, waters=25)
    rows = out.collect()
    atoms, waters = (np.array([[r["x"], r["y"], r["z"]] for r in rows if r["kind"] == k]) for k in "aw")
    assert len(atoms) == 80 and 0 < len(waters) <= 25 and out.columns == p.columns
    d = np.sqrt(((waters[:, None] - atoms[None]) ** 2).sum(axis=2))
    assert d.min() >= 2.5 - 1e-9 and d.min(axis=1).max() <= 3.0 + 1e-9
    assert len({tuple(np.floor(w / 2.0)) for w in waters}) == len(waters)
    assert hydration.hydrate(p.where("false"), waters=5).count() == 0
