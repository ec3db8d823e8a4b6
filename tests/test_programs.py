import numpy as np

from pointmill import __main__ as programs
from pointmill.plans import profile_fit
from tests.test_sources import put


def test_fit_and_profile(spark, tmp_path):
    r = np.random.default_rng(9)
    atoms = "".join(f"{e} {x:.3f} {y:.3f} {z:.3f}\n" for e, (x, y, z) in zip("CNOSCNOSCC", r.uniform(-8, 8, (10, 3)), strict=True))
    structure = put(tmp_path, "a.xyz", "10\nmade\n" + atoms)
    curve = profile_fit.simulate(programs.points_of(spark, structure), 30).orderBy("x").collect()
    data = put(tmp_path, "a.dat", "q I sigma\n" + "".join(f"{c['x']:.8e} {2 * c['y'] + 3:.8e} {c['yerr']:.8e}\n" for c in curve))
    programs.main(["fit", structure, data, "--output", str(tmp_path / "fit")], spark)
    report = {x[0].split()[1]: float(x[0].split()[3]) for x in spark.read.text(str(tmp_path / "fit" / "report")).collect()}
    assert abs(report["a"] - 2) < 0.01 and abs(report["b"] - 3) < 1 and report["chi2"] < 1 and report["dof"] == len(curve) - 2
    assert spark.read.parquet(str(tmp_path / "fit" / "curve")).count() == len(curve)
    programs.main(["debye", structure, "--output", str(tmp_path / "debye"), "--qmax", "0.1"], spark)
    assert 0 < spark.read.parquet(str(tmp_path / "debye" / "profile")).count() < 30
