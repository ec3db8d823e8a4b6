import struct

import numpy as np
import pytest

from pointmill import sinks
from pointmill.operators.mass import elements
from pointmill.sources import curves, maps, registry, structures

PDB = """HEADER    A TEST
ATOM      1  N   GLY A   1      11.104   6.134  -6.504  1.00 10.00           N
ATOM      2  CA  GLY A   1      11.639   6.071  -5.147  0.50 10.00           C
ATOM      3  H   GLY A   1      12.000   7.000  -5.000  1.00 10.00           H
HETATM    4  O   HOH A 101       1.000   2.000   3.000  1.00 20.00            
TER
END
"""


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_dat(spark, tmp_path):
    path = put(tmp_path, "a.dat", "# head\nq I err\n0.1 5 1\n0.2, 6, 1\n0.3\t7\t1\n0.4 8\n\n")
    rows = curves.read_dat(spark, path).orderBy("i").collect()
    assert [(r["x"], r["y"], r["yerr"]) for r in rows] == [(0.1, 5, 1), (0.2, 6, 1), (0.3, 7, 1)]
    assert curves.read_dat(spark, path, skip=1).count() == 2
    assert curves.read_dat(spark, path, q_range=(0.15, 0.25)).count() == 1
    nano = put(tmp_path, "b.dat", "1 1\n2 2\n3 3\n4 4\n")
    assert curves.read_dat(spark, nano).orderBy("i").first()["x"] == 0.1


def test_xvg_and_folder(spark, tmp_path):
    path = put(tmp_path, "a.xvg", "# c\n@ title\n@type xy\n1 5\n2 6\n&\n@type xy\n3 7\n")
    assert [r["x"] for r in curves.read_xvg(spark, put(tmp_path, "b.xvg", "@ t\n1 5\n2 6\n")).orderBy("i").collect()] == [0.1, 0.2]
    sets = {r["set_id"].rsplit(":", 1)[1]: r["count"] for r in curves.read_xvg_sets(spark, path).groupBy("set_id").count().collect()}
    assert sorted(sets.values()) == [1, 2]
    (tmp_path / "d" / "e").mkdir(parents=True)
    put(tmp_path / "d", "x.txt", "1 2\n")
    put(tmp_path / "d" / "e", "y.txt", "1 2\n3 4\n")
    assert curves.read_folder(spark, str(tmp_path / "d")).count() == 3


def test_pdb(spark, tmp_path):
    path = put(tmp_path, "a.pdb", PDB)
    atoms = structures.read_pdb(spark, path).orderBy("line").collect()
    assert [(a["name"], a["element"], a["x"]) for a in atoms] == [("N", "N", 11.104), ("CA", "C", 11.639), ("O", "O", 1.0)]
    assert structures.read_pdb(spark, path, keep_hydrogens=True).count() == 4
    assert structures.unknown_records(curves.lines(spark, put(tmp_path, "z.pdb", "BOGUS line\n"))).count() == 1
    points = {r["kind"]: r["w"] for r in structures.to_points(structures.read_pdb(spark, path), elements(spark)).where("x < 2 OR is_calpha").collect()}
    assert points == {"w": 8.0, "a": 3.0}
    zero = put(tmp_path, "b.pdb", PDB.replace("  1.00 ", "  0.00 ").replace("  0.50 ", "  0.00 "))
    assert {r["occupancy"] for r in structures.read_pdb(spark, zero).collect()} == {1.0}


def test_pdb_round_trip(spark, tmp_path):
    atoms = structures.read_pdb(spark, put(tmp_path, "a.pdb", PDB))
    sinks.write_pdb(atoms, str(tmp_path / "out"))
    again = structures.pdb_records(curves.lines(spark, str(tmp_path / "out" / "part=0")))
    fields = ["name", "resName", "chainID", "resSeq", "x", "y", "z", "element"]
    assert sorted(map(tuple, again.select(*fields).collect())) == sorted(map(tuple, atoms.select(*fields).collect()))


def test_cif_and_xyz(spark, tmp_path):
    cif = """data_X
#
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.auth_comp_id
_atom_site.auth_atom_id
ATOM 1 N N . LYS A 1 1.5 2.5 3.5 B 7 LYS "N'"
ATOM 2 C CA . LYS A 1 4.5 5.5 6.5 B 7 LYS CA
#
loop_
_other.a
1
#
"""
    rows = structures.cif_points(structures.read_cif(spark, put(tmp_path, "a.cif", cif))).orderBy("line").collect()
    assert [(r["name"], r["chainID"], r["resSeq"], r["x"], r["altLoc"]) for r in rows] == [("N'", "B", 7, 1.5, None), ("CA", "B", 7, 4.5, None)]
    xyz = put(tmp_path, "a.xyz", "2\ncomment here\nC 1 2 3\nN 4 5 6\nend\nC 7 8 9\n")
    assert [(r["element"], r["z"]) for r in structures.read_xyz(spark, xyz).orderBy("line").collect()] == [("C", 3.0), ("N", 6.0)]


@pytest.mark.parametrize(("mode", "order"), [(2, (1, 2, 3)), (1, (3, 2, 1)), (0, (2, 1, 3)), (12, (1, 2, 3))])
def test_map(spark, tmp_path, mode, order):
    nx, ny, nz = 3, 4, 5
    want = np.arange(nx * ny * nz).reshape(nx, ny, nz) % 100
    by_axis = {1: nx, 2: ny, 3: nz}
    size = [by_axis[a] for a in order]
    data = want.transpose([a - 1 for a in order[::-1]]).astype(maps.MODES[mode])
    head = bytearray(1024)
    head[:40] = struct.pack("<10i", *size, mode, 0, 0, 0, nx, ny, nz)
    head[40:52] = struct.pack("<3f", nx * 2.0, ny * 2.0, nz * 2.0)
    head[64:76] = struct.pack("<3i", *order)
    path = tmp_path / "a.mrc"
    path.write_bytes(bytes(head) + data.tobytes())
    rows = maps.read_map(spark, str(path), section=10).collect()
    assert len(rows) == want.size and all(r["val"] == want[r["x"], r["y"], r["z"]] and r["cell"] == 2.0 for r in rows)
    with pytest.raises(ValueError):
        maps.voxels(bytes(head) + data.tobytes() + b"x")
    whole, _ = maps.voxels(path.read_bytes())
    for name in (str(path), f"file:{path}", f"file://{path}"):  # a part alone, from the middle of a row on
        parts = maps.MapReader({"paths": f'["{name}"]', "voxels": "7"}).partitions()
        assert [(p.first, p.last) for p in parts] == [(i, min(i + 7, 60)) for i in range(0, 60, 7)]
        alone = maps.part_voxels(parts[4]).to_pylist()
        assert len(alone) == 7 and all(r["val"] == whole[r["x"], r["y"], r["z"]] for r in alone)
    (tmp_path / "b.mrc").write_bytes(path.read_bytes() + b"x")
    assert maps.read_map(spark, [str(path)]).count() == want.size
    with pytest.raises(Exception, match="more or fewer bytes"):
        maps.read_map(spark, str(tmp_path)).count()


def test_registry_and_settings(spark, tmp_path):
    assert registry.kind("/a/b.PDB") == "structure" and registry.kind("x.rsr") == "curve"
    with pytest.raises(ValueError):
        registry.kind("x.xml")
    with pytest.raises(ValueError):
        registry.read(spark, "x.xml")
    path = put(tmp_path, "s.conf", "# c\n[ data ]\nqmin 0.1\nname a b\n")
    assert {(r["section"], r["key"], r["value"]) for r in registry.read_settings(spark, path).collect()} == {("data", "qmin", "0.1"), ("data", "name", "a b")}
    table = spark.createDataFrame([("data", "qmin", "0.1")], "section string, key string, value string")
    sinks.write_settings(table, str(tmp_path / "w"))
    assert registry.read_settings(spark, str(tmp_path / "w")).first()["value"] == "0.1"


def test_curve_sink(spark, tmp_path):
    df = spark.createDataFrame([(0, i, 3, float(i), 2.0 * i, 1.0) for i in range(3)], "set_id long, i long, n long, x double, y double, yerr double")
    sinks.write_curves(df, str(tmp_path / "c"))
    again = curves.read_folder(spark, str(tmp_path / "c"), ".txt")
    assert sorted((r["x"], r["y"]) for r in again.collect()) == [(0, 0), (1, 2), (2, 4)]
