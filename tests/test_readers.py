"""Readers: crystals, files in parts, unknown records, reconstruction flags, files read in splits."""

import struct

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointmill.ordered import carried
from pointmill.sources import curves, maps, registry, structures

CRYSTAL = """data_image0
_chemical_formula_sum  "Ag2 C1"
_cell_length_a       20.5(3)
_cell_length_b       10
_cell_length_c       40.0
_cell_angle_alpha    90.0

loop_
  _space_group_symop_operation_xyz
  'x, y, z'

loop_
  _atom_site_type_symbol
  _atom_site_label
  _atom_site_fract_x
  _atom_site_fract_y
  _atom_site_fract_z
  _atom_site_occupancy
  Ag  Ag1  0.5   0.25  0.125(2)  1.0000
  C   C1   0.0   1.0   0.5       0.5000

loop_
  _atom_site_aniso_label
  _atom_site_aniso_U_11
  Ag1 0.2
"""
ATOM = "ATOM  {0:5d}  CA  ALA A{0:4d}    {0:8.3f}   0.000   1.000  1.00  0.00           C"


def test_crystal_coordinates_are_times_the_cell(spark, tmp_path):
    path = tmp_path / "two.cif"
    path.write_text(CRYSTAL)
    got = registry.read(spark, str(path)).orderBy("line").collect()
    assert [(r["element"], r["name"], r["x"], r["y"], r["z"], r["occupancy"]) for r in got] == [("AG", "Ag1", 10.25, 2.5, 5.0, 1.0), ("C", "C1", 0.0, 10.0, 20.0, 0.5)]


def test_crystal_without_a_cell_is_an_error(spark, tmp_path):
    path = tmp_path / "none.cif"
    path.write_text(CRYSTAL.replace("_cell_length_b", "_other"))
    with pytest.raises(Exception, match="cell length b"):
        registry.read(spark, str(path)).collect()


def test_file_in_parts(spark, tmp_path):
    (tmp_path / "big_part1.pdb").write_text("HEADER x\n" + "\n".join(ATOM.format(i) for i in range(1, 4)) + "\n")
    (tmp_path / "big_part2.pdb").write_text("\r\n".join(ATOM.format(i) for i in range(4, 6)) + "\r\nTER\r\nEND\r\n")
    got = registry.read(spark, str(tmp_path / "big.pdb")).orderBy("line").collect()
    assert [r["serial"] for r in got] == [1, 2, 3, 4, 5] and len({r["set_id"] for r in got}) == 1 and got[0]["set_id"].endswith("/big.pdb")


def test_unknown_records_are_an_error(spark, tmp_path):
    path = tmp_path / "odd.pdb"
    path.write_text(ATOM.format(1) + "\nBOGUS  what\n")
    with pytest.raises(Exception, match="BOGUS"):
        registry.read(spark, str(path)).collect()
    assert structures.read_pdb(spark, str(path), strict=False).count() == 1
    assert structures.unknown_records(structures.lines(spark, str(path))).count() == 1


@pytest.mark.parametrize("suffix, stamp, flags, want", [("mrc", 0, 0, -56), ("rec", 0, 0, 200), ("rec", maps.REC_STAMP, 1, -56), ("rec", maps.REC_STAMP, 0, 200)])
def test_reconstruction_flags(spark, tmp_path, suffix, stamp, flags, want):
    raw = bytearray(1024)
    raw[:16] = struct.pack("<4i", 1, 1, 2, 0)
    raw[28:40] = struct.pack("<3i", 1, 1, 2)
    raw[40:52] = struct.pack("<3f", 1.0, 1.0, 2.0)
    raw[64:76] = struct.pack("<3i", 1, 2, 3)
    raw[152:160] = struct.pack("<2i", stamp, flags)
    path = tmp_path / f"m.{suffix}"
    path.write_bytes(bytes(raw) + bytes([200, 3]))
    assert [r["val"] for r in registry.read(spark, str(path)).orderBy("z").collect()] == [want, 3]
    if stamp:
        with pytest.raises(ValueError):
            maps.header(bytes(raw[:152]) + struct.pack("<2i", stamp, 16) + bytes(raw[160:]), True)


def test_large_files_are_read_in_splits(spark, tmp_path):
    r = np.random.default_rng(0)
    x, y = np.arange(1, 3001) / 4000, r.normal(size=3000)
    path = tmp_path / "long.dat"
    path.write_text("q I err\n" + "".join(f"{a:.6f} {b:.6f} 1.0\n" for a, b in zip(x, y, strict=True)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        rows = curves.lines(spark, str(path))
        got = curves.read_dat(spark, str(path)).orderBy("i").collect()
        assert [r["line"] for r in rows.orderBy("line").collect()] == list(range(3001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["i"] for r in got] == list(range(3000)) and np.allclose([r["y"] for r in got], y, atol=1e-6) and got[0]["n"] == 3000


def sequential_cif(text, category="_atom_site"):
    """Rows of a category's loops, read line by line."""
    rows, names, ended, before = [], [], True, False
    for i, line in enumerate(text.split("\n")):
        line = line.strip()
        label = line.startswith((category + ".", category + "_"))
        if label:
            names = [*names, line[len(category) + 1 :]] if before else [line[len(category) + 1 :]]
            ended = False
        elif line.startswith(("#", "loop_", "_", "data_")):
            ended = True
        elif line and names and not ended and len(line.split()) == len(names):
            rows.append((i, dict(zip(names, line.split(), strict=True))))
        before = label
    return rows


@pytest.mark.parametrize("size", [3, 5, 7, 100_000])
def test_tagged_loops_carry_their_state_between_chunks(spark, tmp_path, size):
    r, parts = np.random.default_rng(size), ["data_x"]
    for k in range(4):
        parts += ["#", "loop_", *[f"_atom_site.{c}" for c in ("id", "type_symbol", "Cartn_x")[: 2 + k % 2]]]
        parts += [" ".join([str(i), "C", "1.5"][: 2 + k % 2]) for i in range(int(r.integers(0, 9)))]
        parts += ["", "loop_", "_other.a", "_other.b", "1 2", "3 4"]
    text = "\n".join(parts)
    (tmp_path / "a.cif").write_text(text)
    (tmp_path / "b.cif").write_text("loop_\n_atom_site.type_symbol\nN\nO\n")
    got = structures.read_cif(spark, str(tmp_path), size=size).collect()
    assert sorted((row["line"], tuple(sorted(row["row"].items()))) for row in got if row["set_id"].endswith("a.cif")) == [(i, tuple(sorted(m.items()))) for i, m in sequential_cif(text)]
    assert sorted(row["row"]["type_symbol"] for row in got if row["set_id"].endswith("b.cif")) == ["N", "O"]


@pytest.mark.parametrize("size", [2, 100_000])
def test_parts_of_a_plot_file_and_first_run_of_coordinates(spark, tmp_path, size):
    plot = tmp_path / "p.xvg"
    plot.write_text("# c\n@ type xy\n1 2\n2 3\n3 4\n&\n1 5\n2 6\n&\n4 4\n5 5\n6 6\n7 7\n")
    got = {}
    for r in curves.read_xvg_sets(spark, str(plot), size).orderBy("set_id", "i").collect():
        got.setdefault(r["set_id"].rsplit(":", 1)[1], []).append(r["y"])
    assert got == {"1": [2, 3, 4], "2": [5, 6], "3": [4, 5, 6, 7]}
    points = tmp_path / "p.xyz"
    points.write_text("3\nname\nC 1 2 3\nN 2 3 4\n\nO 9 9 9\n")
    assert [r["element"] for r in structures.read_xyz(spark, str(points)).orderBy("line").collect()] == ["C", "N"]
    settings = tmp_path / "s.conf"
    settings.write_text("a 1\n[one]\nb 2\n# c\nd 3 4\n[two]\ne 5\n")
    assert sorted(map(tuple, registry.read_settings(spark, str(settings)).collect()), key=str) == [("one", "b", "2"), ("one", "d", "3 4"), ("two", "e", "5"), (None, "a", "1")]


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_carried_states_match_one_window(spark, size):
    r = np.random.default_rng(1)
    data = [(s, int(i), None if r.random() < 0.6 else int(r.integers(100))) for s in "ab" for i in sorted(r.choice(900, 200, replace=False))]
    df = spark.createDataFrame(data, "s string, i long, v long")
    kinds = {k: (k, F.col("v")) for k in ("sum", "max", "last", "before")}
    w = Window.partitionBy("s").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("s", "i", F.sum("v").over(w).alias("sum"), F.max("v").over(w).alias("max"), F.last("v", True).over(w).alias("last"), F.lag("v").over(Window.partitionBy("s").orderBy("i")).alias("before"))
    got = carried(df, ["s"], "i", kinds, size).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
