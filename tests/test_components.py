"""Hydrogens of chemical components, by hand count."""

import pytest

from pointmill.operators import residues
from pointmill.sources import structures

ATOMS = [
    ("GLY", "N", "N", "N", 0), ("GLY", "CA", "CA", "C", 0), ("GLY", "C", "C", "C", 0), ("GLY", "O", "O", "O", 0),
    ("GLY", "H", "H", "H", 0), ("GLY", "H2", "HN2", "H", 0), ("GLY", "HA2", "HA1", "H", 0), ("GLY", "HA3", "HA2", "H", 0),
    ("ABC", "CD1", "CD1", "C", 0), ("ABC", "C21", "C21", "C", 0), ("ABC", "O1'", "O1*", "O", 0), ("ABC", "HD1", "HD1", "H", 0), ("ABC", "C1", "C1", "C", 0), ("ABC", "N", "N", "N", 0),
    ("ABC", "CE1", "CE1", "C", 0), ("ABC", "CE", "CE", "C", 0), ("ABC", "HE", "HE", "H", 0),
    ("ZN", "ZN", "ZN", "ZN", 2),
]
BONDS = [
    ("GLY", "N", "CA", "SING"), ("GLY", "N", "H", "SING"), ("GLY", "N", "H2", "sing"), ("GLY", "CA", "C", "SING"), ("GLY", "HA2", "CA", "SING"), ("GLY", "CA", "HA3", "SING"), ("GLY", "C", "O", "DOUB"),
    ("ABC", "CD1", "C21", "TRIP"), ("ABC", "CD1", "HD1", "SING"), ("ABC", "O1'", "C1", "SING"), ("ABC", "CE", "HE", "SING"),
]


def loop(category, labels, rows):
    quoted = [" ".join(f'"{v}"' if "'" in str(v) else str(v) for v in r) for r in rows]
    return ["loop_", *[f"_{category}.{x}" for x in labels], *quoted, "#"]


def write(path, atoms=ATOMS, bonds=BONDS):
    text = ["data_made", "#"]
    for name in dict.fromkeys(a[0] for a in atoms):  # a component's loops after another's, as in files of many
        text += loop("chem_comp_atom", ("comp_id", "atom_id", "alt_atom_id", "type_symbol", "charge"), [a for a in atoms if a[0] == name])
        own = [b for b in bonds if b[0] == name]
        text += loop("chem_comp_bond", ("comp_id", "atom_id_1", "atom_id_2", "value_order"), own) if own else []
    path.write_text("\n".join(text) + "\n")
    return str(path)


def test_hydrogens_of_components(spark, tmp_path):
    atoms, bonds = structures.read_components(spark, write(tmp_path / "made.cif"))
    assert atoms.count() == len(ATOMS) and bonds.count() == len(BONDS)
    found = {(r["residue"], r["atom"]): (r["element"], r["hydrogens"]) for r in residues.component_hydrogens(atoms, bonds).collect()}
    assert found == {
        ("GLY", "N"): ("N", 1), ("GLY", "CA"): ("C", 2), ("GLY", "C"): ("C", 0), ("GLY", "O"): ("O", 0), ("GLY", "OC1"): ("O", 1), ("GLY", "OC2"): ("O", 0),
        ("ABC", "CD1"): ("C", 1), ("ABC", "CD"): ("C", 1), ("ABC", "C21"): ("C", 0), ("ABC", "O1'"): ("O", 0), ("ABC", "O1*"): ("O", 0), ("ABC", "C1"): ("C", 0), ("ABC", "N"): ("N", 0),
        ("ABC", "CE1"): ("C", 0), ("ABC", "CE"): ("C", 1), ("ABC", "OC1"): ("O", 1), ("ABC", "OC2"): ("O", 0),
        ("ZN", "ZN"): ("ZN", 2),
    }


def test_estimates_for_unknown_names(spark, tmp_path):
    table = residues.component_hydrogens(*structures.read_components(spark, write(tmp_path / "made.cif")))
    rows = [("gly", "ca", "C"), ("GLY", "CX", "C"), ("GLY", "HX", "H"), ("GLY", "S", "S"), ("XXX", "CA", "C"), ("ZN", "ZN", "Zn"), (None, None, None)]
    out = residues.with_estimates(spark.createDataFrame(rows, "resName string, name string, element string"), table)
    assert {(r["resName"], r["name"]): r["hydrogens"] for r in out.collect()} == dict(zip([r[:2] for r in rows], [2.0, 1.0, 0.0, 0.0, 0.0, 2.0, 0.0]))


def test_odd_components(spark, tmp_path):
    atoms, bonds = structures.read_components(spark, write(tmp_path / "made.cif"))
    none = residues.component_hydrogens(atoms.where("false"), bonds.where("false"))
    assert none.count() == 0 and residues.with_estimates(spark.createDataFrame([("A", "B", "C")], "resName string, name string, element string"), none).first()["hydrogens"] == 0.0
    wrong = structures.read_components(spark, write(tmp_path / "wrong.cif", bonds=[("GLY", "N", "H", "QUAD")]))
    with pytest.raises(Exception, match="unknown bond order: QUAD"):
        residues.component_hydrogens(*wrong).collect()
