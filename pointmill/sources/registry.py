"""Which reader belongs to which suffix, and settings files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.ordered import carried
from pointmill.sources import curves, maps, structures
from pointmill.sources.curves import lines

STRUCTURES, CURVES, MAPS, SETTINGS = (".pdb", ".ent", ".cif", ".xyz"), (".dat", ".rsr", ".xvg"), (".map", ".ccp4", ".mrc", ".rec"), (".config", ".conf", ".txt")


def suffix(path: str) -> str:
    dot = path.rfind(".")
    return path[dot:].lower() if dot > path.rfind("/") else ""


def kind(path: str) -> str:
    """structure, curve, map or settings; another suffix is an error."""
    for name, known in (("structure", STRUCTURES), ("curve", CURVES), ("map", MAPS), ("settings", SETTINGS)):
        if suffix(path) in known:
            return name
    raise ValueError(f"no reader for {path!r}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A structure's atoms, a curve's rows or a map's voxels, by the path's suffix."""
    readers = {".pdb": structures.read_pdb, ".ent": structures.read_pdb, ".xyz": structures.read_xyz, ".dat": curves.read_dat, ".rsr": curves.read_dat, ".xvg": curves.read_xvg}
    if suffix(path) == ".cif":
        return structures.read_cif_atoms(spark, path)
    if suffix(path) in MAPS:
        return maps.read_map(spark, path)
    if suffix(path) not in readers:
        raise ValueError(f"no reader for {path!r}")
    return readers[suffix(path)](spark, path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """section, key, value of lines 'key value'; # ; and / begin comments, [ a section."""
    rows = lines(spark, path).withColumn("text", F.trim("text")).where("text <> '' AND NOT text RLIKE '^[#;/]'")
    section = F.when(F.col("text").startswith("["), F.trim(F.translate("text", "[]", "")))
    return carried(rows, ["set_id"], "line", {"section": ("last", section)}).where(~F.col("text").startswith("[")).select("section", F.split("text", r"\s+", 2)[0].alias("key"), F.split("text", r"\s+", 2)[1].alias("value"))
