"""Structure files: fixed-width records, tagged loops, and plain coordinate lists, as point tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions.text import quoted_tokens, tokens
from pointmill.ordered import BLOCK, carried
from pointmill.sources.curves import lines

WATER = ("HOH", "SOL")
#: First and last column (from 1) of each field of an atom record: fixed values of the format.
PDB_FIELDS = {
    "record": (1, 6), "serial": (7, 11), "name": (13, 16), "altLoc": (17, 17), "resName": (18, 20), "chainID": (22, 22), "resSeq": (23, 26), "iCode": (27, 27),
    "x": (31, 38), "y": (39, 46), "z": (47, 54), "occupancy": (55, 60), "tempFactor": (61, 66), "element": (77, 78), "charge": (79, 80),
}
_PDB_TYPES = {"serial": "int", "resSeq": "int", "x": "double", "y": "double", "z": "double", "occupancy": "double", "tempFactor": "double"}
_HEADER = ("HEADER", "TITLE", "COMPND", "SOURCE", "KEYWDS", "EXPDTA", "AUTHOR", "REVDAT", "JRNL", "REMARK", "CRYST1", "MODEL", "SEQRES", "HELIX", "SHEET")


def _field(text: Column, name: str) -> Column:
    first, last = PDB_FIELDS[name]
    value = F.trim(F.substring(text, first, last - first + 1))
    return value.try_cast(_PDB_TYPES[name]) if name in _PDB_TYPES else value


def pdb_records(rows: DataFrame) -> DataFrame:
    """set_id, line and the fields of each atom record. An empty element is the first letter of the name; an empty occupancy is
    1, and where all of a file are 0 they are 1."""
    atoms = rows.where(F.substring("text", 1, 6).isin("ATOM  ", "HETATM"))
    out = atoms.select("set_id", "line", *[_field(F.col("text"), c).alias(c) for c in PDB_FIELDS])
    out = out.withColumns({"occupancy": F.coalesce("occupancy", F.lit(1.0)), "tempFactor": F.coalesce("tempFactor", F.lit(0.0)), "element": F.upper(F.when(F.col("element") == "", F.regexp_extract("name", "([A-Za-z])", 1)).otherwise(F.col("element")))})
    most = out.groupBy("set_id").agg(F.max("occupancy").alias("__most"))
    return out.join(most, "set_id").withColumn("occupancy", F.when(F.col("__most") == 0, 1.0).otherwise(F.col("occupancy"))).drop("__most")


def _known(text: Column) -> Column:
    known = ("ATOM", "HETATM", "TER", "END", "ENDMDL", "MASTER", "CONECT", "ANISOU", "LINK", "SSBOND", "HET", "HETNAM", "FORMUL", "DBREF", "SCALE1", "SCALE2", "SCALE3", "ORIGX1", "ORIGX2", "ORIGX3", "SITE", "CISPEP", "NUMMDL", "SEQADV", "MODRES", "HETSYN", "DBREF1", "DBREF2", "SPLIT", "CAVEAT", "OBSLTE", "SPRSDE", "MDLTYP", "MTRIX1", "MTRIX2", "MTRIX3", "")
    return F.trim(F.translate(F.substring(text, 1, 6), "\r", "")).isin(*known, *_HEADER)


def unknown_records(rows: DataFrame) -> DataFrame:
    """Lines that are neither atoms, terminators, headers nor footers."""
    return rows.where(~_known(F.col("text")))


def _part_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of path, or of its parts (name_part1.pdb, name_part2.pdb, ...) under path's name where it comes in parts."""
    if isinstance(path, str) and "*" not in path and "." in path:
        stem, suffix = path.rsplit(".", 1)
        try:
            parts = lines(spark, f"{stem}_part[0-9]*.{suffix}")
        except AnalysisException:  # no such file
            return lines(spark, path)
        number = F.regexp_extract("set_id", r"_part(\d+)\.[^.]*$", 1).cast("long")
        return parts.select(F.regexp_replace("set_id", r"_part\d+(\.[^.]*)$", "$1").alias("set_id"), (number * F.lit(1 << 32) + F.col("line")).alias("line"), "text")
    return lines(spark, path)


def read_pdb(spark: SparkSession, path: str | list[str], keep_hydrogens: bool = False, strict: bool = True) -> DataFrame:
    """The atoms of a file, or of its parts one after another. A record of no known kind is an error, unless strict is off."""
    rows = _part_lines(spark, path)
    if strict:
        rows = rows.where(F.when(_known(F.col("text")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unrecognized record: "), F.substring("text", 1, 6))).cast("boolean")))
    out = pdb_records(rows)
    return out if keep_hydrogens else out.where("element <> 'H'")


def read_xyz(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """set_id, line, element, x, y, z of the first run of four-token lines."""
    rows = lines(spark, path).withColumn("__t", tokens(F.col("text")))
    four = (F.size("__t") == 4) & F.forall(F.slice("__t", 2, 3), lambda t: t.try_cast("double").isNotNull())
    marked = rows.withColumn("__four", F.coalesce(four, F.lit(False)))
    # the first run: no line of another kind stands between its rows and the file's first such row
    first = marked.where("__four").groupBy("set_id").agg(F.min("line").alias("__first"))
    ends = marked.where(~F.col("__four")).join(first, "set_id").where(F.col("line") > F.col("__first")).groupBy("set_id").agg(F.min("line").alias("__end"))
    kept = marked.where("__four").join(ends, "set_id", "left").where(F.col("__end").isNull() | (F.col("line") < F.col("__end")))
    return kept.select("set_id", "line", F.upper(F.col("__t")[0]).alias("element"), *[F.col("__t")[k + 1].try_cast("double").alias(c) for k, c in enumerate("xyz")])


def read_cif(spark: SparkSession, path: str | list[str], category: str = "_atom_site", recursive: bool = False, size: int = BLOCK) -> DataFrame:
    """set_id, line and a map of label to value for each row of a category's loops: the labels are the lines that begin with it
    and a dot (or, as crystal files have them, an underscore), the rows the lines after them up to a #, a loop_, a data_ or
    another label. Categories that only begin alike are other loops; of atom sites the one that tells elements is read. The last label and the last end so far are carried
    from one size lines to the next, so no task reads a whole file."""
    rows = lines(spark, path, recursive).withColumn("text", F.trim(F.translate("text", "\r", "")))
    label = F.col("text").rlike(f"^{category}[._]")
    marked = rows.withColumn("__label", label).withColumn("__ends", F.col("text").rlike(r"^(#|loop_|_|data_)") & ~label)
    states = {"__since": ("max", F.when(F.col("__label"), F.col("line"))), "__ended": ("max", F.when(F.col("__ends"), F.col("line"))), "__labels": ("sum", F.col("__label").cast("long"))}
    # lines less labels so far: the same for all labels of a run, and another for each run
    seen = carried(marked, ["set_id"], "line", states, size).withColumn("__loop", F.col("__since") - F.col("__labels"))
    name = F.regexp_extract("text", rf"^{category}[._](\S+)", 1)
    names = seen.where("__label").groupBy("set_id", "__loop").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", name.alias("name")))), lambda s: s["name"]).alias("__names"))
    if category == "_atom_site":
        names = names.where(F.array_contains("__names", "type_symbol") | F.array_contains("__names", "Cartn_x"))
    data = seen.where(F.col("__loop").isNotNull() & ~F.col("__label") & ~F.col("__ends") & (F.coalesce("__ended", F.lit(-1)) < F.col("__since")) & (F.col("text") != ""))
    parts = data.join(names, ["set_id", "__loop"]).withColumn("__t", quoted_tokens(F.col("text")))
    return parts.where(F.size("__t") == F.size("__names")).select("set_id", "line", F.map_from_arrays("__names", "__t").alias("row"))


def read_components(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) of a file of chemical components, of one or of many, as residues.component_hydrogens takes them. Rows
    that lack the component's or an atom's name are left out."""

    def item(name: str) -> Column:
        value = F.col("row")[name]
        return F.when(value.isin(".", "?"), None).otherwise(value)

    atoms = read_cif(spark, path, "_chem_comp_atom").select(item("comp_id").alias("residue"), item("atom_id").alias("atom"), item("alt_atom_id").alias("alternative"), F.upper(item("type_symbol")).alias("element"), item("charge").try_cast("int").alias("charge"))
    bonds = read_cif(spark, path, "_chem_comp_bond").select(item("comp_id").alias("residue"), item("atom_id_1").alias("atom_a"), item("atom_id_2").alias("atom_b"), item("value_order").alias("kind"))
    return atoms.where("residue IS NOT NULL AND atom IS NOT NULL"), bonds.where("residue IS NOT NULL")


def cif_items(spark: SparkSession, path: str | list[str], category: str) -> DataFrame:
    """set_id and a map of label to value of a category's single items, a label and its value a line."""
    pattern = rf"^{category}[._](\S+)\s+(\S.*)$"
    rows = lines(spark, path).withColumn("text", F.trim(F.translate("text", "\r", ""))).where(F.col("text").rlike(pattern))
    entry = F.struct(F.regexp_extract("text", pattern, 1).alias("k"), F.regexp_extract("text", pattern, 2).alias("v"))
    return rows.groupBy("set_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("items"))  # a few lines a file


def _other_than(key: str) -> Callable[[Column, Column], Column]:
    return lambda k, v: k != key


def read_cif_atoms(spark: SparkSession, path: str | list[str], keep_hydrogens: bool = True) -> DataFrame:
    """The atoms of macromolecule and crystal files alike: a row without Cartesian coordinates is a crystal's, whose fractional
    ones are taken times the lengths of the file's cell (of right angles: others are read as if they were right)."""
    cells = cif_items(spark, path, "_cell").select("set_id", *[F.regexp_extract(F.col("items")[f"length_{c}"], r"^[^(]*", 0).try_cast("double").alias(f"__{c}") for c in "abc"])
    rows = read_cif(spark, path).join(F.broadcast(cells) if isinstance(path, str) and "*" not in path else cells, "set_id", "left")
    filled = rows
    for axis, side in zip("xyz", "abc", strict=True):
        missing = F.col("row")[f"Cartn_{axis}"].isNull() & F.col("row")[f"fract_{axis}"].isNotNull()
        length = F.coalesce(F.col(f"__{side}"), F.raise_error(F.lit(f"a crystal without cell length {side}")).cast("double"))
        value = (F.regexp_extract(F.col("row")[f"fract_{axis}"], r"^[^(]*", 0).try_cast("double") * length).cast("string")
        filled = filled.withColumn("row", F.when(missing, F.map_concat(F.map_filter("row", _other_than(f"Cartn_{axis}")), F.create_map(F.lit(f"Cartn_{axis}"), value))).otherwise(F.col("row")))
    out = cif_points(filled.drop("__a", "__b", "__c"))
    return out if keep_hydrogens else out.where("element <> 'H'")


def cif_points(rows: DataFrame) -> DataFrame:
    """The atom fields of a loop's rows; author's labels come first, missing optional ones are null, coordinates must be there."""
    def pick(*names: str) -> Column:
        found = [F.when(~F.col("row")[n].isin(".", "?"), F.col("row")[n]) for n in names]
        return F.coalesce(*found) if len(found) > 1 else found[0]

    return rows.select(
        "set_id", "line", pick("group_PDB").alias("record"), pick("id").try_cast("int").alias("serial"), pick("auth_atom_id", "label_atom_id", "label").alias("name"), pick("label_alt_id").alias("altLoc"),
        pick("auth_comp_id", "label_comp_id").alias("resName"), pick("auth_asym_id", "label_asym_id").alias("chainID"), pick("auth_seq_id", "label_seq_id").try_cast("int").alias("resSeq"),
        *[F.coalesce(F.col("row")[f"Cartn_{c}"].try_cast("double"), F.raise_error(F.lit(f"no coordinate {c}")).cast("double")).alias(c) for c in "xyz"],
        F.coalesce(pick("occupancy").try_cast("double"), F.lit(1.0)).alias("occupancy"), F.upper(pick("type_symbol")).alias("element"),
    )


def to_points(atoms: DataFrame, dimension: DataFrame, use_occupancy: bool = True) -> DataFrame:
    """id, body, x, y, z, w (charge by element, times occupancy), kind (a or w), residue, is_calpha: the reduced form of a
    structure. dimension is the bounded table of elements."""
    joined = atoms.join(F.broadcast(dimension), "element", "left")
    occupancy = F.col("occupancy") if use_occupancy and "occupancy" in atoms.columns else F.lit(1.0)
    water = F.col("resName").isin(*WATER) if "resName" in atoms.columns else F.lit(False)
    residue = F.col("resSeq") if "resSeq" in atoms.columns else F.lit(None).cast("int")
    calpha = (F.col("name") == "CA") if "name" in atoms.columns else F.lit(False)
    return joined.select(F.xxhash64("set_id", "line").alias("id"), F.lit(0).cast("long").alias("body"), "x", "y", "z", (F.coalesce(F.col("charge").cast("double") if "charge" in dimension.columns and "charge" not in atoms.columns else dimension["charge"].cast("double"), F.lit(0.0)) * occupancy).alias("w"), F.when(water, "w").otherwise("a").alias("kind"), residue.alias("residue"), calpha.alias("is_calpha"))


def from_arrays(spark: SparkSession, x: list[float], y: list[float], z: list[float], w: list[float]) -> DataFrame:
    if not len(x) == len(y) == len(z) == len(w):
        raise ValueError("arrays of different lengths")
    return spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(zip(x, y, z, w, strict=True))], "id long, body long, x double, y double, z double, w double")
