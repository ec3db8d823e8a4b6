"""Curve files: whitespace or comma separated numbers with headers of free form, and the grid-plot format with # and @ lines.

All readers take many files or folders at once; a file is a set. Lines are numbered within their file by their byte order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions.text import is_numeric, tokens
from pointmill.ordered import BLOCK, carried, number_rows

NAMES = ("x", "y", "yerr", "xerr")


def lines(spark: SparkSession, path: str | list[str], recursive: bool = False, suffix: str | None = None) -> DataFrame:
    """set_id (the file), line (from 0), text. Large files are read in splits: lines are numbered within each and shifted by
    those of the splits before, so that no task needs a whole file."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("set_id"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("text"))
    return number_rows(rows, ["set_id"], ["__at"], F.col("__split")).select("set_id", F.col("i").alias("line"), "text")


def numeric_rows(rows: DataFrame) -> DataFrame:
    """set_id, line, values, width of the lines whose every token is a number."""
    split = rows.withColumn("__t", tokens(F.col("text")))
    kept = split.where((F.size("__t") > 0) & F.forall("__t", is_numeric))
    return kept.select("set_id", "line", F.transform("__t", lambda t: t.try_cast("double")).alias("values"), F.size("__t").alias("width"))


def curve(rows: DataFrame, skip: int = 0, scale_x: float = 1.0) -> DataFrame:
    """set_id, i, n, x, y [, yerr, xerr] from lines: of the numeric ones those of the most frequent width (the least of
    equally frequent ones), less the first skip."""
    numeric = numeric_rows(rows)
    counts = numeric.groupBy("set_id", "width").agg(F.count(F.lit(1)).alias("__n"))
    width = counts.groupBy("set_id").agg(F.min_by("width", F.struct(-F.col("__n"), F.col("width"))).alias("width"))
    placed = number_rows(numeric.join(width, ["set_id", "width"]), ["set_id"], ["line"], F.floor(F.col("line") / F.lit(BLOCK)))
    placed = placed.withColumns({"i": F.col("i") - skip, "n": F.col("n") - skip}).where("i >= 0")
    out = placed.select("set_id", "i", "n", *[F.try_element_at("values", F.lit(k + 1)).alias(c) for k, c in enumerate(NAMES)])
    return out.withColumn("x", F.col("x") * scale_x) if scale_x != 1.0 else out


def to_angstrom(df: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """x in reciprocal Angstrom. A unit named in the header decides; else a last x beyond 1 means reciprocal nanometres."""
    last = df.groupBy("set_id").agg(F.max("x").alias("__last"))
    joined = df.join(last, "set_id")
    nano = F.col("__last") > 1
    if header is not None:
        named = header.groupBy("set_id").agg(F.bool_or(F.lower("text").rlike(r"nm\^?-?1|1/nm|nm\(-1\)")).alias("__nm"), F.bool_or(F.lower("text").rlike(r"\ba\^?-1|1/a\b|angstrom")).alias("__a"))
        joined = joined.join(named, "set_id", "left")
        nano = F.when(F.col("__nm"), True).when(F.col("__a"), False).otherwise(nano)
    return joined.withColumn("x", F.when(nano, F.col("x") / 10).otherwise(F.col("x"))).drop("__last", "__nm", "__a")


def read_dat(spark: SparkSession, path: str | list[str], skip: int = 0, q_range: tuple[float, float] | None = None) -> DataFrame:
    rows = lines(spark, path)
    header = rows.where(~F.forall(tokens(F.col("text")), is_numeric))
    out = to_angstrom(curve(rows, skip), header)
    return out.where(F.col("x").between(*q_range)) if q_range else out


def read_xvg(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """# comments and @ headers are passed over; x is in nanometres."""
    return curve(lines(spark, path).where(~F.col("text").rlike("^[#@]")), scale_x=0.1)


def read_xvg_sets(spark: SparkSession, path: str | list[str], size: int = BLOCK) -> DataFrame:
    """The same, with a set for each part that a line & or @type begins: set_id is file:part."""
    rows = lines(spark, path)
    rows = carried(rows, ["set_id"], "line", {"__part": ("sum", F.col("text").rlike(r"^&|^@\s*type").cast("long"))}, size)
    parts = rows.withColumn("set_id", F.concat_ws(":", "set_id", "__part")).drop("__part")
    return curve(parts.where(~F.col("text").rlike("^[#@&]")), scale_x=0.1)


def read_folder(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """Every file of the suffix below a folder, each a set."""
    return curve(lines(spark, path, True, suffix))


def read_landscape(spark: SparkSession, path: str) -> DataFrame:
    """set_id, row, column, value of a text grid."""
    return numeric_rows(lines(spark, path)).select("set_id", F.col("line").alias("row"), F.posexplode("values").alias("column", "value"))
