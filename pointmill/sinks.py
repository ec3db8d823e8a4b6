"""Writers: Parquet and CSV by Spark's own means, and the fixed text forms of curves and structures as parallel text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.ordered import number_rows


def curve_lines(df: DataFrame) -> DataFrame:
    """set_id, i, value: columns of scientific numbers, 16 wide, 8 digits, parted by tabs."""
    columns = [c for c in ("x", "y", "yerr", "xerr") if c in df.columns]
    return df.select("set_id", "i", F.concat_ws("\t", *[F.lpad(F.format_string("%.8e", F.col(c).cast("double")), 16, " ") for c in columns]).alias("value"))


def write_curves(df: DataFrame, path: str) -> None:
    """A folder for each set, its lines in order over one or more files that sort by name."""
    rows = curve_lines(df).repartitionByRange("set_id", "i").sortWithinPartitions("set_id", "i")
    rows.select("set_id", "value").write.partitionBy("set_id").text(path)


def write_named(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def pdb_line() -> Column:
    """An atom record from serial, name, resName, chainID, resSeq, x, y, z, occupancy, tempFactor, element."""
    return F.format_string(
        "%-6s%5d %-4s%1s%-3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s%2s", "record", (F.col("serial") % 100_000).cast("int"), F.when(F.length("name") < 4, F.concat(F.lit(" "), "name")).otherwise(F.col("name")), F.lit(" "), "resName", "chainID", "resSeq", F.lit(" "), "x", "y", "z", "occupancy", "tempFactor", "element", F.lit("  ")
    )


def write_pdb(atoms: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    """Records renumbered along (set_id, line): a part for each rows_a_file of them, as the format's serials have five digits."""
    rows = number_rows(atoms, ["set_id"], ["line"], F.floor(F.col("line") / rows_a_file)).withColumn("serial", (F.col("i") + 1).cast("int"))
    parts = rows.withColumn("part", F.floor(F.col("i") / rows_a_file).cast("int"))
    parts.repartitionByRange("set_id", "i").sortWithinPartitions("set_id", "i").select("part", pdb_line().alias("value")).write.partitionBy("part").text(path)


def append_frame(points: DataFrame, frame: int, path: str) -> None:
    """A frame of a trajectory: rows keyed by frame, appended to a table."""
    points.withColumn("frame", F.lit(frame)).write.mode("append").partitionBy("frame").parquet(path)


def report(fits: DataFrame) -> DataFrame:
    """A line of fixed width for each parameter of each fit (few rows): name, value, error."""
    return fits.select(F.format_string("| %-10s | %12.6g | %12.6g |", "name", "value", "error").alias("value"))


def write_settings(table: DataFrame, path: str) -> None:
    """Sections and 'key value' lines, from section, key, value (few rows)."""
    heads = table.select("section").distinct().select(F.col("section").alias("s"), F.lit(0).alias("o"), F.lit("").alias("k"), F.concat(F.lit("[ "), "section", F.lit(" ]")).alias("value"))
    body = table.select(F.col("section").alias("s"), F.lit(1).alias("o"), F.col("key").alias("k"), F.concat_ws(" ", "key", "value").alias("value"))
    heads.unionByName(body).orderBy("s", "o", "k").select("value").coalesce(1).write.text(path)


def landscape_lines(scan: DataFrame) -> DataFrame:
    """p1, value: the line of a text grid for each p1 of a landscape (p1, p2, chi2), its values in order of p2. A line is as
    long as the grid is wide."""
    cells = F.array_sort(F.collect_list(F.struct("p2", "chi2")))
    return scan.groupBy("p1").agg(cells.alias("c")).select("p1", F.concat_ws("\t", F.format_string("%.8e", F.col("p1").cast("double")), F.transform("c", lambda c: F.format_string("%.8e", c["chi2"].cast("double")))).alias("value"))


def write_landscape(scan: DataFrame, path: str) -> None:
    rows = landscape_lines(scan)
    rows.repartitionByRange("p1").sortWithinPartitions("p1").select("value").write.text(path)


def voxel_atoms(marked: DataFrame, low: tuple[float, float, float], cell: float = 1.0, set_id: str = "grid") -> DataFrame:
    """Voxels (i, j, k, surface) as records for write_pdb: carbon in chain A for the interior, oxygen in chain B for the surface."""
    xyz = [(F.lit(float(lo)) + F.col(n) * cell).alias(c) for lo, n, c in zip(low, "ijk", "xyz", strict=True)]
    element = F.when(F.col("surface"), "O").otherwise("C")
    rows = marked.select(F.lit(set_id).alias("set_id"), "i", "j", "k", *xyz, F.lit("ATOM").alias("record"), element.alias("name"), F.lit("GRD").alias("resName"), F.when(F.col("surface"), "B").otherwise("A").alias("chainID"), F.lit(1).alias("resSeq"), F.lit(1.0).alias("occupancy"), F.lit(0.0).alias("tempFactor"), element.alias("element"))
    placed = number_rows(rows.withColumnRenamed("i", "vi"), ["set_id"], ["vi", "j", "k"], F.col("vi"))
    return placed.withColumn("line", F.col("i")).drop("i", "n", "vi", "j", "k")
