"""Order within series at scale: row numbers and neighbours without a task that holds a whole series.

A window over a long series would run in one task. Here a series is cut into chunks that follow its order; rows are
numbered within a chunk and shifted by the counts of the chunks before. Once rows are numbered, operators that look at
neighbours run over blocks of rows that overlap by as many rows as they look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pointmill.stored import stored

#: Rows of a block.
BLOCK = 100_000


def number_rows(df: DataFrame, series: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Adds i (from 0, along order) and n (rows of the series). chunk never falls as order rises, such as the day of a time.

    A chunk should hold few rows compared with its series; rows of one chunk are sorted in one task."""
    rows = df.withColumn("__chunk", chunk)
    counts = rows.groupBy(*series, "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(*series)
    before = counts.withColumns(
        {"__before": F.sum("__rows").over(whole.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("__rows").over(whole)}
    ).drop("__rows")
    own = F.row_number().over(Window.partitionBy(*series, "__chunk").orderBy(*order)) - 1
    joined = rows.withColumn("__own", own).join(before, [*series, "__chunk"])
    return joined.withColumn("i", (F.coalesce("__before", F.lit(0)) + F.col("__own")).cast("long")).drop("__chunk", "__own", "__before")


def carried(df: DataFrame, series: list[str], order: str, states: dict[str, tuple[str, Column]], size: int = BLOCK) -> DataFrame:
    """Adds columns with what the rows of a series up to each one leave behind: name -> (kind, column), where kind is sum, max,
    last (both over the rows at which the column isn't null) or before (the column at the row just before, whatever it is).

    order is a number, such as a line's, that no two rows of a series share. Rows are cut into chunks of its values; each gives
    one row of what it leaves behind, these rows are run through first, and every chunk starts from the one before it. So a
    series of any length is many tasks."""
    rows = df.withColumn("__chunk", F.floor(F.col(order) / F.lit(size)))
    value = {name: f"__value_{i}" for i, name in enumerate(states)}
    rows = rows.withColumns({value[name]: c for name, (_, c) in states.items()})

    def left(kind: str, c: str) -> Column:
        return {"sum": F.sum(c), "max": F.max(c), "last": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))), "before": F.max_by(c, order)}[kind]

    def through(kind: str, c: str, w: WindowSpec) -> Column:
        return {"sum": F.sum(c), "max": F.max(c), "last": F.last(c, ignorenulls=True), "before": F.last(c)}[kind].over(w)

    chunks = rows.groupBy(*series, "__chunk").agg(*[left(kind, value[name]).alias(f"__left_{name}") for name, (kind, _) in states.items()])
    passed = Window.partitionBy(*series).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    start = chunks.select(*series, "__chunk", *[through(kind, f"__left_{name}", passed).alias(f"__start_{name}") for name, (kind, _) in states.items()])
    inside = Window.partitionBy(*series, "__chunk").orderBy(order)
    to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumns({f"__own_{name}": F.lag(value[name]).over(inside) if kind == "before" else through(kind, value[name], to_here) for name, (kind, _) in states.items()})
    joined = joined.withColumn("__first", F.row_number().over(inside) == 1).join(start, [*series, "__chunk"])

    def together(name: str, kind: str) -> Column:
        own, before = F.col(f"__own_{name}"), F.col(f"__start_{name}")
        if kind == "before":
            return F.when(F.col("__first"), before).otherwise(own)
        if kind == "max":
            return F.greatest(own, before)
        return F.coalesce(own, before) if kind == "last" else F.when(own.isNull() | before.isNull(), F.coalesce(own, before)).otherwise(own + before)

    out = joined.withColumns({name: together(name, kind) for name, (kind, _) in states.items()})
    return out.select(*[c for c in df.columns if c not in states], *states)


def blocked(df: DataFrame, halo: int, size: int = BLOCK) -> DataFrame:
    """Each row with its block, and again with any block within halo rows of it: adds block and core (False for the copies)."""
    size = max(size, halo)
    spread = F.array_distinct(F.transform(F.array(F.col("i") - halo, F.col("i"), F.col("i") + halo), lambda j: F.floor(j / F.lit(size))))
    known = F.filter(spread, lambda b: (b >= 0) & (b <= F.floor((F.col("n") - 1) / F.lit(size))))
    return df.withColumn("block", F.explode(known)).withColumn("core", F.col("block") == F.floor(F.col("i") / F.lit(size)))


def neighbours(df: DataFrame, series: list[str], columns: dict[str, tuple[str, int]], size: int = BLOCK) -> DataFrame:
    """Adds columns from rows nearby: name -> (column, rows ahead; negative: behind). Null beyond the series' ends."""
    halo = max(abs(k) for _, k in columns.values())
    w = Window.partitionBy(*series, "block").orderBy("i")
    out = blocked(df, halo, size)
    out = out.withColumns({name: F.lead(c, k).over(w) if k >= 0 else F.lag(c, -k).over(w) for name, (c, k) in columns.items()})
    return out.where("core").drop("block", "core")


def first_rows(df: DataFrame, order: list[Column], n: int, size: int = BLOCK) -> DataFrame:
    """The first n rows along order, for any n: rows are dealt into ranges, and only the range in which the n-th falls is
    numbered. Rows that are equal in order are taken in any order."""
    ranges = max(1, -(-df.count() // size))
    placed = stored(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = counts.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"), "__rows")  # a row for each range
    joined = placed.join(before.where(F.col("__before") < n), "__range")
    whole = joined.where(F.col("__before") + F.col("__rows") <= n)
    cut = joined.where(F.col("__before") + F.col("__rows") > n).withColumn("__i", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return whole.unionByName(cut.where(F.col("__before") + F.col("__i") <= n).drop("__i")).drop("__range", "__before", "__rows")
