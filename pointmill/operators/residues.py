"""Residue services: attached hydrogens from a component's bonds, their lookup for atoms, thinning of generated water."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bonds that an uncharged atom makes.
VALENCE = {"H": 1, "C": 4, "N": 3, "O": 2, "F": 1, "P": 5, "S": 2, "CL": 1, "SE": 2, "BR": 1, "I": 1}
#: Bond orders as component files name them. An aromatic bond counts one and a half.
ORDERS = {"SING": 1.0, "DOUB": 2.0, "TRIP": 3.0, "AROM": 1.5}


def hydrogens_from_bonds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """residue, atom, hydrogens: what each heavy atom's bonds to heavy atoms leave of its valence. atoms: residue, atom,
    element; bonds: residue, atom_a, atom_b, kind."""
    order = F.create_map(*[x for k, v in ORDERS.items() for x in (F.lit(k), F.lit(v))])
    valence = F.create_map(*[x for k, v in VALENCE.items() for x in (F.lit(k), F.lit(v))])
    heavy = atoms.where(F.upper("element") != "H").select("residue", "atom", F.upper("element").alias("element"))
    ends = bonds.select("residue", F.explode(F.array(F.struct(F.col("atom_a").alias("atom"), F.col("atom_b").alias("to")), F.struct(F.col("atom_b").alias("atom"), F.col("atom_a").alias("to")))).alias("e"), F.coalesce(order[F.upper("kind")], F.lit(1.0)).alias("order"))
    to_heavy = ends.select("residue", "e.*", "order").join(heavy.select("residue", F.col("atom").alias("to")), ["residue", "to"])
    used = to_heavy.groupBy("residue", "atom").agg(F.sum("order").alias("used"))
    left = F.coalesce(valence[F.col("element")], F.lit(0)) - F.ceil(F.coalesce("used", F.lit(0.0)))
    return heavy.join(used, ["residue", "atom"], "left").select("residue", "atom", F.greatest(left, F.lit(0)).cast("int").alias("hydrogens"))


def component_hydrogens(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """residue, atom, element, hydrogens of components whose files list hydrogens: a heavy atom's are the bonds to hydrogens that
    it has, and an ion's (an atom that is a component by itself) its charge. atoms: residue, atom, alternative, element, charge;
    bonds: residue, atom_a, atom_b, kind; both may hold any number of components.

    The atom N of a component with bonds has one less (but not below 0), as the chain goes on there. Atoms are found by their
    alternative names too; those without, whose names of three or more characters end in a single 1, also without it. A name
    that is another atom's own isn't given to a second. Components with bonds have the chain's ends OC1 (1) and OC2 (0). An
    order of no known kind is an error. Atoms without bonds have none; repeated bonds count each."""
    known = F.upper("kind").isin(*[k for k in ORDERS if k != "AROM"])
    checked = bonds.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown bond order: "), F.coalesce("kind", F.lit("")))).cast("boolean")))
    ends = checked.select("residue", F.explode(F.array(F.struct(F.col("atom_a").alias("atom"), F.col("atom_b").alias("to")), F.struct(F.col("atom_b").alias("atom"), F.col("atom_a").alias("to")))).alias("e")).select("residue", "e.*")
    hydrogens = atoms.where(F.upper("element") == "H").select("residue", F.col("atom").alias("to")).distinct()
    bound = ends.join(hydrogens, ["residue", "to"]).groupBy("residue", "atom").agg(F.count(F.lit(1)).alias("__n"))
    sizes = atoms.groupBy("residue").agg(F.count(F.lit(1)).alias("__size"))
    bonded = bonds.select("residue").distinct()
    heavy = atoms.where(F.upper("element") != "H").join(sizes, "residue").join(bonded.withColumn("__bonds", F.lit(True)), "residue", "left").join(bound, ["residue", "atom"], "left")
    of_bonds = F.coalesce("__n", F.lit(0)) - F.when((F.col("atom") == "N") & F.col("__bonds"), 1).otherwise(0)
    n = F.when(F.col("__size") == 1, F.coalesce(F.col("charge").cast("int"), F.lit(0))).otherwise(F.greatest(of_bonds, F.lit(0)).cast("int"))
    short = F.regexp_extract("atom", r"^(.+[^0-9])1$", 1)
    alias = F.when(F.coalesce("alternative", F.col("atom")) != F.col("atom"), F.col("alternative")).when(F.length(short) > 1, short).otherwise(F.col("atom"))
    named = F.explode(F.array(F.struct(F.col("atom").alias("atom"), F.lit(False).alias("other")), F.struct(alias.alias("atom"), (alias != F.col("atom")).alias("other")))).alias("a")
    rows = heavy.select("residue", F.upper("element").alias("element"), n.alias("hydrogens"), named).select("residue", "a.*", "element", "hydrogens")
    ends_of_chain = bonded.select("residue", F.explode(F.array(*[F.struct(F.lit(name).alias("atom"), F.lit(True).alias("other"), F.lit("O").alias("element"), F.lit(h).alias("hydrogens")) for name, h in (("OC1", 1), ("OC2", 0))])).alias("r")).select("residue", "r.*")
    one = rows.unionByName(ends_of_chain).groupBy("residue", "atom").agg(F.min(F.struct("other", "element", "hydrogens")).alias("r"))
    return one.select("residue", "atom", "r.element", "r.hydrogens")


def with_estimates(atoms: DataFrame, table: DataFrame) -> DataFrame:
    """atoms with hydrogens (double): by residue, name and element from table (residue, atom, element, hydrogens), and for names
    that a residue lacks, the mean of its atoms of that element; 0 for unknown residues or elements, and for hydrogens."""
    known = table.select(F.upper("residue").alias("__r"), F.upper("atom").alias("__a"), F.upper("element").alias("__e"), F.col("hydrogens").cast("double").alias("__h"))
    means = known.groupBy(F.col("__r").alias("__mr"), F.col("__e").alias("__me")).agg(F.avg("__h").alias("__m"))
    residue, name, element = F.upper("resName"), F.upper("name"), F.upper("element")
    joined = atoms.join(known, (residue == F.col("__r")) & (name == F.col("__a")) & (element == F.col("__e")), "left").join(means, (residue == F.col("__mr")) & (element == F.col("__me")), "left")
    n = F.when(element == "H", 0.0).otherwise(F.coalesce("__h", "__m", F.lit(0.0)))
    return joined.withColumn("hydrogens", n).drop("__r", "__a", "__e", "__h", "__mr", "__me", "__m")


def with_implicit_hydrogens(atoms: DataFrame, table: DataFrame) -> DataFrame:
    """atoms with hydrogens and with w raised by them: atom names meet without regard to case, unknown ones get none. A
    structure that has hydrogens of its own stays as it is. table is a dimension of residues and joined as such."""
    own = atoms.agg(F.coalesce(F.bool_or(F.upper("element") == "H"), F.lit(False)).alias("__own"))
    known = table.select(F.upper("residue").alias("__residue"), F.lower("atom").alias("__atom"), F.col("hydrogens").alias("__h"))
    joined = atoms.join(known, (F.upper("resName") == F.col("__residue")) & (F.lower("name") == F.col("__atom")), "left").join(F.broadcast(own))
    n = F.when(F.col("__own"), 0).otherwise(F.coalesce("__h", F.lit(0)))
    return joined.withColumns({"hydrogens": n, "w": F.col("w") + n}).drop("__residue", "__atom", "__h", "__own")


def unknown_atoms(atoms: DataFrame, table: DataFrame) -> DataFrame:
    """resName, name, n of heavy atoms that the table lacks."""
    known = table.select(F.upper("residue").alias("__residue"), F.lower("atom").alias("__atom"))
    missing = atoms.where(F.upper("element") != "H").join(known, (F.upper("resName") == F.col("__residue")) & (F.lower("name") == F.col("__atom")), "left_anti")
    return missing.groupBy("resName", "name").agg(F.count(F.lit(1)).alias("n"))


def thin_by_body(points: DataFrame, target: int, ratios: dict[int, float]) -> DataFrame:
    """About target points stay, those of a body by its ratio (1 if not named) to the others': a hash of the id decides."""
    ratio = F.coalesce(F.create_map(*[x for k, v in ratios.items() for x in (F.lit(k).cast("long"), F.lit(float(v)))])[F.col("body").cast("long")] if ratios else F.lit(1.0), F.lit(1.0))
    total = points.agg(F.sum(ratio).alias("__total"))
    share = F.least(F.lit(1.0), F.lit(float(target)) * ratio / F.greatest(F.col("__total"), F.lit(1e-9)))
    return points.join(F.broadcast(total)).where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).drop("__total")
