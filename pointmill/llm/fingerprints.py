"""SimHash fingerprints and their permuted block tables, in DataFrame functions only.

A text's terms are its runs of five words (a shorter text is one term); a term weighs as many as its words have characters, 63
at most. Each of the 128 bits of a term's hash votes with that weight, for the bit if it is set and against it if not; the
fingerprint has the bits with a majority. Four votes of 16 bits are counted in one long integer, over stretches of 512 terms,
so that a term costs 32 additions; stretches are unpacked and summed by bit.

All fingerprints within a Hamming radius are found by block tables: the 128 bits are cut into blocks, more than the radius;
two fingerprints within it agree in all but radius of the blocks, so that there is a table for every choice of the others, each
keyed by the chosen blocks. There are as many blocks as keep keys longer than the logarithm of the number of fingerprints.
Buckets are compared in blocks of about 1,000 by 1,000 fingerprints, so that no bucket, however large, is one task; a pair is
counted in the first table where it meets.

Null and empty texts have no votes, and the fingerprint 0. Very long texts are read whole. Documents with one doc_id follow
one another by a hash of their text, null ids come first; rows equal in both are one document here, with one next document,
and each gets a row. The only document is its own next. Other columns are never read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import cut, salted_join

SHINGLE, HEAVIEST, STRETCH, BITS = 5, 63, 512, 128
#: Fingerprints that differ in so many bits at most are near.
RADIUS = 3
#: Documents whose order is found together, and fingerprints of a bucket that are compared together, about.
ROWS_A_PART, ROWS_A_BLOCK = 50_000, 1000
_LANES = 0x0001000100010001
_KEYS = ["table", "key_lo", "key_hi"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")


def votes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, lo and hi (the halves of the fingerprint) of each row of texts; keys are the row's own, without nulls.

    If texts is dealt by some of the keys, nothing is shuffled here."""
    terms = texts.select(*keys, _words(F.col(text)).alias("__words"))
    terms = terms.select(*keys, "__words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("__words") - SHINGLE, F.lit(0)))).alias("__i"))
    own = [F.get("__words", F.col("__i") + k) for k in range(SHINGLE)]
    weight = F.least(F.lit(HEAVIEST), reduce(lambda a, b: a + b, [F.coalesce(F.length(w), F.lit(0)) for w in own])).cast("long")
    each = terms.select(*keys, F.shiftright("__i", STRETCH.bit_length() - 1).alias("__stretch"), F.xxhash64(*own).alias("__lo"), weight.alias("__w"))
    each = each.withColumn("__hi", F.xxhash64("__lo"))
    lanes = [F.sum(F.shiftrightunsigned(half, j).bitwiseAND(F.lit(_LANES)) * F.col("__w")).alias(f"{half}{j}") for half in ("__lo", "__hi") for j in range(16)]
    stretches = each.groupBy(*keys, "__stretch").agg(F.sum("__w").alias("__w"), *lanes)
    by_bit = [F.sum(F.shiftrightunsigned(f"{half}{b % 16}", b // 16 * 16).bitwiseAND(F.lit(0xFFFF))).alias(f"{half}_{b}") for half in ("__lo", "__hi") for b in range(64)]
    summed = stretches.groupBy(*keys).agg(F.sum("__w").alias("__w"), *by_bit)

    def half(name: str) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(2 * F.col(f"{name}_{b}") > F.col("__w"), F.lit(_signed(1 << b))).otherwise(F.lit(0)) for b in range(64)]).cast("long")

    return summed.select(*keys, half("__lo").alias("lo"), half("__hi").alias("hi"))


def hamming(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.bit_count(a_lo.bitwiseXOR(b_lo)) + F.bit_count(a_hi.bitwiseXOR(b_hi))


def likeness(*halves: Column) -> Column:
    """Share of equal bits of two fingerprints; half of them are for texts that share nothing."""
    return F.lit(1.0) - hamming(*halves) / F.lit(float(BITS))


def block_masks(count: int, radius: int) -> list[tuple[int, int]]:
    """Masks (low and high half) of the tables' keys for so many fingerprints."""
    blocks = radius + 1
    while (blocks - radius) * (BITS // blocks) < count.bit_length() + 4 and blocks < radius + 4:
        blocks += 1
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    whole = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    picked = [sum(c) for c in combinations(whole, blocks - radius)]
    return [(_signed(m & (1 << 64) - 1), _signed(m >> 64)) for m in picked]


def near_counts(asked: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """lo, hi, n_near of each fingerprint asked: how many documents have one within radius of it.

    asked: lo, hi; prints: lo, hi, n (its documents). No fingerprint stands twice in either."""
    masks = block_masks(prints.count(), radius)

    def tables(df: DataFrame) -> DataFrame:
        keyed = [F.struct(F.lit(t).alias("table"), F.col("lo").bitwiseAND(F.lit(lo)).alias("key_lo"), F.col("hi").bitwiseAND(F.lit(hi)).alias("key_hi")) for t, (lo, hi) in enumerate(masks)]
        return df.select("*", F.inline(F.array(*keyed)))

    index, queries = tables(prints), tables(asked)
    one = F.count(F.lit(1))

    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / F.lit(float(ROWS_A_BLOCK))).cast("int")

    buckets = cut(queries.groupBy(*_KEYS).agg(one.alias("q")).join(index.groupBy(*_KEYS).agg(one.alias("i")), _KEYS).select(*_KEYS, parts("q").alias("q_parts"), parts("i").alias("i_parts")))
    spread = F.xxhash64("lo", "hi")
    found = salted_join(index, buckets, _KEYS, spread).withColumn("i_part", F.pmod(spread, F.col("i_parts")).cast("int"))
    found = found.groupBy(*_KEYS, "i_part").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("found"))
    wanted = salted_join(queries, buckets, _KEYS, spread).withColumn("q_part", F.pmod(spread, F.col("q_parts")).cast("int"))
    wanted = wanted.groupBy(*_KEYS, "q_part", "i_parts").agg(F.collect_list(F.struct("lo", "hi")).alias("wanted"))
    wanted = wanted.select(*_KEYS, "wanted", F.explode(F.sequence(F.lit(0), F.col("i_parts") - 1)).alias("i_part"))

    def first_here(q: Column, x: Column) -> Column:
        """No table before this one has both in one bucket."""
        apart = F.lit(True)
        for t, (lo, hi) in enumerate(masks[:-1]):
            differ = (q["lo"].bitwiseXOR(x["lo"]).bitwiseAND(F.lit(lo)) != 0) | (q["hi"].bitwiseXOR(x["hi"]).bitwiseAND(F.lit(hi)) != 0)
            apart = apart & ((F.col("table") <= t) | differ)
        return apart

    def matched(q: Column) -> Column:
        near = F.filter("found", lambda x: (hamming(q["lo"], q["hi"], x["lo"], x["hi"]) <= radius) & first_here(q, x))
        return F.struct(q["lo"].alias("lo"), q["hi"].alias("hi"), F.aggregate(near, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_near"))

    pairs = wanted.join(found, [*_KEYS, "i_part"]).select(F.inline(F.transform("wanted", matched)))
    return pairs.groupBy("lo", "hi").agg(F.sum("n_near").alias("n_near"))


def _in_order(keys: DataFrame) -> DataFrame:
    """keys with next_k, next_h (of the next document by doc_id; the first after the last), without ordering all in one task."""
    order = [F.asc_nulls_first("doc_id"), F.asc("h")]
    ranges = max(1, -(-keys.count() // ROWS_A_PART))
    placed = cut(keys.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    here = F.struct("doc_id", "h", "k")
    heads = placed.groupBy("part").agg(F.min(here).alias("head"))  # a row for ROWS_A_PART documents
    along = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(along), F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    follows = F.lead(here).over(Window.partitionBy("part").orderBy(*order))
    both = placed.withColumn("follows", follows).join(heads, "part").withColumn("follows", F.coalesce("follows", "head"))
    return cut(both.select("doc_id", "k", "h", "n_chars", "n", F.col("follows.k").alias("next_k"), F.col("follows.h").alias("next_h")))


def fingerprints(documents: DataFrame, text: str = "text", radius: int = RADIUS, every: int = 50) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of each document.

    The edited text has the last floor(n_chars / 4) code points replaced by as many (or all) of the next document's first.
    n_near: of documents whose id is divisible by every, how many others have a fingerprint within radius; else null."""
    slim = documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.select("doc_id", F.xxhash64("doc_id").alias("k"), F.xxhash64("text").alias("h"), "text")
    keys = cut(slim.select("doc_id", "k", "h", F.length("text").alias("n_chars")).groupBy("doc_id", "k", "h", "n_chars").agg(F.count(F.lit(1)).alias("n")))
    order = _in_order(keys)

    # texts are dealt once by document, for both joins
    texts = slim.groupBy("k", "h").agg(F.first("text").alias("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    after = order.select(F.col("k").alias("own_k"), F.col("h").alias("own_h"), F.col("next_k").alias("k"), F.col("next_h").alias("h"), quarter.alias("quarter"))
    fronts = texts.join(after, ["k", "h"]).select(F.col("own_k").alias("k"), F.col("own_h").alias("h"), F.substring("text", F.lit(1), F.col("quarter")).alias("front"))
    n_chars = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - F.floor(n_chars / 4).cast("int")), F.col("front"))
    both = texts.join(fronts, ["k", "h"]).select("k", "h", "text", edited.alias("edited"))
    both = both.select("k", "h", F.sha2("edited", 256).alias("sha"), F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))))
    halves = votes(both, ["k", "h", "sha", "which"], "t")
    of = {w: [F.max(F.when(F.col("which") == k, F.col(c))).alias(f"{w}{c}") for c in ("lo", "hi")] for k, w in ((0, ""), (1, "edited_"))}
    prints = cut(halves.groupBy("k", "h", "sha").agg(*of[""], *of["edited_"]))

    following = prints.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("lo").alias("next_lo"), F.col("hi").alias("next_hi"))
    rows = cut(order.join(prints, ["k", "h"]).join(following, ["next_k", "next_h"]))
    asked = F.expr("try_cast(doc_id AS BIGINT)") % every == 0
    distinct = rows.groupBy("lo", "hi").agg(F.sum("n").alias("n"))
    near = near_counts(rows.where(asked).select("lo", "hi").distinct(), distinct, radius)
    queries = rows.where(asked).select("k", "h", "lo", "hi").join(near, ["lo", "hi"]).select("k", "h", (F.col("n_near") - 1).alias("n_near"))
    rows = rows.join(queries, ["k", "h"], "left")

    def written(lo: str, hi: str) -> Column:
        return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))

    c = F.col
    out = rows.select(
        "doc_id",
        c("n_chars").cast("long").alias("n_chars"),
        c("sha").alias("edited_sha256"),
        written("lo", "hi").alias("fingerprint"),
        written("edited_lo", "edited_hi").alias("edited_fingerprint"),
        likeness(c("lo"), c("hi"), c("edited_lo"), c("edited_hi")).alias("near_edited"),
        likeness(c("lo"), c("hi"), c("next_lo"), c("next_hi")).alias("near_next"),
        "n_near",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("n") - 1) / F.lit(1e6)).cast("long"))).alias("__t"),
        "n",
    )
    copies = F.least(c("n") - c("__t") * 1_000_000, F.lit(1_000_000)).cast("int")
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1), copies))).drop("__t", "__i", "n")
