"""Filter interaction audit: what each of five filters removes in every order of applying them, by a Gray-code subset walk.

Every document fails some of the filters; the set of those is its mask. Documents are counted by part (language) and mask, at
most 32 cells a part. The walk goes through all 32 sets of filters in Gray-code order, so that each step toggles one filter;
each cell carries the number of active filters that it fails, and when that number leaves or reaches 0 the cell's documents
leave or join the running survivors, which are stored for each set. Any step of any order is then a difference of two stored
states.

Filters: A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * capitals (A-Z) > 3 * code points; D: any of #$%&*|;
E: the same text stands under a smaller doc_id anywhere in the table.

Null texts are empty texts; they fail A alone, or E too. Very long texts are read whole. Texts are equal if two 64-bit hashes
of them are. A null doc_id is no smaller than any and none is smaller than it; repeated rows with one doc_id are not each
other's copies, and count each. A null language is the part ''. Of several labels of one doc_id, any 1 counts; documents
without labels, or with a null doc_id, lose nothing good or toxic. Other columns are never read, whatever their names. An
empty table has no parts and gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import arrow_map, cut, salted_join
from pointmill.llm.words import texts

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 200, 50, 3, "#$%&*|"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_COUNTS = ["n", "good", "toxic"]


def _own_masks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Bits 0 to 3 of each document: the filters that its text alone decides."""
    masks = []
    for block in texts(batch.column("text"), lower=False):
        hashes, at = block.words()
        words = np.diff(at)
        owner = np.repeat(np.arange(len(block)), words)
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[new], minlength=len(block))

        def count(hit: np.ndarray, offsets: np.ndarray = block.offsets) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(hit)])
            return total[offsets[1:]] - total[offsets[:-1]]

        data = block.data
        capitals, points, symbols = count((data >= 65) & (data <= 90)), count((data & 0xC0) != 0x80), count(_SYMBOL[data])
        fails = [words < LEAST_WORDS, 100 * distinct < DISTINCT_SHARE * words, 100 * capitals > CAPITAL_SHARE * points, symbols > 0]
        masks.append(sum(f.astype(np.int32) << k for k, f in enumerate(fails)))
    mask = np.concatenate(masks) if masks else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "h1", "h2")] + [pa.array(mask, pa.int32())], names=["doc_id", "part", "h1", "h2", "mask"])


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and the filters they fail.

    Rows are narrow after the texts were read. Copies of one text are counted by what they share before they meet, so that
    any number of them is a few rows by then."""
    text = F.coalesce("text", F.lit(""))
    slim = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    masked = arrow_map(slim, _own_masks, f"doc_id {kind}, part string, h1 long, h2 long, mask int")
    rows = cut(masked.groupBy("doc_id", "part", "h1", "h2", "mask").agg(F.count(F.lit(1)).alias("n")))  # repeated rows as one
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    with_id = salted_join(rows.where("doc_id IS NOT NULL"), known, ["doc_id"], F.col("h1"), "left")
    rows = with_id.unionByName(rows.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    alike = ["h1", "h2", "part", "mask", "good", "toxic"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    by_id = rows.groupBy(*alike, "doc_id").agg(F.sum("n").alias("n"))
    # the rows of least id of each kind, and all; null ids are first of their texts wherever they stand
    groups = by_id.groupBy(*alike).agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.sum("n").alias("n"))
    least = F.min("least").over(Window.partitionBy("h1", "h2"))  # a row for each part and label of a text
    first = F.col("n_null") + F.when(F.col("least") == least, F.coalesce("n_least", F.lit(0))).otherwise(0)
    parted = groups.select("part", "mask", "good", "toxic", "n", first.alias("first"))
    later = 1 << FILTERS.index("E")
    each = parted.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + later).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("c"))
    n = F.col("c.n")
    return each.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def walk(masks: np.ndarray, counts: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """Survivors [set of filters, count] after each set, by toggling one filter at a time."""
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)  # active filters that each cell fails
    alive = counts.sum(axis=0)
    states[0] = alive
    active = 0
    for step in range(1, 1 << filters):
        f = (step & -step).bit_length() - 1  # the filter that the Gray code toggles
        active ^= 1 << f
        hit = (masks >> f & 1).astype(bool)
        before = failing.copy()
        failing[hit] += 1 if active >> f & 1 else -1
        alive = alive - counts[(before == 0) & (failing > 0)].sum(axis=0) + counts[(before > 0) & (failing == 0)].sum(axis=0)
        states[active] = alive
    return states


def _report(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of one part from its cells (32 at most)."""
    masks, counts = part["mask"].to_numpy(np.int64), part[_COUNTS].to_numpy(np.int64)
    states = walk(masks, counts)
    fails = [int(counts[(masks >> f & 1).astype(bool), 0].sum()) for f in range(len(FILTERS))]
    only = [int(counts[masks == 1 << f, 0].sum()) for f in range(len(FILTERS))]
    rows, removed_by = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        active = 0
        for step, letter in enumerate(order, 1):
            f = FILTERS.index(letter)
            lost = states[active] - states[active | 1 << f]
            active |= 1 << f
            removed_by[letter] += int(lost[0])
            rows.append(("".join(order), step, letter, int(states[active][0]), int(lost[0]), fails[f] - int(lost[0]), only[f], int(lost[1]), int(lost[2])))
    out = pd.DataFrame(rows, columns=["filter_order", "step", "letter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    out["shapley"] = out["letter"].map(removed_by)
    out.insert(0, "part", part["part"].iloc[0])
    return out.drop(columns="letter")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    redundant: documents that fail the step's filter and were removed before; unique_fails: that fail no other; shapley: what
    the filter removes, summed over all orders."""
    longs = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs)
    return cells(documents, labels).groupBy("part").applyInPandas(_report, schema)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(ws) < {LEAST_WORDS})::INT AS fa, (100 * len(list_distinct(ws)) < {DISTINCT_SHARE} * len(ws))::INT AS fb,
        (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_SHARE} * length(t))::INT AS fc,
        regexp_matches(t, '[{SYMBOLS}]')::INT AS fd, coalesce(w.doc_id > least, false)::INT AS fe
      FROM w JOIN least USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order FROM f a, f b, f x, f y, f z
      WHERE a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, step, bit, coalesce((SELECT bit_or(g.bit) FROM f g WHERE strpos(filter_order, g.letter) < step), 0) AS before
      FROM o, generate_series(1, 5) AS k(step), f WHERE f.letter = substr(filter_order, step::INT, 1)),
r AS (SELECT part, filter_order, step::INT AS step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
