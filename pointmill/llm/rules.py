"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose metric lies above a cutoff. Cutoffs come from a fixed grid. On the labelled texts of a
stratum (its language), a cutoff is certified if the exact binomial test finds its false rejections (good texts above it)
significantly fewer than the rule's share of the permitted rate: P(Binomial(n, share) <= k) <= level of the test. Two
corrections keep the chance of any wrong certificate, over all rules, cutoffs and strata, at most LEVEL:

- a rule's cutoffs in a stratum are one family, tested from the laxest on until the first that fails. This fixed sequence
  needs no charge for the grid. A stricter cutoff never rejects fewer good texts, so p grows along the sequence and the
  cutoffs that pass are those with p within the family's level;
- families share LEVEL by Holm's method: each of F families gets LEVEL / F; one whose whole grid passes gives its part to
  the others.

So with probability 1 - LEVEL, no certified cutoff of any stratum rejects good documents more often than its share (1 % of
them), and all six rules together not more often than RATE (6 %). With no false rejection and four strata, 614 good labelled
texts certify a cutoff. Of the certified cutoffs of a rule, the one whose labelled rejections are best (bad ones less ten
times good ones; ties: the laxest) is used, or none if none gains. Equal texts of a stratum are one trial, good if any of
their labels is: copies are no independent evidence.

Null and empty texts have no words: all counts are 0 and they fail the base rule, as do all documents of fewer than 50
words. A null stratum is a stratum of its own. Very long texts are counted whole. Repeated rows are judged alike; a document
with several labels counts as above. Without labels nothing is certified and only the base rule rejects. Other columns are
never read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import cut

LEAST_WORDS = 50
#: The most that a rule may cut from the good documents of a stratum, all rules together, and the level of the tests.
RATE, LEVEL = 0.06, 0.05
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\x0c\r"
#: Numerator and denominator of each rule's metric, and the grid of its cutoffs.
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "n_words", [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0]),
    "word_length": ("word_chars", "n_words", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    "repeated_lines": ("n_dup_lines", "n_lines", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]),
    "repeated_words": ("n_repeat_words", "n_words", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.45]),
    "capitals": ("n_capitals", "word_chars", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "exclamations": ("n_exclamations", "n_words", [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0]),
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once for each row, however often then uses it."""
    return F.transform(F.array(value), then)[0]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the same text."""

    def windows(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        triples = F.zip_with(pairs, F.slice(h, 3, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        return F.slice(triples, 1, F.greatest(F.size(h) - 2, F.lit(0)))

    def adjacent(s: Column) -> Column:
        return F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            both = F.zip_with(s, adjacent(s), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
            return F.flatten(both)

        return let(placed, lambda s: F.size(F.array_distinct(F.flatten(F.transform(places(s), lambda p: F.array(p, p + 1, p + 2))))))

    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(
            F.size(h) > 3,
            let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0))),
        ).otherwise(F.lit(0)),
    ).cast("long")


def measures(documents: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, stratum, text_key (of the whole text) and the counts of each document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.col("__text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: _without(x, _SPACE) != "")
    dense = F.col("__dense")
    return (
        documents.select("doc_id", F.col(stratum).alias("stratum"), whole.alias("__text"))
        .withColumn("__dense", _without(F.col("__text"), _SPACE))
        .select(
            "doc_id",
            "stratum",
            F.xxhash64("__text").alias("text_key"),
            let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("__w"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("__l"),
            F.length(dense).cast("long").alias("word_chars"),
            (F.length(dense) - F.length(_without(dense, "#*$%&|<>"))).cast("long").alias("n_symbols"),
            (F.length(dense) - F.length(_without(dense, _UPPER))).cast("long").alias("n_capitals"),
            (F.length(dense) - F.length(_without(dense, "!"))).cast("long").alias("n_exclamations"),
        )
        .select(
            "doc_id",
            "stratum",
            "text_key",
            F.col("__w.n").alias("n_words"),
            "word_chars",
            "n_symbols",
            F.col("__l.d").alias("n_dup_lines"),
            F.col("__w.r").alias("n_repeat_words"),
            F.col("__l.n").alias("n_lines"),
            "n_capitals",
            "n_exclamations",
        )
    )


def metric(rule: str) -> Column:
    over, under, _ = RULES[rule]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k); 1 where k is not below the mean, as no test there can be significant."""
    term = F.struct((n * F.log(F.lit(1 - rate))).alias("log"), F.exp(n * F.log(F.lit(1 - rate))).alias("sum"))
    odds = F.log(F.lit(rate / (1 - rate)))

    def add(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * rate, F.aggregate(steps, term, add, lambda s: s["sum"])).otherwise(F.lit(1.0))


def tested(measured: DataFrame, labels: DataFrame, rate: float = RATE, level: float = LEVEL) -> DataFrame:
    """stratum, rule, cutoff, n_good, good_rejected, bad_rejected, p and certified of each cutoff of each stratum."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = sorted({c for over, under, _ in RULES.values() for c in (over, under)})
    held = measured.where(F.col("n_words") >= LEAST_WORDS).join(known, "doc_id").groupBy("stratum", "text_key", *counts).agg(F.max("quality").alias("quality"))
    good = F.col("quality") == 1
    sums = [F.count_if(good).alias("n_good")]
    for rule, (_, _, grid) in RULES.items():
        sums.append(
            F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.count_if(good & (metric(rule) > c)).alias("good_rejected"), F.count_if(~good & (metric(rule) > c)).alias("bad_rejected")) for c in grid]).alias(rule)
        )
    by = held.groupBy("stratum").agg(*sums)
    each = by.select("stratum", "n_good", F.explode(F.concat(*RULES)).alias("c")).select("stratum", "n_good", "c.*").withColumn("p", binomial_tail(F.col("n_good"), F.col("good_rejected"), rate / len(RULES)))
    # Holm: of the families in the order of their worst p, the first few whose whole grid passes; a row for each rule of a stratum
    everything = Window.partitionBy()
    families = each.groupBy("stratum", "rule").agg(F.max("p").alias("worst")).withColumns({"n": F.count(F.lit(1)).over(everything), "i": F.row_number().over(Window.orderBy("worst", "stratum", "rule"))})
    failed = families.withColumn("fails", F.min(F.when(F.col("worst") > level / (F.col("n") - F.col("i") + 1), F.col("i"))).over(everything))
    left = failed.agg(F.max(F.when(F.col("fails").isNull(), F.lit(1)).otherwise(F.col("n") - F.col("fails") + 1)).alias("left"))
    return each.crossJoin(F.broadcast(left)).withColumn("certified", F.col("p") <= level / F.col("left")).drop("left")  # one row


def cutoffs(measured: DataFrame, labels: DataFrame, rate: float = RATE, level: float = LEVEL) -> DataFrame:
    """stratum, rule, cutoff, n_good, good_rejected, bad_rejected, p: the cutoff in use for each rule of a stratum."""
    gain = F.col("bad_rejected") - 10 * F.col("good_rejected")
    certified = tested(measured, labels, rate, level).where(F.col("certified") & (gain > 0)).withColumn("gain", gain)
    best = certified.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n_good", "good_rejected", "bad_rejected", "p"), F.struct("gain", "cutoff")).alias("b"))
    return best.select("stratum", "rule", "b.*")


def judge(documents: DataFrame, labels: DataFrame, stratum: str = "lang", rate: float = RATE, level: float = LEVEL) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each document."""
    measured = cut(measures(documents, stratum))
    chosen = cutoffs(measured, labels, rate, level)
    by = chosen.groupBy(F.col("stratum").alias("__stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut"))  # a row for each stratum, an entry for each rule
    joined = measured.join(by, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(metric(rule) > F.col("__cut")[rule], F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def _sql() -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    metrics = {rule: f"CASE WHEN {under} > 0 THEN {over}::DOUBLE / {under} ELSE 0.0 END" for rule, (over, under, _) in RULES.items()}
    grid = ", ".join(f"('{rule}', {c}::DOUBLE)" for rule, (_, _, cs) in RULES.items() for c in cs)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {m}" for r, m in metrics.items()) + " END"
    share = RATE / len(RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {space}, '') <> '') AS ls FROM d),
win AS (SELECT rid, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM dup, range(0, 3) AS r(o) GROUP BY rid),
m AS (SELECT d.rid, doc_id, stratum, len(ws)::BIGINT AS n_words, length(translate(t, {space}, '')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        length(t) - length(translate(t, '{_UPPER}', '')) AS n_capitals, length(t) - length(translate(t, '!', '')) AS n_exclamations
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
g(rule, cutoff) AS (VALUES {grid}),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
once AS (SELECT stratum, t, max(quality) AS quality, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_dup_lines) AS n_dup_lines,
        any_value(n_repeat_words) AS n_repeat_words, any_value(n_lines) AS n_lines, any_value(n_capitals) AS n_capitals, any_value(n_exclamations) AS n_exclamations
      FROM m JOIN (SELECT rid, t FROM d) USING (rid) JOIN known USING (doc_id) WHERE n_words >= {LEAST_WORDS} GROUP BY stratum, t),
h AS (SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 1 AND {value} > cutoff) AS k,
        count(*) FILTER (quality = 0 AND {value} > cutoff) AS b
      FROM once, g GROUP BY ALL),
p AS (SELECT *, CASE WHEN k < n_good * {share} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({share}) + (n_good - i) * ln(1 - {share})))) ELSE 1.0 END AS p FROM h),
fam AS (SELECT worst, count(*) OVER () AS n, row_number() OVER (ORDER BY worst) AS i FROM (SELECT stratum, rule, max(p) AS worst FROM p GROUP BY stratum, rule)),
still AS (SELECT greatest(1, max(n) - coalesce(min(i) FILTER (worst > {LEVEL} / (n - i + 1)), max(n) + 1) + 1) AS families FROM fam),
c AS (SELECT stratum, rule, arg_max(cutoff, (b - 10 * k) * 1000.0 + cutoff) AS cutoff FROM p, still
      WHERE p <= {LEVEL} / families AND b - 10 * k > 0 GROUP BY stratum, rule),
f AS (SELECT rid, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (SELECT DISTINCT rid FROM m JOIN c ON m.stratum IS NOT DISTINCT FROM c.stratum WHERE {value} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND m.rid NOT IN (SELECT rid FROM r) AS kept
FROM m JOIN f USING (rid)
"""


ORACLE_SQL = _sql()
