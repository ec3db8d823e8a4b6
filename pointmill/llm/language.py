"""Language identification by Bayesian evidence fusion.

For each page, four pieces of evidence are combined as log-odds:

- the likelihood of its visible text under byte trigram models, learnt from a bounded sample of documents of known language;
- the language that its markup declares, by P(declared | language) as counted over all pages against the text evidence;
- the suffix of its address, and
- its host, as priors smoothed hierarchically: a host's language shares lean on its suffix's, and these on all pages'.

Counts for the last three come from grouped aggregation over all pages of the posteriors that the text alone gives; each
page's own share is taken out of the counts that it is judged by.

Words in navigation, footers and noscript count as text evidence for QUIET of other words: they are the site's own, the same on
its pages in every language, and speak for the site's language, which the host prior already stands for; where a page has no
other words they still tell. Unclosed ones reach to the end, as unclosed scripts, styles and comments do. Markup is read in
time that grows with its length. A declaration is the attribute lang or xml:lang of the html tag, none that ends in -lang.

A null or empty page has no text evidence: what remains decides. A null url, or one without a host, belongs to a host and a
suffix named by the empty string. Without labelled documents the language is null and the posterior 0. Very long pages are
read whole; of equally likely languages the first by name is given. Repeated rows count each; other columns are never read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import arrow_map, cut, salted_join, table_in_shared_folder
from pointmill.llm.words import U64, texts

#: Labelled documents read for each language at most. All languages that documents have are told apart.
PER_LANGUAGE = 400
BUCKETS = 1 << 15
#: A language's rows are counted in 2^RANGE_BITS ranges of their hash to find how far its sample reaches.
RANGE_BITS = 10
#: Keys of sampled documents that are broadcast at most; beyond that, they meet the documents by a shuffle.
BROADCAST_KEYS = 200_000
#: How many pages' worth a level of the hierarchy leans on the level above, and how far a text's evidence may go: trigrams
#: of running text are not independent, so each counts for 1 / SPREAD, and no more than FULL of them do.
LEAN, SPREAD, FULL = 5.0, 8.0, 160
#: What a trigram in navigation, footers or noscript counts.
QUIET = 0.1


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes from each place on."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    return ((code.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(49)).astype(np.int64)


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def model(documents: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and, for each trigram bucket, its log probability in each of them."""
    known = documents.where(F.col("lang").isNotNull()).select("lang", F.xxhash64("doc_id", "text").alias("key"), "text")
    # the first few of each language by a hash of id and text; equal rows count as one. Counts by range of the hash tell how
    # far the first few reach, so that only rows up to there are put in order, whatever share of all rows a language has
    each = known.select("lang", "key").distinct().withColumn("range", F.shiftright("key", 64 - RANGE_BITS))
    ranges = each.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = ranges.withColumn("before", before).where(F.col("before") < per_language).groupBy("lang").agg(F.max("range").alias("last"))
    # a row for each language, of which the model holds BUCKETS numbers anyway
    few = each.join(F.broadcast(reached), "lang").where(F.col("range") <= F.col("last"))
    first = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("n") <= per_language)
    picked = cut(first.select("lang", "key"))
    langs = sorted(r["lang"] for r in picked.select("lang").distinct().collect())  # a name for each language
    if not langs:
        return [], np.zeros((BUCKETS, 0))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, np.ndarray] = {}
        names = batch.column("lang").to_pylist()
        for block in texts(batch.column("text")):
            plain = _PLAIN[block.data]
            for i in range(len(block)):
                name = names[block.first + i]
                n = np.bincount(_buckets(plain[block.offsets[i] : block.offsets[i + 1]]), minlength=BUCKETS)
                rows[name] = rows.get(name, 0) + n
        found = [(name, np.flatnonzero(n), n) for name, n in rows.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([name for name, at, _ in found for _ in at], pa.string()), pa.array(np.concatenate([at for _, at, _ in found]), pa.int64()), pa.array(np.concatenate([n[at] for _, at, n in found]), pa.int64())], names=["lang", "bucket", "n"]
        )

    # at most per_language keys a language, and BUCKETS counts; of equal rows one is read
    side = F.broadcast(picked) if len(langs) * per_language <= BROADCAST_KEYS else picked
    sample = known.join(side, ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")
    table = arrow_map(sample, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(langs)))
    counts[table["bucket"].to_numpy(np.int64), [langs.index(x) for x in table["lang"]]] = table["n"]
    shared = counts.sum(axis=1, keepdims=True)
    prior = (shared + 0.5) / (shared + 0.5).sum()
    counts += 2000 * prior
    return langs, np.log(counts / counts.sum(axis=0))


def visible(html: Column) -> Column:
    """The html without scripts, styles, comments and tags; U+0001 and U+0002 stand where navigation, a footer or noscript
    begins and ends. Whatever is unclosed reaches to the end, so that nothing is searched for twice."""
    bare = F.regexp_replace(F.translate(html, "\x01\x02", "  "), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    begun = F.regexp_replace(bare, r"(?i)<(?:nav|footer|noscript)\b[^>]*(?:>|\z)", "\x01")
    ended = F.regexp_replace(begun, r"(?i)</(?:nav|footer|noscript)\b[^>]*(?:>|\z)", "\x02")
    return F.regexp_replace(ended, r"(?s)<[a-zA-Z/!?][^>]*(?:>|\z)|&[a-zA-Z]+;|&#[0-9xXa-fA-F]+;", " ")


def _loudness(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 for each byte, QUIET for those between marks; an end without a beginning counts for nothing."""
    step = (data == 1).astype(np.int64) - (data == 2)
    out = np.ones(len(data))
    for i in np.unique(np.searchsorted(offsets, np.flatnonzero(step), side="right") - 1):
        depth = np.cumsum(step[offsets[i] : offsets[i + 1]])
        depth -= np.minimum(np.minimum.accumulate(depth), 0)
        out[offsets[i] : offsets[i + 1]][depth > 0] = QUIET
    return out


def evidence(pages: DataFrame, langs: list[str], weights: np.ndarray) -> DataFrame:
    """page_id, url, host, suffix, declared, support (array of log-likelihoods by language) of each page."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"""(?i)<html[^<>]*?\s(?:xml:)?lang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    slim = pages.select("page_id", "url", host.alias("host"), declared.alias("declared"), visible(F.coalesce(F.col("html"), F.lit(""))).alias("text"), F.xxhash64("html").alias("text_key")).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for block in texts(batch.column("text"), block=1 << 20):
            plain = _PLAIN[block.data]
            keep = np.ones(len(plain), bool)
            keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
            data, offsets = plain[keep], np.concatenate([[0], np.cumsum(keep)])[block.offsets]
            at = _buckets(data)
            loud = _loudness(block.data, block.offsets)[keep][: len(at)]
            sums = np.vstack([np.zeros(len(langs)), np.cumsum(weights[at] * loud[:, None], axis=0)])
            mass = np.concatenate([[0.0], np.cumsum(loud)])
            first, last = np.minimum(offsets[:-1], len(at)), np.minimum(np.maximum(offsets[1:] - 2, offsets[:-1]), len(at))
            n = mass[last] - mass[first]
            out.append((sums[last] - sums[first]) / np.maximum(n, QUIET)[:, None] * np.minimum(n, FULL)[:, None] / SPREAD)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "suffix", "declared", "text_key")), pa.array(np.concatenate(out).tolist(), pa.list_(pa.float64()))], names=["page_id", "url", "host", "suffix", "declared", "text_key", "support"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_map(slim, run, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, suffix string, declared string, text_key long, support array<double>")


def _posterior(logs: Column) -> Column:
    """exp(logs) with sum 1."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def identify(pages: DataFrame, documents: DataFrame, per_language: int = PER_LANGUAGE, lean: float = LEAN) -> DataFrame:
    """page_id, url, host, declared, text_lang (by the text alone), lang, posterior of each page."""
    langs, weights = model(documents, per_language)
    if not langs:
        none = F.lit(None).cast("string")
        return evidence(pages, ["?"], np.zeros((BUCKETS, 1))).select("page_id", "url", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("posterior"))
    size = range(len(langs))
    found = table_in_shared_folder(evidence(pages, langs, weights), "evidence").withColumn("p", _posterior(F.col("support")))

    def sums(*keys: str) -> DataFrame:
        """By keys: the posteriors' sums, one column for each language. Few and mergeable, so a large host is no trouble."""
        return found.groupBy(*keys).agg(F.array(*[F.sum(F.col("p")[i]) for i in size]).alias("__".join(keys) + "__n") if keys else F.array(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in size]).alias("all__n"))

    everything = sums()
    joined = found.crossJoin(F.broadcast(everything))  # one row
    spread = F.struct("page_id", "url", "text_key")
    for key in ("host", "suffix", "declared"):  # a key may hold most pages
        joined = salted_join(joined, sums(key), [key], spread)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def leaning(counts: str, above: str) -> Column:
        """The counts' shares, drawn towards those of the level above."""
        return F.zip_with(counts, above, lambda c, s: (c + lean * s) / (F.col(f"{counts}_sum") + lean))

    names = {"all__n": "whole", "suffix__n": "by_suffix", "host__n": "by_host", "declared__n": "by_declared"}
    own = joined.withColumns({new: F.zip_with(old, "p", lambda n, p: F.greatest(n - p, F.lit(0.0))) for old, new in names.items()})
    own = own.withColumns({f"{new}_sum": total(F.col(new)) for new in names.values()})
    own = own.withColumn("share", F.transform("whole", lambda c: (c + 1.0 / len(langs)) / (F.col("whole_sum") + 1)))
    own = own.withColumn("share", leaning("by_suffix", "share")).withColumn("share", leaning("by_host", "share"))
    # P(declared | language), leaning on 1 / 20 for a declaration that names none of the language's pages
    said = F.when(F.col("declared") == "", F.transform("whole", lambda w: F.lit(0.0))).otherwise(F.zip_with("by_declared", "whole", lambda d, w: F.log((d + 0.05 * lean) / (w + lean))))
    own = own.withColumn("said", said).withColumn("prior", F.zip_with("share", "said", lambda s, d: F.log(s) + d))
    best = own.withColumn("q", _posterior(F.zip_with("support", "prior", lambda t, r: t + r)))
    lang_names = F.array(*map(F.lit, langs))

    def top(p: str) -> Column:
        return lang_names[F.array_position(p, F.array_max(p)).cast("int") - 1]

    return best.select("page_id", "url", "host", "declared", top("p").alias("text_lang"), top("q").alias("lang"), F.array_max("q").alias("posterior"))
