"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are lower-cased and split at white space; a text's set holds its runs of five words (all its words, if fewer). Two
texts are linked if the Jaccard similarity of their sets is at least the threshold.

1. Texts of equal words form one class; a class has one MinHash signature, and one document stands for it.
2. Classes that share a band of the signature are candidates. Buckets are joined by pairs of blocks of bounded size, and a
   pair counts only in the first band that it shares.
3. A pair's MinHash values are compared a few at a time; it is dropped as soon as the posterior probability (uniform
   prior) that its similarity reaches the threshold is below the tolerance.
4. The pairs that remain are verified exactly on their whole sets, in tasks of two blocks of documents. Neither pairs nor
   links become rows: candidates travel as arrays, and a task returns counts of links and a spanning forest.
5. Classes joined by links form groups by connected components.

Null and empty texts have no words: they form one class of equal texts, linked to nothing else. Rows with a null doc_id are
joined by their text like others. Repeated rows are copies. Very long texts are read whole. A pair exactly at the threshold
is linked; of equal smallest ids the smallest text hash stands for a group. Other columns pass through whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import arrow_map, cut, free_name, salted_join, table_in_shared_folder
from pointmill.llm.components import connected_components
from pointmill.llm.words import U64, Texts, mix, shingles, texts

SIZE, THRESHOLD = 5, 0.8
#: MinHash values of a signature. They are read as bands of a few values each, as many as the threshold allows (see band_rows).
VALUES = 96
#: The greatest probability with which a pair at the threshold may share no band.
MISS = 1e-4
STEP, TOLERANCE = 16, 1e-5
#: Members of a bucket, and documents of a verifying task, that are taken together at most.
BLOCK = 400
#: Documents to be verified whose ids are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_IDS = 200_000

_rng = np.random.default_rng(20240501)
_FACTOR = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | U64(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> list[int]:
    """For each comparison of step more values, the fewest matches of all so far with which a pair stays.

    With m of n values equal and a uniform prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, VALUES + 1, step):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def band_rows(threshold: float) -> int:
    """Values in a band: the most with which a pair at the threshold shares no band, (1 - t^rows)^(VALUES / rows), with
    probability MISS at most. 4 from 0.76 on (3e-6 at 0.8), 3 from 0.63, 2 from 0.42, 1 from 0.10; below that it is refused."""
    for rows in (4, 3, 2, 1):
        if (1 - threshold**rows) ** (VALUES // rows) <= MISS:
            return rows
    raise ValueError(f"a threshold of {threshold} is too low for signatures of {VALUES} values")


def signatures(block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text's words in order, and its MinHash values (16 bits each) as [text, value]."""
    words, offsets = block.words()
    n = np.diff(offsets)
    full = n > 0
    place = (np.arange(len(words)) - np.repeat(offsets[:-1], n)).astype(U64)
    one, two = np.zeros(len(n), U64), np.zeros(len(n), U64)
    sig = np.zeros((len(n), VALUES), np.uint16)
    if full.any():
        at = offsets[:-1][full]
        one[full] = np.add.reduceat(mix(words + place * U64(0xA0761D6478BD642F)), at)
        two[full] = np.add.reduceat(mix(words ^ mix(place + U64(11))), at)
        runs, run_offsets = shingles(words, offsets, SIZE)
        starts = run_offsets[:-1][full]
        for k in range(VALUES):
            sig[full, k] = (np.minimum.reduceat(runs * _FACTOR[k] + _ADD[k], starts) * U64(0x9E3779B97F4A7C15)) >> U64(48)
    return one.view(np.int64), two.view(np.int64), sig


def band_keys(sig: np.ndarray, rows: int = 4) -> np.ndarray:
    """A key for each band of each signature."""
    bands = VALUES // rows
    parts = sig.reshape(len(sig), bands, rows).astype(U64)
    packed = parts[:, :, 0]
    for j in range(1, rows):
        packed = packed | (parts[:, :, j] << U64(16 * j))
    return mix(packed + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _signed(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text as it is), k1 and k2 (of its words), sig."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [signatures(b) for b in texts(batch.column("text"), block=1 << 20)]
        sig = np.concatenate([p[2] for p in parts])
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * VALUES), len(sig), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.concatenate([p[1] for p in parts])), raw], names=["doc_id", "text_hash", "k1", "k2", "sig"])

    slim = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return arrow_map(slim, run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text_hash long, k1 long, k2 long, sig binary")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _banded(classes: DataFrame, width: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = band_keys(_sigs(batch.column("sig")), width).view(np.int64)
        cid = np.repeat(np.asarray(batch.column("cid")), keys.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cid)], names=["key", "cid"])

    return arrow_map(classes.where("k1 <> 0 OR k2 <> 0").select("cid", "sig"), run, "key long, cid long")


def grouped_runs(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Shuffles df by keys and calls fn(columns, starts) with whole groups: columns is a dict of Arrow arrays, sorted by
    keys, and starts the first row of each group. Several groups come at once, so that small ones cost little."""
    own = df.repartition(*keys).sortWithinPartitions(*keys, *[c for c in df.columns if c == "side"])
    names = df.columns

    def run(batches):
        held: list[pa.RecordBatch] = []

        def split(table: pa.Table) -> np.ndarray:
            new = np.zeros(len(table), bool)
            new[:1] = True
            for k in keys:
                x = table.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            return np.flatnonzero(new)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            starts = split(table)
            last = int(starts[-1]) if len(starts) else 0
            if last and len(table) >= 2000:
                done = table.slice(0, last).combine_chunks()
                held = table.slice(last).combine_chunks().to_batches()
                yield from fn({n: done.column(n).combine_chunks() for n in names}, np.append(starts[:-1], last))
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                starts = split(table)
                yield from fn({n: table.column(n).combine_chunks() for n in names}, np.append(starts, len(table)))

    return own.mapInArrow(run, schema)


def pairs_of(starts: np.ndarray, side: np.ndarray, at_once: int = 400_000):
    """Row pairs (a, b), b after a, of each group: all of a group whose rows are of side 0, else those across the sides
    (rows of side 0 come first). In parts of about at_once pairs."""
    n = int(starts[-1])
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = starts[:-1][group]
    zero = np.concatenate([[0], np.cumsum(side == 0)])
    zeros = (zero[starts[1:]] - zero[starts[:-1]])[group]
    mixed = zeros < np.diff(starts)[group]
    count = np.where(mixed, np.where(side == 1, zeros, 0), np.arange(n) - first)
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + at_once, side="right")) - 1)
        to = min(to, n)
        b = np.repeat(np.arange(at, to), count[at:to])
        if len(b):
            a = first[b] + np.arange(len(b)) - (total[b] - total[at])
            yield a, b
        at = to


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Bayesian pruning: the pairs whose posterior stays at or above the tolerance in every comparison."""
    matches = np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        matches += (sig[a, i * step : (i + 1) * step] == sig[b, i * step : (i + 1) * step]).sum(axis=1)
        stay = matches >= m
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b


def _blocks_of(members: DataFrame, key: str, size: str, salt: str) -> DataFrame:
    """Each row once for every pair of blocks that its block is in: adds columns i, j and side (0: in i, 1: in j only)."""
    n = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(F.col(salt), F.lit(7)), n).cast("int")
    spread = members.withColumn("__n", n).withColumn("__own", own)
    return (
        spread.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumns({"i": F.least("__own", "__other"), "j": F.greatest("__own", "__other"), "side": (F.col("__own") > F.col("__other")).cast("int")})
        .drop("__n", "__own", "__other")
    )


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """t1, t2 (two blocks of documents, or one twice), one, two: the pairs left by the pruning, as arrays of their members."""
    width = band_rows(threshold)
    bands = _banded(classes, width)
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("first")).where("n > 1")
    members = cut(bands.join(buckets, "key"))
    hubs = members.groupBy("cid").agg(F.min("first").alias("hub"))
    sizes = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("hub_n"))
    homes = salted_join(hubs, sizes, ["hub"], F.col("cid")).select("cid", F.xxhash64("hub", F.pmod(F.xxhash64("cid"), F.ceil(F.col("hub_n") / F.lit(BLOCK)))).alias("home"))
    known = homes.join(classes.select("cid", "sig"), "cid")
    rows = _blocks_of(members.join(known, "cid").select("key", "n", "cid", "home", "sig"), "key", "n", "cid").drop("n")
    least = least_matches(threshold)

    def prune(columns, starts):
        sig = _sigs(columns["sig"])
        keys, own = band_keys(sig, width), columns["key"].to_numpy().view(np.uint64)
        cid, home = columns["cid"].to_numpy(), columns["home"].to_numpy()
        at = (keys == own[:, None]).argmax(axis=1)
        for a, b in pairs_of(starts, columns["side"].to_numpy()):
            a, b = surviving(sig, a, b, least)
            if not len(a):
                continue
            earlier = (keys[a] == keys[b]) & (np.arange(keys.shape[1]) < at[b][:, None])
            first = ~earlier.any(axis=1) & (cid[a] != cid[b])
            a, b = a[first], b[first]
            if not len(a):
                continue
            swap = (home[a] > home[b]) | ((home[a] == home[b]) & (cid[a] > cid[b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            # one row for each pair of homes
            order = np.lexsort((home[b], home[a]))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (home[a][1:] != home[a][:-1]) | (home[b][1:] != home[b][:-1])
            heads = np.flatnonzero(new)
            offsets = pa.array(np.append(heads, len(a)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(home[a][heads]), pa.array(home[b][heads]), pa.ListArray.from_arrays(offsets, pa.array(cid[a])), pa.ListArray.from_arrays(offsets, pa.array(cid[b]))],
                names=["t1", "t2", "one", "two"],
            )

    found = grouped_runs(rows, ["key", "i", "j"], prune, "t1 long, t2 long, one array<long>, two array<long>")
    # a task has the pairs of two blocks of bounded size
    return cut(found.groupBy("t1", "t2").agg(F.collect_list(F.struct("one", "two")).alias("p")).select("t1", "t2", F.flatten("p.one").alias("one"), F.flatten("p.two").alias("two")))


def _sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, n, shingles (sorted 64-bit hashes) of the wanted classes, from the texts of the documents that stand for them."""
    own = cut(classes.join(wanted, "cid", "left_semi").select("cid", "k1", "k2", "n", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash")))
    ids = own.select("rep", "rep_hash")
    if own.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    slim = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = slim.join(ids, slim["doc_id"].eqNullSafe(ids["rep"]) & (slim["text_hash"] == ids["rep_hash"]), "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two, sets = [], [], []
        for b in texts(batch.column("text"), block=1 << 20):
            words, offsets = b.words()
            n = np.diff(offsets)
            place = (np.arange(len(words)) - np.repeat(offsets[:-1], n)).astype(U64)
            k1, k2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
            full = n > 0
            if full.any():
                k1[full] = np.add.reduceat(mix(words + place * U64(0xA0761D6478BD642F)), offsets[:-1][full])
                k2[full] = np.add.reduceat(mix(words ^ mix(place + U64(11))), offsets[:-1][full])
            runs, at = shingles(words, offsets, SIZE)
            one.append(k1.view(np.int64))
            two.append(k2.view(np.int64))
            sets += [np.unique(runs[at[i] : at[i + 1]]).tobytes() for i in range(len(b))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), pa.array(sets, pa.binary())], names=["k1", "k2", "shingles"])

    return own.join(arrow_map(found.select("text"), run, "k1 long, k2 long, shingles binary"), ["k1", "k2"]).dropDuplicates(["cid"]).select("cid", "n", "shingles")


def _verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """cid, links, linked_docs, root: for each task of two blocks, how many classes a class is linked to there, how many
    documents these have, and a class that it is connected to there."""
    members = candidates.select("t1", "t2", F.explode(F.array_distinct(F.concat("one", "two"))).alias("cid")).join(sets, "cid")
    none = F.lit(None)
    rows = members.select("t1", "t2", "cid", "n", "shingles", none.cast("array<long>").alias("one"), none.cast("array<long>").alias("two")).unionByName(
        candidates.select("t1", "t2", none.cast("long").alias("cid"), none.cast("long").alias("n"), none.cast("binary").alias("shingles"), "one", "two")
    )

    def verify(columns, starts):
        cid, n = columns["cid"].fill_null(-1).to_numpy(), columns["n"].fill_null(0).to_numpy()
        raw = columns["shingles"]
        out: list[tuple[int, int, int, int]] = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            at = {c: i for i, c in enumerate(cid[s:e].tolist(), s) if c >= 0}
            pairs = {(x, y) for i in range(s, e) if cid[i] < 0 for x, y in zip(columns["one"][i].as_py(), columns["two"][i].as_py(), strict=True)}
            own = {i: np.frombuffer(raw[i].as_py(), np.uint64) for i in at.values()}
            count, docs, parent = dict.fromkeys(own, 0), dict.fromkeys(own, 0), {i: i for i in own}

            def root(i, parent=parent):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, j in ((at[x], at[y]) for x, y in pairs):
                x, y = own[i], own[j]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if shared >= threshold * (len(both) - shared) - 1e-9:
                    count[i] += 1
                    count[j] += 1
                    docs[i] += int(n[j])
                    docs[j] += int(n[i])
                    parent[root(i)] = root(j)
            out += [(int(cid[i]), count[i], docs[i], int(cid[root(i)])) for i in own if count[i]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["cid", "links", "linked_docs", "root"])

    return grouped_runs(rows, ["t1", "t2"], verify, "cid long, links long, linked_docs long, root long")


def _grouped(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of jaccard_join, and head_hash: the text_hash of the one document that stands for the row's group, which
    has the smallest doc_id (null after all others) and, of these, the smallest text_hash. Its doc_id is group_id, which
    does not tell groups apart where ids are null or used again; (group_id, head_hash) does."""
    signed = table_in_shared_folder(_signed(documents), "signatures")
    classes = cut(signed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.first("sig").alias("sig")).withColumn("cid", F.monotonically_increasing_id()))
    candidates = _candidates(classes, threshold)
    links = cut(_verified(candidates, _sets(documents, classes, candidates.select(F.explode(F.array_distinct(F.concat("one", "two"))).alias("cid")).distinct()), threshold))
    counts = links.groupBy(F.col("cid").alias("__cid")).agg(F.sum("linked_docs").alias("linked_docs"))
    labels = connected_components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "k1", "k2", "n", F.col("first.doc_id").alias("class_id"), F.col("first.text_hash").alias("class_hash")).join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    first = F.struct(F.col("class_id").isNull().alias("none"), "class_id", "class_hash")
    smallest = named.groupBy(F.col("label").alias("__label")).agg(F.min(first).alias("head")).select("__label", F.col("head.class_id").alias("group_id"), F.col("head.class_hash").alias("head_hash"))
    headed = salted_join(named, smallest.withColumnRenamed("__label", "label"), ["label"], F.col("cid"))
    full = cut(headed.join(counts, F.col("cid") == F.col("__cid"), "left").select("k1", "k2", "n", "class_id", "group_id", "head_hash", F.coalesce("linked_docs", F.lit(0)).alias("linked_docs")))
    return signed.select("doc_id", "text_hash", "k1", "k2").join(full, ["k1", "k2"]).select("doc_id", "text_hash", "class_id", F.col("n").alias("copies"), (F.col("n") - 1 + F.col("linked_docs")).alias("n_links"), "group_id", "head_hash")


def jaccard_join(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, class_id (smallest doc_id of its equal texts), copies (documents in that class), n_links (other
    documents of at least the threshold), group_id (smallest doc_id of the group that links connect), one row a document."""
    return _grouped(documents, threshold).drop("head_hash")


def one_of_each_group(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents less all but one of each group of near duplicates: the one of the smallest doc_id stays. Groups are
    told apart by their documents, not by ids: a null id and an id of several texts are ids like others."""
    found = cut(_grouped(documents, threshold))
    head = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("head_hash"))
    goes = found.where(~head).select("doc_id", "text_hash").distinct()
    if goes.count() <= BROADCAST_IDS:
        goes = F.broadcast(goes)
    columns, own_hash = documents.columns, free_name(documents, "text_hash")
    tagged = documents.withColumn(own_hash, F.xxhash64("text"))
    goes = goes.select(F.col("doc_id").alias("goes_id"), F.col("text_hash").alias("goes_hash"))
    kept = tagged.alias("t").join(goes.alias("g"), F.col("t.doc_id").eqNullSafe(F.col("g.goes_id")) & (F.col(f"t.{own_hash}") == F.col("g.goes_hash")), "left_anti")
    stays = found.where(head).select("doc_id", "text_hash")
    if stays.count() > stays.distinct().count():  # repeated rows: one of each stays
        kept = kept.dropDuplicates(["doc_id", own_hash])
    return kept.select(*columns)
