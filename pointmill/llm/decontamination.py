"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased and every run of ASCII characters other than letters and digits counts as one space. An item of m
bytes occurs in a document if some stretch of it is within k = floor(rate * m) edits. Such a stretch shares at least
m + 1 - q (k + 1) q-grams with the item, all on at most k + 1 neighbouring diagonals. So shared q-grams are counted in
diagonal bands that are 2 (k + 1) wide and overlap by half; bands that meet the bound are kept and verified by banded
alignment. A cheaper form of the same bound (enough shared q-grams within the length of an item) goes first.

q is 8, or as much less as the bound needs to say something: m // (k + 1) for short items, so that items of any length are
found with all the edits that the rate gives them. Items of under 10 bytes have none: they are found where they stand
verbatim, inside words too.

The benchmark is indexed in blocks of bounded size. Where there is more than one block, a first pass over the documents asks
for the cheap bound alone, by a table of which q-grams the whole benchmark has, and only the documents that pass it are
searched block by block; with one block (the usual case) a single pass does both.

Null and empty texts contain nothing; null and empty items occur nowhere. Very long texts and items are read whole. Of
places with equally few edits the first is reported. Repeated documents each get their rows; of repeated items each is
found. Other columns pass through whatever their names. An empty table on either side gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import arrow_map, cut, free_name, table_in_shared_folder
from pointmill.llm.words import U64, Texts, texts

Q, RATE = 8, 0.1
#: Characters of benchmark text that are indexed together at most: about 30 bytes each in every task.
BLOCK_CHARS = 1_000_000
#: Places of the table that the first pass sieves by: 64 MB, a tenth filled by 6 million q-grams. A fuller one lets more by.
SIEVE = 1 << 26
#: Contaminated documents whose ids are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_IDS = 200_000

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [c if chr(c).isalnum() else 32 for c in range(128)]


def normal(block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes, offsets by text, and which bytes of the block they are."""
    plain = _PLAIN[block.data]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    starts = block.offsets[:-1]
    keep[starts[starts < len(plain)]] = True
    at = np.flatnonzero(keep)
    return plain[keep], np.searchsorted(at, block.offsets), at


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q bytes from each place on, as one number."""
    if len(data) < q:
        return np.zeros(0, U64)
    padded = np.concatenate([data, np.zeros(Q - q, np.uint8)])
    whole = np.ndarray((len(data) - q + 1,), "<u8", np.ascontiguousarray(padded), strides=(1,)).copy()
    return whole if q == Q else whole & U64((1 << 8 * q) - 1)


def _sieve_at(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - size.bit_length() + 1)


def budget(m: int, rate: float) -> tuple[int, int]:
    """Edits and q of an item of m bytes."""
    k = int(m * rate + 1e-9)
    return k, min(Q, m // (k + 1))


@dataclass
class Index:
    """The q-grams of benchmark items of one q."""

    q: int
    ids: list
    items: list[np.ndarray]
    edits: np.ndarray  # k of each item
    least: np.ndarray  # shared q-grams of an occurrence, at least
    keys: np.ndarray
    starts: np.ndarray  # of each key's postings
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    classes: list[tuple[int, int, np.ndarray]]  # least shared q-grams, their span, and which keys count, by item length


def _plain_item(text: str | None) -> np.ndarray:
    (block,) = texts(pa.array([text], pa.string()))
    data = normal(block)[0]
    data = data[1:] if len(data) and data[0] == 32 else data
    return data[:-1] if len(data) and data[-1] == 32 else data


def build(rows: list[tuple], rate: float = RATE) -> list[Index]:
    """An index for each q that the items need."""
    by: dict[int, tuple[list, list[np.ndarray]]] = {}
    for item_id, text in rows:
        data = _plain_item(text)
        if len(data):
            ids, items = by.setdefault(budget(len(data), rate)[1], ([], []))
            ids.append(item_id)
            items.append(data)
    return [_index(q, *by[q], rate) for q in sorted(by)]


def _index(q: int, ids: list, items: list[np.ndarray], rate: float) -> Index:
    m = np.array([len(x) for x in items])
    edits = np.array([budget(len(x), rate)[0] for x in items])
    least = m + 1 - q * (edits + 1)
    all_keys = np.concatenate([grams(x, q) for x in items])
    item = np.repeat(np.arange(len(items)), m - q + 1)
    place = np.concatenate([np.arange(n - q + 1) for n in m])
    order = np.argsort(all_keys, kind="stable")
    keys, starts = np.unique(all_keys[order], return_index=True)
    sieve = np.zeros(1 << max(20, int(8 * len(keys)).bit_length()), bool)
    sieve[_sieve_at(keys, len(sieve))] = True
    which = np.searchsorted(keys, all_keys)
    classes = []
    steps = np.floor(np.log2(m) * 4).astype(int)
    for c in np.unique(steps):
        own = np.flatnonzero(steps == c)
        mask = np.zeros(len(keys), bool)
        mask[which[np.isin(item, own)]] = True
        classes.append((int(least[own].min()), int((m + edits)[own].max()), mask))
    return Index(q, ids, items, edits, least, keys, np.append(starts, len(all_keys)), item[order], place[order], sieve, classes)


def alignment(item: np.ndarray, text: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int]:
    """Fewest edits between item and a stretch of text whose diagonals (place in text less place in item) lie within
    k of lo..hi, and where that stretch ends; k + 1 edits if there are more than k."""
    lo, hi = lo - k, hi + k
    c = np.arange(lo, hi + 1)
    big = k + 1
    padded = np.zeros(len(item) + hi - lo + 1, np.int16)
    at = np.arange(lo, lo + len(padded))
    inside = (at >= 0) & (at < len(text))
    padded[inside] = text[at[inside]]
    padded[~inside] = -1
    row = np.where((c >= 0) & (c <= len(text)), 0, big)
    ramp = np.arange(len(c))
    for i in range(len(item)):
        step = row + (padded[i : i + len(c)] != item[i])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - ramp) + ramp
        ends = c + i + 1
        row = np.where((ends < 0) | (ends > len(text)), big, row)
        if row.min() > k:
            return big, 0
    best = int(row.argmin())
    return int(min(row[best], big)), int(c[best]) + len(item)


def _close(hit: np.ndarray, doc: np.ndarray, least: int, span: int) -> np.ndarray:
    """Which hits are among least hits of one text within span places."""
    near = np.zeros(len(hit), bool)
    if len(hit) < least:
        return near
    last, first = np.arange(least - 1, len(hit)), np.arange(len(hit) - least + 1)
    close = np.flatnonzero((hit[last] - hit[first] <= span) & (doc[last] == doc[first]))
    change = np.zeros(len(hit) + 1, np.int64)
    np.add.at(change, close, 1)
    np.add.at(change, close + least, -1)
    return np.cumsum(change[:-1]) > 0


def search(block: Texts, indexes: list[Index]) -> list[tuple[int, object, int, int, int]]:
    """(text, item id, regions, fewest edits, start of the best region in code points of the lower-cased text)."""
    plain = normal(block)
    return [row for index in indexes for row in _search(block, *plain, index)]


def _search(block: Texts, data: np.ndarray, offsets: np.ndarray, origin: np.ndarray, index: Index) -> list[tuple[int, object, int, int, int]]:
    keys = grams(data, index.q)
    hit = np.flatnonzero(index.sieve[_sieve_at(keys, len(index.sieve))])
    at = np.minimum(np.searchsorted(index.keys, keys[hit]), len(index.keys) - 1)
    same = index.keys[at] == keys[hit]
    hit, at = hit[same], at[same]
    doc = np.searchsorted(offsets, hit, side="right") - 1
    inside = hit + index.q <= offsets[doc + 1]
    hit, at, doc = hit[inside], at[inside], doc[inside]
    near = np.zeros(len(hit), bool)
    for least, span, mask in index.classes:
        own = np.flatnonzero(mask[at])
        near[own[_close(hit[own], doc[own], least, span)]] = True
    hit, at, doc = hit[near], at[near], doc[near]
    if not len(hit):
        return []
    n = index.starts[at + 1] - index.starts[at]
    row = np.repeat(np.arange(len(hit)), n)
    posting = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + index.starts[at[row]]
    item, diagonal, of = index.item[posting], hit[row] - index.place[posting], doc[row]
    band = diagonal // (index.edits[item] + 1)
    triple = np.stack([np.concatenate([of, of]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
    order = np.lexsort(triple[::-1])
    triple = triple[:, order]
    new = np.ones(triple.shape[1], bool)
    new[1:] = (triple[:, 1:] != triple[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, triple.shape[1]))
    triple = triple[:, first]
    kept = triple[:, counts >= index.least[triple[1]]]
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, i, b in kept.T.tolist():
        text, k, it = data[offsets[d] : offsets[d + 1]], int(index.edits[i]), index.items[i]
        lo = b * (k + 1) - int(offsets[d])
        regions = found.setdefault((d, i), [])
        if regions and lo - k <= regions[-1][1] - len(it) <= lo + 2 * k + 1:
            continue  # the overlapping band before has it
        exact = text[max(0, lo) : lo + 2 * k + 2 + len(it)].tobytes().find(it.tobytes()) if lo + 2 * k + 2 + len(it) > 0 else -1
        edits, end = (0, max(0, lo) + exact + len(it)) if exact >= 0 else alignment(it, text, lo, lo + 2 * k + 1, k)
        if edits <= k:
            regions.append((edits, end))
    out = []
    for (d, i), regions in found.items():
        if regions:
            edits, end = min(regions)
            start = int(origin[offsets[d] + max(0, end - len(index.items[i]))])
            lead = block.data[block.offsets[d] : start]
            out.append((d, index.ids[i], len(regions), edits, int((lead & 0xC0 != 0x80).sum())))
    return out


def _may_contain(slim: DataFrame, items: DataFrame, rate: float) -> DataFrame:
    """The rows of slim whose texts meet the cheap bound of some class of items: one pass, by a table of bounded size."""

    def classes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = set()
        for text in batch.column("text").to_pylist():
            data = _plain_item(text)
            if len(data):
                k, q = budget(len(data), rate)
                step = int(np.floor(np.log2(len(data)) * 4))
                found |= {(q, step, len(data) + 1 - q * (k + 1), len(data) + k, int(p)) for p in _sieve_at(grams(data, q), SIEVE).tolist()}
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(found), strict=True)] if found else [pa.array([], pa.int64())] * 5, names=names)

    names = ["q", "step", "least", "span", "place"]
    places = arrow_map(items.select("text"), classes, ", ".join(f"{n} long" for n in names))
    # one row a q and word of 64 places: at most 8 times SIEVE / 64 of them, gathered as bits
    bounds = [(r["q"], r["least"], r["span"]) for r in places.groupBy("q", "step").agg(F.min("least").alias("least"), F.max("span").alias("span")).collect()]  # a few dozen classes
    words = places.groupBy("q", F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits")).toArrow()
    sieves = {}
    for q in {b[0] for b in bounds}:
        own = words.filter(pa.compute.equal(words.column("q"), q))
        sieves[q] = np.zeros(SIEVE // 64, np.int64)
        sieves[q][own.column("word").to_numpy()] = own.column("bits").to_numpy()
    shared = slim.sparkSession.sparkContext.broadcast((bounds, sieves))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds, sieves = shared.value
        keep = np.zeros(batch.num_rows, bool)
        for block in texts(batch.column("text")):
            data, offsets, _ = normal(block)
            for q, bits in sieves.items():
                place = _sieve_at(grams(data, q), SIEVE).astype(np.int64)
                hit = np.flatnonzero((bits[place >> 6] >> (place & 63)) & 1)
                doc = np.searchsorted(offsets, hit, side="right") - 1
                hit, doc = hit[hit + q <= offsets[doc + 1]], doc[hit + q <= offsets[doc + 1]]
                for least, span in {(least, span) for own, least, span in bounds if own == q}:
                    keep[block.first + doc[_close(hit, doc, least, span)]] = True
        return batch.filter(pa.array(keep))

    return arrow_map(slim, run, slim.schema)


def contamination(documents: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, text_hash, item_id, regions, edits (of the best), start (of the best, in code points): one row for each
    document and item that occurs in it."""
    items = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    slim = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    if blocks > 1:
        slim = table_in_shared_folder(_may_contain(slim, items, rate), "candidates")
        dealt = cut(dealt)
    kinds = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, text_hash long, item_id {kinds[1]}, regions long, edits long, start long"
    parts = None
    for b in range(blocks):
        indexes = build([(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == b).collect()], rate)  # a block of bounded size
        if not indexes:
            continue
        shared = documents.sparkSession.sparkContext.broadcast(indexes)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            rows = []
            for block in texts(batch.column("text")):
                rows += [(block.first + d, *rest) for d, *rest in search(block, shared.value)]
            if not rows:
                return None
            doc, item, regions, edits, start = zip(*rows, strict=True)
            own = batch.take(pa.array(doc))
            return pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_hash"), pa.array(item), pa.array(regions, pa.int64()), pa.array(edits, pa.int64()), pa.array(start, pa.int64())], names=["doc_id", "text_hash", "item_id", "regions", "edits", "start"])

        part = arrow_map(slim, run, schema)
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else documents.sparkSession.createDataFrame([], schema)


def clean(documents: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no benchmark item occurs."""
    found = cut(contamination(documents, benchmark, rate).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).distinct())
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    own = free_name(documents, "text_hash")
    tagged = documents.withColumn(own, F.xxhash64("text")).alias("t")
    return tagged.join(found.alias("g"), F.col("t.doc_id").eqNullSafe(F.col("g.found_id")) & (F.col(f"t.{own}") == F.col("g.found_hash")), "left_anti").select(*documents.columns)
