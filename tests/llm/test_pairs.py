"""Near duplicates, decontamination, line dedup and packing, against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.llm import components, decontamination, line_dedup, near_duplicates, packing
from tests.llm.conftest import SCHEMA, prose
from tests.oracle import connect, same


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return links, [root(i) for i in range(len(rows))]


def edited(text, n, seed):
    r = np.random.default_rng(seed)
    w = text.split()
    for _ in range(n):
        w[r.integers(len(w))] = f"new{r.integers(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [400, 7])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = [(i, prose(i, 120)) for i in range(20)]
    rows += [(100 + i, edited(prose(0, 120), i % 7, i)) for i in range(40)]
    rows += [(200 + i, prose(3, 120).upper()) for i in range(3)] + [(300, ""), (301, None), (302, "  "), (303, "two words"), (304, "two  WORDS")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k1": F.lit(1), "cid": F.lit("x")})
    links, groups = brute_links(rows)
    got = {r["doc_id"]: r for r in near_duplicates.jaccard_join(docs).collect()}
    assert len(got) == len(rows)
    assert [got[d]["n_links"] for d, _ in rows] == links
    smallest = defaultdict(lambda: 10**9)
    for (d, _), g in zip(rows, groups, strict=True):
        smallest[g] = min(smallest[g], d)
    assert [got[d]["group_id"] for d, _ in rows] == [smallest[g] for g in groups]
    assert {r["doc_id"] for r in near_duplicates.one_of_each_group(docs).collect()} == set(smallest.values())


def test_jaccard_join_odd_rows(spark, odd, empty):
    out = near_duplicates.jaccard_join(odd)
    assert out.count() == odd.count()
    kept = near_duplicates.one_of_each_group(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == len({(t or "").strip() for t in texts})
    assert near_duplicates.jaccard_join(empty).count() == 0 and near_duplicates.one_of_each_group(empty).count() == 0


def test_groups_without_ids_of_their_own(spark):
    texts = [prose(900 + i, 80) for i in range(6)]
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0]), (None, edited(texts[1], 1, 0))]
    rows += [(7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[4]), (3, texts[2])]
    kept = near_duplicates.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == 6
    second = [t for _, t in got if t in (texts[1], rows[5][1])]
    assert len(second) == 1
    want = [(None, texts[0]), (None, second[0]), (3, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[5])]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_posterior_bounds():
    assert near_duplicates.least_matches() == sorted(near_duplicates.least_matches())
    r = np.random.default_rng(0)
    sig = r.integers(0, 2**16, (2, near_duplicates.VALUES)).astype(np.uint16)
    a, _ = near_duplicates.surviving(sig, np.array([0]), np.array([1]), near_duplicates.least_matches())
    assert len(a) == 0
    lost = 0
    for _ in range(300):
        one = r.integers(0, 2**16, near_duplicates.VALUES).astype(np.uint16)
        two = np.where(r.random(near_duplicates.VALUES) < 0.8, one, r.integers(0, 2**16, near_duplicates.VALUES)).astype(np.uint16)
        lost += len(near_duplicates.surviving(np.stack([one, two]), np.array([0]), np.array([1]), near_duplicates.least_matches())[0]) == 0
    assert lost == 0


@pytest.mark.parametrize("threshold, rows", [(0.95, 4), (0.8, 4), (0.7, 3), (0.5, 2), (0.3, 1)])
def test_bands_follow_the_threshold(spark, threshold, rows):
    """Pairs at and above the threshold are found whatever it is: recall of links against brute force."""
    assert near_duplicates.band_rows(threshold) == rows
    r = np.random.default_rng(int(100 * threshold))
    docs = []
    for i in range(25):
        base = prose(3000 + i, 60)
        docs += [(10 * i, base)] + [(10 * i + k, edited(base, int(r.integers(0, 8)), 50 * i + k)) for k in range(1, 5)]
    got = {x["doc_id"]: x["n_links"] for x in near_duplicates.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), threshold).collect()}
    sets, want = [shingle_set(t) for _, t in docs], 0
    for i in range(len(docs)):
        want += sum(len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9 for j in range(len(docs)) if j != i)
    assert want > 10 and sum(got.values()) == want


def test_low_thresholds_are_refused():
    with pytest.raises(ValueError):
        near_duplicates.band_rows(0.05)


def test_stages_keep_columns_of_inner_names(spark):
    rows = [(i, prose(i % 3, 60), 5) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hash int").withColumns({"text_hash": F.lit(5), "goes_id": F.lit(5)})
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    for out, n in ((near_duplicates.one_of_each_group(docs), 3), (decontamination.clean(docs, bench), 4)):
        assert out.columns == docs.columns and out.count() == n and out.where("__hash = 5 AND text_hash = 5 AND goes_id = 5").count() == n


@pytest.mark.parametrize("hot", [3, 1000])
def test_components(spark, monkeypatch, hot):
    from pointmill.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    edges = [(i, i + 1) for i in range(30) if i % 10 != 9] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(30)) and all(got[k] == 100 for k in range(100, 140))


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_alignment_matches_brute_force():
    r = np.random.default_rng(0)
    for _ in range(60):
        item = r.integers(0, 3, r.integers(8, 30)).astype(np.uint8)
        text = np.concatenate([r.integers(0, 3, r.integers(0, 20)), item, r.integers(0, 3, r.integers(0, 20))]).astype(np.uint8)
        for _ in range(r.integers(0, 4)):
            text = np.delete(text, r.integers(len(text))) if r.random() < 0.5 else np.insert(text, r.integers(len(text) + 1), 1)
        want = edit_distance_inside(item.tolist(), text.tolist())
        k = len(item)
        assert decontamination.alignment(item, text, -len(item), len(text), k)[0] == want


def test_contamination(spark, odd):
    items = [(i, prose(1000 + i, 30)) for i in range(6)] + [(90, None), (91, ""), (92, "#!"), (93, "zqx")]
    docs, want = [], set()
    r = np.random.default_rng(3)
    for d in range(60):
        text = prose(5000 + d, 100)
        if d % 3 == 0:
            i = d // 3 % 6
            hidden = list(items[i][1].upper())
            for _ in range(r.integers(0, int(0.08 * len(hidden)))):
                hidden[r.integers(len(hidden))] = "#"
            text = text[:300] + "... " + "".join(hidden) + "!\n" + text[300:]
            want.add((d, i))
        elif d % 3 == 1:
            text = text[:300] + items[d % 6][1][:60] + text[300:]
        docs.append((d, text, "en", "s", 0))
    table = spark.createDataFrame(docs, SCHEMA).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.contamination(table, bench).collect()} == want
    kept = decontamination.clean(table, bench)
    assert kept.count() == table.count() - len(want) and kept.columns == table.columns
    assert decontamination.contamination(table, bench.where("false")).count() == 0
    assert decontamination.contamination(table.where("false"), bench).count() == 0


@pytest.mark.parametrize("chars", [1_000_000, 150])
def test_items_of_every_length_match_brute_force(spark, monkeypatch, chars):
    """Items of 1 to 100 characters, hidden with up to the edits that they may have and one more; all pairs are compared."""
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", chars)
    r = np.random.default_rng(11)

    def letters(n):
        return "".join(r.choice(list("abcdefghij klmnop"), n)).strip().replace("  ", "ab") or "q"

    items, docs = [], []
    for m in [*range(1, 45), 59, 60, 61, 79, 80, 99, 100]:
        item = "".join(("v" if c == " " else c) for c in letters(m).ljust(m, "w"))
        items.append((m, item))
        for extra in (0, 1):
            hidden = list(item)
            for _ in range(m // 10 + extra):
                k, kind = int(r.integers(len(hidden))), r.integers(3)
                if kind == 0:
                    hidden[k] = "z"
                elif kind == 1 and len(hidden) > 1:
                    del hidden[k]
                else:
                    hidden.insert(k, "y")
            docs.append((len(docs), f"{letters(25)} {''.join(hidden)} {letters(25)}"))
    want = set()
    for d, text in docs:
        data = decontamination.normal(next(iter(decontamination.texts(decontamination.pa.array([text])))))[0].tobytes()
        for i, item in items:
            if (len(item) < 10 and item.encode() in data) or (len(item) >= 10 and edit_distance_inside(item.encode(), data) <= len(item) // 10):
                want.add((d, i))
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want
    assert {(2 * k, i) for k, (i, _) in enumerate(items)} <= want


def test_contamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    items = spark.createDataFrame([(i, prose(i, 30)) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "before " + prose(i, 30) + " after") for i in range(6)], "doc_id long, text string")
    assert {(x["doc_id"], x["item_id"], x["start"]) for x in decontamination.contamination(docs, items).collect()} == {(i, i, 7) for i in range(6)}


def test_line_dedup_matches_sql(spark, sf_dir):
    from pointmill.llm.queries import QUERIES

    same(QUERIES["op8_line_dedup"](spark, sf_dir), connect(sf_dir), line_dedup.ORACLE_SQL)


@pytest.mark.parametrize("bound", [0, 50_000])
def test_line_dedup(spark, odd, empty, monkeypatch, bound, tmp_path):
    import duckdb

    from pointmill.llm import common

    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", bound)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(i, f"Menu\nline {i}\n\nMenu\nshared {i % 20}", "en", "a" if i < 40 else None, 0) for i in range(60)]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["text"] == f"line {i}\n\nshared {i % 20}" and out[i]["dedup_dropped"] == 2 for i in range(60))
    # repeated rows, nulls and columns of every name used inside
    both = spark.createDataFrame(rows + rows[:1] * 30, SCHEMA).unionByName(odd)
    names = ["__host", "__drop", "__kept", "host_of_lines", "lines_kept", "line_t1", "dedup_lines", "dedup_dropped", "key", "host"]
    clash = both.withColumns({n: F.lit(7) for n in names})
    more = line_dedup.line_dedup(clash)
    assert more.columns == [*clash.columns, "_dedup_lines", "_dedup_dropped"] and more.where(" OR ".join(f"`{n}` <> 7" for n in names)).count() == 0
    assert more.count() == both.count() and more.where("text IS NULL").count() == 2
    path = str(tmp_path / "documents")
    both.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    same(line_dedup.line_dedup(both.select("doc_id", "source", "text")), con, line_dedup.ORACLE_SQL)
    assert line_dedup.line_dedup(empty).count() == 0


def test_salted_join(spark, monkeypatch):
    from pointmill.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(i, 1 if i < 60 else i % 7, "x") for i in range(100)], "id long, k int, v string")
    right = spark.createDataFrame([(k, k * 10) for k in (1, 2, 3)], "k int, w int")
    for how in ("inner", "left"):
        assert sorted(tuple(r) for r in common.salted_join(left, right, ["k"], F.col("id"), how).select("id", "k", "w").collect()) == sorted(tuple(r) for r in left.join(right, "k", how).select("id", "k", "w").collect())


def check_pack(pieces, ids):
    by, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append(p)
    for d, own in by.items():
        own.sort(key=lambda p: p["start"])
        copies = [i for k, i in ids if k == d]
        assert sum(p["length"] for p in own) == sum(map(len, copies))
        for p in own:
            assert any(p["doc_tokens"] == len(i) and zlib.crc32(np.array(i[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for i in copies)
    padding = 0
    for own in seqs.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    return padding


def test_pack(spark, odd, empty, tables):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    docs = tables["documents"].select(*odd.columns).unionByName(odd).withColumn("tail", F.lit("clash"))
    ids = [(r["doc_id"], [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    pieces = packing.pack(docs).collect()
    assert Counter(p["doc_id"] for p in pieces).keys() == {d for d, _ in ids}
    assert check_pack(pieces, ids) == 0
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("histogram", [{3000: 501}, {3000: 1}, {4095: 10, 1: 3}, {2049: 100}, {1: 5000}, {1500: 33, 700: 7}, {}])
def test_plan(histogram):
    placed, n = packing.plan(histogram)
    look = packing.Places(placed)
    seqs = defaultdict(list)
    for length, count in histogram.items():
        for number in range(count):
            at = 0
            for start, size, sequence, offset in sorted(look(length, number)):
                assert start == at
                at += size
                seqs[sequence].append((offset, size))
            assert at == length
    assert set(seqs) == set(range(n))
    for own in seqs.values():
        total = sum(s for _, s in own)
        assert sorted(o for o, _ in own) == [sum(s for _, s in sorted(own)[:i]) for i in range(len(own))]
        assert total == packing.WINDOW or total & (total - 1) == 0


def test_fill_is_the_best_sum():
    r = np.random.default_rng(0)
    for _ in range(50):
        counts = {int(k): int(r.integers(1, 4)) for k in r.integers(1, 40, 5)}
        target = int(r.integers(10, 120))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        used = packing.fill(counts, sorted(counts, reverse=True), target)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * m for k, m in used.items()) == max(s for s in sums if s <= target)


def test_tokens_match_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    r = np.random.default_rng(1)
    alphabet = list("abcXYZ019 .,'!-_<|>\n\tàéßñ×÷€—東🙂́  ǆſİ")
    texts = ["".join(r.choice(alphabet, 40)) for _ in range(1500)] + ["<|endoftext|> x<|startoftext|>y", "don't we'll", "Σας ΟΔΟΣ", "½ ²³ x²", None, ""]
    tokens = packing.Tokens(packing.tokenizer_path())
    for block in packing.texts(pa.array(texts), lower=False, block=2000):
        ids, offsets = tokens(block)
        for i in range(len(block)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tk.encode(texts[block.first + i] or "", add_special_tokens=False).ids, 2]
