import corpus_pipeline
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_pairs import brute_links


def test_stages(spark, sf_dir, odd, empty, tables):
    docs = tables["documents"].select(*odd.columns)
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = docs.cache()
        by[name] = {r["doc_id"] for r in docs.collect()}
        if name != "packing":
            assert docs.columns == odd.columns
            assert by[name] <= {r["doc_id"] for r in before.collect()}
    labels = {r["doc_id"]: r["quality"] for r in tables["labels"].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in by["quality"] for d in good) / len(good) > 0.97
    assert by["packing"] == by["decontamination"]
    bench = [r["text"] for r in tables["benchmark"].collect()]
    left = [r["text"] for r in tables["documents"].collect() if r["doc_id"] in by["decontamination"]]
    assert not any(b in t for b in bench for t in left)


def test_one_of_each_group_stays(spark, sf_dir, tables):
    rows = [(r["doc_id"], r["text"]) for r in tables["documents"].collect()]
    _, groups = brute_links(rows)
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, tables["documents"], sf_dir).collect()]
    assert len(kept) == len(set(groups))
    of = {d: g for (d, _), g in zip(rows, groups, strict=True)}
    assert len({of[d] for d in kept}) == len(kept)


def test_odd_rows_pass_every_stage(spark, sf_dir, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs.withColumn("score", docs["doc_id"]), sf_dir).count() >= 0


def test_boilerplate_goes_from_every_host(spark, sf_dir):
    rows = []
    for share in (9, 10, 11, 13):
        for i in range(100):
            text = prose(100 * share + i, 20) + ("\nall rights reserved" if i < share else "") + ("\nsee above" if i >= 96 else "")
            rows.append((len(rows), text, "en", f"host{share}", len(text)))
    out = corpus_pipeline.lines(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert len(out) == 400 and not any("all rights reserved" in r["text"] for r in out)
    assert sum("see above" in r["text"] for r in out) == 16
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_boilerplate_goes_from_small_hosts(spark, sf_dir):
    rows = []
    for pages in (2, 3, 4, 20):
        for i in range(pages):
            text = prose(100 * pages + i, 20) + ("\nall rights reserved" if i < 4 else "")
            rows.append((len(rows), text, "en", f"host{pages}", len(text)))
    out = corpus_pipeline.lines(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert len(out) == 29 and all(r["text"].startswith(rows[r["doc_id"]][1].split("\n")[0]) for r in out)
    assert [r["source"] for r in out if "all rights reserved" in r["text"]] == ["host2", "host2"]
