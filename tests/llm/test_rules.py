"""Quality rules and license scans: both against brute force and, for the rules, SQL."""

import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from pointmill.llm import licences, rules
from tests.llm.conftest import SCHEMA, prose
from tests.oracle import connect, same


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, odd):
    extra = spark.createDataFrame([(50, "a b c a b c\na b c\n\na b c\n x\x0b|<># y z", "en", "s", 0), (51, "a b\na b\na b", "en", "s", 0), (52, "q q q q q", "en", "s", 0)], odd.schema)
    docs = odd.unionByName(extra)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    want = sorted((r["doc_id"] or -1, *brute_counts(r["text"])) for r in docs.collect())
    got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.judge(docs, labels).collect())
    assert got == want
    for r in rules.judge(docs, labels).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])


def test_rules_match_sql(spark, sf_dir):
    from pointmill.llm.queries import QUERIES

    same(QUERIES["op5_quality_rules"](spark, sf_dir), connect(sf_dir), rules.ORACLE_SQL)


def test_binomial_tail(spark):
    df = spark.createDataFrame([(n, k) for n in (0, 10, 400, 5000) for k in (0, 1, 3, 9) if k <= n], "n long, k long")
    for r in df.select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        want = sum(comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["k"] < r["n"] * 0.01 else 1.0
        assert abs(r["p"] - want) < 1e-9


def certified_by_brute_force(rows, labels, rate=rules.RATE, level=rules.LEVEL):
    """stratum, rule -> certified cutoffs, by plain Python: fixed sequences by rule, Holm over rules and strata."""
    values = {r["text_key"]: (r["stratum"], {m: (r[over] / r[under] if r[under] else 0.0) for m, (over, under, _) in rules.RULES.items()}) for r in rows if r["n_words"] >= 50}
    quality = {}
    for r in rows:
        if r["doc_id"] in labels and r["text_key"] in values:
            quality[r["text_key"]] = max(quality.get(r["text_key"], 0), labels[r["doc_id"]])
    share, p = rate / len(rules.RULES), {}
    for stratum in {s for k, (s, _) in values.items() if k in quality}:
        good = [v for k, (s, v) in values.items() if s == stratum and quality.get(k) == 1]
        for rule, (_, _, grid) in rules.RULES.items():
            p[stratum, rule] = {}
            for c in grid:
                k = sum(v[rule] > c for v in good)
                p[stratum, rule][c] = sum(comb(len(good), i) * share**i * (1 - share) ** (len(good) - i) for i in range(k + 1))
    open_families, changed = dict(p), True
    while changed and open_families:
        changed = False
        for f, own in sorted(open_families.items(), key=lambda x: max(x[1].values())):
            if max(own.values()) <= level / len(open_families):
                del open_families[f]
                changed = True
                break
    bound = level / max(1, len(open_families))
    out = {}
    for f, own in p.items():
        for c in sorted(own, reverse=True):  # from the laxest on, until one fails
            if own[c] > bound:
                break
            out.setdefault(f, set()).add(c)
    return out


def junk(seed, n, kind):
    words = prose(seed, n).split()
    if kind == "symbols":
        return " ".join(w + "$$" for w in words)
    if kind == "capitals":
        return " ".join(words).upper()
    return " ".join(w + "!" for w in words)


@pytest.fixture(scope="module")
def holdout(spark):
    """Good and bad documents of two languages, copies among them; one language has too few for a certificate."""
    rows, labels = [], []
    for lang, good, bad in (("en", 900, 90), ("de", 760, 30), ("fr", 90, 20)):
        for i in range(good):
            rows.append((len(rows), prose(7919 * len(rows), 70) + (" $$ ## $$ %% $$ ##" if i < 2 else ""), lang))
            labels.append((rows[-1][0], 1, 0))
        for i in range(bad):
            rows.append((len(rows), junk(31 * len(rows), 70, ("symbols", "capitals", "shouts")[i % 3]), lang))
            labels.append((rows[-1][0], 0, 0))
        rows += [(10_000 + len(rows) + i, rows[-1][1], lang) for i in range(400)]  # copies of one bad text, unlabelled
        labels += [(rows[-1][0], 0, 0)] * 3
    rows += [(50_000, junk(5, 70, "symbols"), None), (None, None, "en"), (50_001, "", "de")]
    docs = spark.createDataFrame([(d, t, s, "s", 0) for d, t, s in rows], SCHEMA)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_match_brute_force(holdout):
    docs, labels = holdout
    measured = rules.measures(docs.withColumns({"stratum": F.lit("clash"), "text_key": F.lit(-1), "n_words": F.lit(-1)}))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    want = certified_by_brute_force(measured.collect(), known)
    got = {}
    for r in rules.tested(measured, labels).where("certified").collect():
        got.setdefault((r["stratum"], r["rule"]), set()).add(r["cutoff"])
    assert got == want and {s for s, _ in got} == {"en", "de"}
    used = rules.cutoffs(measured, labels).collect()
    assert {(r["stratum"], r["rule"]) for r in used} >= {(s, r) for s in ("en", "de") for r in ("symbols", "capitals", "exclamations")}
    assert rules.cutoffs(measured, labels, rate=1e-6).count() == 0


def test_certified_cutoffs_reject_junk_and_match_sql(holdout, tmp_path):
    import duckdb

    docs, labels = holdout
    con = duckdb.connect()
    for name, table in (("documents", docs), ("labels", labels)):
        table.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    judged = rules.judge(docs, labels)
    same(judged, con, rules.ORACLE_SQL)
    out = {r["doc_id"]: r["kept"] for r in judged.join(labels.distinct(), "doc_id").select("doc_id", "kept", "quality").collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert not any(kept for d, kept in out.items() if known[d] == 0 and lang[d] != "fr")
    assert sum(out[d] for d, q in known.items() if q == 1) / sum(known.values()) > 0.99
    assert all(kept for d, kept in out.items() if lang[d] == "fr" and known[d] == 0)  # nothing is certified there
    assert {r["doc_id"]: r["kept"] for r in judged.collect()}[50_000]


def test_cutoffs_are_certified_on_the_larger_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert rules.cutoffs(rules.measures(docs), labels).count() > 0


def test_rules_empty(empty, tables):
    assert rules.judge(empty, tables["labels"]).count() == 0


def test_licences_match_sql(spark, sf_dir):
    from pointmill.llm.queries import QUERIES

    same(QUERIES["op10_licences"](spark, sf_dir), connect(sf_dir), licences.ORACLE_SQL)


def brute_licence(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences_match_brute_force(spark, odd, tables):
    made = spark.createDataFrame(
        [
            (600000, "MIT-License; the Apache\nlicense, and GENERAL public_license v3. mit licensed. mitlicense", "en", "s", 0),
            (600001, "x" * 50 + " mit license " * 500, "en", "s", 0),
            (600002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "en", "s", 0),
            (600003, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "en", "s", 0),
            (600004, "Licensed under CC BY-NC 4.0.", "en", "s", 0),
            (600005, "a licensed driver had permission to redistribute sand under terms of use", "en", "s", 0),
            (600006, "é MIT license é", "en", "s", 0),
            (600007, "cc_by_nc_4_0 licensed_under", "en", "s", 0),
        ],
        odd.schema,
    )
    docs = odd.unionByName(made).unionByName(tables["documents"].select(*odd.columns)).withColumn("score", F.lit(1)).withColumn("r", F.lit(1))
    found = licences.scan(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in found:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in [brute_licence(t) for t in texts[r["doc_id"]]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    by = {r["doc_id"]: r["labels"] for r in found}
    assert (by[600002], by[600003], by[600004], by[600005], by[600000]) == ("mit", "bsd", "cc-by-nc", "", "apache,gpl,mit")
    assert by[600007] == "cc-by-nc"  # any character that no word has may stand between
    assert len(found) == docs.count()
    assert licences.scan(docs.where("false")).count() == 0


def notice(label, least=40):
    return next(t for k, t, _ in licences.TEXTS if k == label and len(t.split()) > least)


def test_texts_that_only_name_a_licence_and_changed_notices(spark, odd, tmp_path):
    import duckdb

    mit, bsd, gpl, isc, mpl = notice("mit"), notice("bsd"), notice("gpl"), notice("isc", 20), notice("mpl", 20)
    nc, words = "Licensed under CC BY-NC 4.0.", "any associated binary charge conditions copy deal documentation"
    made = [
        ("We left the Mozilla Public License behind in 1999 and never looked back.", ""),
        ("The essay compares the GNU Affero General Public License with other texts.", "gpl"),
        ("He had permission is hereby granted free of charge on his lips and sought to deal in the software without restriction.", ""),
        ("Redistribution and use in source and binary forms was the topic of the talk.", ""),
        (f"{mit}\n{nc}\n{bsd}", "bsd,cc-by-nc,mit"),
        (f"{bsd} and {nc} {mit}", "bsd,cc-by-nc,mit"),
        (f"{words} {nc}", "cc-by-nc"),
        (f"{words} x mit license", "mit"),
        (f"{mit} {bsd}", "bsd,mit"),
        (f"{gpl.replace('This program', 'The Small Tool of Example Company Limited')}", "gpl"),
        (bsd.replace("the copyright holder nor", "Example Company and its many friends abroad nor"), "bsd"),
        (mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "PERSONS NAMED ABOVE"), "mit"),
        (isc, "isc"),
        (mpl, "mpl"),
        ("prose " * 3000 + mit + " prose" * 3000, "mit"),
        ("Licensed under the Mozilla Public License", "mpl"),
        ("licensed under cc by 4 0; licensed under cc by 4 0", "cc-by"),
    ]
    common = [(100 + i, f"licensed under cc by nc 4 0 {i}", "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, (t, _) in enumerate(made)] + common, odd.schema)
    found = licences.scan(docs)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in found.collect()}
    assert [got[d][0] for d in range(len(made))] == [want for _, want in made]
    assert got[1][1] == 0.5 and got[0][1] == 0 and got[4][1] == 1
    path = str(tmp_path / "documents")
    docs.unionByName(odd).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    same(licences.scan(docs.unionByName(odd)), con, licences.ORACLE_SQL)
