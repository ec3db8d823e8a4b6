"""License scans by a positional rare-token index, in DataFrame functions only.

Words are runs of digits, lower-cased ASCII letters and other non-ASCII characters. Base places are where one of three
phrases stands. The method:

1. The document frequency of every word of the licence templates is counted over the whole corpus.
2. The index holds, for each template, the places of its few words of highest inverse document frequency.
3. A file's words are looked up in it; each hit votes for a template at a relative position (place in the file less place in
   the template). Votes for one template fall together if their relative positions differ by up to a tenth of its length, so
   that names filled in and words left out don't part them; a place of the template counts once.
4. A template is accepted if enough of its indexed places (LEAST_SHARE) are hit at one relative position, and each of its
   mandatory key phrases stands in the file. Every template is judged by its own words: no notice crowds out another.

A text that only names a licence hits the few words of the name and is not labelled by the method (a base label stays).

Null and empty texts have no words, no places, no labels and score 0. Very long texts are read whole. Of words of equal
frequency the first by spelling are indexed. Repeated rows get equal results, and count each in the frequencies. Other
columns are never read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.llm.rules import let

#: Phrases of the base rule and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Texts of public licences and of the usual notices, each with its label and the key phrases that must stand.
TEXTS: list[tuple[str, str, list[str]]] = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "SPDX-License-Identifier: MIT", ["spdx license identifier mit"]),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction""",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache", "SPDX-License-Identifier: Apache-2.0", ["spdx license identifier apache"]),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ["apache license", "unless required by applicable law or agreed to in writing"],
    ),
    ("gpl", "Licensed under the GNU General Public License", ["gnu general public license"]),
    ("gpl", "under the terms of the GNU General Public License", ["gnu general public license"]),
    ("gpl", "SPDX-License-Identifier: GPL", ["spdx license identifier gpl"]),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        ["gnu general public license", "free software foundation"],
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    ("agpl", "Licensed under the GNU Affero General Public License", ["gnu affero general public license"]),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met""",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ["redistribution and use in source and binary forms", "redistributions of source code must retain"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ["permission to use copy modify and or distribute this software"],
    ),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ["mozilla public license", "this source code form is subject to the terms"],
    ),
    ("mpl", "Licensed under the Mozilla Public License", ["mozilla public license"]),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        ["free and unencumbered software released into the public domain"],
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ["permission is granted to anyone to use this software for any purpose"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("cc-by", "CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa", "CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc", "CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
]
#: Words of a template that are indexed, and the share of their places that must be hit at one relative position.
INDEX_WORDS, LEAST_SHARE = 12, 0.8
#: Every key phrase, with whatever breaks between its words, matches this; texts that don't are not looked up.
ANCHOR = r"(?i)licen[sc]|permission|redistribution|unencumbered|waived|creative[^a-z0-9]+commons|cc[^a-z0-9]+by"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates as words.
TEMPLATES = [(label, [w for w in re.split(_BREAKS, text.lower()) if w], phrases) for label, text, phrases in TEXTS]
VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t})


def drift(words: list[str]) -> int:
    """Relative positions of a template that fall together: this many neighbouring ones."""
    return max(1, len(words) // 10)


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, _BREAKS), lambda w: w != "")


def frequencies(documents: DataFrame, text: str = "text") -> dict[str, int]:
    """How many documents hold each licence word (a bounded number of words), over all documents."""
    own = F.array_distinct(F.filter(words_of(F.col(text)), lambda w: w.isin(VOCABULARY)))
    counts = {r["w"]: r["n"] for r in documents.select(F.explode(own).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in VOCABULARY}


def postings(words: list[str], frequency: dict[str, int]) -> dict[str, list[int]]:
    """The places of a template's rarest words."""
    rare = sorted(set(words), key=lambda w: (frequency[w], w))[:INDEX_WORDS]
    return {w: [i for i, x in enumerate(words) if x == w] for w in rare}


def _phrase_places(words: Column, joined: Column, phrase: str) -> Column:
    """Where the phrase starts, as word numbers from 0; texts without it are not walked."""
    parts = phrase.split()

    def walk(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - len(parts))

        def stands(i: Column) -> Column:
            here = w[i] == parts[0]
            for k, p in enumerate(parts[1:], 1):
                here = here & (w[i + k] == p)
            return here

        return F.filter(at, stands)

    return F.when((F.size(words) >= len(parts)) & joined.contains(f" {phrase} "), walk(words)).otherwise(F.array().cast("array<int>"))


def _longest_run(values: Column) -> Column:
    """How often the most frequent value stands in an array of ints."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.sort_array(values), start, step, lambda s: s["best"])


def _votes(words: Column, index: dict[str, list[int]], width: int) -> Column:
    """The most places of a template that are hit at relative positions that fall together.

    Relative positions are cut into stretches of width, and again half a stretch later, so that few are parted by a cut."""
    table = F.create_map(*[x for w, at in index.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
    placed = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda p: p["w"].isin(list(index)))
    hits = F.flatten(F.transform(placed, lambda x: F.transform(table[x["w"]], lambda at: F.struct((x["i"] - at).alias("s"), at.alias("p")))))

    def most(hits: Column, shift: int) -> Column:
        if width == 1:
            return _longest_run(F.transform(hits, lambda h: h["s"]))
        once = F.array_distinct(F.transform(hits, lambda h: F.struct(F.floor((h["s"] + shift) / F.lit(width)).cast("int").alias("b"), h["p"].alias("p"))))
        return _longest_run(F.transform(once, lambda h: h["b"]))

    return let(hits, lambda h: most(h, 0) if width == 1 else F.greatest(most(h, 0), most(h, width // 2)))


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document.

    score: the greatest share of its indexed places that an accepted template has at one relative position; at least 1/2
    where a base phrase stands."""
    frequency = frequencies(documents, text)

    def stands(joined: Column, phrases: list[str]) -> Column:
        both = F.lit(True)
        for phrase in phrases:
            both = both & joined.contains(f" {phrase} ")
        return both

    def accepted(w: Column, label: str, words: list[str]) -> Column:
        index = postings(words, frequency)
        places = sum(map(len, index.values()))
        share = _votes(w, index, drift(words)) / F.lit(float(places))
        return let(share, lambda v: F.when(v >= LEAST_SHARE, F.struct(F.lit(label).alias("label"), v.alias("share"))))

    def found(w: Column, joined: Column) -> Column:
        """(label, share) of each accepted template; phrases are looked for first, as the cheaper test. Both must hold."""
        return F.filter(F.array(*[F.when(stands(joined, phrases), accepted(w, label, words)) for label, words, phrases in TEMPLATES]), lambda x: x.isNotNull())

    anchor = F.coalesce(F.col(text), F.lit("")).rlike(ANCHOR)
    cheap = documents.select("doc_id", words_of(F.col(text)).alias("__words"), anchor.alias("__anchor"))
    nothing = F.array().cast("array<struct<label:string,share:double>>")

    def judged(w: Column, anchored: Column) -> Column:
        joined = F.when(anchored, F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))).otherwise(F.lit(" "))
        return let(
            joined,
            lambda j: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.array(*[F.struct(F.lit(label).alias("label"), _phrase_places(w, j, phrase).alias("at")) for phrase, label in BASE.items()]).alias("base"),
                F.when(anchored, found(w, j)).otherwise(nothing).alias("more"),
            ),
        )

    out = cheap.select("doc_id", let(F.struct(F.col("__words").alias("w"), F.col("__anchor").alias("a")), lambda s: judged(s["w"], s["a"])).alias("r"))
    places = F.flatten(F.transform("r.base", lambda b: b["at"]))
    base = F.transform(F.filter("r.base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    return out.select(
        "doc_id",
        F.col("r.n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, F.transform("r.more", lambda m: m["label"])))), ",").alias("labels"),
        F.greatest(F.when(F.size(places) > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("r.more", lambda m: m["share"])), F.lit(0.0)))).alias("score"),
    )


def _sql() -> str:
    def rows(values: list[tuple]) -> str:
        return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in values)

    templates = rows([(k, label, drift(t)) for k, (label, t, _) in enumerate(TEMPLATES)])
    every = rows([(k, w, i) for k, (_, t, _) in enumerate(TEMPLATES) for i, w in enumerate(t)])
    phrases = rows([(k, phrase) for k, (_, _, all_) in enumerate(TEMPLATES) for phrase in all_])
    places = []
    for phrase, label in BASE.items():
        parts = phrase.split()
        stands = " AND ".join(f"ws[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"list_filter(range(0, len(ws) - {len(parts) - 1}), lambda i: {stands}) AS {label}")
    at = "list_concat(list_concat(mit, apache), gpl)"
    return f"""
WITH tmpl(tid, label, width) AS (VALUES {templates}), allpost(tid, w, pos) AS (VALUES {every}), phr(tid, phrase) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, regexp_matches(t, '{ANCHOR}') AS anchored,
        list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BREAKS}'), lambda x: x <> '') AS ws FROM d),
b AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS joined, {", ".join(places)} FROM l),
x AS (SELECT rid, anchored, i, w FROM (SELECT rid, anchored, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM l) WHERE w IN (SELECT w FROM allpost)),
df AS (SELECT w, count(DISTINCT rid) AS n FROM x GROUP BY w),
post AS (SELECT tid, w, pos FROM allpost JOIN (SELECT tid, w, row_number() OVER (PARTITION BY tid ORDER BY coalesce(n, 0), w) AS r FROM (SELECT DISTINCT tid, w FROM allpost) LEFT JOIN df USING (w)) USING (tid, w) WHERE r <= {INDEX_WORDS}),
size AS (SELECT tid, count(*)::DOUBLE AS places FROM post GROUP BY tid),
kept AS (SELECT rid, tid FROM b, (SELECT tid, list(phrase) AS ps FROM phr GROUP BY tid) WHERE anchored AND len(list_filter(ps, lambda p: NOT contains(joined, ' ' || p || ' '))) = 0),
votes AS (SELECT rid, tid, max(c) AS v FROM (SELECT rid, tid, shift, floor((i - pos + CASE shift WHEN 0 THEN 0 ELSE width // 2 END) / width) AS stretch, count(DISTINCT pos) AS c
        FROM x JOIN post USING (w) JOIN kept USING (rid, tid) JOIN tmpl USING (tid), (VALUES (0), (1)) AS g(shift) GROUP BY ALL) GROUP BY rid, tid),
more AS (SELECT rid, list(label) AS labels, max(v / places) AS share FROM votes JOIN tmpl USING (tid) JOIN size USING (tid) WHERE v / places >= {LEAST_SHARE} GROUP BY rid),
f AS (SELECT b.rid, doc_id, len(ws) AS n_words, {at} AS places, list_filter(['apache', 'gpl', 'mit'], lambda k: CASE k WHEN 'mit' THEN len(mit) WHEN 'gpl' THEN len(gpl) ELSE len(apache) END > 0) AS base, coalesce(more.labels, []) AS more, coalesce(share, 0) AS share FROM b LEFT JOIN more ON more.rid = b.rid)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels, greatest(CASE WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE, least(1.0::DOUBLE, share::DOUBLE)) AS score FROM f
"""


ORACLE_SQL = _sql()
