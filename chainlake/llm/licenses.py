"""License scan by a positional rare-token index, in DataFrame functions only.

Templates are the texts and notices of licenses as word sequences, each with a mandatory key phrase in
it. The words of the key phrases get their document frequencies over the whole corpus. The index posts
every phrase under its two rarest words (highest IDF), with their offsets. A file that holds rare words
has their positions looked up; a posting of a word at offset o, for a word at position p, says that the
phrase begins at p - o, and the postings of a phrase's two words are intersected by that relative
position. What both name is verified word by word, and the rest of the template is compared position by
position around it: the share of template words in place is the hit's score.

Texts without any looked-up word leave the plan before their words are split. There is no shuffle
but the one of the frequencies (a row a vocabulary word), and no join: a document's hits are
computed in its own row, whatever its id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_GAP, LOWER, UPPER, fresh, read_table

#: Phrases of the contract, each a template of its own.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed values: (label, template, mandatory key phrase within it), the public wording of licenses and of their notices.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "permission to use copy modify and or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software", "permission is granted to anyone to use this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
)


def _normalised(text: str) -> Column:
    """Lower-case words with one blank between them, and none at the ends."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(plain, ALNUM_GAP, " "))


def frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the (built-in, so bounded) vocabulary stands."""
    words = F.split(_normalised(text), " ")
    mine = F.array(*map(F.lit, vocabulary))
    rows = docs.select(F.explode(F.array_intersect(mine, words)).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def postings(phrases: Mapping[str, list[str]], df: Mapping[str, int]) -> dict[str, list[tuple[str, int]]]:
    """By phrase its two rarest words (one, of a phrase of one word) with their offsets, the rarest first."""
    out = {}
    for p, words in phrases.items():
        by_word = {w: i for i, w in reversed(list(enumerate(words)))}
        out[p] = sorted(by_word.items(), key=lambda x: (df[x[0]], x[0]))[:2]
    return out


def _equal(words: Column, start: Column, phrase: list[str]) -> Column:
    return F.slice(words, start + 1, len(phrase)) == F.array(*map(F.lit, phrase))


def scan(
    docs: DataFrame,
    text: str = "text",
    base: Mapping[str, str] = BASE,
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES,
) -> DataFrame:
    """docs with `license`: struct(n_words, base, hits); every row and column is kept.

    base: array of struct(label, start), the places of the base phrases, hits: array of
    struct(label, start, score), the places of the templates' key phrases with the share of template
    words in place; start counts words from 0. Null and empty texts have no words and empty arrays. Whole
    texts are read, however long; repeated rows stay, equal texts get equal results, and an empty table
    stays empty. If docs has a column `license`, in any case of letters, it is replaced.
    """
    phrases = {p: p.split() for p in [*base, *(k for _, _, k in templates)]}
    df = frequencies(docs, text, sorted({w for p in phrases.values() for w in p}))
    posted = postings(phrases, df)
    anchors = sorted({w for rare in posted.values() for w, _ in rare})
    rarest = sorted({rare[0][0] for rare in posted.values()})
    norm, words, at = (fresh(docs, x) for x in ("lic_norm", "lic_words", "lic_at"))
    docs = docs.drop("license")
    spaced = F.concat(F.lit(" "), F.col(norm), F.lit(" "))
    gate = F.lit(False)
    for a in rarest:
        gate = gate | F.contains(spaced, F.lit(f" {a} "))
    none = F.array().cast("array<string>")
    out = docs.withColumn(norm, _normalised(text))
    out = out.withColumn(words, F.when(gate, F.split(norm, " ")).otherwise(none))
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(anchors))
    out = out.withColumn(at, F.when(F.size(words) > 0, placed).otherwise(F.array().cast("array<struct<w:string,i:int>>")))

    def named(word: str, offset: int) -> Column:
        """Where the phrase would begin, by one word's posting."""
        return F.transform(F.filter(at, lambda x: x["w"] == word), lambda x: x["i"] - offset)

    def starts(phrase: str) -> Column:
        first, *rest = (named(*x) for x in posted[phrase])
        for other in rest:
            first = F.array_intersect(first, other)
        return F.filter(first, lambda s: (s >= 0) & _equal(F.col(words), F.greatest(s, F.lit(0)), phrases[phrase]))

    def score(start: Column, template: str, phrase: str) -> Column:
        t, w = template.split(), phrase.split()
        off = next(i for i in range(len(t)) if t[i : i + len(w)] == w)
        text_ = F.array(*map(F.lit, t))
        same = F.filter(F.sequence(F.lit(0), F.lit(len(t) - 1)), lambda j: F.get(F.col(words), start + j - off) == F.get(text_, j))
        return F.size(same) / F.lit(len(t))

    def place(label: str, phrase: str) -> Column:
        return F.transform(starts(phrase), lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))

    def hit(label: str, template: str, phrase: str) -> Column:
        made = lambda s: F.struct(F.lit(label).alias("label"), s.alias("start"), score(s, template, phrase).alias("score"))
        return F.transform(starts(phrase), made)

    places = [place(label, p) for p, label in base.items()]
    hits = [hit(*t) for t in templates]
    n_words = F.when(F.col(norm) == "", 0).otherwise(F.length(norm) - F.length(F.translate(norm, " ", "")) + 1)
    found = F.size(at) > 0
    empty = F.array().cast("array<struct<label:string,start:int>>")
    empty_hits = F.array().cast("array<struct<label:string,start:int,score:double>>")
    return out.select(
        *docs.columns,
        F.struct(
            n_words.cast("long").alias("n_words"),
            F.when(found, F.flatten(F.array(*places))).otherwise(empty).alias("base"),
            F.when(found, F.flatten(F.array(*hits))).otherwise(empty_hits).alias("hits"),
        ).alias("license"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
    base = F.transform("base", lambda x: x["label"])
    labels = F.array_union(base, F.transform("hits", lambda x: x["label"]))
    start = F.transform("base", lambda x: x["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    lit = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
    base = ", ".join(f"('{b}', {lit(p)})" for p, b in BASE.items())
    rows = []
    for label, t, k in TEMPLATES:
        tw, kw = t.split(), k.split()
        off = next(i for i in range(len(tw)) if tw[i : i + len(kw)] == kw)
        rows.append(f"('{label}', {lit(t)}, {lit(k)}, {off})")
    # every phrase has one of these words: only texts with one need a closer look
    longest = sorted({max(p.split(), key=len) for p in [*BASE, *(k for _, _, k in TEMPLATES)]})  # its longest
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT r, w FROM d WHERE list_has_any(w, {longest})),
b(label, p) AS (VALUES {base}),
t(label, tw, kw, off) AS (VALUES {", ".join(rows)}),
bp AS (SELECT r, label, i - 1 AS start FROM (SELECT r, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM c, b) WHERE w[i:i + len(p) - 1] = p),
tp AS (SELECT r, label, list_sum(list_transform(range(1, len(tw) + 1), lambda j: CASE WHEN i - off + j - 1 >= 1 AND w[i - off + j - 1] = tw[j] THEN 1 ELSE 0 END)) / len(tw) AS score
       FROM (SELECT r, w, label, tw, kw, off, unnest(range(1, len(w) - len(kw) + 2)) AS i FROM c, t) WHERE w[i:i + len(kw) - 1] = kw),
ba AS (SELECT r, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM bp GROUP BY r),
la AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM bp UNION ALL SELECT r, label FROM tp) GROUP BY r),
sc AS (SELECT r, max(score) AS s FROM tp GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(ba.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(ba.l, '') AS base_labels, coalesce(la.l, '') AS labels, CAST(coalesce(s, 0) AS DOUBLE) AS score
FROM d LEFT JOIN ba USING (r) LEFT JOIN la USING (r) LEFT JOIN sc USING (r)
"""


SQL8 = _sql()
