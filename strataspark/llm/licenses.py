"""License scans through a positional index of rare words.

Licence templates are notices and whole licence texts. Each template is posted under its RARE_WORDS
words of highest inverse document frequency, taken from counts over all scanned
texts, with their positions. A text's words that the index knows are looked up;
word position minus template position gives the relative position at which the
template would start. Relative positions that enough rare words agree on are
verified: the template's mandatory key phrase must stand there word by word. The
score is the largest share of a verified template's words that stand in place.

Everything is DataFrame operations, one pass for the counts and one for the
lookup, without a shuffle of texts: a text meets only the templates, which are
a fixed table.

Defined results: a null text is an empty one: no words, no labels (empty
strings), null positions, score 0. Repeated rows are scanned alike; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE_WORDS = 4
#: Share of a template's posted words that must agree on a relative position.
AGREE = 0.5

# The base phrases and their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)


@dataclass(frozen=True)
class Template:
    """A licence notice in lower-case words, and the phrase of it that must be there."""

    label: str
    notice: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


# Wordings of public licence notices.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("gpl-2.0", "under the terms of the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "under the terms of the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd", "licensed under the bsd 3 clause license", "bsd 3 clause license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    Template("cc-by", "licensed under cc by 4 0", "cc by"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("reserved", "copyright all rights reserved", "all rights reserved"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
        "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
        "without limitation the rights to use copy modify merge publish distribute sublicense",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
        "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
        "this software",
        "the author disclaims all warranties with regard to this software",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not "
        "be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in "
        "the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must "
        "not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
        "altered source versions must be plainly marked as such",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct "
        "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
        "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such "
        "damage",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
)


def words_of(text: Column) -> Column:
    """The text's words as an array; empty for a null text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    spaced = F.trim(F.regexp_replace(lowered, NOT_WORD, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def vocabulary(templates: Iterable[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def inverse_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """log((1 + texts) / (1 + texts with the word)) of each template word, over all texts."""
    known = F.array(*map(F.lit, vocabulary(templates)))
    # null stands for the text itself, so that one count has both figures
    found = docs.select(F.array_intersect(words_of(F.col("text")), known).alias("w")).select(
        F.explode(F.concat(F.col("w"), F.array(F.lit(None).cast("string")))).alias("word")
    )
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = counts.get(None, 0)
    return {w: math.log((1 + n) / (1 + counts.get(w, 0))) for w in vocabulary(templates)}


def index(idf: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, int, int]]:
    """Postings (word, template, position) of each template's words of highest IDF."""
    postings = []
    for k, t in enumerate(templates):
        rare = sorted(set(t.words), key=lambda w: (-idf[w], w))[:RARE_WORDS]
        postings += [(w, k, i) for i, w in enumerate(t.words) if w in rare]
    return postings


def _phrase_at(words: Column, at: Column, phrase: list[str]) -> Column:
    """Whether the phrase's words stand consecutively from index ``at`` (from 0)."""
    same = [F.get(words, at + i) == F.lit(w) for i, w in enumerate(phrase)]
    out = F.coalesce(same[0], F.lit(False))
    for s in same[1:]:
        out = out & F.coalesce(s, F.lit(False))
    return out


def _places(words: Column, wanted: Column, first: str, phrase: list[str]) -> Column:
    """Indices (from 0) at which the phrase starts; texts that aren't ``wanted`` have none."""
    places = F.filter(
        F.transform(words, lambda w, i: F.when((w == first) & _phrase_at(words, i, phrase), i)),
        lambda i: i.isNotNull(),
    )
    return F.when(wanted, places).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``keep`` columns, the contract's counts, labels and score, and ``matches``:
    the verified templates (label, template, start, coverage) of each text."""
    postings = index(inverse_frequencies(docs, templates), templates)
    rare = sorted({w for w, _, _ in postings})
    by_word = {w: [(k, i) for v, k, i in postings if v == w] for w in rare}
    posted = {k: sum(1 for _, kk, _ in postings if kk == k) for k in range(len(templates))}

    words = F.col("__words")
    out = docs.select(*keep, words_of(F.col("text")).alias("__words"))
    gates = [F.array_contains(words, p.split()[-1]) for p, _ in BASE]
    out = out.withColumns(
        {
            "__rare": F.arrays_overlap(words, F.array(*map(F.lit, rare))),
            **{f"__gate{j}": g for j, g in enumerate(gates)},
        }
    )
    base = {
        f"__base{j}": _places(words, F.col(f"__gate{j}"), p.split()[0], p.split()) for j, (p, _) in enumerate(BASE)
    }
    # words of the index with their positions, then (template, relative position)
    lookup = F.create_map(
        *[
            x
            for w in rare
            for x in (
                F.lit(w),
                F.array(*[F.struct(F.lit(k).alias("t"), F.lit(i).alias("i")) for k, i in by_word[w]]),
            )
        ]
    )
    # a list this long is looked up by hash
    hits = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(*rare), F.struct(w.alias("w"), i.alias("i")))),
        lambda h: h.isNotNull(),
    )
    none = F.array().cast("array<struct<t: int, o: int>>")
    out = out.withColumns({**base, "__hits": F.when(F.col("__rare"), hits)})
    starts = F.flatten(
        F.transform(
            F.col("__hits"),
            lambda h: F.transform(
                F.element_at(lookup, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["i"]).alias("o"))
            ),
        )
    )
    out = out.withColumn("__starts", F.coalesce(F.when(F.col("__rare"), starts), none))
    needed = F.array(*[F.lit(max(1, math.ceil(posted[k] * AGREE))) for k in range(len(templates))])
    # sorted, equal (template, start) pairs stand together; the run's end sees its length
    ordered = F.array_sort("__starts")
    out = out.withColumn("__sorted", ordered)
    agreed = F.array_distinct(
        F.filter(
            F.col("__sorted"),
            lambda s, i: F.get(F.col("__sorted"), i + F.get(needed, s["t"]) - 1) == s,
        )
    )
    out = out.withColumn("__agreed", agreed)
    texts = F.array(*[F.array(*map(F.lit, t.words)) for t in templates])
    labels = F.array(*[F.lit(t.label) for t in templates])
    keys = F.array(
        *[
            F.struct(F.lit(t.key_at).alias("at"), F.array(*map(F.lit, t.key_words)).alias("words"))
            for t in templates
        ]
    )
    verified = F.filter(
        F.col("__agreed"),
        lambda s: (s["o"] + F.get(keys, s["t"])["at"] >= 0)
        & (
            F.slice(words, s["o"] + F.get(keys, s["t"])["at"] + 1, F.size(F.get(keys, s["t"])["words"]))
            == F.get(keys, s["t"])["words"]
        ),
    )
    out = out.withColumn("__verified", verified)
    in_place = lambda s: F.aggregate(
        F.transform(
            F.get(texts, s["t"]),
            lambda w, i: F.when((s["o"] + i >= 0) & (F.get(words, s["o"] + i) == w), 1.0).otherwise(0.0),
        ),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    out = out.withColumn(
        "matches",
        F.transform(
            F.col("__verified"),
            lambda s: F.struct(
                F.get(labels, s["t"]).alias("label"),
                s["t"].alias("template"),
                s["o"].alias("start"),
                (in_place(s) / F.size(F.get(texts, s["t"]))).alias("coverage"),
            ),
        ),
    )
    all_places = F.concat(*[F.col(f"__base{j}") for j in range(len(BASE))])
    base_labels = F.array_compact(
        F.array(*[F.when(F.size(f"__base{j}") > 0, F.lit(label)) for j, (_, label) in enumerate(BASE)])
    )
    own_labels = F.transform("matches", lambda m: m["label"])
    best = F.array_max(F.transform("matches", lambda m: m["coverage"]))
    return out.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own_labels))), ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        "matches",
    )
