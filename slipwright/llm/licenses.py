"""License scans: a positional index of rare licence words. DataFrame functions only.

The index holds, for every word of the licence templates that isn't a stop word, its places in each template. A file's
postings are its words that the index knows, with their places. Document frequencies over all files give each word its
IDF. For each template whose mandatory phrase stands in the file word by word, the file looks up all places of the
``top`` rarest of that template's words that it has: a pair of a place in the file and a place in the template votes for
the difference of both. Words put in or left out move all that follow, so neighbouring differences vote together: a band
is two neighbouring ranges of ``BAND`` differences, which holds any that are at most ``BAND`` apart, and each word counts
once in it. The template's score is the largest number of words in a band, of the ``top`` or all its words if it has
fewer; it counts if the score reaches ``least``. A short stretch of a long notice has too few of its words, and words of
other licences take no place from a template's own.

Base phrases are labels of their own: every place where their words stand one after another.

Defined cases: a null text is an empty one without words; repeated rows each have their own row; an empty table gives
an empty result; words of a file that no template has are nowhere; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Label, mandatory phrase, and the words of the licence's notice: the permission notices of MIT, ISC, Boost,
# zlib and the BSD licences in full (without copyright lines), the file headers that Apache 2.0, the GNU licences and
# MPL 2.0 recommend in their appendices, the dedications of the Unlicense and CC0, and one-line statements.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "licensed under the apache license", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public license as published by", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details you should have received a copy of the gnu affero general public license along with this program"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "mit license", "this project is released under the mit license"),
    ("bsl", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("zlib", "without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("bsd-3-clause", "neither the name of", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl", "subject to the mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www mozilla org mpl software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations under the license"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("gpl", "gnu general public license as published by", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", "cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "cc by sa 4 0"),
]
STOP = {"the", "a", "of", "to", "and", "or", "in", "is", "it", "this", "that", "you", "any", "not", "with", "as", "at", "for", "if", "was", "be", "are", "an", "on", "one", "can", "may"}
TOP = 24
LEAST = 0.7
BAND = 3

#: Between words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX_WORDS = sorted(({w for _, key, text in TEMPLATES for w in f"{key} {text}".split()} | {w for phrase, _ in PHRASES for w in phrase.split()}) - STOP)
_POSTINGS = "array<struct<word:string,at:int>>"


def words_of(text: Column) -> Column:
    """Lower-cased words. Only A-Z may change: the two other characters whose lower case has an ASCII letter are
    first replaced by some other one outside ASCII."""
    safe = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ⓚ")), F.lit("İ"), F.lit("ⓘ"))
    return F.filter(F.split(F.lower(safe), SEPARATORS), lambda w: w != "")


def _indexed(words: Column) -> Column:
    """Postings: words of the index, with their places from 0."""
    return F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda p: p["word"].isin(INDEX_WORDS)).cast(_POSTINGS)


def _places(words: Column, phrase: str) -> Column:
    """Places where the phrase's words stand one after another."""
    parts = phrase.split()
    k, rare = max(enumerate(parts), key=lambda x: (x[1] not in STOP, len(x[1])))
    starts = F.transform(F.filter(F.transform(words, lambda w, i: F.when(w == rare, i)), lambda i: i.isNotNull()), lambda i: i - k)
    return F.filter(starts, lambda s: F.when(s >= 0, F.slice(words, s + 1, F.lit(len(parts))) == F.array(*map(F.lit, parts))).otherwise(False))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base array of places by phrase, seen: the index words of the file, keys: the templates whose
    mandatory phrase stands in it, postings: of files with such a phrase, which alone look anything up)."""
    words = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    # only words whose neighbours could be a phrase are looked at one by one
    none = F.array().cast("array<int>")
    lower = F.lower("text")

    def placed(phrase: str) -> Column:
        needs = F.coalesce(lower.contains(max(phrase.split(), key=len)), F.lit(False))
        return F.when(needs, _places(F.col("words"), phrase)).otherwise(none)

    keys = {key: F.size(placed(key)) > 0 for _, key, _ in TEMPLATES}
    base = F.array(*[placed(phrase) for phrase, _ in PHRASES])
    seen = F.array_distinct(F.filter("words", lambda w: w.isin(INDEX_WORDS)))
    found = words.select("doc_id", "words", base.alias("base"), seen.alias("seen"), *[c.alias(f"key{k}") for k, c in enumerate(keys.values())])
    number = {key: k for k, key in enumerate(keys)}
    every = F.array(*[F.col(f"key{number[key]}") for _, key, _ in TEMPLATES])
    any_key = F.greatest(*[F.col(f"key{k}") for k in range(len(keys))])
    return found.select("doc_id", F.size("words").cast("long").alias("n_words"), "base", "seen", every.alias("keys"), F.when(any_key, _indexed(F.col("words"))).otherwise(F.array().cast(_POSTINGS)).alias("postings"))


def frequencies(found: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many of them each index word is: at most one row a word comes to the driver."""
    rows = found.select(F.explode("seen").alias("word")).groupBy("word").count()
    return found.count(), {r["word"]: r["count"] for r in rows.collect()}


def _lookup(text: str, top: int) -> Column:
    """The postings of the ``top`` rarest words of a template that the file has."""
    own = sorted({w for w in text.split() if w not in STOP})
    rare = F.slice(F.filter("ranked", lambda w: w.isin(own)), 1, top)
    # an array of one: the rarest words are found once, not for each posting
    return F.flatten(F.transform(F.array(rare), lambda r: F.filter("postings", lambda p: F.array_contains(r, p["word"]))))


def _score(lookup: Column, text: str) -> Column:
    """The most looked-up words in one band of differences of places.

    A vote is one number, the band times ``many`` plus the number of the word: equal votes count once. A difference lies
    in two bands, so its votes are cast for both.
    """
    many = 1 << 10
    number, at = {}, {}
    for k, word in enumerate(text.split()):
        if word not in STOP:
            at.setdefault(word, []).append((number.setdefault(word, len(number)), k))
    index = F.create_map(*[x for w, ks in sorted(at.items()) for x in (F.lit(w), F.array(*[F.lit(n - k * many).cast("long") for n, k in ks]))])
    none = F.array().cast("array<long>")
    votes = F.flatten(F.transform(lookup, lambda p: F.transform(F.coalesce(F.element_at(index, p["word"]), none), lambda o: p["at"].cast("long") * many + o)))
    band = lambda v, side: (F.floor(F.floor(v / many) / BAND).cast("long") - side) * many + F.pmod(v, F.lit(many))
    votes = F.flatten(F.transform(votes, lambda v: F.array(band(v, 0), band(v, 1))))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, vote: Column) -> Column:
        own = F.floor(vote / many).cast("long")
        run = F.when(acc["last"] == own, acc["run"] + 1).otherwise(1)
        return F.struct(own.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(F.array_distinct(votes)), start, step, lambda acc: acc["best"])


def scan(docs: DataFrame, top: int = TOP, least: float = LEAST) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = stored(postings(docs), "postings")
    n, seen = frequencies(found)
    idf = F.create_map(*[x for w in INDEX_WORDS for x in (F.lit(w), F.lit(math.log((1 + n) / (1 + seen.get(w, 0)))))])
    # the distinct words that the file has, rarest first
    ranked = F.array_sort(F.transform("seen", lambda w: F.struct((-F.element_at(idf, w)).alias("rank"), w.alias("word"))))
    # only files with a mandatory phrase look anything up
    rows = found.withColumn("ranked", F.when(F.exists("keys", lambda k: k), F.transform(ranked, lambda r: r["word"])))
    scores = []
    for k, (_, _, text) in enumerate(TEMPLATES):
        known = len({w for w in text.split() if w not in STOP})
        share = _score(_lookup(text, top), text) / F.least(F.lit(top), F.lit(known))
        scores.append(F.when(F.col("keys")[k], F.least(share, F.lit(1.0))).otherwise(0.0))
    rows = rows.withColumn("scores", F.array(*scores))
    every = F.flatten("base")
    base = F.array_compact(F.array(*[F.when(F.size(F.col("base")[k]) > 0, label) for k, (_, label) in enumerate(PHRASES)]))
    method = F.array_compact(F.array(*[F.when(F.col("scores")[k] >= least, label) for k, (label, _, _) in enumerate(TEMPLATES)]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, method))), ",").alias("labels"),
        F.greatest(F.array_max("scores"), F.when(F.size(every) > 0, 1.0).otherwise(0.0)).alias("score"),
    )
