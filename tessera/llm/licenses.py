"""Licence scans by a positional rare-token index, in DataFrame expressions alone.

Templates are word sequences with a label, a share of words that must match and a mandatory key phrase inside them. The
index holds, for each template, its words of highest inverse document frequency over all documents with their
positions: as many as the words that may be missing, and one more, so a passage that matches well enough holds at
least one of them at its place. Each file's words look the index up; a posting at position p of the template met at word w
of the file proposes the alignment w - p; the template's other words are then intersected at their relative positions
and the key phrase must stand complete. The index has at most a few hundred entries, fixed by the templates, and goes
into the plan as a literal; nothing but document frequencies of licence words is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower

#: The base phrases and their labels; all of their words must match.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Phrases of well-known licences. Label, words, share of words that must match, mandatory key phrase.
TEMPLATES = (
    ("mit", "released under the mit license", 0.8, "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8, "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", 0.8, "apache license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", 0.75, "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", 0.75, "general public license version 2"),
    ("lgpl", "gnu lesser general public license", 1.0, "lesser general public license"),
    ("agpl", "gnu affero general public license", 1.0, "affero general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.8, "free software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.8, "source and binary forms"),
    ("bsd", "released under the bsd license", 0.8, "bsd license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", 0.75, "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8, "with or without fee"),
    ("cc-by", "licensed under a creative commons attribution license", 0.75, "creative commons attribution"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", 0.85, "apache org licenses license 2 0"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 0.9, "version 2 of the license"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.9, "gnu general public license as published by the free software foundation either version 3"),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", 0.9, "either version 2 1"),
    ("lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.9, "gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.9, "gnu affero general public license as published by the free software foundation either version 3"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.85, "retain the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 0.8, "endorse or promote products derived from this software"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", 0.9, "copy of the mpl"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 0.85, "eclipse public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 0.8, "common development and distribution license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.85, "person or organization obtaining a copy"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 0.85, "authors be held liable"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", 0.8, "related or neighboring rights"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", 0.8, "attribution 4 0 international"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", 0.8, "attribution sharealike"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 0.8, "sil open font license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0.85, "without a written agreement"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 0.85, "governs use of the accompanying software"),
    ("python-2.0", "python software foundation license version 2", 1.0, "python software foundation license"),
    ("eupl-1.2", "licensed under the eupl version 1 2", 0.85, "eupl version 1 2"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish", 0.85, "to deal with the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.8, "released into the public domain"),
)
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates() -> list[tuple]:
    """Number, label, words, how many must match, key phrase's place and length, base or not."""
    rows = []
    for label, text, share, key in [*((label, text, 1.0, text) for label, text in BASE), *TEMPLATES]:
        words, phrase = text.split(), key.split()
        at = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
        rows.append((len(rows), label, words, math.ceil(share * len(words) - 1e-9), at, len(phrase), len(rows) < len(BASE)))
    return rows


def words_of(text: Column) -> Column:
    """A text's words: A-Z in lower case, cut at ASCII characters that are no letters or digits; null gives none."""
    return F.array_remove(F.split(ascii_lower(text), _SPLIT), "")


def index(docs: DataFrame) -> dict[str, list[tuple[int, int]]]:
    """The index: for each template's rarest words by document frequency over docs, templates and places.

    At most one entry for each word of a template, so its size is fixed by the templates.
    """
    lexicon = F.array(*[F.lit(w) for w in sorted({w for row in _templates() for w in row[2]})])
    counted = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), lexicon)).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counted.collect()}
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, _, words, need, *_ in _templates():
        rarest = sorted(range(len(words)), key=lambda k: (frequency.get(words[k], 0), words[k], k))
        for place in rarest[: len(words) - need + 1]:
            postings.setdefault(words[place], []).append((number, place))
    return postings


def alignments(words: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """The verified alignments of a file's words: template, label, base, start and coverage, each once."""
    known = F.array(*[F.lit(w) for w in postings])
    places = F.array(*[F.array(*[F.struct(F.lit(t).alias("template"), F.lit(p).alias("place")) for t, p in found]) for found in postings.values()])
    templates = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, own)).alias("words"), F.lit(need).alias("need"), F.lit(at).alias("key_at"), F.lit(n).alias("key_length"), F.lit(base).alias("base")) for _, label, own, need, at, n, base in _templates()])
    met = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(known, w).cast("int").alias("k"), i.alias("at"))), lambda m: m["k"] > 0)
    proposed = F.array_distinct(F.flatten(F.transform(met, lambda m: F.transform(F.get(places, m["k"] - 1), lambda p: F.struct(p["template"].alias("template"), (m["at"] - p["place"]).alias("start"))))))

    def same(own: Column, start: Column):
        return lambda i: F.coalesce(F.get(words, start + i) == F.get(own, i), F.lit(False))

    def judged(h: Column) -> Column:
        t = F.get(templates, h["template"])
        matched = F.size(F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), same(t["words"], h["start"])))
        phrase = F.forall(F.sequence(t["key_at"], t["key_at"] + t["key_length"] - 1), same(t["words"], h["start"]))
        verified = (matched >= t["need"]) & phrase
        return F.when(verified, F.struct(h["template"].alias("template"), t["label"].alias("label"), t["base"].alias("base"), h["start"].alias("start"), (matched / F.size(t["words"])).alias("coverage")))

    return F.filter(F.transform(proposed, judged), lambda a: a.isNotNull())


def license_matches(docs: DataFrame) -> DataFrame:
    """Every verified passage as a row: doc_id, label, first_word, behind_word and coverage; files without one give none."""
    found = docs.select("doc_id", F.explode(alignments(words_of(F.col("text")), index(docs.select("text")))).alias("a"))
    lengths = F.array(*[F.lit(len(row[2])) for row in _templates()])
    return found.select("doc_id", F.col("a.label").alias("label"), F.col("a.start").alias("first_word"), (F.col("a.start") + F.get(lengths, F.col("a.template"))).alias("behind_word"), F.col("a.coverage").alias("coverage"))


def license_scan(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is the best share of a template's words that match, 0 where no template does. Null and empty texts have no
    words and no labels. Rows that repeat get equal results; a null doc_id keeps its row. An empty table gives no
    rows. Only doc_id and text are read, so other columns may have any name. A row is worked on by itself: its memory
    is that of its words and matches.
    """
    files = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    postings = index(docs.select("text"))
    # Files without any word of the index need no look-ups; overlap hashes the words once.
    looked = F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in postings])), F.col("words")).otherwise(F.array().cast("array<string>"))
    files = files.select("doc_id", F.size("words").cast("long").alias("n_words"), looked.alias("words"))
    found = files.select("doc_id", "n_words", alignments(F.col("words"), postings).alias("found"))
    base = F.filter("found", lambda a: a["base"])
    starts = F.transform("base", lambda a: a["start"].cast("long"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda a: a["label"]))), ",")
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"), names("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda a: a["coverage"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """The same rows by brute force: every template word against every word, without the index."""
    values = ", ".join(
        f"({number}, '{label}', {place}, '{word}', {len(words)}, {need}, {key_at <= place < key_at + key_length}, {key_length}, {base})"
        for number, label, words, need, key_at, key_length, base in _templates()
        for place, word in enumerate(words)
    )
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with template(number, label, place, word, n, need, in_key, key_length, base) as (values {values}),
file as (select doc_id, list_filter(string_split_regex({lower}, '{_SPLIT}'), lambda x: x <> '') as words from documents),
placed as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as spot from file),
aligned as (
  select doc_id, number, label, base, spot - place as start, count(*) / max(n) as coverage
  from placed join template using (word) group by doc_id, number, label, base, spot - place
  having count(*) >= max(need) and count(*) filter (where in_key) = max(key_length)),
found as (
  select doc_id, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word, max(start) filter (where base) as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (where base), '') as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(coverage) as score
  from aligned group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from file left join found using (doc_id)
"""


ORACLE_SQL = _sql()
