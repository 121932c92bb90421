"""License scans by a positional index of rare words.

Templates are short licence notices as word lists, each with a mandatory key phrase. The index has a posting (word,
template, position) for every word of a template. Words are weighed by their inverse document frequency in the
documents scanned. For each template whose key phrase can stand in a file, the file's highest-IDF word of that phrase
is looked up; its places, less the word's position in the phrase, are the only possible starts. A start counts if the
whole key phrase stands there. Around it, the template's postings are intersected by relative position: the support is
the IDF share of the template's ``RARE`` rarest words that stand where the template has them.

Base phrases are the key phrases of their templates, so every place of a base phrase is found. Other labels also need
a support of ``SUPPORT``.

Everything runs on the row's own word array with Spark's array functions: one aggregate over all documents for the
frequencies (its result has one row per template word) and one scan without shuffle or join.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 4
SUPPORT = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str
    base: bool = False


#: Wording of common licence notices.
TEMPLATES = (
    Template("mit", "released under the mit license", "under the mit license", base=True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", base=True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", base=True),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "dedicated to the public domain under cc0 1 0", "public domain under cc0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
)


def words_of(text: str) -> Column:
    """Words of a text: runs of digits, letters and non-ASCII characters; null counts as empty. Letters are lowered
    beyond A-Z too, which changes no word boundary and no ASCII word of the templates."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def postings(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, int, int]]:
    """The index: (word, template number, position)."""
    return [(w, i, p) for i, t in enumerate(templates) for p, w in enumerate(t.notice.split())]


def inverse_frequencies(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """ln((documents + 1) / (documents with the word + 1)) of every template word, over all rows of ``words``."""
    vocabulary = sorted({w for w, _, _ in postings(templates)})
    held = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    # A null word marks the row itself, so one aggregate counts rows and words.
    marked = words.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), held)).alias("word"))
    have = {r["word"]: r["count"] for r in marked.groupBy("word").count().collect()}
    n = have.pop(None, 0)
    return {w: log((n + 1) / (have.get(w, 0) + 1)) for w in vocabulary}


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "\\'") + "'"


def _starts(key: list[str], idf: dict[str, float]) -> Column:
    """Starts of a key phrase, from the places of its highest-IDF word."""
    at = max(range(len(key)), key=lambda i: (idf[key[i]], -i))
    rare, phrase = _quoted(key[at]), ", ".join(map(_quoted, key))
    return F.expr(f"""
        CASE WHEN array_contains(words, {rare}) THEN
            filter(transform(filter(sequence(0, size(words) - 1), i -> words[i] = {rare}), i -> i - {at}),
                   s -> s >= 0 AND slice(words, s + 1, {len(key)}) = array({phrase}))
        ELSE cast(array() AS array<int>) END
    """)


def _supports(template: Template, starts: str, idf: dict[str, float]) -> Column:
    """For each start of the key phrase, the IDF share of the template's rarest words in place."""
    notice, key = template.notice.split(), template.key.split()
    lead = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
    rare = sorted(range(len(notice)), key=lambda i: (-idf[notice[i]], i))[:RARE]
    total = sum(idf[notice[i]] for i in rare)
    if total <= 0:  # every word is in every document
        return F.expr(f"transform({starts}, s -> 1.0D)")
    terms = " + ".join(
        f"CASE WHEN get(words, s + {i - lead}) = {_quoted(notice[i])} THEN {idf[notice[i]] / total!r}D ELSE 0.0D END"
        for i in rare
    )
    return F.expr(f"transform({starts}, s -> {terms})")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
         templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    n_base counts all places of base phrases, overlapping ones too; first_word and last_word are their smallest and
    largest start in words from 0, null without any. Labels are distinct, sorted and joined by commas; score is the
    largest support of a found template, 0 without any. Null and empty texts have no words. Repeated rows are each
    scanned; a null id is carried through; an empty table gives an empty result; other columns are ignored.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), words_of(text).alias("words"))
    idf = inverse_frequencies(words, templates)
    found = words
    for i, t in enumerate(templates):
        found = found.withColumn(f"s{i}", _starts(t.key.split(), idf))
    found = found.select("*", *[_supports(t, f"s{i}", idf).alias(f"p{i}") for i, t in enumerate(templates)])
    base = [i for i, t in enumerate(templates) if t.base]
    places = F.concat(*[F.col(f"s{i}") for i in base])
    best = [F.coalesce(F.array_max(f"p{i}"), F.lit(-1.0)) for i in range(len(templates))]
    held = [F.size(f"s{i}") > 0 if t.base else best[i] >= SUPPORT for i, t in enumerate(templates)]

    def labels(some: list[int]) -> Column:
        named = F.array(*[F.when(held[i], F.lit(templates[i].label)) for i in some])
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(named))), ",")

    every = list(range(len(templates)))
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(every).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), *[F.when(held[i], best[i]) for i in every])).alias("score"),
    )
