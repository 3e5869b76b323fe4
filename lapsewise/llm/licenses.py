"""Licences that texts name or quote: a positional index of licence words. Built-in expressions only.

A template is an excerpt of a licence, or the words that name it; some of its phrases are mandatory. The index has a
posting (template, place) for every word of every template. A file is looked up by its rarest licence words: a template
is open for a file only if the file has that word of its mandatory phrases which the fewest files have. Words of the file
then meet the postings of open templates, and postings that agree on where the template would begin are intersected:
the template stands there if every word of its mandatory phrases is in its place, and ``LEAST`` of all its words are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm import shared

#: Words in texts as they are, before A-Z become small letters: ASCII letters and digits, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Share of a template's words that must be in place.
LEAST = 0.8

#: Words that nearly every file has are not in the index; phrases are known by their other words and the gaps between.
COMMON = {"a", "and", "any", "are", "for", "in", "is", "of", "or", "that", "the", "this", "to", "with"}


@dataclass(frozen=True)
class Template:
    """``mandatory`` phrases are parts of ``text``; without any, all of it is mandatory."""

    label: str
    text: str
    mandatory: tuple[str, ...] = ()
    base: bool = False

    @cached_property
    def words(self) -> list[tuple[int, str]]:
        """Places and words of the index."""
        return [(k, w) for k, w in enumerate(self.text.split()) if w not in COMMON]

    @cached_property
    def needed(self) -> list[int]:
        """Which of ``words`` belong to a mandatory phrase."""
        every, held = self.text.split(), set()
        for phrase in self.mandatory or (self.text,):
            size = len(phrase.split())
            at = next(k for k in range(len(every)) if every[k : k + size] == phrase.split())
            held |= set(range(at, at + size))
        return [n for n, (k, _) in enumerate(self.words) if k in held]


#: Phrases of the base, then wordings of well-known licences.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("apache-2.0", "apache license version 2 0"),
    Template("gpl-2.0", "general public license version 2"),
    Template("gpl-3.0", "general public license version 3"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("epl", "eclipse public license"),
    Template("bsd", "bsd license"),
    Template("boost", "boost software license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "associated documentation files"),
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and", "with or without fee is hereby granted"),
    ),
    Template(
        "apache-text",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license", "obtain a copy of the license"),
    ),
    Template(
        "gpl-text",
        "it under the terms of the gnu general public license as published by the free software foundation",
        ("under the terms of the gnu", "as published by the free software foundation"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for _, w in t.words})


def found(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The whole texts read once: doc_id, ``row``, n_words, and ``hits``, the places and words that are in the index."""
    known = vocabulary(templates)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"),
    )
    numbered = F.transform("words", lambda w, k: F.struct(k.alias("at"), w.alias("word")))
    # letters beyond ASCII that turn into ASCII ones are other letters
    hits = F.filter(F.filter(numbered, lambda h: F.lower(h["word"]).isin(known)), lambda h: h["word"].rlike("^[0-9A-Za-z]+$"))
    small = F.transform(hits, lambda h: F.struct(h["at"].alias("at"), F.lower(h["word"]).alias("word")))
    return slim.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), small.alias("hits"))


def _held(hits: str) -> Column:
    return F.array_distinct(F.transform(hits, lambda h: h["word"]))


def frequencies(matches: DataFrame) -> dict[str, int]:
    """Number of files that have each word of the index, over all files; at most a number for each word of the index."""
    words = matches.select(F.explode(_held("hits")).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in words.collect()}


def rarest(templates: tuple[Template, ...], files: dict[str, int]) -> list[str]:
    """Of each template the word of its mandatory phrases with the highest inverse document frequency."""
    return [min((files.get(t.words[n][1], 0), t.words[n][1]) for n in t.needed)[1] for t in templates]


def places(matches: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row for each place where a template stands: row, label, base, start (word number), share of its words in place."""
    spark = matches.sparkSession
    keys = rarest(templates, frequencies(matches))
    postings = [(w, n, k, 1 << bit) for n, t in enumerate(templates) for bit, (k, w) in enumerate(t.words)]
    postings = spark.createDataFrame(postings, "word string, template int, place int, bit long")
    known = [(n, t.label, t.base, sum(1 << b for b in t.needed), len(t.words)) for n, t in enumerate(templates)]
    known = spark.createDataFrame(known, "template int, label string, base boolean, needed long, size int")

    lookup = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(word).alias("word")) for n, word in enumerate(keys)])
    opened = F.transform(F.filter(lookup, lambda k: F.array_contains("held", k["word"])), lambda k: k["template"])
    files = matches.where(F.size("hits") > 0).select("row", "hits", _held("hits").alias("held"))
    files = files.select("row", "hits", opened.alias("open")).where(F.size("open") > 0)
    words = files.select("row", "open", F.inline("hits"))
    # both tables are as large as the templates, whatever the files are
    met = words.join(F.broadcast(postings), "word").where(F.array_contains("open", F.col("template")))
    agreed = met.groupBy("row", "template", (F.col("at") - F.col("place")).alias("start")).agg(F.bit_or("bit").alias("seen"))
    judged = agreed.join(F.broadcast(known), "template").withColumn("share", F.bit_count("seen") / F.col("size"))
    complete = F.col("seen").bitwiseAND(F.col("needed")) == F.col("needed")
    return judged.where(complete & (F.col("share") >= LEAST)).select("row", "label", "base", F.col("start").cast("long").alias("start"), "share")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): its licences and where the base phrases stand.

    doc_id, ``row``, n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest word
    number; null without any), ``base_labels`` and ``labels`` (sorted arrays), score (the largest share of a template's
    words that stand in place among those found; 0 without any). Only A-Z are made small. Null and empty texts have no
    words and no labels; repeated rows are scanned one by one; a null doc_id stays null. Other columns are not read. An
    empty table gives no rows. ``docs`` is read once, whole; words of the index alone are kept and shuffled.
    """
    matches = shared.stored(found(docs, templates))
    base = F.col("base")
    of_row = places(matches, templates).groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    none = F.array().cast("array<string>")
    return matches.select("doc_id", "row", "n_words").join(of_row, "row", "left").select(
        "doc_id",
        "row",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same scan in SQL, as the numbered query returns it; every place of every template is tried."""
    rows = ",\n    ".join(
        f"({n}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {k}, '{w}', {str(bit in t.needed).lower()})"
        for n, t in enumerate(templates)
        for bit, (k, w) in enumerate(t.words)
    )
    return f"""
with postings(template, label, base, size, place, word, needed) as (values
    {rows}),
docs as (
  select row_number() over () as id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from documents),
numbered as (select id, unnest(words) as word, generate_subscripts(words, 1) - 1 as nth from docs),
agreed as (
  select id, template, any_value(label) as label, any_value(base) as base, nth - place as start,
         count(*) / any_value(size) as share, count(*) filter (where needed) as in_place
  from numbered join postings using (word) group by id, template, nth - place),
placed as (
  select * from agreed
  where share >= {LEAST} and in_place = (select count(*) from postings p where p.template = agreed.template and needed)),
of_doc as (
  select id, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word,
         max(start) filter (where base) as last_word,
         string_agg(distinct label, ',' order by label) filter (where base) as base_labels,
         string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from placed group by id)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0)::double as score
from docs left join of_doc using (id)
"""
