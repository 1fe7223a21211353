"""License scans as an exact set-similarity join, in DataFrame functions only.

Base labels come from phrases of consecutive words.  Further labels come from
joining text blocks (lines) with license templates: a template is found in a
block that holds at least ``CONTAINMENT`` of the template's distinct words.

Template words are ordered by the number of documents of the whole corpus that
have them, rare first.  A block that contains a template must hold one of its
first n - ceil(c * n) + 1 words (prefix filter) and at least ceil(c * n) template
words (length filter, with the least size of all templates).  There is no
positional filter: within the prefix, n - p words always suffice.  What remains
is counted exactly.  The templates are a parameter; their tables (a few hundred
rows) are the only ones broadcast, and nothing grows with a hot word: blocks
meet templates, never each other.

Blocks are lines, or (``wrapped``) also paragraphs and runs of neighbouring
lines, so that a notice wrapped over lines is found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.store import cut

CONTAINMENT = (90, 100)  #: 100 * shared words >= 90 * words of the template

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that name a license, in plain words; the label and its templates.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License"],
    "bsd": ["Redistributions of source code must retain the above copyright notice",
            "Released under the BSD License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "lgpl": ["Licensed under the GNU Lesser General Public License"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "mit-text": ["Permission is hereby granted free of charge to any person obtaining a copy of this software"],
}

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_table(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(template, label, distinct words) of each template with a word."""
    out = []
    for label, texts in templates.items():
        for text in texts:
            words = sorted(set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER)))))
            if words:
                out.append((len(out), label, words))
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda x: x != "")


def _let(value: Column, use) -> Column:
    """use(x) with x bound once to ``value``: lambdas over x don't compute it again."""
    return F.transform(F.array(value), use)[0]


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of rows that have each word of the (bounded) vocabulary, over the whole table."""
    if not vocabulary:
        return {}
    known = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.array_intersect(_words(F.coalesce(F.col("text").cast("string"), F.lit(""))), known))
                        .alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in found.collect()}


def _starts(w: Column, words: list[str]) -> Column:
    """Positions of the array where the words stand consecutively."""
    def here(x: Column, i: Column) -> Column:
        same = x == words[0]
        for k, word in enumerate(words[1:], 1):
            same = same & (F.get(w, i + k) == word)
        return F.coalesce(same, F.lit(False))

    return F.filter(F.transform(w, lambda x, i: F.when(here(x, i), i)), lambda i: i.isNotNull())


def _base(w: Column, phrases: dict[str, str]) -> Column:
    starts = [(_starts(w, phrase.split()), label) for phrase, label in phrases.items()]
    return F.struct(F.array_sort(F.flatten(F.array(*(s for s, _ in starts)))).alias("at"),
                    F.array_compact(F.array(*(F.when(F.size(s) > 0, F.lit(label)) for s, label in starts))).alias("labels"))


def _literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as literals of the plan."""
    names = [field.split()[0] for field in schema.split(", ")]
    value = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    structs = [F.struct(*(value(x).alias(n) for x, n in zip(row, names))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs).cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                 containment: tuple[int, int] = CONTAINMENT, wrapped: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): base places, labels of both kinds, and the places' blocks.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, found (an array of block, label, containment for every block
    that contains a template; blocks count lines from 0).  ``score`` is the
    largest containment found, 1 if a phrase is there, else 0.

    A null, empty or wordless text has no labels, no positions and score 0.
    Repeated rows and rows without a doc_id are scanned like any other; a text's
    length is not limited; other columns are ignored.

    With ``wrapped`` the blocks are runs of neighbouring lines and paragraphs
    (parted by lines without words).  A run skips lines without words and goes
    from each line as far as the lines inside it hold together no more words
    than the longest template.  A line is part of its run.  A run's block is the
    line where it begins; paragraphs count on from the number of lines.
    """
    spark = docs.sparkSession
    t, of = containment
    table = template_table(templates)
    counts = word_counts(docs, sorted({x for _, _, words in table for x in words}))
    prefix, sizes = [], []
    for number, label, words in table:
        needed = -(-t * len(words) // of)
        ordered = sorted(words, key=lambda x: (counts.get(x, 0), x))
        sizes.append((number, label, len(words), needed, words))
        prefix += [(number, x) for p, x in enumerate(ordered[:len(words) - needed + 1]) if len(words) - p >= needed]
    rare = sorted({x for _, x in prefix})
    vocabulary = sorted({x for _, _, words in table for x in words})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # phrases and prefix words as patterns over the raw text: most texts have neither and go no further
    edge = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    any_of = lambda xs: f"(?i)(?:^|{edge})(?:{'|'.join(xs)})(?:{edge}|$)"
    has_phrase = text.rlike(any_of([GAP.join(p.split()) for p in phrases])) if phrases else F.lit(False)
    has_rare = any_of(rare) if rare else r"[^\s\S]"
    no_blocks = F.array().cast("array<struct<block:int,words:array<string>>>")

    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    longest = max((len(re.findall(WORD, x)) for texts in templates.values() for x in texts), default=0)

    def runs(lines: Column) -> Column:
        worded = F.filter(F.transform(lines, lambda line, i: F.struct(
            i.alias("block"), line.rlike(has_rare).alias("rare"), F.array_intersect(_words(line), known).alias("words"),
            F.size(_words(line)).alias("n"))), lambda x: x["n"] > 0)
        state = "struct<words:array<string>,inner:int>"

        def widened(acc: Column, x: Column) -> Column:
            return F.when(acc["inner"] <= longest, F.struct(F.array_union(acc["words"], x["words"]), acc["inner"] + x["n"]).cast(state)).otherwise(acc)

        def run_from(w: Column, x: Column, i: Column) -> Column:
            whole = F.aggregate(F.slice(w, i + 2, F.lit(longest + 1)), F.struct(x["words"], F.lit(0)).cast(state), widened, lambda acc: acc["words"])
            near = F.exists(F.slice(w, i + 1, F.lit(longest + 2)), lambda y: y["rare"])
            return F.struct(x["block"].alias("block"), F.when(near, whole).alias("words"))

        return _let(worded, lambda w: F.transform(w, lambda x, i: run_from(w, x, i)))

    def blocks(lines: Column) -> Column:
        held = F.transform(lines, lambda line, i: F.struct(i.alias("block"), F.when(
            line.rlike(has_rare), F.array_intersect(_words(line), known)).alias("words")))
        if wrapped:
            edges = GAP.removesuffix("+")
            paragraphs = F.transform(F.split(text, rf"\n{edges}*\n"), lambda part, i: F.struct(
                (i + F.size(lines)).alias("block"), F.when(part.rlike(has_rare), F.array_intersect(_words(part), known)).alias("words")))
            held = F.concat(runs(lines), paragraphs)
        least = min((needed for _, _, _, needed, _ in sizes), default=1)
        return F.filter(held, lambda b: F.size(b["words"]) >= least)

    n_words = F.when(text.rlike(WORD), F.size(F.filter(F.split(text, GAP), lambda x: x != ""))).otherwise(F.lit(0))
    base = (F.when(has_phrase, _let(_words(text), lambda w: _base(w, phrases))) if phrases
            else F.lit(None).cast("struct<at:array<int>,labels:array<string>>"))
    scanned = cut(docs.select(
        F.col("doc_id"), F.md5(text).alias("fingerprint"), n_words.cast("long").alias("n_words"), base.alias("base"),
        F.when(text.rlike(has_rare), blocks(F.split(text, "\n"))).otherwise(no_blocks).alias("blocks")), "scanned")

    templates_df = _literal_rows(spark, sizes, "template int, label string, size int, needed int, words array<string>")
    prefix_df = _literal_rows(spark, prefix, "template int, word string")
    # copies of a text have the same blocks: each text is joined once
    held = (scanned.filter(F.size("blocks") > 0).groupBy("fingerprint").agg(F.max("blocks").alias("blocks"))
            .select("fingerprint", F.inline("blocks").alias("block", "block_words")))
    candidates = (held.select("fingerprint", "block", "block_words", F.explode("block_words").alias("word"))
                  .join(F.broadcast(prefix_df), "word").drop("word").distinct())
    shared = F.size(F.array_intersect("block_words", "words"))
    joined = (candidates.join(F.broadcast(templates_df), "template").filter(shared >= F.col("needed"))
              .groupBy("fingerprint")
              .agg(F.array_sort(F.collect_set(F.struct("block", "label", (shared / F.col("size")).alias("containment")))).alias("found")))
    joined = cut(joined, "found")
    own = F.coalesce(F.col("found"), F.array().cast("array<struct<block:int,label:string,containment:double>>"))
    base_labels = F.coalesce(F.col("base.labels"), F.array().cast("array<string>"))
    all_labels = F.array_union(base_labels, F.transform(own, lambda x: x["label"]))
    line = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    at = F.col("base.at")
    return (scanned.join(joined, "fingerprint", "left").select(
        "doc_id", "n_words", F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        line(base_labels).alias("base_labels"), line(all_labels).alias("labels"),
        F.when(F.size(base_labels) > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform(own, lambda x: x["containment"])), F.lit(0.0))).alias("score"),
        own.alias("found")))
