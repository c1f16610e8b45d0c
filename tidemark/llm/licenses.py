"""License scans by an exact set-similarity join of text blocks with templates.

A template is a license statement or notice; its tokens are its distinct pairs of neighbouring words. Texts are cut into blocks
of words that overlap by half, at several widths; a template belongs to the least width of which one block surely holds a whole copy of it.
A block is found if it has at least THRESHOLD of the template's tokens. Tokens are put in order of their frequency over the blocks of all texts, rarest
first, and a pair of block and template is formed only if their prefixes share a token (prefix filter), the block has enough
tokens (length filter) and what stands behind the shared token can still reach the threshold (positional filter). Pairs are then
counted in full, so nothing is missed and nothing found wrongly.

Texts are read once. Only tokens of templates can be shared, so a block goes on as its tokens among these, and only if they
could suffice for the least template of its width.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, narrow_batches

#: Share of a template's tokens that a block must have.
THRESHOLD = 0.9
#: Words of a block at each width; neighbours overlap by half, so a passage of half the width is whole in one.
WIDTHS = (16, 32, 64, 128, 256, 512)
#: Words of all templates together, at most: their tokens go to every task.
MOST_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    """A label and a text that stands for it."""

    label: str
    text: str


#: Phrases whose places count, with their labels. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Usual statements and the openings of usual notices. Fixed values.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mit", "Released under the MIT License"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl", "licensed under the GNU General Public License"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("cc-by", "licensed under CC BY 4.0"),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0"),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0"),
    Template("cc-by-nd", "licensed under CC BY-ND 4.0"),
    Template("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    Template("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)

# Bytes that are no part of a word become blanks, A to Z lower case; bytes from 0x80 on are parts of words.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A to Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def pairs_of(text: str) -> set[tuple[bytes, bytes]]:
    w = words_of(text)
    return set(zip(w, w[1:], strict=False))


@dataclass
class Index:
    """Templates as numbers: words, and tokens by width."""

    words: dict[bytes, int]  # from 1 on
    phrases: list[tuple[list[int], str]]
    labels: list[str]
    widths: list[int]  # of each template
    sets: list[list[int]]  # tokens of each template
    least: list[int]  # tokens that a block needs, of each template

    @classmethod
    def of(cls, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> Index:
        texts = [words_of(t.text) for t in templates]
        if sum(map(len, texts)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words")
        if any(len(set(t)) < 2 for t in texts) or any(len(t) > WIDTHS[-1] // 2 for t in texts):
            raise ValueError(f"a template has two different words at least and {WIDTHS[-1] // 2} words at most")
        places = [words_of(p) for p, _ in phrases]
        words = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in [*places, *texts] for w in t))}
        widths = [next(w for w in WIDTHS if w // 2 >= len(t)) for t in texts]
        numbers: dict[tuple, int] = {}
        sets = [sorted({numbers.setdefault((width, a, b), len(numbers)) for a, b in zip(t, t[1:], strict=False)}) for width, t in zip(widths, texts, strict=True)]
        found = cls(words, [([words[w] for w in p], label) for p, (_, label) in zip(places, phrases, strict=True)], [t.label for t in templates], widths, sets, [math.ceil(threshold * len(s) - 1e-9) for s in sets])
        found.tokens = {k: (words[a], words[b]) for (_, a, b), k in numbers.items()}
        return found

    def lookup(self, width: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Sorted codes of the width's tokens, their numbers, and the tokens that a block needs at least."""
        mine = sorted({k for s, w in zip(self.sets, self.widths, strict=True) if w == width for k in s})
        codes = np.array([self.tokens[k][0] * (len(self.words) + 1) + self.tokens[k][1] for k in mine], np.int64)
        order = np.argsort(codes)
        return codes[order], np.array(mine, np.int64)[order], min(n for n, w in zip(self.least, self.widths, strict=True) if w == width)


def blocks_of(ids: np.ndarray, lookup: tuple[np.ndarray, np.ndarray, int], width: int, vocabulary: int) -> list[tuple[int, list[int]]]:
    """Blocks of a text of word numbers (0: of no template) that have enough tokens: ordinal, distinct tokens."""
    codes, numbers, least = lookup
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    if len(at) < least:
        return []
    code = ids[at] * (vocabulary + 1) + ids[at + 1]
    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    hit = codes[place] == code
    at, token = at[hit], numbers[place[hit]]
    if len(at) < least:
        return []
    half = width // 2
    # Words at and at + 1 are both in the block that begins at or before the first and ends behind the second.
    newest = at // half
    older = np.flatnonzero((newest > 0) & (at + 1 < (newest + 1) * half))
    block = np.concatenate([newest, newest[older] - 1])
    both = np.unique(np.stack([block, np.concatenate([token, token[older]])], axis=1), axis=0)
    cuts = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0]]))
    return [(int(b[0, 0]), b[:, 1].tolist()) for b in np.split(both, cuts[1:]) if len(b) >= least]


ROW = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base", pa.list_(pa.string())),
        ("blocks", pa.list_(pa.struct([("width", pa.int32()), ("block", pa.int64()), ("tokens", pa.list_(pa.int32()))]))),
    ]
)
ROW_SQL = "n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<width: int, block: long, tokens: array<int>>>"


def _described(index: Index):
    def run(batches):
        lookups = {w: index.lookup(w) for w in sorted(set(index.widths))}
        get, n_known = index.words.get, len(index.words)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                ids = np.array([get(w, 0) for w in words], np.int64)
                starts, base = [], []
                for phrase, label in index.phrases:
                    at = np.flatnonzero(ids == phrase[0])
                    at = at[at + len(phrase) <= len(ids)]
                    for k, w in enumerate(phrase[1:], 1):
                        at = at[ids[at + k] == w]
                    if len(at):
                        starts.append(at)
                        base.append(label)
                places = np.concatenate(starts) if starts else np.empty(0, np.int64)
                blocks = [{"width": w, "block": b, "tokens": t} for w, held in lookups.items() for b, t in (blocks_of(ids, held, w, n_known) if len(ids) > 1 else ())]
                first, last = (int(places.min()), int(places.max())) if len(places) else (None, None)
                out.append((len(words), len(places), first, last, sorted(set(base)), blocks))
            columns = list(zip(*out, strict=True)) or [[]] * len(ROW)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), f.type) for c, f in zip(columns, ROW, strict=True))], names=["doc_id", *ROW.names])

    return run


def described(docs: DataFrame, index: Index) -> DataFrame:
    """A row for each document: doc_id, row_id, its words and base places, and the blocks that could hold a template."""
    narrow_batches(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_described(index), f"doc_id {kind}, {ROW_SQL}")
    return cut(rows.withColumn("row_id", F.monotonically_increasing_id()))


def joined(rows: DataFrame, index: Index) -> DataFrame:
    """(row_id, width, block, template, containment): all blocks that have enough of a template's tokens."""
    spark = rows.sparkSession
    blocks = rows.select("row_id", F.inline("blocks"))
    # The order: how many blocks of all texts have a token, at most MOST_WORDS of them.
    often = dict(blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect())
    order = {t: k for k, t in enumerate(sorted(index.tokens, key=lambda t: (often.get(t, 0), t)))}
    ranked = [sorted(order[t] for t in s) for s in index.sets]
    of_template = [(i, w, r, n) for i, (w, r, n) in enumerate(zip(index.widths, ranked, index.least, strict=True))]
    templates = spark.createDataFrame(of_template, "template int, width int, ranks array<int>, least int")
    prefixes = templates.select("template", "width", "least", F.col("ranks").alias("template_ranks"), F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - F.col("least") + 1)).alias("place", "rank"))
    ranks = spark.createDataFrame([(t, k) for t, k in order.items()], "token int, rank int")
    # Each block's tokens in the order. A block has few: those of templates of its width.
    by_rank = blocks.select("row_id", "width", "block", F.explode("tokens").alias("token")).join(F.broadcast(ranks), "token").groupBy("row_id", "width", "block").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    sides = by_rank.select("row_id", "width", "block", "ranks", F.posexplode("ranks").alias("at", "rank"))
    # Every template has MOST_WORDS tokens at most, all of them together too.
    met = sides.join(F.broadcast(prefixes), ["width", "rank"])
    reach = 1 + F.least(F.size("ranks") - F.col("at") - 1, F.size("template_ranks") - F.col("place") - 1)
    likely = met.where((F.size("ranks") >= F.col("least")) & (F.col("at") <= F.size("ranks") - F.col("least")) & (reach >= F.col("least")))
    both = F.size(F.array_intersect("ranks", "template_ranks"))
    full = likely.where(both >= F.col("least")).select("row_id", "width", "block", "template", (both / F.size("template_ranks")).alias("containment"))
    return full.distinct()


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses named or quoted in docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters a to z (A to Z are lower-cased) and characters from U+0080 on; a null text is
    empty. n_base counts the places where a phrase's words stand consecutively, first_word and last_word are the smallest and
    largest start, null without one; base_labels are those phrases' labels, labels theirs and those of templates that a block has,
    distinct, sorted and joined by commas, empty without any. score: the largest share of a template's tokens that a block found has; 0
    without one. Texts are read whole, however long. Rows that repeat are rows of their own. Empty table: empty result.
    Other columns are ignored, whatever their names.
    """
    index = Index.of(templates, phrases, threshold)
    rows = described(docs, index)
    named = rows.sparkSession.createDataFrame(list(enumerate(index.labels)), "template int, label string")
    found = joined(rows, index).join(F.broadcast(named), "template").groupBy("row_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    none = F.array().cast("array<string>")
    return rows.drop("blocks").join(found, "row_id", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
