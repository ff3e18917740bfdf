"""Operator 4: licence scans by an exact set-similarity join of text lines with licence templates.

A block is a line of a text; a template is a licence sentence; both are sets of words.  A block meets a
template if it holds at least THRESHOLD of the template's words.  Words are ordered by how many blocks of all
documents hold them, rarest first (one counting job over the whole corpus, whose result has one
row a template word).  A block that meets a template of k words shares one of the template's first
k - needed + 1 words (prefix filter), has at least ``needed`` template words at all (length filter), and at a first
shared word enough words left on both sides (positional filter); what passes is counted exactly.
Words outside all templates cannot add to an overlap, so blocks are cut down to template words first.

Fixed phrases are found on top: places where their words stand consecutively in the document.

A template may be met without the word that names its licence.  ``op4_license_scan`` gives what meets, as its
SQL does; ``op4_license_names`` gives what is confirmed: a template whose naming words (NAMES) are in the block
as well, in one run of words of its family, where no longer name of the family is in that run (so the run
"cc by nc" is no "cc by").  For that, blocks are lines and also stretches of the document over line breaks of as
many words as the template has, divided by the threshold: a hard-wrapped sentence is found.

Results of odd input: null and empty texts have no words, labels or places and a score of 0; a text
without line breaks is one block, whatever its length; repeated rows give equal rows; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernel import ALNUM, Words, portions

THRESHOLD = 0.8

# Phrases with their labels, and licence sentences in lower case without punctuation.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)


# The words that name a licence; templates without them are met by their wording alone.  Labels of one family can hold one another.
NAMES = {"gpl": "gnu", "apache": "apache", "mpl": "mozilla", "cc-by": "cc by", "cc-by-nc": "cc by nc", "cc-by-sa": "cc by sa", "public-domain": "public domain"}
FAMILIES = (("cc-by", "cc-by-nc", "cc-by-sa"),)


def naming_words(template: str, label: str) -> frozenset[str]:
    """The naming words of a template; the two texts of MIT differ in having one."""
    return frozenset(["mit"]) if label == "mit" and "mit" in template.split() else frozenset(NAMES.get(label, "").split())


def word_hashes(words: Sequence[str]) -> np.ndarray:
    return Words(pa.array([" ".join(words)]), ALNUM).hash


class Templates:
    """Templates over the codes of their words, with prefixes once the words are ordered."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        self.vocabulary = sorted({w for t, _ in templates for w in t.split()})
        hashes = word_hashes(self.vocabulary)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.sets = [frozenset(number[w] for w in t.split()) for t, _ in templates]
        self.labels = [label for _, label in templates]
        self.names = [frozenset(number[w] for w in naming_words(t, label)) for t, label in templates]
        self.length = [len(t.split()) for t, _ in templates]
        self.reach = [math.ceil(n / threshold - 1e-9) for n in self.length]
        self.rivals = [[u for u in range(len(templates)) if self.names[t] < self.names[u] and any(self.labels[t] in f and self.labels[u] in f for f in FAMILIES)] for t in range(len(templates))]
        self.family = [frozenset().union(*(self.names[u] for u in range(len(templates)) if u == t or any(self.labels[t] in f and self.labels[u] in f for f in FAMILIES))) for t in range(len(templates))]
        self.needed = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.rank_by({})

    def rank_by(self, blocks_with: dict[int, int]) -> Templates:
        ranked = sorted(range(len(self.vocabulary)), key=lambda k: (blocks_with.get(k, 0), self.vocabulary[k]))
        self.rank = np.empty(len(ranked), np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        self.ordered = [sorted(int(self.rank[k]) for k in s) for s in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (words, need) in enumerate(zip(self.ordered, self.needed, strict=True)):
            for place, r in enumerate(words[: len(words) - need + 1]):
                self.index.setdefault(r, []).append((t, place))
        self.in_prefix = np.isin(self.rank, list(self.index))  # by vocabulary number
        return self

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, or -1."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def matches(self, block: list[int]) -> list[tuple[int, float]]:
        """Templates that a block, its distinct template words by rank, meets, and their containment."""
        seen, out, have = set(), [], set(block)
        for j, r in enumerate(block):
            for t, i in self.index.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first shared word: nothing of the template's prefix before it is in the block
                words, need = self.ordered[t], self.needed[t]
                if len(block) < need or 1 + min(len(words) - i - 1, len(block) - j - 1) < need:
                    continue
                shared = sum(w in have for w in words)
                if shared >= need:
                    out.append((t, shared / len(words)))
        return out


    def named(self, t: int, block: list[int]) -> bool:
        """Whether a block, its words in order (-1 outside all templates), names template t itself and not only a longer name."""
        name = self.names[t]
        if not name:
            return True
        if len(name) == 1:
            return not name.isdisjoint(block)
        run: set[int] = set()
        for c in [*block, -1]:
            if c in self.family[t]:
                if c not in run:
                    run.add(c)
                    continue
            if name <= run and not any(self.names[u] <= run for u in self.rivals[t]):
                return True
            run = {c} if c in self.family[t] else set()
        return False

    def confirmed(self, code: np.ndarray, line: np.ndarray) -> dict[int, float]:
        """Of one document's words: the templates that a block confirms, and their best containment."""
        best: dict[int, float] = {}
        prefix = np.flatnonzero((code >= 0) & self.in_prefix[code])
        for x in np.unique(line[prefix]):
            a, e = np.searchsorted(line, [x, x + 1])
            block = code[a:e].tolist()
            for t, share in self.matches(np.unique(self.rank[[c for c in block if c >= 0]]).tolist()):
                if share > best.get(t, 0) and self.named(t, block):
                    best[t] = share
        done = {t: -1 for t in range(len(self.sets))}
        for i in prefix:
            for t, _ in self.index[int(self.rank[code[i]])]:
                reach, need = self.reach[t], self.needed[t]
                low, high = max(0, i - reach + 1, done[t] + 1), min(len(code), i + reach)
                if line[low : low + 1].tolist() == line[high - 1 : high].tolist() or len(self.sets[t].intersection(code[max(0, i - reach + 1) : high].tolist())) < need:
                    continue
                for start in range(low, i + 1):  # every stretch that holds this word and was not looked at yet
                    block = code[start : start + reach].tolist()
                    shared, beyond = self.sets[t].intersection(block), len(self.family[t])
                    # a name that goes on past the end of the stretch is read to its end
                    if len(shared) >= need and len(shared) / len(self.sets[t]) > best.get(t, 0) and self.names[t] <= shared and self.named(t, code[max(0, start - beyond) : start + reach + beyond].tolist()):
                        best[t] = len(shared) / len(self.sets[t])
                done[t] = i
        return best


def _lines(w: Words) -> np.ndarray:
    """A number for the line of each word, rising through the texts."""
    breaks = np.flatnonzero(w.data == 0x0A)
    return np.searchsorted(breaks, w.start) + w.doc


def block_counts(docs: DataFrame, templates: Templates) -> dict[int, int]:
    """In how many blocks of all documents each template word is: at most one row a template word comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.vocabulary), np.int64)
        for batch in batches:
            for a, e in portions(batch.column("text")):
                w = Words(batch.column("text").slice(a, e - a), ALNUM, lower=True)
                code = templates.codes(w.hash)
                at = np.flatnonzero(code >= 0)
                both = np.unique(_lines(w)[at] * len(total) + code[at])
                total += np.bincount(both % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "blocks"])

    rows = docs.select("text").mapInArrow(run, "word long, blocks long").groupBy("word").agg(F.sum("blocks").alias("blocks")).collect()
    return {r["word"]: r["blocks"] for r in rows}


HITS = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, hits array<struct<label:string,line:long,first_word:long,containment:double>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: words, phrase places, labels, the best containment found, and every block that meets a template."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = Templates(templates, threshold)
    known.rank_by(block_counts(src, known))
    wanted = [(word_hashes(p.split()), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in portions(batch.column("text")):
                part = batch.slice(a, e - a)
                yield _scan(part, known, wanted)

    return src.mapInArrow(run, HITS.format(src.schema["doc_id"].dataType.simpleString()))


def _scan(part: pa.RecordBatch, known: Templates, phrases: list[tuple[np.ndarray, str]]) -> pa.RecordBatch:
    w = Words(part.column("text"), ALNUM, lower=True)
    h, doc, n = w.hash, w.doc, part.num_rows
    places, base = [np.zeros(0, np.int64)], [set() for _ in range(n)]
    for words, label in phrases:
        k = len(words)
        if len(h) >= k:
            same = doc[k - 1 :] == doc[: len(h) - k + 1]
            for j, x in enumerate(words):
                same = same & (h[j : len(h) - k + 1 + j] == x)
            at = np.flatnonzero(same)
            places.append(at)
            for d in np.unique(doc[at]):
                base[d].add(label)
    every = np.concatenate(places)
    own = doc[every]
    start = every - w.first[own]
    n_base = np.bincount(own, minlength=n)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, own, start)
    np.maximum.at(last, own, start)
    hits: list[list[dict]] = [[] for _ in range(n)]
    code, line = known.codes(h), _lines(w)
    chosen = np.unique(line[(code >= 0) & known.in_prefix[code]])
    for x in chosen:
        a, e = np.searchsorted(line, [x, x + 1])
        some = code[a:e]
        block = np.unique(known.rank[some[some >= 0]]).tolist()
        d = int(doc[a])
        for t, share in known.matches(block):
            hits[d].append({"label": known.labels[t], "line": int(x), "first_word": int(a - w.first[d]), "containment": share})
    # lines are numbered within their text
    breaks = np.searchsorted(np.flatnonzero(w.data == 0x0A), w.offsets[:-1]) + np.arange(n)
    for d, found in enumerate(hits):
        for x in found:
            x["line"] -= int(breaks[d])
    none = n_base == 0
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(n_base.astype(np.int64)),
            pa.array(first, mask=none), pa.array(last, mask=none),
            pa.array([",".join(sorted(b)) for b in base]),
            pa.array([",".join(sorted(b | {x["label"] for x in f})) for b, f in zip(base, hits, strict=True)]),
            pa.array([1.0 if b else max((x["containment"] for x in f), default=0.0) for b, f in zip(base, hits, strict=True)], pa.float64()),
            pa.array(hits, pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("first_word", pa.int64()), ("containment", pa.float64())]))),
        ],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits"],
    )


def confirm(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: the labels of the templates that a block meets and names, and the best containment among them."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = Templates(templates, threshold)
    known.rank_by(block_counts(src, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in portions(batch.column("text")):
                part = batch.slice(a, e - a)
                w = Words(part.column("text"), ALNUM, lower=True)
                code, line = known.codes(w.hash), _lines(w)
                found = [known.confirmed(code[x:y], line[x:y]) for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array([",".join(sorted({known.labels[t] for t in f})) for f in found]), pa.array([max(f.values(), default=0.0) for f in found], pa.float64())],
                    names=["doc_id", "n_words", "labels", "score"],
                )

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, labels string, score double")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("hits")


def op4_license_names(spark, sf_dir: str) -> DataFrame:
    return confirm(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({sorted(set(t.split()))!r}, {Templates([(t, label)], THRESHOLD).needed[0]}, '{label}')" for t, label in TEMPLATES)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH ph(ws, label) AS (VALUES {phrases}), te(ws, need, label) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lower} AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, {words}) AS ws FROM d),
x AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
b AS (SELECT rid, i - 1 AS p, label FROM x, ph WHERE x.ws[i:i + len(ph.ws) - 1] = ph.ws),
bb AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid),
l AS (SELECT rid, list_distinct(regexp_extract_all(line, {words})) AS ls FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)),
t AS (SELECT rid, label, len(list_intersect(l.ls, te.ws)) / len(te.ws) AS share FROM l, te WHERE len(list_intersect(l.ls, te.ws)) >= te.need),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM t UNION ALL SELECT rid, label FROM b) GROUP BY rid),
ts AS (SELECT rid, max(share) AS share FROM t GROUP BY rid)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN bb USING (rid) LEFT JOIN al USING (rid) LEFT JOIN ts USING (rid)
"""


ORACLE_SQL = _oracle()
