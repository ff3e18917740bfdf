"""Operator 13: phrases that belong together, by compressed position bitmaps.

Every block of documents holds, for each of its words, the positions at which it stands, as bytes of eight positions each, the
empty ones left out.  Pieces of text are kept apart by a free position.  A phrase is extended depth-first: its bitmap moved on
by one position, AND the bitmaps of the words there, is the bitmap of the longer phrase, and its set bits are counted.  A batch
of first words goes down to the longest phrases before the next one begins, so what is open stays small.

Counts of the blocks are added up in buckets of the phrases' hashes, one length after the other, so that a block extends a phrase only if
that phrase, and for the longer one its rest, occur ``least`` times in all:

1. words, and the number of all words, of each language;
2. pairs of frequent words;
3. triples of frequent pairs;
4. phrases of four and five words all of whose triples are frequent.

The first block that asks for a frequent phrase is told to report it.  All parts of a phrase, and every longer phrase that is as frequent as
it, occur in that block too, so it also knows the counts of all cuts, and whether the phrase is part of a longer one with the same count.
Scores are exact decimals of 38 digits; the best of each language are taken in two steps, so no task sorts a language.

A block sends each phrase once, so a frequent word or a language with most rows costs one entry a block.  Words are told
apart by 64-bit hashes: two phrases of P counted ones share one with probability about P * P / 2**65.

Results of odd input: a null text is empty; a null language is ``und``, and so is one with this name; an empty language is one of its own; ids do not matter, and repeated rows
count as often as they are there; phrases of one score and count are ordered by the bytes of their UTF-8; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.blocks import press, unpress
from tessera.llm.kernel import U, Words, distinct_places, mix, pack_sorted, planes, portions, slice_bounds, unpack_sorted, unplanes

LONGEST = 5
LEAST = 100
TOP = 2000
BLOCK_BYTES = 16 << 20
#: Entries of bitmaps that go down together.
BATCH = 1 << 16
SALTS = 64
WORD = np.ones(256, bool)
WORD[[0x20, 0x09]] = False
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD &= ~ENDS
MESSAGE = "bucket int, block int, kind int, keys binary, counts binary, owned binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("owned", pa.binary())])
VERTICAL = "block int, words array<binary>, langs array<string>, keys binary, lang_of binary, entries binary, chunks binary, bits binary"
_VERTICAL = pa.schema([("block", pa.int32()), ("words", pa.list_(pa.binary())), ("langs", pa.list_(pa.string())), *((c, pa.binary()) for c in ("keys", "lang_of", "entries", "chunks", "bits"))])
FOUND = "lang string, phrase string, a long, n long, l array<long>, r array<long>"
_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("n", pa.int64()), ("l", pa.list_(pa.int64())), ("r", pa.list_(pa.int64()))])
#: Kinds of messages are the shortest phrase asked.


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") | 1


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of phrases with one word more."""
    return mix(prefix * U(0x9E3779B97F4A7C15) + word)


class Tokens:
    """The words of some texts: key (of language and word), position, language, and their bytes."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        encoded = langs.fill_null("und").dictionary_encode()
        self.langs: list[str] = encoded.dictionary.to_pylist()
        self.words = w = Words(texts, WORD, lower=True)
        self.lang = np.asarray(encoded.indices.to_numpy(zero_copy_only=False), np.int64)[w.doc]
        salt = np.array([lang_key(x) for x in self.langs], U)
        self.key = mix(w.hash ^ salt[self.lang]) if len(w.start) else np.zeros(0, U)
        ends = np.concatenate([[0], np.cumsum(ENDS[w.data])])[w.start]
        new = np.concatenate([[True], (ends[1:] != ends[:-1]) | (w.doc[1:] != w.doc[:-1])])[: len(ends)]
        # a free position before every piece
        self.position = np.arange(len(ends)) + np.cumsum(new)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        for a, e in portions(batch.column("text")):
            yield Tokens(batch.column("text").slice(a, e - a), batch.column("lang").slice(a, e - a))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    distinct, place = distinct_places(keys)
    return distinct, np.bincount(place, weights=counts).astype(np.int64)


def word_counts(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the words, and under the key of a language of all its words."""
    keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
    for t in _tokens(batches):
        own = np.bincount(t.lang, minlength=len(t.langs)) if len(t.lang) else np.zeros(len(t.langs), np.int64)
        distinct, times = _summed(t.key, np.ones(len(t.key), np.int64))
        keys, counts = _summed(np.concatenate([keys, distinct, np.array([lang_key(x) for x in t.langs], U)]), np.concatenate([counts, times, own]))
    return keys, counts


@dataclass
class Bitmaps:
    """Bitmaps of some phrases: entries in the order of the phrases (rows of ``path``, as numbers of words)."""

    path: np.ndarray
    key: np.ndarray
    phrase: np.ndarray
    chunk: np.ndarray
    bits: np.ndarray


class Vertical:
    """The bitmaps of a block's frequent words, by word and by chunk."""

    def __init__(self, row: dict):
        self.words, self.langs = row["words"], row["langs"]
        self.keys, self.lang_of = unpack_sorted(unpress(row["keys"])), unplanes(unpress(row["lang_of"]), np.int32)
        entries = unplanes(unpress(row["entries"]), np.int32)
        self.chunk, self.bits = np.cumsum(unplanes(unpress(row["chunks"]), np.int32), dtype=np.int32), np.frombuffer(unpress(row["bits"]), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(entries)])
        self.word = np.repeat(np.arange(len(entries), dtype=np.int32), entries)
        order = np.argsort(self.chunk, kind="stable")
        self.there, self.bits_there = self.word[order], self.bits[order]
        self.at = np.searchsorted(self.chunk[order], np.arange(int(self.chunk.max(initial=0)) + 3))

    @staticmethod
    def row(block: int, batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> dict:
        """The vertical form of a block, of its frequent words only."""
        langs: dict[str, int] = {}
        word, position, names, lang_of, start = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], {}, np.zeros(len(frequent), np.int32), 0
        for t in _tokens(batches):
            at = np.minimum(np.searchsorted(frequent, t.key), max(len(frequent) - 1, 0))
            own = np.flatnonzero(frequent[at] == t.key) if len(frequent) and len(t.key) else np.zeros(0, np.int64)
            at, blob = at[own] if len(own) else own, t.words.data.tobytes()
            numbers = np.array([langs.setdefault(x, len(langs)) for x in t.langs], np.int32)
            for w, i in zip(*(x.tolist() for x in np.unique(at, return_index=True)), strict=True):
                if w not in names:
                    names[w] = blob[t.words.start[own[i]] : t.words.end[own[i]]]
                    lang_of[w] = numbers[t.lang[own[i]]]
            word.append(at.astype(np.int32))
            position.append((t.position[own] + start).astype(np.int32))
            start += int(t.position[-1]) + 2 if len(t.position) else 0
        held = np.array(sorted(names), np.int64)
        all_words, all_positions = np.searchsorted(held, np.concatenate(word)).astype(np.int32), np.concatenate(position)
        order = np.argsort(all_words, kind="stable")
        w, p = all_words[order], all_positions[order]
        chunk, bit = (p >> 3).astype(np.int32), (1 << (p & 7)).astype(np.uint8)
        new = np.flatnonzero(np.concatenate([np.ones(min(len(w), 1), bool), (w[1:] != w[:-1]) | (chunk[1:] != chunk[:-1])]))
        bits = np.bitwise_or.reduceat(bit, new) if len(new) else bit
        entries = np.bincount(w[new], minlength=len(held)).astype(np.int32)
        return {"block": block, "words": [names[i] for i in held.tolist()], "langs": list(langs), "keys": press(pack_sorted(frequent[held])), "lang_of": press(planes(lang_of[held])), "entries": press(planes(entries)), "chunks": press(planes(np.diff(chunk[new], prepend=np.int32(0)))), "bits": press(bits.tobytes())}

    def batches(self) -> Iterator[Bitmaps]:
        """The words, some at a time."""
        at = 0
        while at < len(self.keys):
            end = max(at + 1, int(np.searchsorted(self.first, self.first[at] + BATCH, "right")) - 1)
            own = slice(self.first[at], self.first[end])
            yield Bitmaps(np.arange(at, end)[:, None], self.keys[at:end], self.word[own] - at, self.chunk[own], self.bits[own])
            at = end

    def extend(self, node: Bitmaps) -> tuple[Bitmaps, np.ndarray]:
        """All phrases one word longer, and how often each is there."""
        low, carry = (node.bits.astype(np.uint16) << 1).astype(np.uint8), node.bits >> 7
        here, over = np.flatnonzero(low), np.flatnonzero(carry)
        phrase = np.concatenate([node.phrase[here], node.phrase[over]])
        chunk = np.concatenate([node.chunk[here], node.chunk[over] + 1])
        moved = np.concatenate([low[here], carry[over]])
        first, count = self.at[chunk], self.at[chunk + 1] - self.at[chunk]
        of = np.repeat(np.arange(len(chunk)), count)
        there = np.arange(len(of)) + np.repeat(first - np.cumsum(count) + count, count)
        bits = moved[of] & self.bits_there[there]
        hit = np.flatnonzero(bits)
        of, word, bits = of[hit], self.there[there[hit]], bits[hit]
        pair = phrase[of] * len(self.keys) + word
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.concatenate([np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1]])
        number = np.cumsum(new) - 1
        parent, last = pair[new] // max(len(self.keys), 1), pair[new] % max(len(self.keys), 1)
        out = Bitmaps(np.column_stack([node.path[parent], last]), extended(node.key[parent], self.keys[last]), number, chunk[of[order]], bits[order])
        return out, np.bincount(number, weights=np.bitwise_count(out.bits), minlength=len(out.key)).astype(np.int64)

    def part_key(self, path: np.ndarray) -> np.ndarray:
        """The keys of phrases given as numbers of words."""
        out = self.keys[path[:, 0]]
        for k in range(1, path.shape[1]):
            out = extended(out, self.keys[path[:, k]])
        return out


def kept(node: Bitmaps, which: np.ndarray) -> Bitmaps:
    """Only some of the phrases."""
    number = np.cumsum(which) - 1
    own = which[node.phrase]
    return Bitmaps(node.path[which], node.key[which], number[node.phrase[own]], node.chunk[own], node.bits[own])


class Told:
    """Frequent phrases of a block by length: sorted keys, counts, and whether the block reports them."""

    def __init__(self, rows: list[dict]):
        self.by_kind: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for kind in {r["kind"] for r in rows}:
            own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"])
            keys = np.concatenate([unpack_sorted(unpress(r["keys"])) for r in own])
            counts = np.concatenate([unplanes(unpress(r["counts"]), np.int64) for r in own])
            owned = np.concatenate([np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=len(unpack_sorted(unpress(r["keys"])))) for r in own]).astype(bool)
            self.by_kind[kind] = keys, counts, owned

    def keys(self, kind: int) -> np.ndarray:
        return self.by_kind[kind][0] if kind in self.by_kind else np.zeros(0, U)

    def places(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are frequent, and where they stand."""
        own = self.keys(kind)
        if not len(own) or not len(keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return own[at] == keys, at


def _kind(length: int) -> int:
    """The round in which phrases of a length are counted."""
    return min(length, 4)


def walk(vertical: Vertical, told: Told, upto: int, counted: int) -> Iterator[tuple[int, Bitmaps, np.ndarray]]:
    """Length, bitmaps and counts of the phrases of up to so many words whose parts are frequent, as far as lengths have been ``counted``; depth-first."""

    def down(node: Bitmaps, length: int) -> Iterator[tuple[int, Bitmaps, np.ndarray]]:
        longer, counts = vertical.extend(node)
        length += 1
        # the phrase without its last word was extended; its rest, and if counted itself, must be frequent too
        for span in {min(length - 1, counted), min(length, counted)} - {1}:
            frequent, _ = told.places(_kind(span), vertical.part_key(longer.path[:, -span:]))
            longer, counts = kept(longer, frequent), counts[frequent]
        if not len(longer.key):
            return
        yield length, longer, counts
        if length < upto:
            yield from down(longer, length)

    for node in vertical.batches():
        yield from down(node, 1)


def phrase_counts(vertical: Vertical, told: Told, kind: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(node.key, counts) for length, node, counts in walk(vertical, told, LONGEST if kind == 4 else kind, kind - 1) if _kind(length) == kind]
    return _summed(np.concatenate([np.zeros(0, U), *(k for k, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)]))


def report(vertical: Vertical, told: Told) -> pa.Table:
    """The block's own frequent phrases that no longer phrase of the same count contains, with the counts of the parts of every cut."""
    length_of, paths, keys = [], [], []
    for length, node, _ in walk(vertical, told, LONGEST, LONGEST):
        length_of.append(np.full(len(node.key), length))
        paths.append(np.pad(node.path, ((0, 0), (0, LONGEST - length))))
        keys.append(node.key)
    if not keys:
        return _FOUND.empty_table()
    length, path, key = np.concatenate(length_of), np.concatenate(paths), np.concatenate(keys)

    def counted(size: int, of: np.ndarray) -> np.ndarray:
        there, at = told.places(_kind(size), of)
        return np.where(there, told.by_kind[_kind(size)][1][at], 0) if _kind(size) in told.by_kind else np.zeros(len(of), np.int64)

    a, owned = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    whole: list[np.ndarray] = []
    for size in range(2, LONGEST + 1):
        own = np.flatnonzero(length == size)
        if not len(own):
            continue
        a[own] = counted(size, key[own])
        owned[own] = told.by_kind[_kind(size)][2][told.places(_kind(size), key[own])[1]]
        if size > 2:
            for part in (path[own, : size - 1], path[own, 1:size]):
                parts = vertical.part_key(part)
                whole.append(parts[counted(size - 1, parts) == a[own]])
    owned &= ~np.isin(key, np.concatenate([np.zeros(0, U), *whole]))
    out: list[dict] = []
    totals = counted(1, np.array([lang_key(x) for x in vertical.langs], U))
    for size in range(2, LONGEST + 1):
        own = np.flatnonzero(owned & (length == size))
        first = np.column_stack([counted(k, vertical.part_key(path[own, :k])) for k in range(1, size)]).tolist() if len(own) else []
        rest = np.column_stack([counted(size - k, vertical.part_key(path[own, k:size])) for k in range(1, size)]).tolist() if len(own) else []
        for i, le, ri in zip(own.tolist(), first, rest, strict=True):
            words = path[i, :size].tolist()
            lang = int(vertical.lang_of[words[0]])
            out.append({"lang": vertical.langs[lang], "phrase": b" ".join(vertical.words[w] for w in words).decode(), "a": int(a[i]), "n": int(totals[lang]), "l": le, "r": ri})
    return pa.Table.from_pylist(out, schema=_FOUND)


def _sent(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[dict]:
    cuts = slice_bounds(keys, n_buckets)
    own = [(int(b), cuts[b], cuts[b + 1]) for b in np.flatnonzero(np.diff(cuts))]
    return [{"bucket": b, "block": block, "kind": kind, "keys": press(pack_sorted(keys[a:e])), "counts": press(planes(counts[a:e])), "owned": b""} for b, a, e in own]


def _answer(rows: list[dict], least: int) -> list[dict]:
    """Tells each block which of its phrases are frequent, how often they occur in all, and which of them it is the first to hold."""
    asked = [unpack_sorted(unpress(r["keys"])) for r in rows]
    distinct, place = distinct_places(np.concatenate(asked))
    total = np.bincount(place, weights=np.concatenate([unplanes(unpress(r["counts"]), np.int64) for r in rows])).astype(np.int64)
    block = np.repeat([r["block"] for r in rows], [len(k) for k in asked])
    owner = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(owner, place, block)
    out, at = [], 0
    for r, keys in zip(rows, asked, strict=True):
        own, at = place[at : at + len(keys)], at + len(keys)
        frequent = total[own] >= least
        if frequent.any():
            own = own[frequent]
            out.append({"bucket": r["bucket"], "block": r["block"], "kind": r["kind"], "keys": press(pack_sorted(keys[frequent])), "counts": press(planes(total[own])), "owned": np.packbits(owner[own] == r["block"]).tobytes()})
    return out


def candidates(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Frequent phrases that no longer one of the same count contains: lang, phrase, a, n, and the counts l and r of the parts of every cut."""
    parts, size = blocks.shuffle_partitions(docs), blocks.text_bytes(docs, text)[1]
    n_blocks, n_buckets = max(parts, math.ceil(size / block_bytes)), max(math.ceil(parts / 2), math.ceil(size // 12 / blocks.BUCKET_KEYS))
    named = [F.col(c) for c in docs.columns if c in ("doc_id", text)]
    dealt = docs.select(F.pmod(F.xxhash64(*named), F.lit(n_blocks)).cast("int").alias("block"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    schema = blocks.packed_schema(dealt)
    by_block = blocks.packed(dealt).groupBy("block")

    def table(rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(rows, schema=_MESSAGE)

    def ask_words(key, texts):
        return table(_sent(key[0].as_py(), 1, *word_counts(blocks.unpacked(texts, schema)), n_buckets))

    def answered(asked: DataFrame) -> DataFrame:
        return asked.groupBy("bucket").applyInArrow(lambda rows: table(_answer(rows.to_pylist(), least)), MESSAGE)

    def upright(key, texts, told):
        if not texts.num_rows or not told.num_rows:
            return _VERTICAL.empty_table()
        return pa.Table.from_pylist([Vertical.row(key[0].as_py(), blocks.unpacked(texts, schema), Told(told.to_pylist()).keys(1))], schema=_VERTICAL)

    def ask(kind: int, key, state: pa.Table, told: list[dict]) -> pa.Table:
        if not state.num_rows:
            return _MESSAGE.empty_table()
        return table(_sent(key[0].as_py(), kind, *phrase_counts(Vertical(state.to_pylist()[0]), Told(told), kind), n_buckets))

    def finish(key, state, told):
        return report(Vertical(state.to_pylist()[0]), Told(told.to_pylist())) if state.num_rows else _FOUND.empty_table()

    # one plan: the texts, the bitmaps and the questions of a round are exchanged once and read by all that need them
    words = answered(by_block.applyInArrow(ask_words, MESSAGE))
    state = by_block.cogroup(words.groupBy("block")).applyInArrow(upright, VERTICAL).groupBy("block")
    pairs = answered(state.applyInArrow(lambda key, state: ask(2, key, state, []), MESSAGE))
    triples = answered(state.cogroup(pairs.groupBy("block")).applyInArrow(lambda key, state, told: ask(3, key, state, told.to_pylist()), MESSAGE))
    short = pairs.unionByName(triples)
    long = answered(state.cogroup(short.groupBy("block")).applyInArrow(lambda key, state, told: ask(4, key, state, told.to_pylist()), MESSAGE))
    every = short.unionByName(words).unionByName(long)
    return state.cogroup(every.groupBy("block")).applyInArrow(finish, FOUND)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = candidates(docs, text, lang, least, block_bytes)
    # 4 + 16 + 16 digits and 2 for the products: nothing is rounded
    part = "cast({} as decimal(16,0))".format
    score = f"(cast(1000 as decimal(4,0)) * {part('a')} * {part('n')}) div ({part('l[i]')} * {part('r[i]')})"
    cut = F.expr(f"array_min(transform(sequence(0, size(l) - 1), i -> struct({score} as score, i as k)))")
    scored = found.withColumn("cut", cut).selectExpr("lang", "phrase", "a", "l[cut.k] as l", "r[cut.k] as r", "n", "cut.score as score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, string_split_regex(piece, '[\x20\x09]+') AS w0 FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, [x FOR x IN w0 IF x <> ''] AS w FROM p),
g AS (SELECT lang, m, w[i:i + m - 1] AS ph FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
f AS MATERIALIZED (SELECT lang, m, ph, count(*) AS f FROM g GROUP BY lang, m, ph HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
q AS (SELECT c.lang, c.m, c.ph, c.f AS a, k, f1.f AS l, f2.f AS r, n.n, (1000 * CAST(c.f AS HUGEINT) * n.n) // (CAST(f1.f AS HUGEINT) * f2.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN f f1 ON f1.lang = c.lang AND f1.ph = c.ph[1:k] JOIN f f2 ON f2.lang = c.lang AND f2.ph = c.ph[k + 1:] JOIN n ON n.lang = c.lang),
s AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
x AS (SELECT DISTINCT lang, f AS a, unnest([ph[1:m - 1], ph[2:m]]) AS ph FROM f WHERE m > 2),
o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM s ANTI JOIN x USING (lang, ph, a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
