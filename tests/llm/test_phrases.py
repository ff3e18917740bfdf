"""Operator 13 against a plain count of phrases."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, score int"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {(lang, w[i : i + m]) for (lang, w), a in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= 100 * f[lang, w[i : i + m]]}
    out = []
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place, ranked = Counter(), []
    for lang, *rest in out:
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], *rest))
    return ranked


def corpus():
    rnd = random.Random(9)
    words = "a b the The of ÉTÉ été 日本 x1 zz".split()
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(k))
    rows = [(text(rnd.randint(0, 60)), rnd.choice(["en", "de", None, "und", ""])) for _ in range(60)]
    fixed = "one two three four five six"
    return [*rows, (None, "en"), ("", None), (" ,. \n", "en"), (fixed, "en"), (fixed, "en"), (f"{fixed} {fixed}", "en"), (f"two three. {fixed}", "de"), ("a " * 3000, "de"), *[(text(40), "en")] * 5]


@pytest.mark.parametrize(("least", "top", "block_bytes"), [(2, 50, 1 << 20), (3, 2000, 300), (1, 2000, 2000)])
def test_collocations_equal_a_plain_count(spark, least, top, block_bytes, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, g, "p", 1) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.collocations(docs, least=least, top=top, block_bytes=block_bytes).collect()
    want = brute(rows, least, top)
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want and len(want) > 20


def test_small_batches_go_down_depth_first(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "BATCH", 3)
    texts = pa.record_batch({"text": ["a b a b c a b", "b c a"], "lang": ["x", "x"]})
    keys, counts = phrases.word_counts(iter([texts]))
    vertical = phrases.Vertical(phrases.Vertical.row(0, iter([texts]), keys))
    lengths, seen = [], Counter()
    for length, node, times in phrases.walk(vertical, phrases.Told([]), 3, 1):
        lengths.append(length)
        for path, t in zip(node.path.tolist(), times.tolist(), strict=True):
            seen[b" ".join(vertical.words[w] for w in path).decode()] += t
    assert seen == {"a b": 3, "b a": 1, "b c": 2, "c a": 2, "a b a": 1, "b a b": 1, "a b c": 1, "b c a": 2, "c a b": 1}
    assert lengths == [2, 3] * (len(lengths) // 2) and len(lengths) > 2


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, m = 3_000_000_000, 9_000_000_000_000, 7_000_000_001
    found = spark.createDataFrame([("x", "p q", a, n, [m], [m])], phrases.FOUND)
    original, phrases.candidates = phrases.candidates, lambda *_: found
    try:
        row = phrases.collocations(found).first()
    finally:
        phrases.candidates = original
    assert row.score == 1000 * a * n // (m * m)


def test_empty_and_wordless_tables(spark):
    for rows in ([], [(1, None, None, "", 0), (2, ". ,", "en", "", 0), (None, None, None, None, None)]):
        out = phrases.collocations(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
