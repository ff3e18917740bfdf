"""Each training-data operator against a brute-force version, on small tables with odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import eliasfano, forest, licenses, lm, mainhtml, mixing, near, pieces, quality, substring, toxicity
from tessera.llm.kernel import SPACED, U, Words, distinct_places, pack_sorted, planes, unpack_sorted, unplanes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, `set` string, node string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def corpus():
    rnd = random.Random(7)
    vocabulary = [f"{a}{b}" for a in "the of wort élan mañana über 日本 x1 cc by".split() for b in ("", "s", "ed", "!")]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = text(30), text(120)
    words = base.split()
    texts = [text(80), None, "", "   \n\t ", "one", "two words", base, base, base + " tail", f"{text(40)} {passage}\n{text(20)}", f"{passage} {text(60)}", "\n".join([text(6)] * 5), text(2500)]
    for k in range(8):
        near_copy = list(words)
        near_copy[10 * k + 3] = f"changed{k}"
        texts.append(" ".join(near_copy))
    texts += ["All Rights reserved.\nThis work is licensed under the GNU General Public License, version 3.", "cc by cc by-nc", "a " * 60, "日本語 テスト　全角 😀"]
    rows = [(i, t, None, ["b", "a", None, "ä"][i % 4], None, 5, "x", "y") for i, t in enumerate(texts)]
    return [*rows, (6, texts[6], "en", "a", 1, 2, "x", "y"), (None, base, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_kernel_words_and_planes():
    texts = ["a bb  c\n", None, "", "é x", "  q", "\x0b\x1fz"]
    w = Words(pa.array(texts), SPACED)
    assert w.count.tolist() == [len(SPACE.findall(t or "")) for t in texts]
    assert len(set(w.hash.tolist())) == 7
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 100, dtype=U))
    assert (unpack_sorted(pack_sorted(x)) == x).all() and (unplanes(planes(x), U) == x).all()


def test_distinct_places():
    rng = np.random.default_rng(4)
    for keys in (np.zeros(0, U), rng.integers(0, 2**64, 500, dtype=U)[rng.integers(0, 500, 2000)], rng.integers(0, 50, 300, dtype=U), U(2**63) + rng.integers(0, 2**12, 1000, dtype=U)):
        want, places = np.unique(keys, return_inverse=True)
        got = distinct_places(keys)
        assert (got[0] == want).all() and (got[1] == places).all()


def test_elias_fano_trie(tmp_path):
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 5000):
        keys = np.unique(np.minimum(rng.zipf(1.4, n), 2**29).astype(U) << U(26) | rng.integers(0, 2**26, n, dtype=U))
        codes = rng.integers(1, 65536, len(keys))
        eliasfano.Trie.write(str(tmp_path / f"{n}.trie"), keys, codes, 26)
        asked = np.unique(np.concatenate([keys, keys + U(1), rng.integers(0, 2**56, 50, dtype=U)]))
        want = dict(zip(keys.tolist(), codes.tolist(), strict=True))
        trie = eliasfano.Trie(str(tmp_path / f"{n}.trie"), 26)
        assert trie.lookup(asked).tolist() == [want.get(k, 0) for k in asked.tolist()]
        assert (trie.successors.get(np.arange(len(keys))) & U(2**26 - 1) == keys & U(2**26 - 1)).all()
    p = np.array([0, 1, 0.5, 1 / 3, 1e-7, 1e-13])
    assert np.allclose(eliasfano.probability(eliasfano.quantise(p)), p, rtol=2.6e-4, atol=0)
    assert eliasfano.probability(np.uint16(65535)) == pytest.approx(1e-14)


def brute_lm(rows, order):
    """Each row's id, fold, tokens, known tokens, training tokens, base score and score, from exact counts."""
    tokens = [[*SPACE.findall(lower(r[1] or "")), "\0end"] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    count = [Counter() for _ in range(order + 1)]
    for ts, h in zip(tokens, held, strict=True):
        padded = ["\0end"] * (order - 1) + ts
        if not h:
            for k in range(1, order + 1):
                count[k].update(tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded)))
    n, v = sum(count[1].values()), len(count[1])
    contexts = [Counter() for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in count[k].items():
            contexts[k][g[:-1]] += c
    for r, ts, h in zip(rows, tokens, held, strict=True):
        padded, base, score = ["\0end"] * (order - 1) + ts, 0.0, 0.0
        for i in range(order - 1, len(padded)):
            p = (count[1][(padded[i],)] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                g = tuple(padded[i - k + 1 : i + 1])
                p = (count[k][g] + lm.MU[k] * p) / (contexts[k][g[:-1]] + lm.MU[k])
            score += math.log10(p)
        yield r[0], h, len(ts), sum(count[1][(t,)] > 0 for t in ts), n, base, score


@pytest.mark.parametrize(("order", "slice_"), [(1, 1 << 16), (2, 1 << 16), (3, 1 << 16), (3, 4), (4, 1)])
def test_lm_scores(docs, empty, order, slice_):
    """Exact but for the codes of probabilities, each 0.025 % off at most (1.1e-4 in a token's logarithm); also with contexts cut into slices."""
    key = lambda r: (r[0] is None, r[0], r[5])
    want = sorted(brute_lm(corpus(), order), key=key)
    got = sorted((tuple(r) for r in lm.score(docs, order=order, slice_counts=slice_).collect()), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], abs=1.1e-4 * (order - 1) * g[2] + 1e-9)
    assert lm.score(empty, order=order).count() == 0


@pytest.mark.parametrize("slice_", [1, 3, 1 << 16])
def test_lm_blocks_and_buckets_agree_on_slices(slice_):
    """Two blocks and three buckets by hand: what is told is the brute-force probability of every n-gram of order 2."""
    texts = [["a b a c a d a b", "a b", "b a"], ["a d a e", "x"]]
    made = [pa.record_batch({"text": t, "held_out": [False] * len(t)}) for t in texts]
    told: list[list[list[dict]]] = [[], []]
    for order in (1, 2):
        blocks_ = []
        for k in range(2):
            tokens = lm._Tokens([made[k]], slice_)
            tokens.hear(told[k], lm.MU)
            blocks_.append(list(lm._ask(k, tokens, order, 3)))
        answers = [a for b in range(3) if any(r["bucket"] == b for rows in blocks_ for r in rows) for a in lm._answer(pa.Table.from_pylist([r for rows in blocks_ for r in rows if r["bucket"] == b], schema=lm._ASKED), order, lm.MU[order])]
        for k in range(2):
            told[k].append([a for a in answers if a["block"] == k])
    rows = [(100 * k + i, t) for k in range(2) for i, t in enumerate(texts[k])]
    bigrams, contexts = Counter(), Counter()
    for _, t in rows:
        padded = ["\0end", *t.split(), "\0end"]
        bigrams.update(zip(padded, padded[1:]))
        contexts.update(padded[:-1])
    for k in range(2):
        tokens = lm._Tokens([made[k]], slice_)
        tokens.hear(told[k], lm.MU)
        want = [bigrams[g] / (contexts[g[0]] + lm.MU[2]) for t in texts[k] for padded in [["\0end", *t.split(), "\0end"]] for g in zip(padded, padded[1:])]
        assert np.allclose(tokens.terms[0][0], want, rtol=2.6e-4, atol=0)
        assert tokens.count.tolist() == [bigrams[g] for t in texts[k] for padded in [["\0end", *t.split(), "\0end"]] for g in zip(padded, padded[1:])]


def test_lm_default_uses_two_words_of_context(spark):
    # after "x a" comes c, after "y a" comes d: one word of context cannot tell them apart
    texts = ["x a c", "y a d"] * 20 + ["x a c", "x a d"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, held_out="doc_id >= 40").collect()}
    assert got[40] > got[41] + 0.1


def test_quality_counts_and_verdict(docs, empty):
    got = quality.judge(docs).select("doc_id", "text", "quality.*").collect()
    for r in got:
        text = r.text or ""
        ws = SPACE.findall(text)
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        many = Counter(grams)
        repeat = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), len(repeat))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.base_failed == (len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    assert quality.judge(docs, rules=()).where("quality.kept").count() == sum(not r.base_failed for r in got)
    assert "quality" in quality.judge(docs).columns and quality.judge(docs).where("quality.kept").select("set").count() >= 1


def test_quality_counts_do_not_depend_on_hashes(spark, docs):
    """Windows whose hashes collide, and repeats that interleave with them: A B A B by place."""
    turns = spark.createDataFrame([(900, "a b c x d e f y a b c z d e f w a b c"), (901, "p q r s t u v w"), (902, "m m m m m")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(turns)
    counted = [sorted(((r.doc_id or -1, r.text or "", r.n_repeat_words, r.kept) for r in quality.judge(table, hash_bits=bits).select("doc_id", "text", "quality.*").collect())) for bits in (64, 3, 0)]
    assert counted[0] == counted[1] == counted[2]
    assert {r[0]: r[2] for r in counted[2] if r[0] >= 900} == {900: 15, 901: 0, 902: 5}


def brute_spans(rows, window):
    where = {}
    for doc_id, text in rows:
        ws = SPACE.findall(text or "")
        for i in range(len(ws) - window + 1):
            if doc_id is not None:
                key = tuple(ws[i : i + window])
                where[key] = min(where.get(key, doc_id), doc_id)
    for doc_id, text in rows:
        ws = SPACE.findall(text or "")
        gone = {i + k for i in range(len(ws) - window + 1) if doc_id is not None and where[tuple(ws[i : i + window])] < doc_id for k in range(window)}
        yield doc_id, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()


@pytest.mark.parametrize(("window", "anchor"), [(13, 5), (4, 1), (6, 6)])
def test_substring_spans(docs, empty, window, anchor):
    got = substring.duplicate_spans(docs, window=window, anchor=anchor, block_bytes=2000, carry=("lang", "set")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == Counter(brute_spans([r[:2] for r in corpus()], window))
    for r in got:
        assert sum(s.last - s.first for s in r.spans) == r.n_removed
        for s in r.spans:
            assert SPACE.findall(r.text)[s.first : s.last] == SPACE.findall(r.text[s.char_start : s.char_end])
    texts = {r[0]: SPACE.findall(r[1] or "") for r in corpus()}
    for r in got:
        covered = set()
        for f in r.factors:
            assert f.reference_id < r.doc_id and f.length >= window
            assert texts[r.doc_id][f.first : f.first + f.length] == texts[f.reference_id][f.reference_first : f.reference_first + f.length]
            covered |= set(range(f.first, f.first + f.length))
        assert len(covered) == r.n_removed
        assert [f.first for f in r.factors] == sorted(f.first for f in r.factors)
    assert substring.duplicate_spans(empty).count() == 0


def test_substring_factors_name_their_reference(spark):
    """A passage taken from two references is two factors that overlap where the words of both meet."""
    w = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(w[:30])), (2, "x " + " ".join(w[15:50])), (3, "a b " + " ".join(w[5:45]) + " c"), (4, "y " * 5 + " ".join(w[40:60]))]
    got = {r.doc_id: r for r in substring.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(f) for f in got[3].factors] == [(2, 25, 1, 5), (15, 27, 2, 4)] and [(s.first, s.last) for s in got[3].spans] == [(2, 42)]
    assert [tuple(f) for f in got[2].factors] == [(1, 15, 1, 15)] and got[1].factors == [] and got[4].factors == []


def test_substring_text_without_spans(docs):
    got = {r.doc_id: r for r in substring.remove_spans(substring.duplicate_spans(docs).where("doc_id in (0, 10)")).collect()}
    assert got[0].text == corpus()[0][1] and SPACE.findall(got[10].text) == SPACE.findall(got[10].kept)


def test_license_scan(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    gpl = next(r for r in got.values() if "gpl" in r.labels)
    assert (gpl.n_base, gpl.base_labels, gpl.first_word, gpl.score) == (2, "gpl,reserved", 0, 1.0)
    ccs = next(r for r in got.values() if r.n_words == 5 and "cc-by" in r.base_labels)
    assert (ccs.n_base, ccs.first_word, ccs.last_word) == (2, 0, 2)
    assert all(r.labels == "" and r.score == 0 for r in got.values() if r.n_words == 0)
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for doc_id, text, *_ in corpus():
        lines = [set(words.findall(lower(x))) for x in (text or "").split("\n")]
        want = {label for t, label in licenses.TEMPLATES if any(len(b & set(t.split())) >= licenses.THRESHOLD * len(set(t.split())) for b in lines)}
        if doc_id is not None:
            assert want | set(filter(None, got[doc_id].base_labels.split(","))) == set(filter(None, got[doc_id].labels.split(",")))
    assert licenses.scan(empty).count() == 0


def test_license_prefix_mask_is_by_vocabulary_number():
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD).rank_by({0: 5, 3: 9, 7: 1})
    assert all(known.in_prefix[k] == (int(known.rank[k]) in known.index) for k in range(len(known.vocabulary)))


def test_license_names_are_confirmed(spark, empty):
    cases = [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Licensed under CC BY 4.0 or under CC BY-NC 4.0", "cc-by,cc-by-nc"),
        ("released under the license", ""),
        ("released under\nthe MIT\nlicense", "mit"),
        ("some text\nLicensed under the\nApache License,\nVersion 2.0 and more text", "apache"),
        ("Licensed under\nCC BY-NC 4.0", "cc-by-nc"),
        ("Licensed under CC\nBY 4.0", "cc-by"),
        ("licensed under\n" + "word " * 40 + "\ncc by sa 4 0", ""),
        ("Permission is hereby granted, free of charge,\nto any person obtaining a copy of\nthis software", "mit"),
        (None, ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.confirm(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert licenses.confirm(empty).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((600, 16)).astype(np.float32)
    vectors[100:300] = vectors[50]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows[7] = (7, None, "x")
    rows[50 * 3] = (150, [0.0] * 16, "x")
    rows[9] = (9, [1.0, None] * 8, "x")
    rows[11] = (11, [float("nan")] * 16, "x")
    rows[12] = (12, [1.0] * 4, "x")
    rows.append(rows[20])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    got = forest.nearest(table, table.where("vec_id % 50 = 0"), node_rows=20, block_rows=100).collect()
    fine = {i: np.array(v, float) for i, v, _ in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    hit = total = 0
    for q in [i for i in fine if i % 50 == 0]:
        scores = sorted((-(v @ fine[q]) / np.sqrt((v @ v) * (fine[q] @ fine[q])), i) for i, v in fine.items() if i != q)[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        if q in range(100, 300) or q == 50:
            assert [r.vec_id for r in mine] == [i for i in (50, *range(100, 110)) if i != q][:5]
        hit += len({r.vec_id for r in mine} & {i for _, i in scores})
        total += 5
        for r in mine:
            v, w = fine[q], fine[r.vec_id]
            assert r.score == pytest.approx(v @ w / np.sqrt((v @ v) * (w @ w)), abs=1e-14)
    assert hit / total >= 0.9
    assert forest.nearest(table.limit(0), table.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, shard string")
    assert few.count() == 3 and forest.nearest(few, few.where("vec_id = 0")).count() == 2


def test_nearest_in_clusters_scores_few_rows(spark):
    """Clustered vectors with a constant number of candidates: under a tenth of the rows are scored; lone queries ascend to shorter prefixes."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24))
    vectors = np.concatenate([centres[rng.integers(0, 60, 2900)] + 0.25 * rng.standard_normal((2900, 24)), rng.standard_normal((100, 24)) - 3])
    order = rng.permutation(3000)
    vectors = vectors[order]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = forest.nearest(table, table.where("vec_id % 50 = 0"), trees=16, least=250, scored=True).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 300 and hit >= 0.9 * 300
    assert np.mean([r.scored for r in got]) < 300


def test_nearest_rows_of_one_id_are_one_row(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [5.0, 1.0])], "vec_id long, embedding array<double>")
    for frame in (table, table.repartition(4)):
        got = forest.nearest(frame, frame.where("vec_id = 0")).collect()
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (2, pytest.approx(1 / math.sqrt(26)))]


def brute_components(rows, width, percent):
    sets = {}
    for doc_id, text in rows:
        ws = SPACE.findall(lower(text or ""))
        if ws and doc_id is not None:
            sets[doc_id] = frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1)))
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = {k: min(x, y) if c in (x, y) else c for k, c in comp.items()}
    return {(i, len(sets.get(i, ())), comp.get(i, i)) for i, _ in rows}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, width, percent):
    got = near.near_duplicates(docs, width=width, percent=percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {x for x in brute_components([r[:2] for r in corpus()], width, percent) if x[0] is not None}
    assert len(got) == len(corpus()) and all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert near.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Hundreds of near copies of one text, many of them under the threshold with one another; parts and deep nodes are met."""
    monkeypatch.setattr(near, "PART", 32)
    monkeypatch.setattr(near, "NODE_PART", 48)
    monkeypatch.setattr(near, "SMALL", 24)
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(220):
        ws = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            ws[rnd.randrange(150)] = f"z{rnd.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 85)


def test_toxicity_held_out(spark, docs, empty):
    rnd = random.Random(1)
    plain, bad = [f"word{k}" for k in range(300)], ["idiot", "clown", "moron"]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        ws = [rnd.choice(plain) for _ in range(40)] + ([rnd.choice(bad) for _ in range(3)] if toxic else [])
        rnd.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, 1 if toxic else 0))
    labels += [(3, None), (None, 1)]
    table, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(table, toxicity.fit(table, known)).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    weights = toxicity.fit(table, known)
    assert len(weights[0]) < 2000 and toxicity.fit(empty.select("doc_id", "text"), known.limit(0))[0].size == 0
    odd = toxicity.score(docs, weights).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 for r in odd) and toxicity.score(empty, weights).count() == 0


def test_mix_against_water_filling(docs, empty):
    got = mixing.mix(docs).selectExpr("doc.doc_id", "doc.source", "doc.text", "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for r in got:
        assert r.size == len(SPACE.findall(r.text or ""))
        sizes[r.source] += r.size
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.remove(s)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s in names:
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s)
    again = mixing.mix(docs.repartition(5)).selectExpr("doc.doc_id", "doc.text", "copies").collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in again) == Counter((r.doc_id, r.text, r.copies) for r in got)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_mix_takes_some_of_equal_rows(spark, partitions):
    """A thousand equal rows of ten words: the target is met to half a document, not by all or none of them."""
    schema = "doc_id long, text string, source string, u long, size string"
    rows = [(5, "ten words " * 5, "a", 1, "x")] * 1000 + [(k, "w " * 70, "b", 1, "x") for k in range(100, 103)] + [(9, None, None, 1, "x")] * 20
    got = mixing.mix(spark.createDataFrame(rows, schema).repartition(partitions)).selectExpr("doc.source", "doc.u", "size", "target", "copies").collect()
    for source in ("a", "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= own[0]["size"] / 2 and all(r.copies in (1, 2) for r in own)
    assert len(got) == len(rows) and {r.copies for r in got if r.source is None} == {0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header><nav><ul><li><a href=a>Menu one</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work for you and for others.</div><article><h1>Title &amp; more</h1><p>First <b>bold
paragraph</b> with&nbsp;text that says something at some length about a topic.<p>Second&lt;x&gt; paragraph<br>goes on here for quite a while.<div class="ad">Buy now</div>
<script>var a="</p>";</script><form>Your name <input></form></article><div id="comments"><p>Nice post, I liked it very much and will come back to read more of it soon.</p></div><footer>&copy; 2024</footer>"""


def test_main_text(spark):
    want = "Title & more First bold paragraph with text that says something at some length about a topic. Second<x> paragraph goes on here for quite a while."
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p <b", "x"), (5, "u", PAGE, "x"), (None, "u", "<article><p>" + "long text " * 20000, "x")]
    got = {r.page_id: r for r in mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == want and got[5].text == want and got[1].n_chars == len(want)
    assert (got[2].text, got[3].text, got[2].n_chars) == ("", "", 0) and got[None].n_chars == 199999
    assert mainhtml.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def article_of(html):
    """The article of a page of the driver's table by patterns alone."""
    inside = re.sub(r"</?(?:h1|p|br|div|li|ul)\b[^>]*>", " ", re.search(r"<article>(.*?)</article>", html, re.S)[1])
    return " ".join(unescape(re.sub(r"<[^>]*>", "", inside)).split())


def table_pages():
    return [r["html"] for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]


def test_main_text_of_all_pages_of_a_table():
    for html in table_pages():
        assert mainhtml.main_text(html) == article_of(html)


def test_cut_decides_where_elements_do_not_say_what_they_are():
    """Pages with div in place of article, nav and footer: the cut halves the errors of the classifier alone."""
    costs, alone, cut = mainhtml.Costs(), 0, 0
    for html in table_pages():
        want = {b.text for b in mainhtml.blocks_of(re.search(r"<article>.*?</article>", html, re.S)[0], costs)}
        found = mainhtml.blocks_of(re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", html).replace(' class="ad"', ""), costs)
        for b, kept, s in zip(found, mainhtml.label(found, costs), mainhtml.scores(found, costs), strict=True):
            alone += (s > 0) != (b.text in want)
            cut += kept != (b.text in want)
    assert cut < 0.6 * alone


def test_smoothing_keeps_a_short_and_a_linked_paragraph():
    long = "<p>" + "a paragraph of many words on one topic that goes on " * 6
    page = f"<div>{long}</p><p>Yes.</p>{long}</p></div><div><ul><li><a href=a>Home page</a><li><a href=b>More</a></ul></div>"
    costs = mainhtml.Costs()
    found = mainhtml.blocks_of(page, costs)
    assert [s > 0 for s in mainhtml.scores(found, costs)] == [True, False, True, False, False]
    assert mainhtml.label(found, costs) == [True, True, True, False, False]


def test_article_parts_stay():
    page = '<article><h1>T</h1><p class="meta">Written on a day</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be, <object>an object</object>.</p><xmp>a <b> & &amp; c</xmp><figure><figcaption class="caption">A figure of it</figcaption></figure><p class="disclaimer">No warranty is given here</p><button>Go</button></article>'
    assert mainhtml.main_text(page) == "T Written on a day Let x=1 be, an object. a <b> & &amp; c A figure of it No warranty is given here"


@pytest.mark.parametrize("piece", ["<a '", "<a ='", "<div>", "<div></p>", "<head>", "<!", "<!--", "<p>x", "<", "<script>", "<a b=", "</x", "<li>y</ul>"])
def test_malformed_pages_of_a_megabyte_take_seconds(piece):
    began = time.process_time()
    mainhtml.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 30


def test_min_cut_is_minimal():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        content, boiler = [rnd.random() * 3 for _ in range(n)], [rnd.random() * 3 for _ in range(n)]
        edges = [(a, b, rnd.random()) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        cost = lambda labels: sum(boiler[i] if x else content[i] for i, x in enumerate(labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(mainhtml.min_cut(content, boiler, edges)) == pytest.approx(best)


def test_pieces(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = pieces.encode_decode(docs, pieces.default_model(), outputs=("ids", "spans", "decoded", "n_tokens", "n_bytes", "ids_sha256")).collect()
    texts = Counter((r[0], tuple(model.encode(r[1] or "")), model.decode(model.encode(r[1] or ""))) for r in corpus())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == texts
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        at = 0
        for s in r.spans:
            assert s.start == at
            at = s.end
        assert at == r.n_bytes
    assert pieces.encode_decode(empty, pieces.default_model()).count() == 0


def test_spans_are_the_surfaces_of_the_library(docs):
    """Every piece but byte pieces covers the text that the library names as its surface."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    compared = 0
    for r in pieces.encode_decode(docs, pieces.default_model(), outputs=("spans",)).where("doc_id is not null").collect():
        data = texts[r.doc_id].encode()
        for s, piece in zip(r.spans, model.encode(texts[r.doc_id], return_type="proto").pieces, strict=True):
            if not model.is_byte(piece.id):
                assert data[s.start : s.end].decode() == piece.surface
                compared += 1
    assert compared > 1000


def test_copies_of_one_text_are_dealt_over_keys(spark, monkeypatch):
    monkeypatch.setattr(near, "COPIES", 4)
    rows = [(i, "one text of some words that is copied often") for i in range(30)] + [(40, "another text of some words here"), (41, None), (None, "one text of some words that is copied often")]
    got = {(r.doc_id, r.component_id) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(30)} | {(40, 40), (41, 41), (None, None)}


def charsmap(pairs):
    """A compiled character map of one-byte sources, for the trie reader."""
    units, pool = [0] * 1024, b""
    units[0] = 256 << 10  # children of the root from 256 on
    for k, (source, target) in enumerate(pairs):
        at, leaf = 256 ^ ord(source), 768 + 2 * k
        units[at] = ord(source) | 0x100 | (at ^ leaf) << 10
        units[leaf] = 0x80000000 | len(pool)
        pool += target.encode() + b"\0"
    return len(units).__mul__(4).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + pool


def test_normalizer_map_and_alignment():
    n = pieces.Normalizer(charsmap([("A", "a"), ("&", "and"), ("\t", " ")]))
    out, origin = n("A&\tb é")
    assert out.decode() == "▁aand▁b▁é"
    assert origin.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 4, 4, 4, 5, 6, 7]
    trimmed = pieces.Normalizer(b"", True, True)
    assert trimmed("  a   b  ")[0].decode() == "▁a▁b" and pieces.Normalizer(b"")("")[0] == b""
