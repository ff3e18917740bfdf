"""Operator 12 against brute force, and its transform against sorted suffixes."""

import hashlib
import random

import pytest

from tessera.llm import columnwise, suffixes


def some_strings(rnd, alphabet, least):
    base = "".join(rnd.choice(alphabet) for _ in range(60))
    out = []
    for _ in range(rnd.randint(1, 12)):
        a = rnd.randint(0, 30)
        s = base[a : a + rnd.randint(least, 30)] if rnd.random() < 0.5 else "".join(rnd.choice(alphabet) for _ in range(rnd.randint(least, 25)))
        out.append(s.encode())
    return out


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc\x00", "é日a"])
def test_transform_and_common_prefixes_equal_sorted_suffixes(alphabet):
    rnd = random.Random(3)
    for _ in range(20):
        strings = some_strings(rnd, alphabet, 1)
        ordered = sorted(((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: ([b + 1 for b in x[0]] + [0], x[1]))
        transform, shared = columnwise.construct(strings, 1)
        assert transform.tolist() == [strings[k][i - 1] + 1 if i else 0 for _, k, i in ordered]
        common = [0] + [next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y))) for (x, _, _), (y, _, _) in zip(ordered, ordered[1:], strict=False)]
        assert shared.tolist() == common


@pytest.mark.parametrize(("width", "stride"), [(5, 1), (6, 2), (6, 3), (10, 5)])
def test_windows_of_a_class_are_equal_and_all_are_there(width, stride):
    rnd = random.Random(4)
    for alphabet in ("ab", "abcd"):
        for _ in range(20):
            strings = some_strings(rnd, alphabet, width)
            found = list(zip(*(x.tolist() for x in columnwise.windows(strings, width, stride)), strict=True))
            assert sorted((s, f) for s, f, _ in found) == [(k, i) for k, s in enumerate(strings) for i in range(len(s) - width + 1)]
            texts = {}
            for s, f, kind in found:
                texts.setdefault(kind, set()).add(strings[s][f : f + width])
            assert all(len(t) == 1 for t in texts.values()) and len(set.union(*texts.values())) == len(texts)


def test_large_collections_take_narrow_symbols():
    class Long(bytes):
        def __len__(self):
            return 1 << 20

    assert [columnwise.widest_stride([Long()] * n, 100) for n in (1, 15, 17, 5000)] == [5, 5, 4, 2]
    assert columnwise.widest_stride([b"abc"], 7) == 1


def brute(rows, width):
    seen = {}
    for i, t in rows:
        b = (t or "").encode() if i is not None else b""
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] = min(seen.get(b[p : p + width], (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1) if i is not None else []:
            if seen[b[p : p + width]] < (i, p):
                gone[p : p + width] = [True] * width
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(1)
    base = "".join(rnd.choice("ab é") for _ in range(300))
    rows = []
    for i in range(60):
        a = rnd.randint(0, 200)
        rows.append((i, base[a : a + rnd.randint(0, 100)] + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))))
    return [*rows, (100, None), (101, ""), (102, "a" * 900), (103, "abc" * 300), (None, base), (5, base), (5, base), (104, base), (-3, base[50:]), (105, "😀日" * 20)]


@pytest.mark.parametrize(("hot_runs", "block_bytes", "collection"), [(1000, 2000, 2000), (1, 300, 500)])
def test_repeated_spans_equal_brute_force(spark, hot_runs, block_bytes, collection):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n_bytes int, bucket string, spans string").repartition(3)
    got = suffixes.repeated_spans(docs, shape=suffixes.Shape(20, 6, collection, hot_runs), block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(rows, 20)
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.last - s.first for s in r.spans) == r.n_removed


def test_repeated_spans_of_production_width(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, long = text(40), text(3000)
    rows = [(i, f"{text(rnd.randint(0, 30))} {passage} {text(20)}" if i % 3 else text(60)) for i in range(40)] + [(50, long), (51, long[2000:9000] + text(9)), (52, long), (53, passage[:99]), (54, passage[:100]), (55, "z" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.repeated_spans(docs, block_bytes=1 << 14).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(rows, 100)


def test_pieces_are_told_in_one_order_whatever_the_order_of_rows():
    import pyarrow as pa

    from tessera.llm import blocks

    schema, rnd, orders = pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), random.Random(6), []
    rows = [(i, t) for i, t in corpus() if i is not None]
    for _ in range(3):
        rnd.shuffle(rows)
        batch = pa.record_batch({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}, schema=schema)
        texts = pa.table({"rows": [blocks.press(batch.serialize())]})
        shape = suffixes.Shape(20, 6, 2000, 1000)
        keys = suffixes.Block(texts, schema, None, shape).anchors()[0]
        told = suffixes._table([{"bucket": 0, "block": 0, "kind": suffixes.ANCHORS, "sizes": blocks.press(bytes([suffixes.SHARED]) * len(keys))}])
        pieces, by = suffixes._by_key(suffixes.Block(texts, schema, told, shape).distinct()[1])
        assert len(set(by.tolist())) < len(by)
        orders.append(pieces)
    assert orders[0] == orders[1] == orders[2]


def test_the_largest_id_is_an_id(spark):
    rows = [(2**63 - 1, "abcdefghijklmnopqrstuvwxyz" * 2), (3, "bcdefghijklmnopqrstuvwxyz"), (None, "abcdefghijklmnopqrstuvwxyz" * 2)]
    got = suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), shape=suffixes.Shape(20, 6)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute(rows, 20)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_spans(empty).collect() == []
