"""Pairs by tiles against the SQL of the same views, which joins words."""

import random

import pyarrow as pa
import pytest

from tessera.operators import alignment, tiles
from tessera.plans.operator import OPERATORS, selected

NAMES = ["max_distance", "nearest_parents", "packed_pair_distance", "sampled_nearest"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(spark, name, sites):
    needed, view = ("embed_sites", "sketch_pairs") if name == "sampled_nearest" else ("words", "packed_pairs")
    return OPERATORS[name].run(spark, **{view: alignment._by_rows(view, selected(needed, spark, embed_sites=sites))})


def alignments():
    rnd = random.Random(5)
    full = [(7 * i - 50, s, rnd.randint(0, 4)) for i in range(60) for s in range(64)]
    gaps = [(i, s, rnd.randint(0, 5)) for i in range(50) for s in range(rnd.choice([0, 20, 70]), rnd.choice([21, 60, 150])) if rnd.random() < 0.8]
    alike = [(i, s, (s + (i % 3 == 0 and s == 5)) % 4) for i in range(40) for s in range(64)]
    return {"full": full, "gaps": gaps, "alike": alike, "nameless": [*full[:640], *((None, s, 1) for s in range(9))], "twice": [*full[:640], *full[:70]], "one": full[:64], "none": []}


@pytest.mark.parametrize("name", NAMES)
def test_tiles_equal_joined_words(spark, name, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST_TILE", 7)
    for kind, sites in alignments().items():
        frame = spark.createDataFrame(sites, "seq_id long, site int, base int").repartition(3)
        got, want = OPERATORS[name].run(spark, embed_sites=frame), plain(spark, name, frame)
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert rows(got) == rows(want), kind


@pytest.mark.parametrize("name", NAMES)
def test_no_row_a_pair_and_word(spark, name):
    frame = spark.createDataFrame([(i, s, (i * s) % 4) for i in range(9) for s in range(64)], "seq_id long, site int, base int")
    assert "Join" not in OPERATORS[name].run(spark, embed_sites=frame)._jdf.queryExecution().optimizedPlan().toString()


def test_ids_that_are_no_numbers_take_the_join(spark):
    frame = spark.createDataFrame([(f"s{i}", s, (i * s) % 4) for i in range(9) for s in range(64)], "seq_id string, site int, base int")
    assert rows(OPERATORS["nearest_parents"].run(spark, embed_sites=frame)) == rows(plain(spark, "nearest_parents", frame))


@pytest.mark.parametrize("name", NAMES)
def test_blocks_of_many_tiles_equal_joined_words(spark, name, monkeypatch):
    for key, value in {"TILE": 4, "LEAST_TILE": 12, "RUN": 3, "PAIRS": 7}.items():
        monkeypatch.setattr(tiles, key, value)
    for kind in ("full", "gaps", "alike"):
        frame = spark.createDataFrame(alignments()[kind], "seq_id long, site int, base int")
        for held in (1 << 24, 300):  # few blocks of several tiles, and more where a block may hold less
            monkeypatch.setattr(tiles, "HELD", held)
            assert rows(OPERATORS[name].run(spark, embed_sites=frame)) == rows(plain(spark, name, frame)), (kind, held)


@pytest.mark.parametrize("ordered", [False, True])
def test_tiles_cross_the_shuffle_as_often_in_a_large_table(spark, ordered, monkeypatch):
    """Not once for each tile that it meets, which would be 8 times as often in the larger table."""
    monkeypatch.setattr(tiles, "TILE", 8)
    monkeypatch.setattr(tiles, "LEAST_TILE", 4)

    def copies(n):
        def run(meetings):
            read = {int(ids[0]): len(ids) for m in meetings for ids, _ in m[:2]}
            yield pa.RecordBatch.from_pydict({"n": [sum(read.values())]})

        words = spark.range(n).selectExpr("id AS seq_id", "0 AS word", "id % 1000 AS bases", "1L AS valid")
        return tiles._meetings(words, tiles.tiling(words), ordered, run, "n long").agg({"n": "sum"}).first()[0] / n

    assert copies(1280) <= 1.1 * copies(160)


def test_ids_of_pairs_are_small_in_files(spark, monkeypatch, tmp_path):
    """All 4,096 sequences of this tile between an id and the same id took 0.98 bytes a pair."""
    monkeypatch.setattr(tiles, "LEAST_TILE", 4096)
    words = spark.range(4096).selectExpr("id * 3 AS seq_id", "0 AS word", "id % 1000 AS bases", "1L AS valid")
    tiles.pairs(words, tiles.tiling(words)).select("left_id", "right_id").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 4096 * 4095 // 2
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * 4096 * 4095 // 2
