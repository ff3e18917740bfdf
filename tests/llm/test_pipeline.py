"""The pipeline's stages on a small corpus."""

import re

import corpus_pipeline
from tests.llm.test_operators import SPACE


def test_stages(spark):
    plain = " ".join(f"the word{k} of text{k}" for k in range(40))
    other = " ".join(f"and item{k} in list{k}" for k in range(60))
    shared = " ".join(f"to passage{k}" for k in range(30))
    junk = "### $$$ %%% " * 60
    rows = [(1, plain, "en", "a", len(plain)), (2, plain, "en", "b", len(plain)), (3, other + " " + shared, "en", "a", 1), (4, " ".join(f"is new{k} the" for k in range(40)) + " " + shared, "en", None, 1), (5, junk, "en", "a", 1), (6, None, None, None, None), (7, "short", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = corpus_pipeline.blocks.cut_lineage(docs)
        if name != "encoding":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append((name, sorted({r.doc_id for r in docs.select("doc_id").collect()})))
        if name == "substring_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert texts[1] == plain and "passage5" in texts[3] and "passage5" not in texts[4] and len(SPACE.findall(texts[4])) == 120
    assert dict(kept)["quality"] == [1, 2, 3, 4] and dict(kept)["near_dedup"] == [1, 3, 4] and dict(kept)["substring_dedup"] == [1, 3, 4]
    assert all(r.n_tokens == len(r.ids) and re.fullmatch("[0-9a-f]{64}", r.decoded_sha256) for r in docs.collect())


ODD = "doc_id long, text string, lang string, source string, n_chars long, block int, kept boolean, doc string"


def odd_rows():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    text = lambda k: ". ".join(" ".join(words[(k * 7 + i * (j + 3)) % 19] + str((i * j + k) % 13) for i in range(9)) for j in range(1, 13))
    rows = [(k, text(k)) for k in range(6)] + [(2, text(2)), (2, text(9)), (None, text(11)), (None, None), (20, None), (21, ""), (22, "\n \t")]
    return [(i, t, None, "s" if k % 3 else None, None if t is None else len(t), 0, False, "x") for k, (i, t) in enumerate(rows)]


def test_stages_with_odd_rows_keep_the_columns_and_the_clean_documents(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        ids = [r.doc_id for r in out.collect()]
        if name == "near_dedup":
            # one row of each id, one document of equal texts, and all rows without an id
            assert sorted(i for i in ids if i is not None and i < 6) == list(range(6)) and ids.count(None) == 2
        if name == "substring_dedup":
            assert {0, 1, 2, 3, 4, 5} <= set(ids) and ids.count(None) == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == len(odd_rows()) and all(r.n_tokens == 0 for r in last if r.doc_id in (20, 21))


def test_stages_of_an_empty_table_are_empty(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ODD), "").collect() == [], name
