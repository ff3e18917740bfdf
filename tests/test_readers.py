"""Readers of alignment and annotation files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.sources import readers

FASTA = ">one x\n; a comment\nacgu\nAC\n\n>two\nAC-TAC\n>two\nACNTAC\n"
CLUSTAL = "CLUSTAL W\n\none   ACGT 4\ntwo   AC-T 4\ntri   ACNT 4\n      ** *\n\none   AC\ntwo   AC\ntri   AC\n"
NEXUS = "#NEXUS\nbegin data;\nMatrix\n'one x' ACGT AC [6]\n\"two\" AC-TAC\ntri ACN\ntri TAC\n;\nend;\n"
PHYLIP = " 3 6\none ACGT\ntwo AC-T\ntri ACNT\n\nAC\nAC\nAC\n"


def texts(spark, *values):
    return spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(values)], "path string, text string")


def read(frame):
    return [tuple(r)[1:] for r in frame.orderBy("path", "position").collect()]


def test_formats(spark):
    same = lambda a, b, c: [(1, a, "ACGTAC"), (2, b, "AC-TAC"), (3, c, "ACNTAC")]
    assert read(readers.fasta(texts(spark, FASTA))) == [(1, "one x", "acguAC"), (2, "two", "AC-TAC"), (3, "two", "ACNTAC")]
    assert read(readers.clustal(texts(spark, CLUSTAL))) == same("one", "two", "tri")
    assert read(readers.nexus(texts(spark, NEXUS))) == same("one x", "two", "tri")
    assert read(readers.phylip(texts(spark, PHYLIP))) == same("one", "two", "tri")
    every = readers.finalize(readers.alignment(texts(spark, FASTA, CLUSTAL, NEXUS, PHYLIP)))
    assert read(every) == same("one x", "two", "two_2") + same("one", "two", "tri") + same("one x", "two", "tri") + same("one", "two", "tri")
    coded = readers.sites(every).where("path = 'f1' and seq_id = 1").orderBy("site")
    assert [r.base for r in coded.collect()] == [0, 1, 5, 3, 0, 1]


@pytest.mark.parametrize(
    ("text", "reader"),
    [("ACGT\n>one\nAC\n", readers.fasta), ("#NEXUS\nbegin data;\n", readers.nexus), ("4 6\none ACGTAC\n", readers.phylip), ("what", readers.alignment), (">a\nAC\n>b\nAC\n", lambda t: readers.finalize(readers.fasta(t))), (">a\nAC\n>b\nAC\n>c\nA\n", lambda t: readers.finalize(readers.fasta(t)))],
)
def test_malformed(spark, text, reader):
    with pytest.raises(PySparkException):
        reader(texts(spark, text)).collect()


def test_unknown_formats_raise_over_grouped_texts(spark):
    """The check must not move below an aggregate that makes the texts."""
    rows = spark.createDataFrame([("f0", 0, ">a"), ("f0", 1, "ACGT"), ("f1", 0, "what")], "path string, line int, text string")
    whole = rows.groupBy("path").agg(F.expr("array_join(transform(array_sort(collect_list(struct(line, text))), x -> x.text), '\n')").alias("text"))
    assert [r.sequence for r in readers.alignment(whole.where("path = 'f0'")).collect()] == ["ACGT"]
    with pytest.raises(PySparkException, match="unknown alignment format"):
        readers.alignment(whole).collect()


def test_annotations(spark):
    gff = "##gff-version 3\nchrM\ttool\tCDS\t7\t450\t.\t-\t2\tID=orf1;gene=coat%20p;gene=rep+2\nchrM\ttool\tCDS\t12\t5\t.\t+\t0\tID=turned\n"
    gb = 'FEATURES             Location/Qualifiers\n     tRNA            complement(61..140)\n                     /gene="trn"\n                     /note=short\n     odd             elsewhere\n'
    bed = "seg 3 17 stem\nseg 620 9999\n"
    got = {r.id: r for r in readers.annotations(texts(spark, gff, gb, bed), 700).collect()}
    c = got["orf1"]
    assert (c.type, c.feature_start, c.feature_end, c.strand, c.phase, c.name, c.source) == ("CDS", 6, 450, "-", 2, "rep+2", "tool")
    g = got["f1-1"]
    assert (g.type, g.feature_start, g.feature_end, g.strand, g.name) == ("tRNA", 60, 140, "-", "trn")
    assert g.attributes == {"location": "complement(61..140)", "gene": "trn", "note": "short"}
    assert (got["f2-1"].feature_start, got["f2-1"].feature_end, got["f2-1"].name) == (3, 17, "stem")
    assert (got["f2-2"].feature_end, got["f2-2"].name) == (700, "region 2") and len(got) == 4
