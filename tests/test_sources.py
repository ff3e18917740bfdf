"""Generated alignments, projects and the command."""

from pyspark.sql import functions as F

from tessera.__main__ import scan
from tessera.plans.catalogue import OPERATORS
from tessera.sources import generators, project

SEQUENCES = "seq_id long, name string, sequence string"
EVENTS = "event_id string, recombinant long, major long, minor long, tract_start int, tract_end int, p double, status string"


def test_designs_have_their_tracts(spark):
    assert generators.truth(spark).count() == sum(len(d.tracts) for d in generators.DESIGNS.values())
    sites = generators.example(spark, "circular_family").where("seq_id in (0, 1, 8)")
    assert sites.count() == 3 * 3200
    near = sites.alias("x").join(sites.alias("y"), "site").where("x.seq_id = 0").groupBy("y.seq_id", F.expr("site >= 2720 or site < 470").alias("inside")).agg(F.avg((F.col("x.base") != F.col("y.base")).cast("int")).alias("p"))
    p = {(r.seq_id, r.inside): r.p for r in near.collect()}
    assert p[1, True] < 0.05 < p[8, True] and p[8, False] < 0.05 < p[1, False]
    again = generators.example(spark, "circular_family").where("seq_id in (0, 1, 8)").repartition(5)
    assert again.exceptAll(sites).count() == 0


def test_planted_roles_are_decided(spark):
    sites = generators.planted_sites(spark, 6, 400, [generators.Tract(0, 1, 120, 240)], lineages=3, between=0.3)
    best = OPERATORS["three_seq_siegmund"].run(spark, sites=sites).orderBy("p", "event_id").first()
    assert abs(best.tract_start - 120) <= 12 and abs(best.tract_end - 240) <= 12
    trials = OPERATORS["role_trials"].run(spark, sites=sites).where(F.col("event_id") == best.event_id)
    assert {r.trial: r.score for r in trials.collect()}["current"] > 60


def test_project_round_trip_and_clamps(spark):
    s = spark.createDataFrame([(0, "a", "ACGT"), (1, "b", "ACGA"), (2, None, "ACGC")], SEQUENCES)
    rows = [("e1", 0, 1, 2, 1, 3, 0.01, "accepted"), ("e2", 0, 1, 2, -5, 99, 7.0, "odd"), ("e3", 0, 0, 2, 1, 3, 0.1, "accepted"), ("e4", 0, 1, 9, 1, 3, 0.1, "accepted")]
    lines = project.lines(s, spark.createDataFrame(rows, EVENTS)).unionByName(spark.createDataFrame([("not json",)], "value string"))
    sequences, events = project.restore(lines)
    assert sorted(tuple(r) for r in sequences.collect()) == [(0, "a", "ACGT"), (1, "b", "ACGA"), (2, "Sequence_3", "ACGC")]
    assert sorted(tuple(r) for r in events.collect()) == [("e1", 0, 1, 2, 1, 3, 0.01, "accepted"), ("e2", 0, 1, 2, 0, 4, 1.0, "unreviewed")]


def test_command(spark, tmp_path):
    sites = generators.planted_sites(spark, 5, 300, [generators.Tract(0, 1, 90, 180)], lineages=3, between=0.3)
    rows = sites.groupBy("seq_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(site, base))), x -> substr('ACGT', x.base + 1, 1)), '')").alias("s")).collect()
    source = tmp_path / "in.fasta"
    source.write_text("".join(f">n{r.seq_id}\n{r.s}\n" for r in sorted(rows)))
    scan(spark, str(source), str(tmp_path / "out"))
    sequences, events = project.load(spark, str(tmp_path / "out/project"))
    assert sequences.count() == 5 and events.where("recombinant = 0 and p < 0.001").count() == 1
