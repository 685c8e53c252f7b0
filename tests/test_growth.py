"""What grows with the input: rows moved, folders made, turns of sequential rules."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociq.functions import scalars
from lociq.operators import alignments, assembly, exons, hits, intervals
from lociq.operators.intervals import islands, islands_of_bins
from lociq.plans import catalog

DATA = "/root/testdata/sf0.001"


def exchanges(df):
    """Moves of rows by key in a plan, as it stands before any is reused."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_exon_resolution_moves_rows_few_times(spark):
    assert exchanges(catalog.queries()["exon_resolution"](spark, DATA)) <= 16


@pytest.mark.parametrize("width", [8, 100, 5000])
def test_islands_of_bins_are_whole(spark, width):
    r = random.Random(21)
    rows = [(i, r.choice("ab"), s := r.randrange(3000), s + r.choice([0, 2, 9, 150])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, c string, s long, e long")
    groups = lambda found: sorted(sorted(k) for k in found.values())
    want, got = {}, {}
    for x in islands(df, ["c"], "s", "e").collect():
        want.setdefault((x.c, x.island), []).append(x.k)
    held = islands_of_bins(df, ["c"], "s", "e", width)
    for x in held.where("not open").collect():
        got.setdefault((x.c, x.bin, x.island), []).append(x.k)
    for x in islands(held.where("open"), ["c"], "s", "e", "whole").collect():
        got.setdefault((x.c, None, x.whole), []).append(x.k)
    assert groups(got) == groups(want)


def test_islands_that_end_within_a_batch_are_settled_apart(spark):
    """Batches of three rows: islands go over their edges, and one is as long as three batches."""
    rows = [(f"{i}at2|c:{at}-{i}|+", f"{i}at2", "c", at, at + 30, "+", float(i % 7)) for i, at in enumerate([3, 9, 40, 100, 112, 124, 136, 148, 160, 172, 184, 196, 300, 303, 400])]
    df = spark.createDataFrame(rows, "gene string, marker string, contig string, low long, high long, strand string, score double")
    env = df.selectExpr("marker", "gene", "1 env_from", "9 env_to")
    want = sorted(map(repr, exons.resolve_overlaps(df, env).collect()))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert sorted(map(repr, exons.resolve_overlaps(df, env).collect())) == want and 0 < len(want) < len(rows)
    finally:
        spark.conf.set(key, before)


def by_turns(rows):
    """The rule of alignments.suppress_overlapping said pair by pair."""
    gone = set()
    for a, (i, s, e, v) in enumerate(rows):
        for b, (j, t, f, w) in enumerate(rows):
            if a in gone:
                break
            near = s <= t < e or s < f <= e
            if i != j and b not in gone and t > 0 and near and min(e, f) - max(s, t) > 0.8 * max(e - s, f - t):
                gone.add(a if w > v else b)
    return {rows[a][0] for a in gone}


def test_alignments_go_as_in_turns():
    r = random.Random(22)
    for n in (1, 2, 5, 40, 300):
        for spread in (3, 30, 900):
            rows = sorted([(r.choice([k, k, k, r.randrange(n)]), s := r.randrange(spread), s + r.randrange(20, 40), float(r.randrange(30))) for k in range(n)], key=lambda x: x[0])
            got = alignments._suppressed(pd.DataFrame(rows, columns=["aln_id", "start", "end", "score"]))
            assert set(got.aln_id) == by_turns(rows)


def test_alignments_of_one_place_take_few_turns():
    """200,000 rows of 600 places: pairs by turns had not ended after 45 seconds."""
    k = np.arange(200_000)
    frame = pd.DataFrame({"aln_id": k, "start": k * 37 % 600, "end": k * 37 % 600 + 40 + k % 25, "score": np.random.default_rng(3).random(len(k))})
    began = time.process_time()
    assert 0 < len(alignments._suppressed(frame)) < len(k) and time.process_time() - began < 20


def test_exon_rows_move_once_to_their_gene(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert exchanges(catalog.queries()["exon_rows"](spark, DATA)) == 2
    finally:
        spark.conf.set(key, before)


def test_text_of_whole_tables_is_written_compressed(spark):
    """Files of blocks and of lines; what is read back is compared with SQL elsewhere."""
    for name in ("alignment_scan", "domain_table_scan", "hmm_prediction_scan", "prokaryotic_gene_scan", "translated_search_scan"):
        files = catalog.queries()[name](spark, DATA).inputFiles()
        assert files and all(f.endswith(".txt.lz4") for f in files), name


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    rows = spark.range(200).selectExpr("concat('k', id % 7) k", "id * 5 s", "id * 5 + id % 11 e")
    rows.repartition(5).write.parquet(f"{tmp_path}/t")
    df, before = spark.read.parquet(f"{tmp_path}/t"), intervals.union_length(rows, ["k"], "s", "e").collect()
    monkeypatch.setattr(intervals, "PART_BYTES", 100)
    assert intervals.dealt(df, ["k"]).rdd.getNumPartitions() > 40
    assert sorted(intervals.union_length(df, ["k"], "s", "e").collect()) == sorted(before)


@pytest.mark.parametrize("name", ["marker_fasta_files", "marker_gff_files"])
def test_files_do_not_grow_with_the_markers(spark, name):
    """200 markers had a folder each."""
    rows = catalog.queries()[name](spark, DATA)
    assert rows.select("marker").distinct().count() > 50 and len(rows.inputFiles()) <= 12


def test_frameshifts_search_each_exon_once(spark):
    """The tokens of a string were made for each event anew."""
    plan = spark.range(1).select(scalars.frameshifts(F.concat(F.lit("30M2F30M9N20M"), F.col("id").cast("string"), F.lit("G40M"))).alias("f"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert plan.first().f == (2, 2)


def test_genome_table_takes_places_from_the_rows_it_has(spark):
    statuses = spark.createDataFrame([("1at2", "Complete"), ("2at2", "Missing")], "marker string, status string")
    kept = spark.createDataFrame([("1at2", "c:5-9", 7.0, 3, 5, 9, "-")], "marker string, gene string, score double, matched_length long, g_start long, g_end long, strand string")
    got = hits.result_table(statuses, kept, places=(F.col("g_start"), F.col("strand")))
    assert [(x.marker, x.g_start, x.strand) for x in got.collect()] == [("1at2", 5, "-"), ("2at2", None, None)]


def test_assembly_metrics_go_through_sequences_once(spark):
    """Four scans made lengths and counts, each from the sequences."""
    plan = assembly.metrics(spark.createDataFrame([("a", "ACNNNNNNNNNNGT")], "input string, seq string"), ["input"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("seq#") > 0 and plan.count("LogicalRDD") == 1
