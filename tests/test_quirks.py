"""Micro-tables, one per rule, and folds against small sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from lociq.functions import scalars as X
from lociq.operators import alignments, assembly, exons, hits, lineage, regions
from lociq.operators.intervals import greedy_accept, islands, union_length


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values()) or (0,)], list(cols) or ["_"]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("spans, want", [([(1, 5), (5, 9)], 9), ([(1, 5), (6, 9)], 9), ([(1, 9), (2, 3)], 9), ([(1, 2), (8, 9)], 4)])
def test_interval_union(spark, spans, want):
    df = spark.createDataFrame([("m", a, b) for a, b in spans], "k string, s long, e long")
    assert union_length(df, ["k"], "s", "e").first()["matched_length"] == want


@pytest.mark.parametrize("k, n, want", [(25, 124, 20.2), (2, 124, 1.6), (97, 124, 78.2), (49, 255, 19.2), (44, 2137, 2.1), (2091, 2137, 97.8), (21, 80, 26.2), (21, 2000, 1.1)])
def test_percentages_round_like_python(spark, k, n, want):
    assert one(spark, X.percent(F.col("k"), F.col("n")), k=k, n=n) == want == round(k / n * 100, 1)


def test_class_bounds_are_inclusive(spark):
    found = spark.createDataFrame([("m", "a", 80, 100), ("m", "b", 120, 100), ("m", "c", 79, 100), ("m", "d", 121, 100)], "marker string, gene string, matched_length long, qlen long")
    cut = spark.createDataFrame([("m", 100.0, 10.0)], "marker string, length double, sigma double")
    assert {r.gene: r["rank"] for r in hits.classify_by_length(found, cut).collect()} == {"a": "complete", "b": "complete", "c": "fragment", "d": "very_large"}
    assert {r.gene: r["rank"] for r in hits.classify_by_profile(found).collect()} == {"a": "complete", "b": "complete", "c": "fragment", "d": "complete"}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "marker string, gene string, rank string, score double, file string")


def test_ranks_marker_and_gene_anti_joins(spark):
    rows = [("1at2", "g1", "complete", 9.0, "f"), ("1at2", "g2", "fragment", 8.0, "f"), ("2at2", "g1", "fragment", 7.0, "f"), ("3at2", "g1", "very_large", 7.0, "f"), ("3at2", "g3", "fragment", 6.0, "f"), ("4at2", "g4", "very_large", 5.0, "f"), ("4at2", "g5", "fragment", 5.0, "f")]
    got = {(r.marker, r.gene) for r in hits.resolve_ranks(ranked(spark, rows)).collect()}
    # the very_large row that falls to complete's gene leaves its marker's fragment alone
    assert got == {("1at2", "g1"), ("3at2", "g3"), ("4at2", "g4")}


def test_equal_scores_go_to_the_first_file(spark):
    rows = [("2at2", "g", "complete", 5.0, "2at2.out"), ("10at2", "g", "complete", 5.0, "10at2.out")]
    assert [r.marker for r in hits.best_marker_per_gene(ranked(spark, rows), [F.col("file")]).collect()] == ["10at2"]


def test_relative_filter_keeps_equality(spark):
    rows = [("1at2", "a", "complete", 100.0, "f"), ("1at2", "b", "complete", 85.0, "f"), ("1at2", "c", "complete", 84.9, "f")]
    assert {r.gene for r in hits.relative_score_filter(ranked(spark, rows)).collect()} == {"a", "b"}


def test_statuses_and_notation(spark):
    rows = [("1at2", "a", "complete", 1.0, "f"), ("2at2", "b", "complete", 1.0, "f"), ("2at2", "c", "very_large", 1.0, "f"), ("3at2", "d", "fragment", 1.0, "f")]
    cut = spark.createDataFrame([(f"{k}at2",) for k in range(1, 5)], "marker string")
    s = hits.summarise(hits.consolidate(ranked(spark, rows), cut))
    assert s.select(hits.notation(s)).first()[0] == "C:50.0%[S:25.0%,D:25.0%],F:25.0%,M:25.0%,n:4"
    empty = hits.summarise(hits.consolidate(ranked(spark, []), cut)).first()
    assert (empty.c, empty.m, empty.c_percent) == (0, 4, 0.0)


def test_later_rounds_replace(spark):
    a = ranked(spark, [("1at2", "g", "complete", 1.0, "f1"), ("1at2", "g", "complete", 2.0, "f2"), ("1at2", "h", "complete", 3.0, "f")])
    b = ranked(spark, [("1at2", "g", "complete", 9.0, "f0")])
    assert {(r.gene, r.score) for r in hits.upsert_rounds(a, b).collect()} == {("g", 9.0), ("h", 3.0)}


def test_suppression_chain_and_cutoff(spark):
    rows = [("m", "c", 1, 10, 3, True), ("m", "c", 8, 20, 2, True), ("m", "c", 18, 30, 1, True), ("n", "c", 1, 10, 2, False), ("n", "c", 5, 12, 1, True)]
    df = spark.createDataFrame(rows, "marker string, contig string, s long, e long, w int, ok boolean")
    got = {(r.marker, r.s) for r in greedy_accept(df, ["marker", "contig"], [-F.col("w")], "s", "e", F.col("ok")).collect()}
    assert got == {("m", 1), ("m", 18), ("n", 5)}


def test_greedy_fold_equals_the_sequential_rule(spark):
    r = random.Random(0)
    rows = [(g, i, a := r.randint(0, 200), a + r.randint(1, 25), r.randint(0, 9)) for g in range(40) for i in range(25)]
    df = spark.createDataFrame(rows, "g long, i long, s long, e long, w long")
    want = set()
    for g in range(40):
        kept = []
        for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[4], x[1])):
            if all(x[2] > k[3] or k[2] > x[3] for k in kept):
                kept.append(x)
        want |= {(g, k[1]) for k in kept}
    assert {(x.g, x.i) for x in greedy_accept(df, ["g"], [-F.col("w"), F.col("i")], "s", "e").collect()} == want


def test_alignment_suppression_equals_the_sequential_rule(spark):
    r = random.Random(1)
    rows = [(i, "m", f"c{r.randint(0, 9)}", a := r.randint(0, 60), a + r.randint(20, 40), r.randint(1, 5)) for i in range(400)]
    want = set()
    for c in {x[2] for x in rows}:
        group, gone = [x for x in rows if x[2] == c], set()
        for i in group:
            for j in group:
                if i[0] in gone:
                    break
                starts, ends = i[3] <= j[3] < i[4], i[3] < j[4] <= i[4]
                if i[0] == j[0] or j[0] in gone or j[3] <= 0 or not (starts or ends):
                    continue
                if min(i[4], j[4]) - max(i[3], j[3]) > 0.8 * max(i[4] - i[3], j[4] - j[3]):
                    gone.add(i[0] if j[5] > i[5] else j[0])
        want |= {x[0] for x in group} - gone
    df = spark.createDataFrame(rows, "aln_id long, marker string, contig string, start long, end long, score long")
    assert {x.aln_id for x in alignments.suppress_overlapping(df).collect()} == want


def test_islands_part_what_cannot_overlap(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 5, 9), ("c", 10, 12)], "c string, s long, e long")
    assert [x.island for x in islands(df, ["c"], "s", "e").orderBy("s").collect()] == [1, 1, 2]


def test_regions_extend_absorb_and_ignore(spark):
    rows = [(0, 1000, 1100, 0.1), (1, 40000, 40100, 0.01), (2, 500, 600, 0.2), (3, 30000, 30100, 0.2), (4, 200000, 200100, 0.2)]
    df = spark.createDataFrame([("m", "c", i, s, e, 1, 9, v) for i, s, e, v in rows], "marker string, contig string, i int, start long, end long, m_start long, m_end long, evalue double")
    got = regions.accumulate(df, [F.col("i")]).first()
    assert (got.start, got.end, got.evalue, len(got.spans)) == (500, 40100, 0.01, 4)
    with pytest.raises(ValueError):
        regions.top_contigs(df, 21, [])


@pytest.mark.parametrize("rows, want", [([(10, 5, 1, 0), (10, 5, 2, 0), (12, 0, 3, 0)], 1), ([(10, 5, 1, 20), (10, 5, 2, 40), (12, 0, 3, 60), (14, 1, 2, 80)], 3), ([(10, 5, 1, 20), (10, 5, 2, 80), (10, 5, 2, 80)], 1), ([(0, 0, 0, 0), (0, 0, 0, 0)], 0)])
def test_lineage_ties(spark, rows, want):
    df = spark.createDataFrame([("x", i, i, *r) for i, r in enumerate(rows)], "input string, lineage long, ordinal long, s long, d long, f long, s_percent long")
    assert lineage.best_lineage(df, ["input"]).first().lineage == want


def test_placement_needs_twelve_markers_unless_exempt(spark):
    paths = spark.createDataFrame([("7", ["1", "2", "7"]), ("8", ["1", "2", "8"]), ("204428", ["1", "204428"])], "taxid string, path array<string>")
    weigh = lambda *r: spark.createDataFrame([("g", t, w, w) for t, w in r], "g string, taxid string, weight long, first long")
    pick = lambda *r: lineage.choose_taxid(weigh(*r), paths, ["g"], "root").first().taxid
    assert pick(("7", 20), ("8", 3)) == "7" and pick(("7", 20), ("8", 10)) == "2" and pick(("7", 5)) == "root" and pick(("204428", 5), ("7", 4)) == "204428"


def test_identifiers(spark):
    ids = {"1at2|c|x:5-9|+": "c|x:5-9", "c:5-9|-": "c:5-9", "plain": "plain", "t|c:1-2|+": "c:1-2"}
    for target, gene in ids.items():
        assert one(spark, X.gene_of_target(F.col("t")), t=target) == gene
    assert one(spark, X.marker_in(F.lit("xx 12at345_1 y"))) == "12at345" and one(spark, X.marker_number(F.lit("12at345"))) == 12
    assert one(spark, X.dataset_version(F.lit("bacteria_odb12"))) == 12 and one(spark, X.dataset_version(F.lit("bacteria_odb9"))) is None
    assert one(spark, X.display_length(F.lit(1_999_999))) == "1 MB" and one(spark, X.display_length(F.lit(1999))) == "1 KB" and one(spark, X.display_length(F.lit(900))) == "900"


def test_sequences(spark):
    assert one(spark, X.reverse_complement(F.lit("ACGTN"))) == "NACGT" and one(spark, X.translate(F.lit("ATGTAAnnnGC"))) == "MXX"
    frames = {r["frame"]: r["protein"] for r in one(spark, X.six_frames(F.lit("ATGAAA")))}
    assert frames == {1: "MK", 2: "X", 3: "E", -1: "FH", -2: "F", -3: "S"}
    f = lambda c: tuple(one(spark, X.frameshifts(F.lit(c))))
    assert f("20M1F20M") == (1, 1) and f("19M1F20M") == (0, 0) and f("20M1F10M5N10M") == (0, 0) and f("10M2D10M2G30M3F25M") == (2, 5)
    assert one(spark, X.internal_stops(F.lit("*AB*C*"))) == 1 and one(spark, X.cleaned_protein(F.lit("*ab*c*"))) == "ABC"


def test_alphabets_and_headers(spark):
    seqs = spark.createDataFrame([("n", 0, "ACGTRYN" * 1000), ("n", 1, "PPPP"), ("p", 0, "ACGT"), ("p", 1, "MKL"), ("q", 0, "AC-")], "input string, i long, seq string")
    assert {r.input: r.nucleotide for r in assembly.is_nucleotide(seqs, ["input"], "i").collect()} == {"n": True, "p": False, "q": False}
    assert {r.input: r.protein for r in assembly.is_protein(seqs, ["input"], "i").collect()} == {"n": True, "p": True, "q": False}
    h = spark.createDataFrame([("a", ">x y"), ("a", ">x z"), ("a", ">q/1 z"), ("a", "> s"), ("a", ">é")], "input string, header string")
    r = assembly.header_audit(h, ["input"]).first()
    assert (r.n_headers, r.n_forbidden, r.n_spaced, r.n_repeated_ids) == (5, 2, 1, 1)


def test_metrics(spark):
    s = spark.createDataFrame([("a", "A" * 50 + "N" * 10 + "C" * 30), ("a", "G" * 20)], "input string, seq string")
    r = assembly.metrics(s, ["input"]).first()
    assert (r.n_scaffolds, r.n_contigs, r.total_length, r.scaffold_n50, r.contig_n50, round(r.gap_percent, 2)) == (2, 3, 110, 90, 50, 9.09)


def E(gene, marker, low, high, score, strand="+"):
    return exons.Exon(gene, marker, low, high, strand, score)


def test_exons_lower_score_is_cut_from_the_end():
    a = exons.Match("1at2|c:100-900|+", "1at2", 50.0, [(1, 60)], [E("1at2|c:100-900|+", "1at2", 100, 279, 50.0), E("1at2|c:100-900|+", "1at2", 700, 900, 50.0)])
    b = exons.Match("2at2|c:700-1300|+", "2at2", 90.0, [(1, 200)], [E("2at2|c:700-1300|+", "2at2", 700, 1300, 90.0)])
    gone = exons.eliminate([a, b])
    assert gone == {("1at2", a.gene, 700, 900)}
    new = exons.rebuild(a, gone)
    assert (new["new_gene"], new["start_trim"], new["end_trim"]) == ("1at2|c:100-279|+", 0, 201) and exons.rebuild(b, gone)["new_gene"] == b.gene


def test_exons_both_used_removes_the_weaker_gene():
    a = exons.Match("1at2|c:100-400|+", "1at2", 50.0, [(1, 100)], [E("1at2|c:100-400|+", "1at2", 100, 400, 50.0)])
    b = exons.Match("2at2|c:130-430|+", "2at2", 90.0, [(1, 100)], [E("2at2|c:130-430|+", "2at2", 130, 430, 90.0)])
    gone = exons.eliminate([a, b])
    assert exons.rebuild(a, gone) is None and exons.rebuild(b, gone) is not None


def test_exon_sweep_needs_frame_strand_and_other_gene():
    a, b = E("1at2|c:1-9|+", "1at2", 100, 200, 5.0), E("2at2|c:5-9|+", "2at2", 103, 190, 4.0)
    assert exons.sweep([a, b]) == [(b, a)]
    assert not exons.sweep([a, E("2at2|c:5-9|+", "2at2", 104, 190, 4.0)]) and not exons.sweep([a, E("2at2|c:5-9|-", "2at2", 103, 190, 4.0, "-")]) and not exons.sweep([a, E("1at2|c:1-9|+", "3at2", 103, 190, 4.0)])


def test_envelope_over_an_exon_end_uses_all_later_ones():
    x = [E("g", "m", 1, 90, 1.0), E("g", "m", 200, 290, 1.0), E("g", "m", 400, 490, 1.0)]
    used, unused = exons.split_by_use(x, [(10, 35)])
    assert len(used) == 3 and not unused
    used, unused = exons.split_by_use(x, [(2, 20)])
    assert [e.low for e in used] == [1] and [e.low for e in unused] == [200, 400]


def test_parasites(spark):
    st = spark.createDataFrame([(f"{i}at2", "Missing" if i < 9 else "Complete") for i in range(20)], "marker string, status string")
    r = hits.parasite_check(st, st.where("status = 'Missing'").select("marker")).first()
    assert r.parasitic and r.n == 11 and r.s_percent == 100.0 and r.m_percent == 0.0


def test_same_marker_elimination_equals_the_sequential_rule(spark):
    r = random.Random(3)
    rows = [(f"g{i:03d}", "m", f"c{i % 5}", a := r.randint(0, 300), a + r.randint(20, 60), "+", float(r.randint(1, 6))) for i in range(150)]
    gone = set()
    for c in {x[2] for x in rows}:
        part = [x for x in rows if x[2] == c]
        pairs = [(x, y) for x in part for y in part if x[0] != y[0] and x[3] <= y[3] < x[4] and (x[3] < y[3] or x[0] < y[0]) and x[3] % 3 == y[3] % 3]
        for x, y in sorted(pairs, key=lambda p: (-max(p[0][6], p[1][6]), p[0][0], p[1][0])):
            if x[0] not in gone and y[0] not in gone:
                gone.add(y[0] if x[6] > y[6] else x[0])
    df = spark.createDataFrame(rows, "gene string, marker string, contig string, low long, high long, strand string, score double")
    assert {x.gene for x in exons.eliminate_same_marker(df).collect()} == {x[0] for x in rows} - gone


def test_binned_islands_equal_plain_ones(spark):
    r = random.Random(7)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, s := r.randrange(4000), s + r.choice([0, 3, 5, 40, 700])) for i in range(500)] + [("c", 900, 5, 9)]
    df = spark.createDataFrame(rows, "c string, k long, s long, e long")
    for touching in (True, False):
        want = {(x.k, x.island) for x in islands(df, ["c"], "s", "e", touching=touching).collect()}
        for width in (16, 300, 1 << 16):
            got = islands(df, ["c"], "s", "e", touching=touching, width=width)
            assert got.columns == [*df.columns, "island"] and {(x.k, x.island) for x in got.collect()} == want


def turns(order):
    """The sweep said turn by turn, over all pairs."""
    lost, had, out = [], [], []
    for a in order:
        if a.place not in lost:
            for b in order:
                if a.low <= b.low < a.high and b.place != a.place and b.place not in had and a.strand == b.strand and a.low % 3 == b.low % 3 and exons.without_strand(a.gene) != exons.without_strand(b.gene):
                    pair = (b, a) if a.score > b.score else (a, b)
                    lost.append(pair[0].place)
                    out.append(pair)
            had.append(a.place)
    return sorted(out, key=lambda p: -max(p[0].score, p[1].score))


def test_sweep_equals_its_turns():
    r = random.Random(8)
    for _ in range(300):
        xs = [E(f"{r.randrange(4)}at2|c:{r.randrange(3)}-9|+", f"{r.randrange(4)}at2", low := r.randrange(0, 30), low + r.randrange(1, 25), float(r.randrange(5)), r.choice("++-")) for _ in range(r.randrange(0, 14))]
        assert exons.sweep(xs) == turns(sorted(xs, key=lambda e: (e.low, e.high, e.gene, e.marker)))


def used_by_definition(sizes, env, shift):
    """Which exons are used, amino acid by amino acid of the gene."""
    ends = [sum(sizes[: k + 1]) + 1 + shift for k in range(len(sizes))]
    used, at = set(), 0
    for a, b in env:
        while at < len(sizes) and not a < ends[at]:
            at += 1
        if at == len(sizes):
            break
        used.add(at)
        if b > ends[at]:
            return used | set(range(at, len(sizes)))
    return used


def test_split_by_use_equals_its_definition():
    r = random.Random(9)
    for _ in range(500):
        at, xs = 0, []
        for _ in range(r.randrange(1, 7)):
            low = at + r.randrange(1, 50)
            at = low + r.randrange(3, 120)
            xs.append(E("g|+", "m", low, at, 1.0))
        if r.random() < 0.5:
            xs = xs[::-1]
        env = sorted((a := r.randrange(1, 150), a + r.randrange(1, 80)) for _ in range(r.randrange(0, 4)))
        trim = r.choice([0, 0, 30, 33])
        hit = used_by_definition([round((x.high - x.low + 1) / 3) for x in xs], env, trim / 3)
        span = [c for k in hit for c in (xs[k].low, xs[k].high)]
        inside = {k for k, x in enumerate(xs) if hit and k not in hit and (min(span) <= x.low < max(span) or min(span) < x.high < max(span))}
        used, unused = exons.split_by_use(xs, env, trim)
        assert set(used) == {xs[k] for k in hit | inside} and set(unused) == set(xs) - set(used)


def test_earlier_trims_shift_the_envelopes(spark):
    rows = [("1at2|c:100-900|+", "1at2", "c", 100, 279, "+", 50.0), ("1at2|c:100-900|+", "1at2", "c", 700, 900, "+", 50.0), ("2at2|c:700-1300|+", "2at2", "c", 700, 1300, "+", 90.0), ("3at2|d:1-90|+", "3at2", "d", 1, 90, "+", 9.0)]
    df = spark.createDataFrame(rows, "gene string, marker string, contig string, low long, high long, strand string, score double")
    env = spark.createDataFrame([("1at2", rows[0][0], 62, 100), ("2at2", rows[2][0], 1, 200)], "marker string, gene string, env_from long, env_to long")
    plain = {x.marker: x for x in exons.resolve_overlaps(df, env).collect()}
    assert set(plain) == {"2at2", "3at2"} and plain["3at2"].exons == [(1, 90)] and plain["2at2"].env == [(1, 200)]
    trims = spark.createDataFrame([("1at2", rows[0][0], 120)], "marker string, gene string, start_trim long")
    cut = {x.marker: x for x in exons.resolve_overlaps(df, env, trims).collect()}["1at2"]
    assert (cut.new_gene, cut.end_trim, cut.exons, cut.env) == ("1at2|c:100-279|+", 201, [(100, 279)], [(62, 100)])


def test_files_of_one_marker_are_suppressed_apart(spark):
    found = spark.createDataFrame([("a.out", "1at2", "t1", "c", 1, 100, 50, 9.0, 9.0), ("b.out", "1at2", "t2", "c", 50, 150, 40, 8.0, 8.0), ("b.out", "1at2", "t3", "c", 60, 160, 30, 7.0, 7.0)], "file string, marker string, target string, contig string, g_start long, g_end long, matched_length long, best double, first_score double")
    kept = hits.suppress_overlapping_genes(found, spark.createDataFrame([("1at2", 5.0)], "marker string, cutoff double"))
    assert {x.target for x in kept.collect()} == {"t1", "t2"}


def test_the_flow_reports_one_fragment_per_marker(spark):
    rows = [("1at2", "a", "fragment", 90.0, "f", 10), ("1at2", "b", "fragment", 95.0, "f", 10), ("2at2", "c", "fragment", 90.0, "f", 10), ("2at2", "d", "fragment", 90.0, "f", 12), ("3at2", "e", "complete", 90.0, "f", 10), ("3at2", "g", "complete", 89.0, "f", 10)]
    df = spark.createDataFrame(rows, "marker string, gene string, rank string, score double, file string, matched_length long")
    cut = spark.createDataFrame([("1at2",), ("2at2",), ("3at2",)], "marker string")
    kept, statuses = hits.status_flow(df, cut, [F.col("file"), F.col("gene")])
    assert {x.gene for x in kept.collect()} == {"b", "d", "e", "g"}
    assert {x.marker: x.status for x in statuses.collect()} == {"1at2": "Fragmented", "2at2": "Fragmented", "3at2": "Duplicated"}
    assert hits.result_table(statuses, kept).count() == 4


def test_islands_of_exons_are_settled_as_the_whole_contig(spark):
    r = random.Random(12)
    rows = []
    for g in range(60):
        marker, contig, strand, at = f"{g % 25}at2", r.choice("cd"), r.choice("++-"), r.randrange(0, 6000)
        gene, score = f"{marker}|{contig}:{at}-{g}|{strand}", float(r.randrange(40, 90))
        for _ in range(r.randrange(1, 4)):
            size = r.randrange(30, 200)
            rows.append((gene, marker, contig, at, at + size, strand, score))
            at += size + r.randrange(3, 90)
    env = [(m, g, a := r.randrange(1, 60), a + r.randrange(5, 60)) for m, g in sorted({(x[1], x[0]) for x in rows})]
    df = spark.createDataFrame(rows, "gene string, marker string, contig string, low long, high long, strand string, score double")
    got = exons.resolve_overlaps(df, spark.createDataFrame(env, "marker string, gene string, env_from long, env_to long")).collect()
    want = []
    for contig in "cd":
        matches = {}
        for x in rows:
            if x[2] == contig:
                m = matches.setdefault((x[1], x[0]), exons.Match(x[0], x[1], x[6], [e[2:] for e in env if e[:2] == (x[1], x[0])]))
                m.exons.append(E(x[0], x[1], x[3], x[4], x[6], x[5]))
        gone = exons.eliminate(list(matches.values()))
        want += [(contig, *(b[k] for k in ("marker", "gene", "new_gene", "new_low", "new_high", "start_trim", "end_trim"))) for m in matches.values() if (b := exons.rebuild(m, gone))]
    assert sorted(tuple(x)[:8] for x in got) == sorted(want) and len(want) < 60
