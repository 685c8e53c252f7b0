"""Queries see every row of their tables: against brute force on tables larger than former cuts."""

import random

import pytest

from lociq.functions.scalars import six_frames
from lociq.operators import assembly
from lociq.plans import catalog


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with 4,400 events, and their rows."""
    r = random.Random(5)
    rows = [(i, r.randint(0, 39), f"t{i % 5}", round(r.random() * 50, 2)) for i in range(4400)]
    d = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return str(d), rows


def alignments(rows):
    """(id, start, end, score) in file order by contig."""
    out = {}
    for i, user, _, value in rows:
        start = i * 37 % 600
        out.setdefault(f"c{user % 20}", []).append((i, start, start + 40 + i % 25, value))
    return out


def test_alignment_suppression_sees_all_alignments(spark, events):
    d, rows = events
    want = set()
    for group in alignments(rows).values():
        gone = set()
        for i in group:
            for j in group:
                if i[0] in gone:
                    break
                inside = i[1] <= j[1] < i[2] or i[1] < j[2] <= i[2]
                if i[0] == j[0] or j[0] in gone or j[1] <= 0 or not inside:
                    continue
                if min(i[2], j[2]) - max(i[1], j[1]) > 0.8 * max(i[2] - i[1], j[2] - j[1]):
                    gone.add(i[0] if j[3] > i[3] else j[0])
        want |= {x[0] for x in group} - gone
    got = [x.aln_id for x in catalog.queries()["greedy_alignment_suppression"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(want) >= 4000


def test_same_marker_elimination_sees_all_alignments(spark, events):
    d, rows = events
    want = set()
    for group in alignments(rows).values():
        gone, pairs = set(), []
        for x in group:
            pairs += [(x, y) for y in group if x[0] != y[0] and x[1] <= y[1] < x[2] and (x[1] < y[1] or str(x[0]) < str(y[0])) and x[1] % 3 == y[1] % 3]
        for x, y in sorted(pairs, key=lambda p: (-max(p[0][3], p[1][3]), str(p[0][0]), str(p[1][0]))):
            if x[0] not in gone and y[0] not in gone:
                gone.add(y[0] if x[3] > y[3] else x[0])
        want |= {str(x[0]) for x in group} - {str(g) for g in gone}
    got = [x.gene for x in catalog.queries()["same_marker_elimination"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(map(int, want)) >= 4000


def test_six_frame_translation_sees_whole_sequences(spark, tmp_path):
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefgh ijk\n") for _ in range(n)) for n in (0, 1, 2, 3, 119, 120, 121, 122, 300, 5000)]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    code = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYYXXCCXWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", strict=True))
    want = {}
    for i, t in enumerate(texts):
        seq = "".join("ACGTNACGTACGTNACGTACGTACGT"[ord(c) - 97] for c in t if c.isalpha())
        for sign, s in ((1, seq), (-1, seq[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            for k in range(3):
                want[i, sign * (k + 1)] = "".join(code.get(s[j : j + 3], "X") for j in range(k, len(s) - 2, 3))
    got = catalog.queries()["six_frame_translation"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(x.seq_id, x.frame): x.protein for x in got} == want and max(map(len, want.values())) > 1000


def test_translations_equal_the_scalar_rule(spark):
    rows = [(i, s) for i, s in enumerate(["acgu UUacg", "ACGTRYKMBVDHNacgtn" * 3, None, "", "é😀TTTACGéACG", "ac", "éACG,ACGGTU\nACG"])]
    df = spark.createDataFrame(rows, "k long, seq string")
    want = df.selectExpr("*").select("k", "seq", six_frames(df.seq).alias("f")).selectExpr("k", "seq", "explode(f) f").selectExpr("k", "seq", "f.frame", "f.protein")
    got = assembly.translations(df)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_line_ranges_are_made_of_every_event(spark, events):
    d, rows = events
    ids = {x[0] for x in rows}
    want = {(i, n) for i, user, *_ in rows for n in range(i, i + user % 40) if n in ids}
    got = [(x.gene, x.line_no) for x in catalog.queries()["gff_line_ranges"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and len({g for g, _ in got}) > 4000
