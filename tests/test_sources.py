"""Readers and writers on small files."""

import os

from lociq.sources import sinks, text


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fna", ">s1 first one\nACG\nTT\n>s2\nGG\n\n>s3 empty\n")
    assert {(r.seq_id, r.description, r.seq) for r in text.fasta(spark, p).collect()} == {("s1", "s1 first one", "ACGTT"), ("s2", "s2", "GG"), ("s3", "s3 empty", "")}
    assert text.headers(spark, p).count() == 3


def test_domain_hits(spark, tmp_path):
    row = "c:1-9|+ - 300 12at2 - 200 1e-9 99.5 0.1 1 2 1e-8 1e-7 98.0 0.0 5 190 6 200 4 210 0.95 two words"
    p = put(tmp_path, "12at2.out", f"# head\n{row}\n")
    r = text.domain_hits(spark, p).first()
    assert (r.marker, r.target, r.qlen, r.full_score, r.hmm_from, r.env_to, r.description) == ("12at2", "c:1-9|+", 200, 99.5, 5, 210, "twowords")


def test_translated_search(spark, tmp_path):
    good = "1at2\tc1\t9\t9\t9\t9\t3\t40\t900\t100\t1e-5\t70"
    p = put(tmp_path, "x.tsv", f"# q\n{good}\nbroken\trow\n# BLAST processed 1 queries\n")
    r = text.translated_search(spark, p).collect()
    assert len(r) == 1 and (r[0].start, r[0].end, r[0].evalue, r[0].strand) == (100, 900, 1e-5, "+")
    assert text.search_is_complete(spark, p) and not text.search_is_complete(spark, put(tmp_path, "y.tsv", good + "\n"))


PAF = "##PAF\t5at2_0\t100\t0\t99\t-\tctg\t5000\t10\t310\t90\t99\t0\tx\tAS:i:77\tq\tq\tq\tcg:Z:20M1F20M\n##STA\tMK*lv*\nctg\tmp\tmRNA\t11\t310\t77\t-\t.\tID=1;Identity=0.91;Target=x 1 2\nctg\tmp\tCDS\t11\t100\t40\t-\t0\tP=1\nctg\tmp\tCDS\t200\t310\t37\t-\t0\tP=1\n##PAF\t6at2_0\t50\t0\t0\t*\t*\t0\t0\t0\t0\t0\t0\n"


def test_alignment_blocks(spark, tmp_path):
    r = text.alignment_blocks(spark, put(tmp_path, "m.gff", PAF)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.gene, r.marker, r.score, r.cigar, r.protein, r.identity, len(r.exons), len(r.gff)) == ("5at2_0|ctg:10-310|-", "5at2", 77, "20M1F20M", "MK*LV*", 0.91, 2, 3)


def test_predictor_header(spark):
    h = "1at2_0|c|x|-|120.5|1e-9|2|100|900|900[890]:700[700]:201[190]|300[299]:100[100]:201[200]"
    df = spark.createDataFrame([(h,)], "h string")
    r = df.select(text.predictor_header(df.h).alias("x")).first().x
    assert (r.gene, r.contig, r.n_exons, r.score) == ("1at2_0|c|x:100-900|-", "c|x", 2, 120.5)
    assert [(e.low, e.high) for e in r.taken] == [(889, 700), (299, 100)] and [(e.a, e.b) for e in r.exons] == [(890, 700), (299, 100)]


def test_gene_scans(spark, tmp_path):
    p = put(tmp_path, "g.faa", ">ctg_1_7 # 3 # 98 # -1 # ID=1_7;score=12.5;x\nMKV*\n")
    r = text.prokaryotic_genes(text.fasta(spark, p)).first()
    assert (r.gene, r.contig) == ("ctg_1:3-98|-", "ctg_1")
    body = "# start gene g1\nc\tA\tgene\t5\t95\t1\t+\t.\tg1\nc\tA\tCDS\t5\t40\t1\t+\t.\tx\nc\tA\tCDS\t60\t95\t1\t+\t.\tx\n# coding sequence = [atg\n# aaa]\n# protein sequence = [MK\n# L]\n# end gene g1\n# start gene g2\nc\tA\tgene\t200\t300\t1\t+\t.\tg2\n# protein sequence = [M"
    r = text.hmm_predictions(spark, put(tmp_path, "3at2.out.1", "# head\n" + body)).collect()
    assert len(r) == 1 and (r[0].marker, r[0].gene, r[0].nt, r[0].aa, len(r[0].exons)) == ("3at2", "c:5-95|+", "ATGAAA", "MKL", 2)


def test_small_tables(spark, tmp_path):
    assert [tuple(r) for r in text.score_cutoffs(spark, put(tmp_path, "s", "1at2\t50.5\n")).collect()] == [("1at2", 50.5)]
    assert [tuple(r) for r in text.length_cutoffs(spark, put(tmp_path, "l", "1at2 0 0 120\n")).collect()] == [("1at2", 1.0, 120.0)]
    assert text.dataset_config(spark, put(tmp_path, "c", "domain=x\nname=b_odb12\n"))["name"] == "b_odb12"
    paths = {r.taxid: r.path for r in text.taxid_paths(spark, put(tmp_path, "t", "#h\na\tb\tc\td\t1,2,7\n")).collect()}
    assert paths["2"] == ["1", "2"] and paths["7"] == ["1", "2", "7"]
    q, nodes = text.placements(spark, put(tmp_path, "p.json", '{"tree": "((2157:0.1[0],204428:0.2[1])7:1.5[2]);", "placements": [{"p": [[9, 1.0], [1, 0.5]]}]}'))
    assert q.first().nodes == ["9", "1"] and {r.node: r.taxid for r in nodes.collect()}["1"] == "204428"
    log = "Main genome scaffold total:\t7\nMain genome contig total:\t9\nMain genome scaffold sequence total:\t1.2 MB\nMain genome contig sequence total:\t1.1 MB\t2.5% gap\nMain genome scaffold N/L50:\t3/500\nMain genome contig N/L50:\t400/5\n"
    r = text.metrics_log(spark, put(tmp_path, "m.log", log)).first()
    assert (r.n_scaffolds, r.gap, r.scaffold_n50, r.contig_n50) == ("7", "2.5%", 500, 400)
    s = "\t12\tComplete and single-copy (S)\n\t3\tComplete and duplicated (D)\n\t2\tFragmented (F)\n\t4\tMissing (M)\n"
    r = text.short_summaries(spark, put(tmp_path, "sum.txt", s)).first()
    assert (r.s, r.d, r.f, r.m) == (12, 3, 2, 4)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("10at2", "Complete", "c:1-9", 9, 1, "-", 5.25, 4.0, "l", "d"), ("2at2", "Missing", None, None, None, None, None, None, None, None)], "marker string, status string, gene string, start long, end long, strand string, score double, matched_length double, link string, description string")
    out = sinks.full_table_rows(rows, True, True)
    assert [r.marker for r in out.collect()] == ["2at2", "10at2"] and out.columns == ["marker", "status", "sequence", "gene_start", "gene_end", "strand", "score", "length", "link", "description"]
    sinks.write_table(out, str(tmp_path / "t"))
    body = next((tmp_path / "t").glob("part*")).read_text().splitlines()
    assert body[0].split("\t")[:2] == ["2at2", "Missing"] and body[1].split("\t")[2:6] == ["c", "9", "1", "-"]
    sinks.write_fasta(spark.createDataFrame([("s", "1at2", "x", "AC"), ("s", "1at2", "y", None)], "status string, marker string, seq_id string, seq string"), str(tmp_path / "f"), ("status", "marker"))
    assert next((tmp_path / "f/status=s/marker=1at2").glob("part*")).read_text() == ">x\nAC\n"
    assert os.path.isdir(tmp_path / "f")
    done = sinks.batch_table(spark.createDataFrame([("a", "d", 1.0, 1.0, 0.0, 0.0, 0.0, 5)], "input string, dataset string, c_percent double, s_percent double, d_percent double, f_percent double, m_percent double, n long"), spark.createDataFrame([("a",), ("b",)], "input string")).collect()
    assert [(r.Input_file, r.Complete) for r in done] == [("a", 1.0), ("b", None)]
    assert "C:x" in sinks.text_summary(dict.fromkeys("csdfmn", 1), "C:x", {"N50": "1 KB"}) and sinks.table_header("1", "d", True, False).endswith("Score\tLength")
    df = spark.createDataFrame([("c g1.t1",)], "l string")
    from pyspark.sql import functions as F

    assert df.select(sinks.renamed_gff(df.l, 2, F.lit(5))).first()[0] == "c r2.m5.g1.t1"
