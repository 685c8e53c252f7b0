"""Whole runs from files: proteins, genomes, transcripts, the automatic lineage, batches and restarts."""

import json
import logging

import pytest

from lociq import log, workflow
from lociq.config import Config, extra_parameters, unused_options
from lociq.errors import ConfigError, NoGenesError
from lociq.sources import remote

ROW = "{t} - 300 {m} - 100 1e-9 {s} 0.1 1 1 1e-8 1e-7 {s} 0.0 1 {e} 1 {e} 1 {e} 0.95 {d}\n"


def hits(folder, rows):
    """rows of (marker, target, score, end of the match, description)."""
    folder.mkdir(parents=True, exist_ok=True)
    for m in {r[0] for r in rows}:
        (folder / f"{m}.out").write_text("# head\n" + "".join(ROW.format(m=m, t=t, s=s, e=e, d=d) for x, t, s, e, d in rows if x == m))


def dataset(base, name, domain, markers):
    d = base / "lineages" / name
    d.mkdir(parents=True)
    (d / "dataset.cfg").write_text(f"domain={domain}\nname={name}\n")
    (d / "scores_cutoff").write_text("".join(f"{k}at2\t50\n" for k in markers))
    return d


def lines(folder, name):
    return "".join(p.read_text() for p in sorted((folder / name).glob("part*"))).splitlines()


def config(tmp_path, **kw):
    return Config(**{"in_": str(tmp_path / "in"), "out": "r", "out_path": str(tmp_path / "out"), "mode": "proteins", "download_path": str(tmp_path / "data"), "quiet": True} | kw).validated()


PROTEINS = [("1at2", "p1", 90.0, 95, "d"), ("2at2", "p2", 80.0, 90, "d"), ("2at2", "p3", 80.0, 90, "d"), ("3at2", "p4", 80.0, 30, "d"), ("3at2", "p6", 70.0, 30, "d"), ("4at2", "p5", 10.0, 99, "d")]


def test_protein_run(spark, tmp_path):
    d = dataset(tmp_path / "data", "set_odb12", "eukaryota", range(1, 5))
    (d / "links.txt").write_text("1at2\tfirst gene\thttp://x/1\n")
    hits(tmp_path / "in", PROTEINS)
    row = workflow.run(spark, config(tmp_path, lineage_dataset="set"))[0]
    assert (row["dataset"], row["n"], row["s_percent"], row["f_percent"]) == ("set_odb12", 4, 25.0, 25.0)
    run = tmp_path / "out/r/run_set_odb12"
    table = lines(run, "full_table")
    assert table[1].startswith("# The lineage dataset is: set_odb12") and table[2].startswith("# Marker id\tStatus\tSequence\tScore\tLength\tLink")
    assert [x.split("\t")[:5] for x in table[3:]] == [["1at2", "Complete", "p1", "90.0", "95"], ["2at2", "Duplicated", "p2", "80.0", "90"], ["2at2", "Duplicated", "p3", "80.0", "90"], ["3at2", "Fragmented", "p4", "80.0", "30"], ["4at2", "Missing", "", "", ""]]
    assert table[3].endswith("http://x/1\tfirst gene") and lines(run, "missing")[-1] == "4at2"
    summary = json.loads((tmp_path / "out/r/short_summary.specific.set_odb12.r.json").read_text())
    assert summary["results"]["s"] == 1 and summary["one_line_summary"].startswith("C:50.0%")
    with pytest.raises(ConfigError):
        workflow.run(spark, config(tmp_path, lineage_dataset="set"))
    for p in (tmp_path / "in").glob("*"):
        p.write_text(p.read_text().replace("80.0", "60.0"))
    again = workflow.run(spark, config(tmp_path, lineage_dataset="set", restart=True))[0]
    assert again["s_percent"] == 25.0 and lines(run, "full_table")[4].split("\t")[3] == "80.0"  # the finished stage is taken up
    assert workflow.run(spark, config(tmp_path, lineage_dataset="set", force=True)) and lines(run, "full_table")[4].split("\t")[3] == "60.0"


def paf(target, low, high, protein, strand="+", identity=0.9):
    gff = "".join(f"ctg\tmp\t{k}\t{a}\t{b}\t9\t{strand}\t0\t{t}\n" for k, a, b, t in (("mRNA", low, high, f"ID=1;Identity={identity};Target=x"), ("CDS", low, high, "P=1")))
    return f"##PAF\t{target}\t100\t0\t99\t{strand}\tctg\t5000\t{low}\t{high}\t90\t99\t0\tAS:i:77\tq\tq\tq\tcg:Z:20M\n##STA\t{protein}\n".replace("0\tAS:i:77", "0\tx\tAS:i:77", 1) + gff


def test_genome_run_settles_exons_and_reports_places(spark, tmp_path):
    dataset(tmp_path / "data", "euk_odb12", "eukaryota", range(1, 5))
    given = tmp_path / "in"
    genes = given / "genes/euk_odb12"
    genes.mkdir(parents=True)
    (genes / "alignments.gff").write_text(paf("1at2_0", 100, 400, "MKL") + paf("2at2_0", 130, 430, "MK*V") + paf("3at2_0", 1000, 1300, "MAA", "-"))
    (given / "sequences.fna").write_text(">ctg\n" + "ACGT" * 100 + "N" * 20 + "ACGT" * 100 + "\n")
    places = {"1at2": "1at2_0|ctg:100-400|+", "2at2": "2at2_0|ctg:130-430|+", "3at2": "3at2_0|ctg:1000-1300|-"}
    hits(given / "hits/euk_odb12", [("1at2", places["1at2"], 60.0, 90, "d"), ("2at2", places["2at2"], 90.0, 95, "d"), ("3at2", places["3at2"], 70.0, 90, "d")])
    row = workflow.run(spark, config(tmp_path, mode="genome", lineage_dataset="euk"))[0]
    assert (row["s_percent"], row["metrics"]["n_scaffolds"], row["metrics"]["n_contigs"], row["e_percent"]) == (50.0, 1, 2, 50.0)
    run = tmp_path / "out/r/run_euk_odb12"
    body = {x.split("\t")[0]: x.split("\t") for x in lines(run, "full_table") if not x.startswith("#")}
    assert body["1at2"][1] == "Missing" and body["2at2"][1:6] == ["Complete", "ctg", "130", "430", "+"] and body["3at2"][1:6] == ["Complete", "ctg", "1300", "1000", "-"]
    fasta = {p.parent.name: p.read_text() for p in (run / "sequences/aa/status=Complete").glob("*/part*")}
    assert fasta == {"marker=2at2": f">{places['2at2']}\nMKV\n", "marker=3at2": f">{places['3at2']}\nMAA\n"}
    assert "Identity=0.9" in "".join(p.read_text() for p in (run / "gff/marker=3at2").glob("part*"))
    assert "C:50.0%[S:50.0%,D:0.0%]" in (tmp_path / "out/r/short_summary.specific.euk_odb12.r.txt").read_text()


def test_transcripts_get_the_protein_of_their_frame(spark, tmp_path):
    dataset(tmp_path / "data", "bac_odb12", "prokaryota", range(1, 4))
    given = tmp_path / "in"
    hits(given / "hits/bac_odb12", [("1at2", "t1", 90.0, 95, "orig_seq_frame_2"), ("2at2", "t2", 90.0, 95, "rev_comp_frame_1")])
    (given / "sequences.fna").write_text(">t1\nAATGAAA\n>t2\nTTTCAT\n>t3\nATGATG\n")
    workflow.run(spark, config(tmp_path, mode="transcriptome", lineage_dataset="bac"))
    run = tmp_path / "out/r/run_bac_odb12"
    assert sorted(lines(run, "single_copy_proteins")) == sorted([">t1", "MK", ">t2", "MK"])
    assert {p.read_text() for p in (run / "sequences/nt/status=Complete").glob("*/part*")} == {">t1\nAATGAAA\n", ">t2\nTTTCAT\n"}


def roots(tmp_path, euk=range(1, 5), found="eukaryota"):
    data, given = tmp_path / "data", tmp_path / "in"
    for root, domain, markers in (("archaea_odb12", "prokaryota", range(11, 15)), ("bacteria_odb10", "prokaryota", range(21, 25)), ("eukaryota_odb12", "eukaryota", euk)):
        dataset(data, root, domain, markers)
    low = {"archaea_odb12": 11, "bacteria_odb10": 21, "eukaryota_odb12": 1}
    for name, k in low.items():
        n = 3 if name.startswith(found) else 1
        hits(given / f"hits/{name}", [(f"{k + i}at2", f"p{k + i}", 90.0 if n > 1 else 20.0, 95, "d") for i in range(n)])
    return data, given


def test_the_best_root_is_chosen_and_refined_by_placement(spark, tmp_path):
    data, given = roots(tmp_path)
    dataset(data, "fungi_odb12", "eukaryota", range(1, 3))
    hits(given / "hits/fungi_odb12", [("1at2", "p1", 90.0, 95, "d")])
    (given / "placement").mkdir()
    (given / "placement/eukaryota.json").write_text('{"tree": "((1:0.1[0],4751:0.2[1])7:1.5[2]);", "placements": [' + ",".join(['{"p": [[1, 1.0]]}'] * 12) + "]}")
    (data / "placement_files").mkdir()
    (data / "placement_files/taxid_paths.eukaryota_odb12.txt").write_text("#h\na\tb\tc\td\t1,2759,4751,5000\n")
    (data / "placement_files/taxid_datasets.eukaryota_odb12.txt").write_text("2759\teukaryota_odb12\n4751\tfungi_odb12,x\n")
    kept = log.set_up(None, True)
    row = workflow.run(spark, config(tmp_path, auto_lineage=True))[0]
    assert (row["dataset"], row["s_percent"], row["n"]) == ("fungi_odb12", 50.0, 2) and row["scores"]["eukaryota"].startswith("C:75.0%") and row["scores"]["bacteria"].startswith("C:0.0%")
    assert any("bacteria_odb12 is not there, bacteria_odb10 is used" in m for m in kept.messages)
    base = tmp_path / "out/r"
    assert (base / "short_summary.specific.fungi_odb12.r.txt").exists() and (base / "short_summary.generic.eukaryota_odb12.r.txt").exists()
    assert "Scores_archaea_odb12" in workflow.batch_lines(config(tmp_path, auto_lineage=True), [row]) and "\t50.0\t" in workflow.batch_lines(config(tmp_path, auto_lineage=True), [row])


def test_viruses_are_tried_where_no_root_fits(spark, tmp_path):
    data, given = roots(tmp_path, found="none")
    dataset(data, "herpes_odb12", "viruses", range(31, 33))
    hits(given / "hits/herpes_odb12", [("31at2", "p31", 90.0, 95, "d")])
    (data / "information").mkdir()
    (data / "information/virus_datasets.txt").write_text("herpes_odb10\n")
    row = workflow.run(spark, config(tmp_path, auto_lineage=True))[0]
    assert (row["dataset"], row["s_percent"]) == ("herpes_odb12", 50.0)


def test_nothing_found_by_any_root(spark, tmp_path):
    roots(tmp_path, found="none")
    with pytest.raises(NoGenesError):
        workflow.run(spark, config(tmp_path, auto_lineage=True))


def test_a_batch_goes_on_past_failed_inputs(spark, tmp_path):
    dataset(tmp_path / "data", "set_odb12", "eukaryota", range(1, 5))
    hits(tmp_path / "in/good/hits", PROTEINS)
    hits(tmp_path / "in/other/hits", PROTEINS[:1])
    hits(tmp_path / "in/none/hits", [("4at2", "p5", 10.0, 99, "d")])
    rows = workflow.run(spark, config(tmp_path, lineage_dataset="set", batch=True))
    assert [(r["input"], r.get("error"), r.get("c_percent")) for r in rows] == [("good", None, 50.0), ("none", "No genes found", None), ("other", None, 25.0)]
    table = (tmp_path / "out/r/batch_summary.txt").read_text().splitlines()
    assert table[0].split("\t")[:2] == ["Input_file", "Dataset"] and len({x.count("\t") for x in table}) == 1
    assert table[1].split("\t") == ["good", "set_odb12", "50.0", "25.0", "25.0", "25.0", "25.0", "4"] and table[2].startswith("none\tNo genes found")
    with pytest.raises(ConfigError):  # settings end a batch
        workflow.run(spark, config(tmp_path, lineage_dataset="nowhere", force=True))


def test_options_of_other_pipelines_are_named():
    c = Config(in_="x", mode="proteins", lineage_dataset="b", limit=5, contig_break=7, long=True).validated()
    assert unused_options(c, "proteins") == ["contig_break", "limit", "long"] and unused_options(c, "genome_hmm") == []
    assert Config(in_="x", mode="proteins", lineage_dataset="/data/set").validated().lineage_dataset == "/data/set"


def test_extra_parameters():
    assert extra_parameters('"--a=1 -s=2 --z=3"', {"a", "s"}) == ({"a": "1", "s": "2"}, ["z is not an accepted parameter"])
    assert extra_parameters("a=1", {"a"})[0] == {} and extra_parameters("--a", {"a"})[1] and extra_parameters("", {"a"}) == ({}, [])


def test_log_files_and_warnings(tmp_path, capsys):
    kept = log.set_up(str(tmp_path / "logs"), True)
    logging.getLogger("lociq").warning("take %s", "care")
    logging.getLogger("lociq").error("broken")
    assert kept.messages == ["take care", "broken"] and "care" not in (err := capsys.readouterr().err) and "broken" in err
    assert "take care" in next((tmp_path / "logs").glob("*.log")).read_text() and log.timestamp(0, "%Y") in ("1969", "1970")
    log.set_up()


def test_files_are_fetched_checked_and_repeated(tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text("right")
    bad.write_text("wrong")
    md5 = remote.digest(str(good))
    target = str(tmp_path / "to/file")
    assert remote.fetch([f"file://{bad}", "file:///nowhere", f"file://{good}"], target, md5, (0,)) == target and open(target).read() == "right"
    good.unlink()
    assert remote.fetch([f"file://{good}"], target, md5, ()) == target  # it is there already
    with pytest.raises(ConfigError):
        remote.fetch([f"file://{bad}"], str(tmp_path / "other"), md5, ())
