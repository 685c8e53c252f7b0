import pytest

from lociq import config as C
from lociq.errors import ConfigError, NoGenesError, is_fatal


def test_arguments_win_over_the_file(tmp_path, monkeypatch):
    p = tmp_path / "c.ini"
    p.write_text("[run]\nin = x\nmode = prot\ncpu = 4\nevalue = 0.01\n")
    c = C.load({"cpu": 8, "limit": None}, str(p))
    assert (c.in_, c.mode, c.cpu, c.evalue, c.limit) == ("x", "proteins", 8, 0.01, 3)
    monkeypatch.setenv(C.ENVIRONMENT, str(p))
    assert C.load({}).cpu == 4


@pytest.mark.parametrize("bad", [{}, {"in": "x"}, {"in": "x", "mode": "huh"}, {"in": "x", "mode": "geno", "limit": 0}, {"in": "x", "mode": "geno", "limit": 21}, {"in": "x", "mode": "geno", "force": True, "restart": True}, {"in": "x", "mode": "geno", "nonsense": 1}, {"in": "x", "mode": "geno", "cpu": "many"}, {"in": "x", "mode": "geno", "lineage_dataset": "b_odb9"}])
def test_bad_settings(bad):
    with pytest.raises(ConfigError):
        C.load(bad)


def test_missing_file():
    with pytest.raises(ConfigError):
        C.load({}, "/nowhere.ini")


def test_lineages():
    auto = C.load({"in": "x", "mode": "geno"})
    assert auto.auto_lineage and auto.roots() == ["archaea", "bacteria", "eukaryota"]
    assert C.load({"in": "x", "mode": "geno", "auto_lineage_prok": True}).roots() == ["archaea", "bacteria"]
    assert C.load({"in": "x", "mode": "geno", "auto_lineage_prok": True, "auto_lineage_euk": True}).roots() == ["archaea", "bacteria", "eukaryota"]
    named = C.load({"in": "x", "mode": "geno", "lineage_dataset": "b_odb10", "auto_lineage": True})
    assert (named.lineage_dataset, named.datasets_version, named.roots()) == ("b_odb10", "odb10", [])
    assert C.load({"in": "x", "mode": "geno", "lineage_dataset": "b"}).lineage_dataset == "b_odb12"


def test_pipelines():
    g = C.load({"in": "x", "mode": "geno"})
    assert (g.pipeline("eukaryota"), g.pipeline("prokaryota")) == ("genome_aligner_b", "genome_gene_finder")
    assert C.load({"in": "x", "mode": "tran"}).pipeline("eukaryota") == "transcriptome_aligner_a"


def test_tool_parameters_and_datasets(tmp_path):
    assert C.tool_parameters("--a=1 --b=x", {"a", "b"}) == {"a": "1", "b": "x"}
    with pytest.raises(ConfigError):
        C.tool_parameters("--c=1", {"a"})
    for v in ("odb10", "odb12"):
        (tmp_path / f"b_{v}").mkdir()
    assert C.newest_dataset(str(tmp_path), "b").endswith("b_odb12") and C.newest_dataset(str(tmp_path), "b_odb10").endswith("b_odb10")
    with pytest.raises(ConfigError):
        C.newest_dataset(str(tmp_path), "z")


def test_fatality():
    assert is_fatal(ConfigError("x"), True) and not is_fatal(NoGenesError("s"), True) and is_fatal(NoGenesError("s"), False)


def test_protein_run_end_to_end(spark, tmp_path, capsys):
    from lociq.__main__ import main

    hits, data = tmp_path / "hits", tmp_path / "b_odb12"
    hits.mkdir()
    data.mkdir()
    row = "{t} - 300 {m} - 100 1e-9 {s} 0.1 1 1 1e-8 1e-7 {s} 0.0 1 {e} 1 100 1 100 0.95 d"
    (hits / "1at2.out").write_text(row.format(t="p1", m="1at2", s=90.0, e=95) + "\n")
    (hits / "2at2.out").write_text("\n".join(row.format(t=t, m="2at2", s=80.0, e=90) for t in ("p2", "p3")) + "\n")
    (hits / "3at2.out").write_text(row.format(t="p4", m="3at2", s=80.0, e=30) + "\n")
    (hits / "4at2.out").write_text(row.format(t="p5", m="4at2", s=10.0, e=99) + "\n")
    (data / "scores_cutoff").write_text("".join(f"{k}at2\t50\n" for k in range(1, 5)))
    assert main(["-i", str(hits), "-m", "prot", "-l", str(data), "-o", "r", "--out_path", str(tmp_path)]) == 0
    assert "C:50.0%[S:25.0%,D:25.0%],F:25.0%,M:25.0%,n:4" in capsys.readouterr().out
    assert next((tmp_path / "r/missing").glob("part*")).read_text() == "4at2\n"
    assert main(["-m", "prot"]) == 1
