import os

import pytest

from lociq import runs, tools
from lociq.errors import ConfigError


def test_folders_and_restart(spark, tmp_path):
    f = runs.RunFolder(str(tmp_path), "r", "b_odb12")
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert runs.stage(spark, f, "a", make).count() == 3
    with pytest.raises(ConfigError):
        runs.RunFolder(str(tmp_path), "r", "b_odb12")
    again = runs.RunFolder(str(tmp_path), "r", "b_odb12", restart=True)
    assert runs.stage(spark, again, "a", make, True).count() == 3 and len(made) == 1
    os.remove(again.path("stages", "a", "_SUCCESS"))
    runs.stage(spark, again, "a", make, True)
    assert len(made) == 2 and again.summary_names(True)[0].endswith("short_summary.specific.b_odb12.r.txt")
    assert runs.archive(again.run).endswith(".tar.gz") and not os.path.exists(again.run)


def test_listings(spark, tmp_path):
    m = spark.createDataFrame([("b_odb12", "d", "h1", "prokaryota", "lineages"), ("e_odb12", "d", "h2", "eukaryota", "lineages"), ("x", "d", "h3", "eukaryota", "placement_files")], "dataset string, date string, hash string, domain string, type string")
    assert [r.dataset for r in runs.list_datasets(m).collect()] == ["b_odb12", "e_odb12"] and runs.list_datasets(m, "eukaryota").count() == 1
    assert runs.expected_hash(m, "x") == "h3"
    with pytest.raises(ConfigError):
        runs.expected_hash(m, "nope")
    (tmp_path / "hmms").mkdir()
    (tmp_path / "hmms/2at2.hmm").write_text("x")
    (tmp_path / "hmms/1at2.hmm").write_text("x")
    with pytest.raises(ConfigError):
        runs.check_dataset(str(tmp_path))
    (tmp_path / "dataset.cfg").write_text("domain=x")
    runs.check_dataset(str(tmp_path))
    assert runs.profiles(str(tmp_path / "hmms")) == ["1at2", "2at2"] and len(runs.inputs_of(str(tmp_path))) == 2


def test_box():
    b = runs.boxed(["C:1%", "x" * 100]).split("\n")
    assert len({len(x) for x in b}) == 1 and len(b) == 5 and len(b[0]) == 80


def test_jobs_run_in_their_own_folders(spark):
    jobs = spark.createDataFrame([("a", 1, {"x": "one"}), ("b", 2, {"x": "two"})], "job string, size long, files map<string,string>")
    out = {r.job: (r.code, r.output) for r in tools.run_jobs(jobs, tools.find_tool("cat"), ["{x}"]).collect()}
    assert out == {"a": (0, "one"), "b": (0, "two")}
    slow = tools.run_jobs(jobs.where("job = 'a'"), tools.find_tool("sleep"), ["5"], timeout=1)
    assert tools.failed(slow).count() == 1 and tools.find_tool("no-such-tool") is None and tools.find_tool("cat", "/nowhere") is None
