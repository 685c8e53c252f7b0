"""Optional runners of external programs, one job per row.

Programs are found by a configured folder, else on the path; without one its
outputs are read from files instead.  Jobs are rows, so Spark schedules, retries
and moves them; a job that runs too long is ended and its row says so.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds a job may take.
TIMEOUT = 3600
RESULT = "job string, code int, output string, message string"


def find_tool(name: str, folder: str | None = None) -> str | None:
    """Path of a program in the folder configured, else on the path."""
    if folder:
        path = os.path.join(folder, name)
        return path if os.access(path, os.X_OK) else None
    return shutil.which(name)


def tool_version(path: str, flag: str = "--version") -> str:
    out = subprocess.run([path, flag], capture_output=True, text=True, timeout=60)
    return (out.stdout or out.stderr).strip().split("\n")[0]


def run_jobs(jobs: DataFrame, tool: str, arguments: list[str], timeout: int = TIMEOUT) -> DataFrame:
    """Runs a program for each job (job, size, files map<name, body>): largest first, each in a folder of its own.

    arguments may name files as {name} and the output as {out}; without {out} the
    program's standard output is the result.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for job, files in zip(part["job"], part["files"], strict=True):
                with tempfile.TemporaryDirectory() as d:
                    places = {"out": os.path.join(d, "out")}
                    for name, body in dict(files).items():
                        places[name] = os.path.join(d, name)
                        with open(places[name], "w") as f:
                            f.write(body)
                    try:
                        done = subprocess.run([tool, *(a.format(**places) for a in arguments)], capture_output=True, text=True, timeout=timeout, cwd=d)
                        made = open(places["out"]).read() if os.path.exists(places["out"]) else done.stdout
                        rows.append((job, done.returncode, made, done.stderr[-2000:]))
                    except (subprocess.TimeoutExpired, OSError) as e:
                        rows.append((job, -1, None, str(e)))
            yield pd.DataFrame(rows, columns=["job", "code", "output", "message"])

    n = 4 * int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = jobs.repartition(n, F.xxhash64("job")).sortWithinPartitions(F.desc("size"))
    return dealt.select("job", "files").mapInPandas(run, RESULT)


def failed(results: DataFrame) -> DataFrame:
    return results.where("code <> 0")
