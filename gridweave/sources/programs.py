"""The external generator of Steiner points, run by the executors, one project at a time.

Two programs in a row: the first reads the points, the second reads what the first
wrote and tells the points it found.  They are looked for in the folder that the
request names, else in that of GEOSTEINER_HOME, and on the PATH.  A missing or
failing program is an error text of its project and stops no other.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridweave.sources import files

#: Names of the programs, the variable of their folder, seconds for each, texts of warnings.
PROGRAMS = ("efst", "bb")
HOME = "GEOSTEINER_HOME"
SECONDS = 120
MISSING = "GeoSteiner binaries efst/bb not found (set GEOSTEINER_HOME or PATH)"


def located(name: str, home: str | None) -> str | None:
    """The program's path, or None."""
    home = home or os.environ.get(HOME, "").strip()
    inside = [os.path.join(home, *sub, name) for sub in ((), ("bin",))] if home else []
    return next((p for p in inside if os.path.isfile(p)), None) or shutil.which(name)


def piped(points: str, home: str | None, seconds: float = SECONDS) -> tuple[str | None, str | None]:
    """(what the last program wrote, None), or (None, what went wrong)."""
    paths = [located(name, home) for name in PROGRAMS]
    if None in paths:
        return None, MISSING
    text = points
    for name, path in zip(PROGRAMS, paths):
        try:
            done = subprocess.run([path], input=text, capture_output=True, text=True, timeout=seconds, cwd=home if home and os.path.isdir(home) else None)
        except (OSError, subprocess.SubprocessError) as e:
            return None, str(e)
        if done.returncode:
            return None, f"{name} failed: {(done.stderr or done.stdout).strip() or done.returncode}"
        text = done.stdout
    return text, None


def steiner_inputs(terminals: DataFrame) -> DataFrame:
    """project_id, input: for projects with two terminals or more."""
    enough = terminals.groupBy("project_id").count().filter("count > 1")
    return files.steiner_input(terminals.join(enough, "project_id", "left_semi"))


def run_steiner(asked: DataFrame) -> DataFrame:
    """The columns of asked (project_id, input, geosteiner_home and others), output, error.

    Projects are dealt over the tasks before, since each may take minutes.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            told = [piped(points, home if isinstance(home, str) and home else None) for points, home in zip(part["input"], part["geosteiner_home"])]
            yield part.assign(output=[t[0] for t in told], error=[t[1] for t in told])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return asked.repartition(F.col("project_id")).mapInPandas(run, f"{fields}, output string, error string")
