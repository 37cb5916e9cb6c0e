"""Questions about conda's JSON, as Columns over its list of environment paths."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def env_exists(paths: Column, name: Column) -> Column:
    return F.exists(paths, lambda p: base_name(p) == name)


def envs_with_prefix(paths: Column, prefix: Column) -> Column:
    """Names in the order of the list."""
    return F.filter(F.transform(paths, base_name), lambda n: F.startswith(n, prefix))


def needs_process(requested: Column, current: Column) -> Column:
    """Whether a step must leave its process: it asks for an environment that is neither local nor the current one, case aside."""
    asked = F.lower(F.coalesce(requested, F.lit("local")))
    return (asked != "local") & (asked != F.lower(current))


def conda_info(executable: str | None = None) -> dict[str, Any]:
    """What ``conda info --json`` says. Raises FileNotFoundError without conda."""
    exe = executable or os.environ.get("CONDA_EXE") or shutil.which("conda")
    if not exe:
        raise FileNotFoundError("conda is neither in CONDA_EXE nor on the path")
    return json.loads(subprocess.run([exe, "info", "--json"], capture_output=True, text=True, check=True, timeout=60).stdout)


def conda_executable(info: dict[str, Any]) -> str:
    """The executable that conda's JSON names, if it exists, else the one of the environment, else the plain name."""
    listed = info.get("conda_exe")
    return listed if listed and os.path.exists(listed) else os.environ.get("CONDA_EXE", "conda")
