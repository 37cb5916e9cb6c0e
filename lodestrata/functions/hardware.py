"""Accelerator tags, as Columns over a driver's CUDA version, and for this machine."""

from __future__ import annotations

import platform
import shutil
import subprocess

from pyspark.sql import Column
from pyspark.sql import functions as F

# Builds that can be had, newest first, the one taken when nothing fits, where they are, and labels.
BUILDS = ("cu128", "cu126", "cu124", "cu121", "cu118")
FALLBACK = "cu124"
INDEX = "https://download.pytorch.org/whl/"
LABELS = {"mps": "Apple MPS (Metal Performance Shaders)", "cpu": "CPU (no GPU acceleration)", "cuda": "NVIDIA CUDA "}
PROBE_SECONDS = 10


def cuda_version(report: Column) -> tuple[Column, Column]:
    """Major and minor version in a report that has "CUDA Version: M.m"; null without."""
    part = lambda i: F.regexp_extract(report, r"CUDA Version:\s*([0-9]+)\.([0-9]+)", i).try_cast("int")
    return part(1), part(2)


def gpu_tag(major: Column, minor: Column) -> Column:
    """The exact build for a version, else the newest not above it, else the fallback."""
    exact = F.concat(F.lit("cu"), major.cast("string"), minor.cast("string"))
    number = major * 100 + minor
    best = F.coalesce(*[F.when(number >= int(b[2:-1]) * 100 + int(b[-1]), F.lit(b)) for b in BUILDS], F.lit(FALLBACK))
    return F.when(exact.isin(*BUILDS), exact).otherwise(best)


def gpu_label(tag: Column) -> Column:
    version = F.concat(F.substring(tag, 3, 2), F.lit("."), F.substring(tag, 5, 1))
    return F.when(tag == "mps", LABELS["mps"]).when(tag == "cpu", LABELS["cpu"]).otherwise(F.concat(F.lit(LABELS["cuda"]), version))


def torch_install_args(tag: Column) -> Column:
    packages = F.array(F.lit("torch"), F.lit("torchvision"))
    return F.when(tag == "mps", packages).otherwise(F.concat(packages, F.array(F.lit("--index-url"), F.concat(F.lit(INDEX), tag))))


def tag_of(major: int, minor: int) -> str:
    if (exact := f"cu{major}{minor}") in BUILDS:
        return exact
    return next((b for b in BUILDS if (int(b[2:-1]), int(b[-1])) <= (major, minor)), FALLBACK)


def detect_gpu() -> str:
    """This machine's tag: "mps", "cpu" or a CUDA build."""
    import re

    if platform.system() == "Darwin":
        return "mps" if platform.machine() == "arm64" else "cpu"
    if (probe := shutil.which("nvidia-smi")) is None:
        return "cpu"
    try:
        done = subprocess.run([probe], capture_output=True, text=True, timeout=PROBE_SECONDS)
    except (subprocess.TimeoutExpired, OSError):
        return FALLBACK
    if done.returncode:
        return "cpu"
    found = re.search(r"CUDA Version:\s*(\d+)\.(\d+)", done.stdout)
    return tag_of(int(found[1]), int(found[2])) if found else FALLBACK
