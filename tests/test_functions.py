import pytest
from pyspark.sql import functions as F

from lodestrata.functions import environments, hardware
from lodestrata.plans.environments import Registry

INFO = {"conda_version": "24.1.0", "envs": ["/opt/conda", "/opt/conda/envs/flow--a", "/opt/conda/envs/flow--b"], "envs_dirs": ["/opt/conda/envs"], "root_prefix": "/opt/conda"}


@pytest.mark.parametrize("major,minor,tag", [(12, 8, "cu128"), (12, 7, "cu126"), (12, 5, "cu124"), (12, 0, "cu118"), (11, 8, "cu118"), (13, 1, "cu128"), (11, 7, "cu124"), (10, 2, "cu124")])
def test_tags_of_column_and_function_agree(spark, major, minor, tag):
    assert hardware.tag_of(major, minor) == tag
    assert spark.range(1).select(hardware.gpu_tag(F.lit(major), F.lit(minor))).first()[0] == tag


def test_labels_and_arguments(spark):
    df = spark.createDataFrame([("cpu",), ("mps",), ("cu121",)], "tag string")
    got = {r.tag: (r.l, r.a) for r in df.select("tag", hardware.gpu_label(F.col("tag")).alias("l"), hardware.torch_install_args(F.col("tag")).alias("a")).collect()}
    assert got["mps"] == ("Apple MPS (Metal Performance Shaders)", ["torch", "torchvision"])
    assert got["cpu"][1][-1].endswith("/whl/cpu") and got["cu121"] == ("NVIDIA CUDA 12.1", ["torch", "torchvision", "--index-url", "https://download.pytorch.org/whl/cu121"])


def test_detected_tag_is_known():
    assert hardware.detect_gpu() in {"cpu", "mps", *hardware.BUILDS}


def test_environment_names(spark):
    df = spark.createDataFrame([(INFO["envs"],)], "envs array<string>")
    r = df.select(environments.env_exists(F.col("envs"), F.lit("flow--a")).alias("a"), environments.env_exists(F.col("envs"), F.lit("flow")).alias("b"), environments.envs_with_prefix(F.col("envs"), F.lit("flow--")).alias("c")).first()
    assert (r.a, r.b, r.c) == (True, False, ["flow--a", "flow--b"])


def test_registry_from_conda():
    registry = Registry.from_conda(INFO)
    assert registry.find("FLOW--A") == "/opt/conda/envs/flow--a/bin/python"
    with pytest.raises(LookupError):
        registry.find("absent")


def test_conda_is_not_required(monkeypatch):
    monkeypatch.delenv("CONDA_EXE", raising=False)
    monkeypatch.setenv("PATH", "/nowhere")
    with pytest.raises(FileNotFoundError):
        environments.conda_info()
    assert environments.conda_executable(INFO) == "conda"


def test_the_executable_is_the_one_that_conda_names(tmp_path, monkeypatch):
    monkeypatch.delenv("CONDA_EXE", raising=False)
    exe = tmp_path / "conda"
    assert environments.conda_executable({"conda_exe": str(exe)}) == "conda"
    exe.touch()
    assert environments.conda_executable({"conda_exe": str(exe)}) == str(exe)
