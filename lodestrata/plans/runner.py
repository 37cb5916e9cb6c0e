"""Runs a pipeline: folds its steps over a state, building DataFrame plans in this process and crossing into other environments only where a step asks for one.

Steps are Python files with ``METADATA`` and ``run(state, **params)``. The state is a mapping with ``metadata``, ``input`` and
what steps have added. Tables in it are lazy DataFrames: Catalyst sees the steps' joined plan, and a plan is cut only at an
environment barrier (tables are written and read again) or where METADATA says ``materialize``.
"""

from __future__ import annotations

import datetime
import importlib.util
import logging
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from . import handoff
from .environments import LOCAL, PIPELINE_SECONDS, STEP_SECONDS, Registry, current_name, needs_process, run_child
from .spec import PipelineSpec, StepSpec, load, run_metadata
from .voice import engine_speaks, steps_log, steps_speak

log = logging.getLogger("lodestrata.engine")
PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


def load_step(name: str, folder: Path):
    """The step's module, read when its turn comes."""
    path = folder / f"{name}.py"
    if not path.is_file():
        raise FileNotFoundError(f"step file not found: {path}")
    spec = importlib.util.spec_from_file_location(f"lodestrata_step_{name}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def settings(module) -> dict[str, Any]:
    declared = getattr(module, "METADATA", None) or {}
    transfer = declared.get("data_transfer") or "file_paths"
    return {
        "environment": declared.get("environment") or LOCAL, "mode": "pickle" if transfer == "pickle" else "file_paths",
        "materialize": bool(declared.get("materialize")),
    }


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _table_folder(shared: str | None) -> str:
    """A new folder where tables cross: shared by the cluster, or this machine's without a session."""
    if spark := _session():
        from ..storage import new_folder

        return new_folder(spark, shared)
    import tempfile
    import uuid

    if not shared:
        return tempfile.mkdtemp(prefix="lodestrata-handoff-")
    folder = f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    system, path = handoff.file_system(folder)
    system.create_dir(path)
    return folder


def _read(path: str):
    spark = _session()
    return spark.read.parquet(path) if spark else handoff.TableRef(path)


def _elsewhere(request: dict, environment: str, mode: str, seconds: float, registry: Registry, verbose: int) -> Any:
    """The result of a request in another environment. What it printed is passed on if steps speak."""
    tell = steps_log.info if steps_speak(verbose) else None
    return handoff.attach(run_child(request | {"package_root": PACKAGE_ROOT}, registry.find(environment), mode, seconds, tell), _read)


def _in_environment(step: StepSpec, path: Path, state: dict, chosen: dict, registry: Registry, shared: str | None, verbose: int) -> Any:
    folder = _table_folder(shared)
    request = {"step": str(path), "params": step.params, "state": handoff.detach(state, folder), "folder": folder}
    return _elsewhere(request, chosen["environment"], chosen["mode"], STEP_SECONDS, registry, verbose)


def materialised(value: Any, shared: str | None = None) -> Any:
    """The value with its tables written to the shared folder and read again."""
    folder = _table_folder(shared)
    return handoff.attach(handoff.detach(value, folder), _read)


def run_pipeline(
    yaml_path: str | Path,
    label: str = "test",
    input_data: dict | None = None,
    *,
    environments: dict[str, str] | None = None,
    shared: str | None = None,
    placed: bool = False,
    on_step: Callable[[int, str, Any], None] | None = None,
    output: str | Path | None = None,
) -> Any:
    """Run a pipeline file and return the last step's state.

    environments: executables by name. placed: this process is already the pipeline's own environment. on_step is
    called with number, name and state after each step. output: where the run leaves a folder with its metadata and one folder per
    step with the step's parameters and times. A step that fails in this process raises its own error, noted with the step's name;
    one that fails in another raises StepFailed.
    """
    spec = load(yaml_path)
    registry, here = Registry(environments or {}), current_name()
    speaks = engine_speaks(spec.verbose)
    if not placed and needs_process(spec.environment, here):
        return _whole_in_environment(spec, label, input_data, registry, shared, output)
    state: Any = {"metadata": run_metadata(spec, label, datetime.datetime.now()), "input": input_data or {}}
    records = _records(output, state["metadata"], spec)
    for step in spec.steps:
        if speaks:
            log.info("step %d of %d: %s", step.index, len(spec.steps), step.name)
        began = time.time()
        try:
            module = load_step(step.name, spec.steps_dir)
            chosen = settings(module)
            if needs_process(chosen["environment"], here):
                state = _in_environment(step, spec.steps_dir / f"{step.name}.py", state, chosen, registry, shared, spec.verbose)
            else:
                state = module.run(state, **step.params)
                if chosen["materialize"]:
                    state = materialised(state, shared)
        except Exception as e:
            e.add_note(f"in step {step.index}, {step.name}, of {spec.path}")
            raise
        if records:
            records.step(step.index, step.name, _facts(step, module, chosen, began))
        if on_step:
            on_step(step.index, step.name, state)
    if records:
        records.end(spec.step_names)
    return state


def _records(output: str | Path | None, metadata: dict, spec: PipelineSpec):
    if output is None:
        return None
    from ..sources.artefacts import RunFolder

    made = RunFolder(output, metadata["label"], spec.workflow)
    made.begin(metadata)
    return made


def _facts(step: StepSpec, module: Any, chosen: dict, began: float) -> dict[str, Any]:
    """What a step's record says: lazy tables are computed later, so its time is that of planning and of what the step itself ran."""
    declared, ended = getattr(module, "METADATA", None) or {}, time.time()
    clock = lambda t: datetime.datetime.fromtimestamp(t).strftime("%Y-%m-%d %H:%M:%S")
    return {
        "step_name": step.name, "step_number": step.index, "version": declared.get("version"), "environment": chosen["environment"],
        "start_time": clock(began), "end_time": clock(ended), "runtime_seconds": round(ended - began, 1), "parameters_used": step.params,
    }


def _whole_in_environment(
    spec: PipelineSpec, label: str, input_data: dict | None, registry: Registry, shared: str | None, output: str | Path | None,
) -> Any:
    folder = _table_folder(shared)
    pipeline = {
        "yaml_path": str(spec.path), "label": label, "input_data": input_data or None, "environments": registry.executables,
        "shared": shared, "output": output and str(output),
    }
    request = {"pipeline": handoff.detach(pipeline, folder), "folder": folder}
    return _elsewhere(request, spec.environment, "file_paths", PIPELINE_SECONDS, registry, spec.verbose)


def told(result: Any) -> str:
    """The result as JSON; after a selection workflow, a line per selected region before it."""
    import json

    lines = []
    chosen = result.get("feedback") if isinstance(result, dict) else None
    if isinstance(chosen, dict) and hasattr(chosen.get("cells"), "toLocalIterator"):
        from ..operators.feedback import report

        lines = [r["line"] or f"label={r['label']:3d}" for r in report(chosen["cells"]).orderBy("label").toLocalIterator()]
    return "\n".join([*lines, json.dumps(result, indent=2, default=str)])


def main(argv: list[str] | None = None) -> int:
    import argparse
    import json

    parser = argparse.ArgumentParser(prog="lodestrata", description="Run a pipeline file.")
    parser.add_argument("yaml_path")
    parser.add_argument("--label", default="test")
    parser.add_argument("--input", help="JSON with the pipeline's input")
    parser.add_argument("--source", help="the input's data_source: a folder of tables or pictures")
    parser.add_argument("--output", help="where to leave a folder with the run's records")
    parser.add_argument(
        "--environment", action="append", default=[], metavar="NAME=PYTHON", help="an environment's executable; may be repeated",
    )
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    given = json.loads(args.input) if args.input else {}
    if args.source:
        from pyspark.sql import SparkSession

        given["data_source"] = args.source
        SparkSession.builder.getOrCreate()
    known = dict(x.split("=", 1) for x in args.environment)
    print(told(run_pipeline(args.yaml_path, args.label, given or None, environments=known, output=args.output)))
    if spark := _session():
        from ..storage import clear

        clear(spark)  # nothing reads the run's tables any more
    return 0
