"""Pipeline configurations: a YAML file that names an ordered list of steps, read into frozen specs."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: Metadata keys that steer the engine and are not passed on to the steps.
ENGINE_KEYS = ("verbose", "functions_dir", "environment")
DEFAULT_STEPS_DIR = "../steps"


@dataclass(frozen=True)
class StepSpec:
    index: int
    name: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class PipelineSpec:
    path: Path
    workflow: str
    metadata: dict[str, Any]
    steps: tuple[StepSpec, ...]

    @property
    def verbose(self) -> int:
        return self.metadata.get("verbose", 0)

    @property
    def environment(self) -> str | None:
        return self.metadata.get("environment")

    @property
    def steps_dir(self) -> Path:
        return (self.path.parent / self.metadata.get("functions_dir", DEFAULT_STEPS_DIR)).resolve()

    @property
    def step_names(self) -> list[str]:
        return [s.name for s in self.steps]


def _plain(value: Any) -> Any:
    """Dates as ISO strings, so that a configuration survives JSON."""
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def parse(text: str, path: Path) -> PipelineSpec:
    """The first key that isn't ``metadata`` is the workflow; later ones are ignored. Raises ValueError for what can't be run."""
    try:
        import yaml
    except ImportError as e:  # the one optional dependency
        raise ImportError("reading pipeline files needs PyYAML") from e
    config = _plain(yaml.safe_load(text))
    if not isinstance(config, dict):
        raise ValueError(f"{path}: not a mapping of metadata and a workflow")
    metadata = config.get("metadata") or {}
    if not isinstance(metadata, dict):
        raise ValueError(f"{path}: metadata must be a mapping")
    workflow = next((k for k in config if k != "metadata"), None)
    if workflow is None:
        raise ValueError(f"{path}: no workflow key beside metadata")
    steps = config[workflow]
    if not isinstance(steps, list) or not steps:
        raise ValueError(f"{path}: workflow {workflow!r} must be a list of steps")
    specs = []
    for i, step in enumerate(steps, 1):
        if not isinstance(step, dict) or not step:
            raise ValueError(f"{path}: step {i} of {workflow!r} must be a mapping from its name to its parameters")
        name, params = next(iter(step.items()))
        if params is not None and not isinstance(params, dict):
            raise ValueError(f"{path}: parameters of step {name!r} must be a mapping")
        specs.append(StepSpec(i, str(name), dict(params or {})))
    return PipelineSpec(path, str(workflow), metadata, tuple(specs))


def load(path: str | Path) -> PipelineSpec:
    path = Path(path).resolve()
    return parse(path.read_text(encoding="utf-8"), path)


def run_metadata(spec: PipelineSpec, label: str, at: datetime.datetime) -> dict[str, Any]:
    """What steps find under ``metadata``. The file's own metadata comes last and wins."""
    own = {
        "datetime": at.strftime("%Y%m%d-%H%M%S"), "label": label, "workflow_name": spec.workflow, "yaml_filename": spec.path.name,
        "steps": spec.step_names, "verbose": spec.verbose,
    }
    return own | {k: v for k, v in spec.metadata.items() if k not in ENGINE_KEYS}
