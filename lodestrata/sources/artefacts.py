"""A run's own records: a folder per run, one per step inside it, each with its metadata as YAML-compatible JSON."""

from __future__ import annotations

import json
import time
from pathlib import Path
from typing import Any


class RunFolder:
    """{label}_{workflow}_output/ with metadata.yaml, and NN_step/ with step_metadata.yaml. JSON is YAML, so no writer is needed."""

    def __init__(self, base: str | Path, label: str, workflow: str):
        self.path = Path(base) / f"{label}_{workflow}_output"
        self.began = time.time()

    def begin(self, metadata: dict[str, Any]) -> None:
        self.path.mkdir(parents=True, exist_ok=True)
        (self.path / "metadata.yaml").write_text(json.dumps(metadata, indent=2, default=str) + "\n", encoding="utf-8")

    def end(self, done: list[str]) -> None:
        """Adds to the metadata which steps were run and how long the run took."""
        path = self.path / "metadata.yaml"
        told = json.loads(path.read_text(encoding="utf-8")) | {
            "steps_executed": done, "total_runtime_seconds": round(time.time() - self.began, 1),
        }
        path.write_text(json.dumps(told, indent=2, default=str) + "\n", encoding="utf-8")

    def step(self, index: int, name: str, facts: dict[str, Any]) -> Path:
        folder = self.path / f"{index:02d}_{name}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "step_metadata.yaml").write_text(json.dumps(facts, indent=2, default=str) + "\n", encoding="utf-8")
        return folder
