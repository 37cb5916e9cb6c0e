"""Named Python environments: a registry of executables, and processes that run steps under them."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from . import handoff

STEP_SECONDS, PIPELINE_SECONDS = 300, 600
LOCAL = "local"
#: An environment may say its name here; otherwise it is the last part of the interpreter's prefix.
NAME_VARIABLE = "LODESTRATA_ENV"


class StepFailed(RuntimeError):
    """A step failed in another process; the message holds its error and trace."""


def current_name() -> str:
    return os.environ.get(NAME_VARIABLE) or os.path.basename(sys.prefix)


@dataclass
class Registry:
    """Executables by environment name, compared without case; names known to conda can be added from its JSON."""

    executables: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_conda(cls, info: dict[str, Any]) -> Registry:
        return cls({os.path.basename(p): os.path.join(p, "bin", "python") for p in info.get("envs", [])})

    def find(self, name: str) -> str:
        for known, exe in self.executables.items():
            if known.lower() == name.lower():
                return exe
        raise LookupError(f"no environment {name!r} among {sorted(self.executables)}")


def needs_process(requested: str | None, current: str) -> bool:
    """Whether a step or pipeline must leave this process: it names an environment that is neither local nor the current one."""
    return bool(requested) and requested.lower() not in (LOCAL, current.lower())


def run_child(request: dict[str, Any], executable: str, mode: str, seconds: float, tell: Callable[[str], None] | None = None) -> Any:
    """Run child.py on a request and return its result, tables still marked; tell is called with what it printed."""
    folder = Path(tempfile.mkdtemp(prefix="lodestrata-child-"))  # read by this machine's child alone
    asked, answer = folder / "request", folder / "response"
    handoff.dump(request, asked, mode)
    try:
        command = [executable, str(Path(__file__).with_name("child.py")), str(asked), str(answer), mode]
        done = subprocess.run(command, env=os.environ | {"PYTHONIOENCODING": "utf-8"}, timeout=seconds, capture_output=True, text=True)
        if tell and done.stdout.strip():
            tell(done.stdout.rstrip())
        if not answer.exists():
            raise StepFailed(f"process failed with exit code {done.returncode}: {done.stderr[-2000:]}")
        said = handoff.restore(answer, mode)
    finally:
        for p in (asked, answer):
            p.unlink(missing_ok=True)
        folder.rmdir()
    if "error" in said:
        raise StepFailed(f"{said['error']}\n{said['trace']}")
    return said["result"]
