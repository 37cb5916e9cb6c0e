"""Setting up and removing named environments: plans first, as plain data, then a run that may be dry.

An environment's name is a prefix and a step's name. What exists is never made again, and only names with the prefix are removed.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Action:
    name: str
    commands: tuple[tuple[str, ...], ...]  # none: nothing to do


@dataclass(frozen=True)
class Tally:
    done: tuple[str, ...] = ()
    skipped: tuple[str, ...] = ()
    failed: tuple[str, ...] = ()

    @property
    def all_well(self) -> bool:
        return not self.failed


def known_names(info: dict[str, Any]) -> list[str]:
    return [os.path.basename(p.rstrip("/")) for p in info.get("envs", [])]


def _chosen(wanted: Iterable[str], only: str | None) -> list[str]:
    wanted = list(wanted)
    if only is not None and only not in wanted:
        raise LookupError(f"no {only!r} among {', '.join(wanted) or 'none'}")
    return wanted if only is None else [only]


def setup_plan(
    info: dict[str, Any], prefix: str, wanted: dict[str, dict[str, Any]], conda: str = "conda", only: str | None = None,
) -> list[Action]:
    """wanted: by step, its "python" version and pip "packages" (optional). An unknown ``only`` is a LookupError."""
    known, plan = set(known_names(info)), []
    for step in _chosen(wanted, only):
        name, asked = prefix + step, wanted[step]
        make = (conda, "create", "-n", name, f"python={asked['python']}", "-y")
        fill = (conda, "run", "-n", name, "python", "-m", "pip", "install", *asked.get("packages", ()))
        plan.append(Action(name, () if name in known else (make, fill) if asked.get("packages") else (make,)))
    return plan


def cleanup_plan(info: dict[str, Any], prefix: str, conda: str = "conda", only: str | None = None) -> list[Action]:
    """Removal of the environments whose names begin with the prefix, in conda's order."""
    if not prefix:
        raise ValueError("without a prefix, every environment would go")
    steps = [n[len(prefix) :] for n in known_names(info) if n.startswith(prefix)]
    return [Action(prefix + s, ((conda, "env", "remove", "-n", prefix + s, "-y"),)) for s in _chosen(steps, only)]


def _call(command: tuple[str, ...]) -> bool:
    return subprocess.run(command, capture_output=True, text=True).returncode == 0


def carry_out(
    plan: list[Action], dry: bool = True, call: Callable[[tuple[str, ...]], bool] = _call, tell: Callable[[str], None] = print,
) -> Tally:
    """Run a plan's commands; a failing one ends its environment's turn only. A dry run tells them and does nothing."""
    done, skipped, failed = [], [], []
    for action in plan:
        for command in action.commands:
            tell(" ".join(command))
        if dry or not action.commands:
            skipped.append(action.name)
        else:
            (done if all(map(call, action.commands)) else failed).append(action.name)
    return Tally(tuple(done), tuple(skipped), tuple(failed))
