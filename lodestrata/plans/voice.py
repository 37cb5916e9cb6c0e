"""Who speaks at which level: 0 silent, 1 the engine, 2 the steps, 3 both. Standard library only, as steps elsewhere use it too."""

from __future__ import annotations

import logging
from typing import Any

steps_log = logging.getLogger("lodestrata.steps")


def engine_speaks(verbose: int) -> bool:
    return verbose in (1, 3)


def steps_speak(verbose: int) -> bool:
    return verbose >= 2


def say(state: Any, line: str) -> None:
    """A step's line, if the run's level lets steps speak."""
    if steps_speak((state.get("metadata") or {}).get("verbose") or 0):
        steps_log.info(line)
