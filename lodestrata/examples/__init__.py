"""Example pipelines, and stand-ins for their environments."""

from __future__ import annotations

import os
import stat
import sys
import tempfile
from pathlib import Path

PIPELINES = Path(__file__).with_name("pipelines")


def stand_ins(*names: str) -> dict[str, str]:
    """Executables that run this Python under another environment name."""
    folder = Path(tempfile.mkdtemp(prefix="lodestrata-envs-"))  # used on this machine by child processes alone
    made = {}
    for name in names:
        script = folder / name
        script.write_text(f'#!/bin/sh\nLODESTRATA_ENV={name} exec "{sys.executable}" "$@"\n')
        script.chmod(script.stat().st_mode | stat.S_IXUSR)
        made[name] = os.fspath(script)
    return made


def environments() -> dict[str, str]:
    return stand_ins("example--env_a", "example--env_b", "example--env_c")
