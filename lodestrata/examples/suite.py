"""Runs all example pipelines and holds each to whether it should pass: ``python -m lodestrata.examples.suite``. Exit code 1 if one did otherwise."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from . import PIPELINES, environments

#: Whether each pipeline should pass.
EXPECTED = {
    "local": True, "mixed": True, "step_env": True, "pipeline_env": True, "combined": True, "data_survival": True, "pickle": True,
    "error": False, "missing_step": False,
}


def outcomes(expected: dict[str, bool] | None = None) -> Iterator[tuple[str, bool, bool, str]]:
    """(name, should pass, passed, the error's first line) of each pipeline, as it ends."""
    from ..plans.runner import run_pipeline

    known = environments()
    for name, good in (EXPECTED if expected is None else expected).items():
        try:
            run_pipeline(PIPELINES / f"{name}.yaml", f"test_{name}", {}, environments=known)
            yield name, good, True, ""
        except Exception as e:
            yield name, good, False, f"{type(e).__name__}: {e}".splitlines()[0]


def main(tell: Callable[[str], None] = print, expected: dict[str, bool] | None = None) -> int:
    right = total = 0
    for name, good, passed, error in outcomes(expected):
        total += 1
        right += good == passed
        tell(f"{'as expected' if good == passed else 'NOT AS EXPECTED'}: {name} {'passed' if passed else 'failed, ' + error[:80]}")
    tell(f"{right} of {total} as expected")
    return int(right < total)


if __name__ == "__main__":
    sys.exit(main())
