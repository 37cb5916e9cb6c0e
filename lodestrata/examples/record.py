"""What example steps leave behind: notes about the process that ran them, and the record that must survive an environment switch."""

from __future__ import annotations

import os
import sys
from math import isclose
from typing import Any

from ..plans.environments import current_name
from ..plans.voice import say

# The fields of the steps' notes.
NOTES = {
    "step_local": ("executed", "environment", "environment_name", "python_executable", "process_id", "params_used"),
    "step_local_2": (
        "executed", "environment", "environment_name", "python_executable", "process_id", "params_used", "previous_steps_found",
    ),
    "step_env": (
        "executed", "requested_environment", "actual_environment", "environment_match", "python_executable", "process_id",
        "params_used",
    ),
    "step_env_b": (
        "executed", "requested_environment", "actual_environment", "environment_match", "python_executable", "process_id",
        "params_used",
    ),
    "step_pickle": ("executed", "data_transfer", "received_previous_data", "environment", "process_id"),
}
#: What a state holds besides the steps' results.
GIVEN = ("metadata", "input")


def earlier_steps(state: dict) -> list[str]:
    return [name for name in state if name not in GIVEN]


def noted(state: dict, step: str, declared: dict[str, Any], params: dict[str, Any]) -> dict:
    """The state with a step's note in it."""
    asked, got = declared.get("environment", "local"), current_name()
    known = {
        "executed": True, "params_used": params, "process_id": os.getpid(), "python_executable": sys.executable,
        "requested_environment": asked, "actual_environment": got, "environment_match": asked == got, "environment_name": got,
        "environment": got if "data_transfer" in declared else asked, "data_transfer": declared.get("data_transfer"),
        "previous_steps_found": earlier_steps(state), "received_previous_data": "step_write_data" in state,
    }
    say(state, f"{step}: in {got}, process {os.getpid()}, with {params}")
    return state | {step: {field: known[field] for field in NOTES[step]}}


# One of each kind, a mixed list among them.
RECORD = {
    "string": "hello_from_step_write_data", "integer": 42, "float": 3.14159, "boolean": True, "list": [1, 2, 3, "four", 5.0],
    "nested": {"key": "value", "numbers": [10, 20, 30]}, "none_value": None,
}
# Names of the checks and where each looks.
PLACES = {
    "string": ("string",), "integer": ("integer",), "float": ("float",), "boolean": ("boolean",), "list_mixed_types": ("list",),
    "nested_key": ("nested", "key"), "nested_numbers": ("nested", "numbers"), "none_value": ("none_value",),
}
SIGNED = {"has_written_by_env": ("written_by_env", str), "has_written_by_pid": ("written_by_pid", int)}
_ABSENT = object()


def _at(value: Any, place: tuple[str, ...]) -> Any:
    for key in place:
        value = value.get(key, _ABSENT) if isinstance(value, dict) else _ABSENT
    return value


def same(a: Any, b: Any) -> bool:
    """Equal, of the same type all through; floats within rounding."""
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return isclose(a, b, abs_tol=1e-5) if isinstance(a, float) else a == b


def verdicts(got: Any) -> dict[str, bool]:
    """Each check's outcome."""
    out = {name: same(_at(got, place), _at(RECORD, place)) for name, place in PLACES.items()}
    length = _at(got, ("list",))
    out["list_length"] = isinstance(length, list) and len(length) == len(RECORD["list"])
    return out | {name: isinstance(_at(got, (key,)), kind) for name, (key, kind) in SIGNED.items()}
