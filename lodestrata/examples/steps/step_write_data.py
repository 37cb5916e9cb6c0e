"""Leaves one value of each kind, signed with where it was written."""

METADATA = {"description": "Values to be carried over", "version": "1.0", "environment": "local"}


def run(state, **params):
    import os

    from lodestrata.examples.record import RECORD
    from lodestrata.plans.environments import current_name

    state["step_write_data"] = RECORD | {"written_by_env": current_name(), "written_by_pid": os.getpid()}
    return state
