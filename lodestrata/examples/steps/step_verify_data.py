"""Compares the carried record with the one that was written, and fails if anything was changed on the way."""

METADATA = {"description": "Checks carried values", "version": "1.0", "environment": "local"}


def run(state, **params):
    import os

    from lodestrata.examples.record import verdicts
    from lodestrata.plans.environments import current_name

    found = verdicts(state.get("step_write_data"))
    if changed := sorted(name for name, kept in found.items() if not kept):
        raise ValueError(f"changed on the way: {', '.join(changed)}")
    state["step_verify_data"] = {"all_passed": True, "checks": found, "verified_in_env": current_name(), "verified_by_pid": os.getpid()}
    return state
