"""Asks for another environment than the pipeline's and notes which one it got."""

METADATA = {"description": "Runs in another environment", "version": "1.0", "environment": "example--env_c"}


def run(state, **params):
    from lodestrata.examples.record import noted

    return noted(state, "step_env_b", METADATA, params)
