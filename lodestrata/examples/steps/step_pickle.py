"""Crosses into another environment by pickle."""

METADATA = {"description": "Pickle hand-off", "version": "1.0", "environment": "example--env_b", "data_transfer": "pickle"}


def run(state, **params):
    from lodestrata.examples.record import noted

    return noted(state, "step_pickle", METADATA, params)
