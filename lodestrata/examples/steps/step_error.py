"""Fails on purpose."""

METADATA = {"description": "Fails on purpose", "version": "1.0", "environment": "local"}


def run(state, **params):
    raise RuntimeError("Deliberate test error")
