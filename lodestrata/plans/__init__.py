"""Pipelines as plans: configuration, run state, environments and the runner."""
