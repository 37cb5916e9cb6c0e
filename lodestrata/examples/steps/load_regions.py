"""Labelled measurements from a table of events: one region per user."""

METADATA = {"description": "Labelled measurements from events", "version": "1.0", "environment": "local"}


def run(state, **params):
    from pyspark.sql import SparkSession

    from lodestrata.operators.select import count_labels
    from lodestrata.sources.images import events_as_regions

    source = f"{state['input']['data_source']}/{params.get('table', 'events')}.parquet"
    pixels = events_as_regions(SparkSession.getActiveSession().read.parquet(source))
    state["segment"] = {"pixels": pixels, "keys": ["label"], "counted": count_labels(pixels.filter("label > 0"))}
    return state
