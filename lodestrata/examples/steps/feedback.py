"""The selected regions as a nested document, written where output_dir says, or left as a table."""

METADATA = {"description": "Feedback document", "version": "1.0", "environment": "local"}


def run(state, **params):
    from lodestrata.operators.feedback import cells, document
    from lodestrata.sources.feedback import write_file

    chosen, about = state["extract_features"], state["metadata"]
    records = cells(chosen["selected"])
    made = document(
        records, state["segment"]["counted"], about["label"], chosen["select_by"], chosen["percentile"], chosen["threshold"],
        about["datetime"],
    )
    where = params.get("output_dir", ".")
    state["feedback"] = {"cells": records, "document": made, "filepath": write_file(made, where, about["label"]) if where else None}
    return state
