"""Features per region, and the regions at or above a percentile of one of them."""

METADATA = {"description": "Measure regions and select rare ones", "version": "1.0", "environment": "local"}


def run(state, **params):
    from lodestrata.operators.regions import region_properties
    from lodestrata.operators.select import at_or_above, exact_percentile
    from lodestrata.storage import written

    feature, percentile = params.get("select_by", "area"), params.get("percentile", 99)
    found = state["segment"]
    features = written(region_properties(found["pixels"], tuple(found["keys"])))  # the percentile and the selection read it several times
    threshold = exact_percentile(features, feature, percentile)
    state["extract_features"] = {
        "properties": features, "select_by": feature, "percentile": percentile, "threshold": threshold,
        "selected": at_or_above(features, feature, threshold),
    }
    return state
