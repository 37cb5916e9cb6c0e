"""Regions of the preprocessed pictures, by the plain substitute for a trained model."""

METADATA = {"description": "Segmentation by threshold and components", "version": "1.0", "environment": "local"}


def run(state, **params):
    from pyspark.sql import functions as F

    from lodestrata.operators.select import count_labels
    from lodestrata.operators.segment import segment, threshold_components

    pre = state["preprocess"]
    images = pre["image_preprocessed"].withColumn("pixels", F.transform("pixels", lambda v: v / F.lit(255.0)))
    labelled = segment(images, threshold_components(params.get("threshold", 0.5)))
    # features are measured on the pictures as they came
    raw = pre["image"].select("image_id", "width", F.posexplode("pixels").alias("i", "value")).select(
        "image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"),
        (F.col("i") % F.col("width")).cast("int").alias("x"), "value",
    )
    pixels = labelled.drop("value").join(raw, ["image_id", "y", "x"])
    state["segment"] = {
        "pixels": pixels, "keys": ["image_id", "label"], "counted": count_labels(labelled), "diameter": params.get("diameter"),
        "segmenter": "threshold_components",
    }
    return state
