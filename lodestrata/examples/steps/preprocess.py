"""Pictures, smoothed, equalised and cut to whole numbers."""

METADATA = {"description": "Load and preprocess pictures", "version": "1.0", "environment": "local"}


def run(state, **params):
    from pyspark.sql import SparkSession

    from lodestrata.operators.image import clahe, quantise, smooth
    from lodestrata.sources.images import from_vectors, read_images

    spark, source = SparkSession.getActiveSession(), state["input"]["data_source"]
    if state["input"].get("format") == "images":
        images = read_images(spark, source).selectExpr(
            "xxhash64(path) AS image_id", "height", "width", "transform(pixels, v -> v / (shiftleft(1, depth) - 1)) AS pixels",
        )
    else:
        images = from_vectors(spark.read.parquet(f"{source}/embeddings.parquet"))
    sigma, clip = params.get("sigma", 1.0), params.get("clip_limit", 0.03)
    done = quantise(clahe(smooth(images, sigma), clip, tuple(params["tile"]) if params.get("tile") else None))
    state["preprocess"] = {"image": images, "image_preprocessed": done, "sigma": sigma, "clip_limit": clip, "data_source": source}
    return state
