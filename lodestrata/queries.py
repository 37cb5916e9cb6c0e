"""Registered queries of the analysis engine and the SQL each must agree with.

The driver's tables stand in for pictures: events are pixels of one region per user, and vectors of 64 components are
pictures of 8 by 8. Floating-point columns are rounded to six digits at the very end; selections use unrounded values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import environments as envs
from .functions import hardware
from .operators import feedback, image, regions, segment, select
from .shipping import ship
from .sources import feedback as sinks
from .sources import images
from .sources.tables import read_table, spread
from .storage import new_folder, written

SEGMENT_OVER, PERCENTILE = 0.58, 99
_OUT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _OUT[f.__name__] = (f, sql)
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.events_as_regions(read_table(spark, sf_dir, "events"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_properties(_pixels(spark, sf_dir))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.from_vectors(spread(read_table(spark, sf_dir, "embeddings")))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(_pictures(spark, sf_dir), segment.threshold_components(SEGMENT_OVER))


# --- regions, percentile, selection -------------------------------------------------------------------------------

_REGIONS = """
    pixels AS (SELECT user_id AS label, hour(ts) AS y, CAST(json_extract_string(props, '$.k') AS INTEGER) AS x, value FROM events),
    moments AS (
        SELECT label, count(*) AS area, avg(y) AS centroid_y, avg(x) AS centroid_x, avg(value) AS mean_intensity, max(value) AS max_intensity,
            var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM pixels WHERE label > 0 GROUP BY label),
    axes AS (SELECT *, (vy + vx + sqrt(4 * c * c + (vx - vy) * (vx - vy))) / 2 AS l1, greatest((vy + vx - sqrt(4 * c * c + (vx - vy) * (vx - vy))) / 2, 0) AS l2 FROM moments),
    features AS (
        SELECT label, area, centroid_y, centroid_x, CASE WHEN l1 > 0 THEN sqrt(greatest(1 - l2 / l1, 0)) ELSE 0 END AS eccentricity, mean_intensity, max_intensity,
            4 * sqrt(l1) AS major_axis_length, 4 * sqrt(l2) AS minor_axis_length FROM axes)"""
_SELECTED = _REGIONS + """,
    threshold AS (SELECT quantile_cont(area, 0.99) AS threshold FROM features),
    selected AS (SELECT features.*, threshold FROM features, threshold WHERE area >= threshold)"""
_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in (
    "centroid_y", "centroid_x", "eccentricity", "mean_intensity", "max_intensity", "major_axis_length", "minor_axis_length",
))


@_query(f"WITH {_REGIONS} SELECT label, area, {_R6} FROM features")
def region_properties(spark, sf_dir):
    return _rounded(_features(spark, sf_dir))


_HULLS = """
    spans AS (SELECT label, y, min(x) AS first, max(x) AS last, count(DISTINCT x) AS n FROM pixels WHERE label > 0 GROUP BY label, y),
    points AS (
        SELECT label, 2 * y + d AS h, CAST(last AS DOUBLE) + CASE WHEN d = 0 THEN 0.5 ELSE 0 END AS r,
            CAST(first AS DOUBLE) - CASE WHEN d = 0 THEN 0.5 ELSE 0 END AS l
        FROM spans, (VALUES (-1), (0), (1)) t(d)),
    lines AS (SELECT label, CAST(unnest(range(min(y), max(y) + 1)) AS INTEGER) AS y FROM spans GROUP BY label),
    reach AS (
        SELECT lines.label, lines.y,
            max(CASE WHEN a.h = b.h THEN greatest(a.r, b.r) ELSE a.r + (2 * lines.y - a.h) * (b.r - a.r) / (b.h - a.h) END) AS r,
            min(CASE WHEN a.h = b.h THEN least(a.l, b.l) ELSE a.l + (2 * lines.y - a.h) * (b.l - a.l) / (b.h - a.h) END) AS l
        FROM lines JOIN points a ON a.label = lines.label AND a.h <= 2 * lines.y JOIN points b ON b.label = lines.label AND b.h >= 2 * lines.y
        GROUP BY lines.label, lines.y),
    hulls AS (SELECT label, CAST(sum(floor(r + 1e-9) - ceil(l - 1e-9) + 1) AS BIGINT) AS convex_area FROM reach GROUP BY label),
    areas AS (SELECT label, CAST(sum(n) AS BIGINT) AS area FROM spans GROUP BY label)"""


@_query(f"WITH {_REGIONS}, {_HULLS} SELECT label, area, convex_area, round(area / CAST(convex_area AS DOUBLE), 6) AS solidity FROM areas JOIN hulls USING (label)")
def region_solidity(spark, sf_dir):
    return _rounded(regions.region_solidity(_pixels(spark, sf_dir)))


@_query(f"WITH {_SELECTED} SELECT round(threshold, 6) AS threshold FROM threshold")
def percentile_threshold(spark, sf_dir):
    return _rounded(select.percentile_threshold(_features(spark, sf_dir)))


@_query(f"WITH {_SELECTED} SELECT label, area, {_R6}, round(threshold, 6) AS threshold FROM selected")
def rare_event_select(spark, sf_dir):
    return _rounded(select.select_rare(_features(spark, sf_dir)))


_BY_FEATURE = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, label FROM features WHERE {f} >= (SELECT quantile_cont({f}, 0.95) FROM features)" for f in (
        "centroid_y", "centroid_x", "mean_intensity", "max_intensity", "major_axis_length",
    )
)


@_query(f"WITH {_REGIONS} {_BY_FEATURE}")
def rare_event_by_feature(spark, sf_dir):
    names = ("centroid_y", "centroid_x", "mean_intensity", "max_intensity", "major_axis_length")
    features, out = written(_features(spark, sf_dir).select("label", *names)), None  # read once per feature and pass
    for f, threshold in select.exact_percentiles(features, dict.fromkeys(names, 95.0)).items():
        one = select.at_or_above(features, f, threshold).select(F.lit(f).alias("feature"), "label")
        out = one if out is None else out.union(one)
    return out


@_query(f"WITH {_SELECTED} SELECT label FROM selected")
def selected_labels(spark, sf_dir):
    return select.select_rare(_features(spark, sf_dir).select("label", "area")).select("label").orderBy("label")


@_query(f"WITH {_REGIONS} SELECT coalesce(CAST(max(label) AS BIGINT), 0) AS n_cells FROM pixels WHERE label > 0")
def segment_count(spark, sf_dir):
    return select.count_labels(_pixels(spark, sf_dir).filter("label > 0"))


_CELLS = "CAST(label AS INTEGER) AS label, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, area, round(mean_intensity, 6) AS mean_intensity, round(eccentricity, 6) AS eccentricity"


@_query(f"WITH {_SELECTED} SELECT {_CELLS} FROM selected")
def feedback_cells(spark, sf_dir):
    return _rounded(feedback.cells(select.select_rare(_features(spark, sf_dir))))


@_query(f"WITH {_REGIONS} SELECT {_CELLS} FROM features WHERE label IN (SELECT c_custkey FROM customer)")
def feedback_lookup(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label"))
    return _rounded(feedback.cells(select.look_up(_features(spark, sf_dir), wanted)))


@_query(f"WITH {_SELECTED} SELECT (SELECT count(*) FROM selected) AS n_selected, (SELECT coalesce(max(label), 0) FROM pixels WHERE label > 0) AS n_total, 'area' AS feature, CAST(99 AS DOUBLE) AS percentile, (SELECT round(threshold, 6) FROM threshold) AS threshold")
def feedback_summary(spark, sf_dir):
    doc = _document(spark, sf_dir)
    return doc.select(
        "n_selected", "n_total", "selection_criteria.feature", "selection_criteria.percentile",
        F.round("selection_criteria.threshold", 6).alias("threshold"),
    )


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = written(_features(spark, sf_dir))
    threshold = select.exact_percentile(features, "area", PERCENTILE)
    records = feedback.cells(select.at_or_above(features, "area", threshold))
    return feedback.document(records, segment_count(spark, sf_dir), "run", "area", PERCENTILE, threshold, "20260101-000000")


@_query(f"WITH {_SELECTED} SELECT c.label, round(c.centroid_x, 6) AS centroid_x, c.area FROM selected c")
def feedback_doc(spark, sf_dir):
    each = _document(spark, sf_dir).select(F.explode("cells").alias("c"))
    return each.select(F.col("c.label").cast("long").alias("label"), F.round("c.centroid_x", 6).alias("centroid_x"), "c.area")


@_query()
def feedback_json(spark, sf_dir):
    return sinks.as_json(_document(spark, sf_dir))


@_query(f"WITH {_SELECTED} SELECT 'run' AS label, '20260101-000000' AS datetime, 'area' AS feature, (SELECT count(*) FROM selected) AS n_selected, (SELECT coalesce(max(label), 0) FROM pixels WHERE label > 0) AS n_total, CAST(label AS INTEGER) AS cell, area FROM selected")
def feedback_json_parsed(spark, sf_dir):
    """The document's text, read as JSON again: a row per record."""
    schema = "datetime string, label string, selection_criteria struct<feature:string>, n_selected long, n_total long, cells array<struct<label:int,area:long>>"
    read = sinks.as_json(_document(spark, sf_dir)).select(F.from_json("document", schema).alias("d")).select(
        "d.*", F.explode("d.cells").alias("c"),
    )
    return read.select(
        "label", "datetime", "selection_criteria.feature", "n_selected", "n_total", F.col("c.label").alias("cell"),
        F.col("c.area").alias("area"),
    )


@_query(f"WITH {_SELECTED} SELECT CAST(label AS INTEGER) AS label, printf('label=%3d  pos=(%.1f, %.1f)  area=%dpx', label, centroid_x, centroid_y, area) AS line FROM selected")
def cell_report(spark, sf_dir):
    return feedback.report(feedback.cells(select.select_rare(_features(spark, sf_dir))))


# --- pictures ------------------------------------------------------------------------------------------------------

_GRID = "grid AS (SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, (CAST(embedding[i + 1] AS DOUBLE) + 0.6) / (0.6 + 0.6) AS value FROM embeddings, range(64) r(i) WHERE len(embedding) = 64)"
_SMOOTH = f"""
    {_GRID},
    weights AS (SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS w FROM range(-4, 5) r(d)),
    down AS (SELECT g.image_id, g.y, g.x, sum(w * o.value) AS value FROM grid g JOIN weights ON true JOIN grid o ON o.image_id = g.image_id AND o.x = g.x AND o.y = least(greatest(g.y + d, 0), 7) GROUP BY ALL),
    smoothed AS (SELECT g.image_id, g.y, g.x, sum(w * o.value) AS value FROM down g JOIN weights ON true JOIN down o ON o.image_id = g.image_id AND o.y = g.y AND o.x = least(greatest(g.x + d, 0), 7) GROUP BY ALL)"""


@_query(f"WITH {_GRID} SELECT image_id, y, x, round(value, 6) AS value FROM grid")
def image_grid(spark, sf_dir):
    return _rounded(image.to_pixels(_pictures(spark, sf_dir)))


@_query(f"WITH {_SMOOTH} SELECT image_id, y, x, round(value, 6) AS value FROM smoothed")
def gaussian_smooth(spark, sf_dir):
    return _rounded(image.to_pixels(image.smooth(_pictures(spark, sf_dir))))


@_query(f"WITH {_SMOOTH} SELECT image_id, y, x, CAST(floor(value * 255) AS INTEGER) AS value FROM smoothed")
def quantize(spark, sf_dir):
    return image.to_pixels(image.quantise(image.smooth(_pictures(spark, sf_dir))))


@_query()
def clahe(spark, sf_dir):
    return _rounded(image.to_pixels(image.clahe(image.smooth(_pictures(spark, sf_dir)), tile=(4, 4))))


@_query(f"WITH {_GRID} SELECT image_id, y, x, 16 AS depth, CAST(floor(value * 65535) AS DOUBLE) AS value FROM grid")
def image_scan(spark, sf_dir):
    deep = _pictures(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: F.floor(v * 65535).cast("int")))
    back = images.decode_images(images.encode_tiff(deep)).withColumn("image_id", F.split("path", r"\.")[0].cast("long"))
    return image.to_pixels(back, ("depth",))


@_query(f"WITH {_GRID} SELECT image_id, y, x, 8 AS depth, CAST(floor(value * 255) AS DOUBLE) AS value FROM grid")
def image_files(spark, sf_dir):
    """Pictures of 8 bits, written as files and read from their folder."""
    flat = _pictures(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: F.floor(v * 255).cast("int")))
    folder = new_folder(spark)
    images.write_files(images.encode_tiff(flat, 8), folder)
    back = images.read_images(spark, folder, "*.tif").withColumn("image_id", F.regexp_extract("path", r"(-?[0-9]+)\.tif$", 1).cast("long"))
    return image.to_pixels(back, ("depth",))


_COMPONENTS = f"""
    {_GRID},
    ink AS (SELECT image_id, y * 8 + x AS p, y, x, value FROM grid WHERE value > {SEGMENT_OVER}),
    reach(image_id, p, q) AS (
        SELECT image_id, p, p FROM ink
        UNION
        SELECT r.image_id, r.p, i.p FROM reach r JOIN ink a ON a.image_id = r.image_id AND a.p = r.q JOIN ink i ON i.image_id = r.image_id AND abs(i.y - a.y) + abs(i.x - a.x) = 1),
    roots AS (SELECT image_id, p, min(q) AS root FROM reach GROUP BY ALL),
    labelled AS (SELECT i.image_id, i.y, i.x, CAST(dense_rank() OVER (PARTITION BY i.image_id ORDER BY root) AS INTEGER) AS label, i.value FROM ink i JOIN roots USING (image_id, p))"""


@_query(f"WITH RECURSIVE {_COMPONENTS} SELECT image_id, y, x, label FROM labelled")
def segment_components(spark, sf_dir):
    return _segmented(spark, sf_dir).select("image_id", "y", "x", "label")


@_query(f"""WITH RECURSIVE {_COMPONENTS},
    cells AS (SELECT image_id, label, count(*) AS area, avg(y) AS centroid_y, avg(x) AS centroid_x, avg(value) AS mean_intensity FROM labelled GROUP BY image_id, label)
    SELECT image_id, label, area, round(centroid_y, 6) AS centroid_y, round(centroid_x, 6) AS centroid_x, round(mean_intensity, 6) AS mean_intensity FROM cells WHERE area >= (SELECT quantile_cont(area, 0.99) FROM cells)""")
def rare_cells(spark, sf_dir):
    features = regions.region_properties(
        _segmented(spark, sf_dir), ("image_id", "label"), ("area", "centroid_y", "centroid_x", "mean_intensity"),
    )
    return _rounded(select.select_rare(features).drop("threshold"))


# --- orchestration -------------------------------------------------------------------------------------------------


def _run(spark: SparkSession, name: str, **more):
    from .examples import PIPELINES, environments
    from .plans.runner import run_pipeline

    ship(spark)
    return run_pipeline(PIPELINES / f"{name}.yaml", f"test_{name}", {}, environments=environments(), **more)


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@_query("SELECT 'test_mixed' AS label, 'mixed-test' AS workflow_name, 'mixed.yaml' AS yaml_filename, 'step_local,step_local_2' AS steps, 3 AS verbose, '1.0' AS version, 'mixed test' AS purpose, true AS dated")
def run_metadata(spark, sf_dir):
    m = _run(spark, "mixed")["metadata"]
    import re

    names = ("label", "workflow_name", "yaml_filename", "steps", "verbose", "version", "purpose")
    told = m | {"steps": ",".join(m["steps"])}
    schema = ", ".join(f"{n} {'int' if n == 'verbose' else 'string'}" for n in names) + ", dated boolean"
    return _rows(spark, schema, [(*[told[n] for n in names], bool(re.fullmatch(r"\d{8}-\d{6}", m["datetime"])))])


@_query("SELECT 'step_local' AS step, true AS executed, 'hello' AS test_param, 42 AS number")
def pipeline_local(spark, sf_dir):
    got = _run(spark, "local")["step_local"]
    row = ("step_local", got["executed"], got["params_used"]["test_param"], got["params_used"]["number"])
    return _rows(spark, "step string, executed boolean, test_param string, number int", [row])


@_query("SELECT * FROM (VALUES ('step_local', 'first', ''), ('step_local_2', 'second', 'step_local')) t(step, stage, before)")
def pipeline_mixed(spark, sf_dir):
    s = _run(spark, "mixed")
    return _rows(
        spark, "step string, stage string, before string",
        [(n, s[n]["params_used"]["stage"], ",".join(s[n].get("previous_steps_found", []))) for n in ("step_local", "step_local_2")],
    )


@_query("SELECT * FROM (VALUES ('metadata', false), ('input', false), ('step_local', true), ('step_env_b', true), ('step_local_2', true)) t(step, counted)")
def previous_steps(spark, sf_dir):
    """The keys of a finished run's state, and which of them are steps."""
    from .examples.record import earlier_steps

    state = _run(spark, "combined")
    found = earlier_steps(state)
    return _rows(spark, "step string, counted boolean", [(name, name in found) for name in state])


@_query("SELECT * FROM (VALUES ('step_env', true, 'example--env_b', true), ('step_local_2', true, '', true)) t(step, executed, requested, matched)")
def pipeline_step_env(spark, sf_dir):
    s = _run(spark, "step_env")
    here, there, last = s["step_local"], s["step_env"], s["step_local_2"]
    elsewhere = there["environment_match"] and there["process_id"] != here["process_id"]
    back = last["environment_name"] == here["environment_name"] and last["process_id"] == here["process_id"]
    rows = [("step_env", there["executed"], there["requested_environment"], elsewhere), ("step_local_2", last["executed"], "", back)]
    return _rows(spark, "step string, executed boolean, requested string, matched boolean", rows)


@_query("SELECT * FROM (VALUES ('step_local', 'example--env_b'), ('step_local_2', 'example--env_b')) t(step, environment)")
def pipeline_env(spark, sf_dir):
    s = _run(spark, "pipeline_env")
    return _rows(spark, "step string, environment string", [(n, s[n]["environment_name"]) for n in ("step_local", "step_local_2")])


@_query("SELECT * FROM (VALUES ('step_local', 'example--env_a'), ('step_env_b', 'example--env_c'), ('step_local_2', 'example--env_a')) t(step, environment)")
def pipeline_combined(spark, sf_dir):
    s = _run(spark, "combined")
    where = {"step_local": "environment_name", "step_env_b": "actual_environment", "step_local_2": "environment_name"}
    return _rows(spark, "step string, environment string", [(n, s[n][field]) for n, field in where.items()])


_CHECKS = (
    "string", "integer", "float", "boolean", "list_length", "list_mixed_types", "nested_key", "nested_numbers", "none_value",
    "has_written_by_env", "has_written_by_pid",
)
_SURVIVED = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', true)" for c in _CHECKS) + ") t(name, passed)"


@_query(_SURVIVED)
def data_survival(spark, sf_dir):
    return _rows(spark, "name string, passed boolean", list(_run(spark, "data_survival")["step_verify_data"]["checks"].items()))


@_query(_SURVIVED)
def pickle_survival(spark, sf_dir):
    return _rows(spark, "name string, passed boolean", list(_run(spark, "pickle")["step_verify_data"]["checks"].items()))


def _failure(spark: SparkSession, name: str) -> DataFrame:
    done: list[str] = []
    try:
        _run(spark, name, on_step=lambda i, step, state: done.append(step))
        error, noted = "", ""
    except Exception as e:
        error, noted = type(e).__name__, " ".join(e.__notes__).split(",")[1].strip()
    return _rows(spark, "error string, step string, done string", [(error, noted, ",".join(done))])


@_query("SELECT 'RuntimeError' AS error, 'step_error' AS step, 'step_local' AS done")
def pipeline_error(spark, sf_dir):
    return _failure(spark, "error")


@_query("SELECT 'FileNotFoundError' AS error, 'step_does_not_exist' AS step, 'step_local' AS done")
def pipeline_missing_step(spark, sf_dir):
    return _failure(spark, "missing_step")


@_query("SELECT * FROM (VALUES (0, false, false), (1, true, false), (2, false, true), (3, true, true)) t(level, engine, steps)")
def verbosity_matrix(spark, sf_dir):
    from .plans.voice import engine_speaks, steps_speak

    return _rows(spark, "level int, engine boolean, steps boolean", [(v, engine_speaks(v), steps_speak(v)) for v in range(4)])


@_query("SELECT * FROM (VALUES ('local', 'base', false), ('LOCAL', 'base', false), ('Base', 'base', false), ('other', 'base', true), (NULL, 'base', false)) t(requested, current, process)")
def env_placement(spark, sf_dir):
    asked = _rows(
        spark, "requested string, current string",
        [("local", "base"), ("LOCAL", "base"), ("Base", "base"), ("other", "base"), (None, "base")],
    )
    return asked.withColumn("process", envs.needs_process(F.col("requested"), F.col("current")))


_ENVS = ["/opt/conda", "/opt/conda/envs/flow--one", "/opt/conda/envs/flow--two", "/opt/conda/envs/other"]


@_query("SELECT * FROM (VALUES ('flow--one', true), ('flow', false), ('other', true)) t(name, found)")
def env_exists(spark, sf_dir):
    return _rows(
        spark, "name string, envs array<string>", [(n, _ENVS) for n in ("flow--one", "flow", "other")],
    ).select("name", envs.env_exists(F.col("envs"), F.col("name")).alias("found"))


@_query("SELECT * FROM (VALUES ('flow--', 'flow--one,flow--two'), ('x', '')) t(prefix, names)")
def env_prefix(spark, sf_dir):
    asked = _rows(spark, "prefix string, envs array<string>", [(p, _ENVS) for p in ("flow--", "x")])
    return asked.select("prefix", F.array_join(envs.envs_with_prefix(F.col("envs"), F.col("prefix")), ",").alias("names"))


@_query("""SELECT report, tag, label, args FROM (VALUES
    ('| CUDA Version: 12.8 |', 'cu128', 'NVIDIA CUDA 12.8', 'torch torchvision --index-url https://download.pytorch.org/whl/cu128'),
    ('CUDA Version: 12.5', 'cu124', 'NVIDIA CUDA 12.4', 'torch torchvision --index-url https://download.pytorch.org/whl/cu124'),
    ('CUDA Version: 13.0', 'cu128', 'NVIDIA CUDA 12.8', 'torch torchvision --index-url https://download.pytorch.org/whl/cu128'),
    ('CUDA Version: 11.8', 'cu118', 'NVIDIA CUDA 11.8', 'torch torchvision --index-url https://download.pytorch.org/whl/cu118'),
    ('CUDA Version: 10.2', 'cu124', 'NVIDIA CUDA 12.4', 'torch torchvision --index-url https://download.pytorch.org/whl/cu124'),
    ('none', 'cu124', 'NVIDIA CUDA 12.4', 'torch torchvision --index-url https://download.pytorch.org/whl/cu124')) t(report, tag, label, args)""")
def gpu_tag(spark, sf_dir):
    reports = _rows(
        spark, "report string",
        [
            ("| CUDA Version: 12.8 |",), ("CUDA Version: 12.5",), ("CUDA Version: 13.0",), ("CUDA Version: 11.8",),
            ("CUDA Version: 10.2",), ("none",),
        ],
    )
    tagged = reports.withColumn("tag", hardware.gpu_tag(*hardware.cuda_version(F.col("report"))))
    return tagged.select(
        "report", "tag", hardware.gpu_label(F.col("tag")).alias("label"),
        F.array_join(hardware.torch_install_args(F.col("tag")), " ").alias("args"),
    )


@_query("SELECT 9 AS total, 9 AS as_expected, true AS all_ok")
def suite_summary(spark, sf_dir):
    from .examples import suite

    ship(spark)
    rows = [(name, good, passed) for name, good, passed, _ in suite.outcomes()]
    told = _rows(spark, "name string, expected boolean, passed boolean", rows)
    return told.agg(
        F.count("*").cast("int").alias("total"),
        F.count_if(F.col("expected") == F.col("passed")).cast("int").alias("as_expected"),
        F.every(F.col("expected") == F.col("passed")).alias("all_ok"),
    )


@_query(f"WITH {_SELECTED} SELECT CAST(label AS INTEGER) AS label, area, round(mean_intensity, 6) AS mean_intensity FROM selected")
def pipeline_rare_regions(spark, sf_dir):
    """The flagship workflow, driven by its pipeline file."""
    from .examples import PIPELINES
    from .plans.runner import run_pipeline

    ship(spark)
    state = run_pipeline(PIPELINES / "rare_regions.yaml", "rare", {"data_source": sf_dir})
    return _rounded(state["feedback"]["cells"].select("label", "area", "mean_intensity"))


@_query()
def pipeline_rare_cells(spark, sf_dir):
    from .examples import PIPELINES
    from .plans.runner import run_pipeline

    ship(spark)
    state = run_pipeline(PIPELINES / "rare_cells.yaml", "rare", {"data_source": sf_dir})
    return _rounded(state["feedback"]["cells"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _OUT.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _OUT.items() if sql}
