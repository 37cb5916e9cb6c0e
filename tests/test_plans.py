import datetime

import pytest

from lodestrata.examples import PIPELINES, environments, stand_ins
from lodestrata.plans import environments as places
from lodestrata.plans import handoff
from lodestrata.plans.runner import load_step, main, run_pipeline, settings
from lodestrata.plans.spec import load, parse, run_metadata


def made(tmp_path, yaml, **steps):
    (tmp_path / "steps").mkdir(exist_ok=True)
    (tmp_path / "p").mkdir(exist_ok=True)
    for name, body in steps.items():
        (tmp_path / "steps" / f"{name}.py").write_text(body)
    (tmp_path / "p" / "x.yaml").write_text(yaml)
    return tmp_path / "p" / "x.yaml"


@pytest.mark.parametrize("text", ["", "metadata:\n  verbose: 1\n", "flow:\n", "flow: 3\n", "flow:\n  - only_a_name\n", "- a\n", "flow:\n  - s: 3\n"])
def test_what_is_no_pipeline_raises_value_error(tmp_path, text):
    with pytest.raises(ValueError):
        parse(text, tmp_path / "x.yaml")


def test_first_key_beside_metadata_is_the_workflow(tmp_path):
    spec = parse("metadata: {verbose: 1}\none:\n  - a: {p: null, d: 2026-01-27}\n  - b: null\ntwo:\n  - c: null\n", tmp_path / "x.yaml")
    assert (spec.workflow, spec.step_names) == ("one", ["a", "b"])
    assert spec.steps[0].params == {"p": None, "d": "2026-01-27"} and spec.steps[1].params == {}


def test_file_metadata_wins_over_the_engines(tmp_path):
    spec = parse("metadata: {label: mine, verbose: 2, purpose: x}\nw:\n  - a: null\n", tmp_path / "x.yaml")
    m = run_metadata(spec, "given", datetime.datetime(2026, 1, 2, 3, 4, 5))
    assert m["label"] == "mine" and m["datetime"] == "20260102-030405" and m["verbose"] == 2 and m["purpose"] == "x"
    assert "functions_dir" not in m


def test_missing_file():
    with pytest.raises(FileNotFoundError):
        load("/nowhere/x.yaml")


def test_settings_have_defaults():
    class Bare:
        pass

    class Null:
        METADATA = {"environment": None, "data_transfer": "other"}

    assert settings(Bare)["environment"] == "local" and settings(Null) == {"environment": "local", "mode": "file_paths", "materialize": False}


@pytest.mark.parametrize("asked,here,leaves", [(None, "base", False), ("local", "base", False), ("LOCAL", "base", False), ("Base", "base", False), ("other", "base", True)])
def test_placement(asked, here, leaves):
    assert places.needs_process(asked, here) is leaves


def test_a_step_that_returns_nothing_is_the_result(tmp_path):
    assert run_pipeline(made(tmp_path, "w:\n  - quiet: null\n", quiet="def run(state, **p):\n    pass\n")) is None


def test_own_error_keeps_its_type_and_names_the_step(tmp_path):
    with pytest.raises(KeyError) as e:
        run_pipeline(made(tmp_path, "w:\n  - bad: null\n", bad="def run(state, **p):\n    return state['absent']\n"))
    assert "step 1, bad" in e.value.__notes__[0]


def test_missing_step_fails_at_its_turn():
    done = []
    with pytest.raises(FileNotFoundError):
        run_pipeline(PIPELINES / "missing_step.yaml", on_step=lambda i, n, s: done.append(n))
    assert done == ["step_local"]


def test_error_elsewhere_is_step_failed(tmp_path):
    path = made(tmp_path, "w:\n  - far: null\n", far='METADATA = {"environment": "there"}\ndef run(state, **p):\n    print("noise <result>")\n    raise ValueError("no luck")\n')
    with pytest.raises(places.StepFailed, match="ValueError: no luck"):
        run_pipeline(path, environments=stand_ins("there"))


def test_unknown_environment_is_named(tmp_path):
    path = made(tmp_path, "w:\n  - far: null\n", far='METADATA = {"environment": "nowhere"}\ndef run(state, **p):\n    return state\n')
    with pytest.raises(LookupError, match="nowhere"):
        run_pipeline(path, environments=stand_ins("there"))


def test_time_limit(tmp_path, monkeypatch):
    import subprocess

    monkeypatch.setattr("lodestrata.plans.runner.STEP_SECONDS", 0.5)
    path = made(tmp_path, "w:\n  - far: null\n", far='METADATA = {"environment": "there"}\ndef run(state, **p):\n    import time\n    time.sleep(20)\n')
    with pytest.raises(subprocess.TimeoutExpired):
        run_pipeline(path, environments=stand_ins("there"))


def test_environments_really_change_and_come_back():
    state = run_pipeline(PIPELINES / "combined.yaml", environments=environments())
    assert state["step_env_b"]["environment_match"] is True
    assert state["step_local"]["process_id"] == state["step_local_2"]["process_id"] != state["step_env_b"]["process_id"]
    assert state["step_local_2"]["previous_steps_found"] == ["step_local", "step_env_b"]


def test_tables_cross_as_parquet_and_come_back_as_frames(spark, tmp_path):
    here = "def run(state, **p):\n    from pyspark.sql import SparkSession\n    state['t'] = SparkSession.getActiveSession().range(5)\n    return state\n"
    far = 'METADATA = {"environment": "there"}\ndef run(state, **p):\n    import pyarrow.compute as pc\n    t = state["t"].to_arrow()\n    state["sum"] = pc.sum(t["id"]).as_py()\n    state["back"] = t.slice(0, 2)\n    return state\n'
    state = run_pipeline(made(tmp_path, "w:\n  - a: null\n  - b: null\n", a=here, b=far), environments=stand_ins("there"), shared=str(tmp_path / "shared"))
    assert state["sum"] == 10 and state["t"].count() == 5 and state["back"].count() == 2


def test_plans_are_cut_only_where_asked(spark, tmp_path):
    one = "METADATA = {'materialize': %s}\ndef run(state, **p):\n    from pyspark.sql import SparkSession\n    state['t'] = SparkSession.getActiveSession().range(5).selectExpr('id + 1 AS x')\n    return state\n"
    for flag, kind in ((True, "LogicalRelation"), (False, "Range")):
        state = run_pipeline(made(tmp_path, "w:\n  - a: null\n", a=one % flag), shared=str(tmp_path / "shared"))
        assert kind in state["t"]._jdf.queryExecution().analyzed().getClass().getName() or kind in state["t"]._jdf.queryExecution().analyzed().treeString()


@pytest.mark.parametrize("mode,back", [("pickle", (1, 2)), ("file_paths", [1, 2])])
def test_values_in_both_modes(tmp_path, mode, back):
    handoff.dump({"a": (1, 2), "m": [1, "four", 5.0, None]}, tmp_path / "f", mode)
    got = handoff.restore(tmp_path / "f", mode)
    assert got["a"] == back and got["m"] == [1, "four", 5.0, None] and isinstance(got["m"][2], float)


def test_repeated_step_overwrites(tmp_path):
    body = "def run(state, **p):\n    state['s'] = p\n    return state\n"
    assert run_pipeline(made(tmp_path, "w:\n  - s: {n: 1}\n  - s: {n: 2}\n", s=body))["s"] == {"n": 2}


def test_command_line(capsys):
    assert main([str(PIPELINES / "local.yaml"), "--label", "cli", "--input", '{"k": 1}']) == 0
    assert '"label": "cli"' in capsys.readouterr().out


def test_load_step_needs_a_file(tmp_path):
    with pytest.raises(FileNotFoundError, match="absent.py"):
        load_step("absent", tmp_path)


def test_changed_records_are_found():
    from lodestrata.examples.record import RECORD, verdicts

    good = RECORD | {"written_by_env": "x", "written_by_pid": 1}
    assert all(verdicts(good).values()) and len(verdicts(good)) == 11
    for change, name in (({"list": [1, 2, 3, "four", 5]}, "list_mixed_types"), ({"integer": 42.0}, "integer"), ({"boolean": 1}, "boolean"), ({"nested": {}}, "nested_key"), ({"list": None}, "list_length"), ({"written_by_pid": "1"}, "has_written_by_pid")):
        assert not verdicts(good | change)[name]
    assert not any(verdicts(None).values())


def test_run_folder_of_a_run(tmp_path):
    import json

    run_pipeline(PIPELINES / "mixed.yaml", "a", output=tmp_path)
    folder = tmp_path / "a_mixed-test_output"
    told = json.loads((folder / "metadata.yaml").read_text())
    assert told["label"] == "a" and told["steps_executed"] == ["step_local", "step_local_2"] and told["total_runtime_seconds"] >= 0
    assert json.loads((folder / "02_step_local_2" / "step_metadata.yaml").read_text())["parameters_used"] == {"stage": "second"}


@pytest.mark.parametrize("verbose,engine,steps", [(0, False, False), (1, True, False), (2, False, True), (3, True, True)])
def test_who_speaks(tmp_path, caplog, verbose, engine, steps):
    """Steps in this process and in another one, and the engine, at each level."""
    body = "def run(state, **p):\n    from lodestrata.plans.voice import say\n    say(state, 'here I am')\n    return state\n"
    path = made(tmp_path, f"metadata: {{verbose: {verbose}}}\nw:\n  - near: null\n  - far: null\n", near=body, far='METADATA = {"environment": "there"}\n' + body)
    with caplog.at_level("INFO"):
        run_pipeline(path, environments=stand_ins("there"))
    said = [(r.name, r.getMessage()) for r in caplog.records]
    assert len([m for n, m in said if n == "lodestrata.engine"]) == 2 * engine
    assert [m for n, m in said if n == "lodestrata.steps"] == ["here I am"] * 2 * steps


def test_suite_and_its_exit_code():
    from lodestrata.examples import suite

    lines = []
    assert suite.main(lines.append, {"local": True, "error": False}) == 0 and lines[-1] == "2 of 2 as expected"
    assert suite.main(lines.append, {"error": True}) == 1 and "NOT AS EXPECTED: error failed, RuntimeError" in lines[-2]


def test_command_line_with_a_source(spark, capsys, tmp_path):
    assert main([str(PIPELINES / "rare_regions.yaml"), "--source", "/root/testdata/sf0.001", "--output", str(tmp_path)]) == 0
    out = capsys.readouterr().out
    assert out.startswith("label=") and "px" in out.splitlines()[0] and (tmp_path / "test_rare-region-selection_output").is_dir()


def test_upkeep_of_environments():
    from lodestrata.plans import upkeep

    info = {"envs": ["/c", "/c/envs/p--a", "/c/envs/p--old", "/c/envs/q"]}
    plan = upkeep.setup_plan(info, "p--", {"a": {"python": "3.11"}, "b": {"python": "3.12", "packages": ["numpy"]}})
    assert [(x.name, len(x.commands)) for x in plan] == [("p--a", 0), ("p--b", 2)]
    lines, calls = [], []
    assert upkeep.carry_out(plan, tell=lines.append, call=calls.append) == upkeep.Tally(skipped=("p--a", "p--b")) and len(lines) == 2 and not calls
    assert upkeep.carry_out(plan, False, lambda c: "create" in c, lines.append) == upkeep.Tally(skipped=("p--a",), failed=("p--b",))
    gone = upkeep.cleanup_plan(info, "p--")
    assert [x.name for x in gone] == ["p--a", "p--old"] and upkeep.carry_out(gone, False, lambda c: True, lines.append).all_well
    assert [x.name for x in upkeep.cleanup_plan(info, "p--", only="old")] == ["p--old"]
    for bad in (lambda: upkeep.cleanup_plan(info, "p--", only="b"), lambda: upkeep.setup_plan(info, "p--", {}, only="x")):
        with pytest.raises(LookupError):
            bad()
    with pytest.raises(ValueError):
        upkeep.cleanup_plan(info, "")
