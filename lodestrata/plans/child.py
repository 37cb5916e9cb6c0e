"""Entry point of a process that runs one step, or a whole pipeline, in another environment.

``python child.py REQUEST RESPONSE MODE``. Only the standard library and modules beside this one are needed, so the other
environment need not have Spark. The response is a file; what the step prints is its own affair.
"""

from __future__ import annotations

import importlib.util
import logging
import sys
import traceback
from pathlib import Path


def _load(name: str, path: Path):
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    return module


def main(request: str, response: str, mode: str) -> int:
    handoff = _load("lodestrata_handoff", Path(__file__).with_name("handoff.py"))
    asked = handoff.restore(Path(request), mode)
    sys.path.append(asked["package_root"])
    logging.basicConfig(level=logging.INFO, format="%(message)s", stream=sys.stdout)  # the parent passes it on
    try:
        if "pipeline" in asked:
            from lodestrata.plans.runner import run_pipeline

            result = run_pipeline(**asked["pipeline"], placed=True)
        else:
            step = _load("lodestrata_step", Path(asked["step"]))
            result = step.run(handoff.attach(asked["state"], handoff.TableRef), **asked["params"])
        answer = {"result": handoff.detach(result, asked["folder"])}
        handoff.dump(answer, Path(response), mode)
    except Exception as e:
        handoff.dump({"error": f"{type(e).__name__}: {e}", "trace": traceback.format_exc()}, Path(response), mode)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
