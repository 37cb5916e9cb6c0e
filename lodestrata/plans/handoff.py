"""State that crosses into another Python environment: tables as Parquet, everything else as JSON or pickle.

A state is a tree of mappings, lists and values. Tables in it (Spark DataFrames, or Arrow tables made by a child) are
written to a folder and replaced by references, so that no table ever passes through a text stream. The rest goes
into one manifest file: JSON keeps plain values (tuples become lists, keys strings), pickle keeps any object.
"""

from __future__ import annotations

import json
import pickle
import uuid
from pathlib import Path
from typing import Any

MODES = ("file_paths", "pickle")
_MARK = "$table"


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path on it."""
    import re

    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))


class TableRef:
    """A table of the state as a step in another environment sees it: a Parquet path, read on demand."""

    def __init__(self, path: str):
        self.path = path

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TableRef) and other.path == self.path

    def __hash__(self) -> int:
        return hash(self.path)

    def to_arrow(self):
        import pyarrow.dataset as ds

        system, path = file_system(self.path)
        return ds.dataset(path, filesystem=system, format="parquet").to_table()


def _write(value: Any, folder: str) -> str | None:
    kind = f"{type(value).__module__}.{type(value).__qualname__}"
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}.parquet"
    if kind.startswith("pyspark.sql") and kind.endswith("DataFrame"):
        value.write.parquet(path)
        return path
    if kind == "pyarrow.lib.Table":
        import pyarrow.parquet as pq

        system, target = file_system(path)
        pq.write_table(value, target, filesystem=system)
        return path
    return value.path if isinstance(value, TableRef) else None


def detach(value: Any, folder: str) -> Any:
    """The value with its tables written and marked."""
    if (path := _write(value, folder)) is not None:
        return {_MARK: path}
    if isinstance(value, dict):
        return {k: detach(v, folder) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(detach(v, folder) for v in value)
    return value


def attach(value: Any, make) -> Any:
    """The value with each marked table replaced by make(path)."""
    if isinstance(value, dict):
        return make(value[_MARK]) if set(value) == {_MARK} else {k: attach(v, make) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(attach(v, make) for v in value)
    return value


def dump(value: Any, path: Path, mode: str) -> None:
    if mode == "pickle":
        path.write_bytes(pickle.dumps(value))
    else:
        path.write_text(json.dumps(value), encoding="utf-8")


def restore(path: Path, mode: str) -> Any:
    return pickle.loads(path.read_bytes()) if mode == "pickle" else json.loads(path.read_text(encoding="utf-8"))
