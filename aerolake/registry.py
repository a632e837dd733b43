"""Named queries: name -> (spark, sf_dir) -> DataFrame, with SQL twins where they exist.

Extensions register with ``query``; ``run`` hands a plugin-like callable whatever
of the known inputs its signature names.
"""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "E6_inference"
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its DuckDB text if SQL can express it."""

    def registered(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLE[name] = oracle
        return f

    return registered


def _load() -> None:
    importlib.import_module("aerolake.plans.wifi")
    importlib.import_module("aerolake.plans.models")
    importlib.import_module("aerolake.plans.streams")


def queries() -> dict[str, Query]:
    """All registered queries."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB text of those that SQL can express."""
    _load()
    return dict(_ORACLE)


def discover(folder: str) -> dict[str, dict]:
    """M1: plugins in a folder: modules or packages with a ``run`` and, if they like, a ``metadata`` dict.

    By name: the callable, its metadata, and which of the modules that metadata lists
    under ``dependencies`` are missing (such a plugin is listed all the same).  What
    cannot be imported is listed with its error and no callable.
    """
    import importlib.util
    from pathlib import Path

    found: dict[str, dict] = {}
    for path in sorted(Path(folder).iterdir()):
        source = path / "plugin.py" if path.is_dir() else path
        if source.suffix != ".py" or not source.is_file() or source.stem == "__init__":
            continue
        name = path.stem
        spec = importlib.util.spec_from_file_location(f"aerolake_plugin_{name}", source)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
        except Exception as e:  # noqa: BLE001  a plugin may fail in any way
            found[name] = {"run": None, "metadata": {}, "missing": [], "error": repr(e)}
            continue
        if callable(getattr(module, "run", None)):
            about = dict(getattr(module, "metadata", {}))
            missing = [m for m in about.get("dependencies", []) if importlib.util.find_spec(m) is None]
            found[name] = {"run": module.run, "metadata": about, "missing": missing, "error": None}
    return found


def run(plugin: Callable, **inputs):
    """M1, M2: call a plugin with those inputs that its signature names; all of them if it takes any keyword."""
    wanted = inspect.signature(plugin).parameters
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in wanted.values()):
        return plugin(**inputs)
    missing = [n for n, p in wanted.items() if n not in inputs and p.default is inspect.Parameter.empty and p.kind is not inspect.Parameter.VAR_POSITIONAL]
    if missing:
        raise TypeError(f"{plugin.__name__} needs {', '.join(missing)}")
    return plugin(**{n: inputs[n] for n in wanted if n in inputs})
