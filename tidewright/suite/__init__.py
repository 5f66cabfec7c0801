"""Registered queries: every operator run over the given tables, with an SQL statement of the same result."""

from importlib import import_module

from .registry import QUERIES, SQL

_MODULES: tuple[str, ...] = (
    "core", "values", "roles", "joins", "calendar", "quality", "signals", "advice",
    "forecast", "evaluation", "blending", "auditing", "runlog", "inout",
)


def load() -> tuple[dict, dict]:
    for m in _MODULES:
        try:
            import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
    return QUERIES, SQL
