"""Registered queries, bound to the given tables, with their SQL twins."""

from importlib import import_module

MODULES = (
    "filters",
    "joins",
    "vectors",
    "aggregates",
    "windows",
    "meshes",
    "surfaces",
    "twoviews",
    "graphs",
    "tiles",
    "files",
    "expressions",
    "streams",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
