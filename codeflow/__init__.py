"""codeflow: a call-graph analytics engine on Spark DataFrames.

The public names below are loaded when they are first used, so that Python workers import only what they run."""

from importlib import import_module

_PUBLIC = {
    "sources.files": ("from_memory", "from_path", "matching", "markers", "report", "as_json"),
    "sources.snapshots": ("SnapshotStore",),
    "plans.discovery": ("Discovery", "Request", "discover"),
    "plans.framework": ("FrameworkIndex", "build_index", "node_filters", "update_index"),
    "plans.workspace": ("Analysis", "analyze", "endpoint_graph", "previous_analysis", "previous_facts", "publish"),
    "plans.session": ("REGISTRY", "Session", "Technology", "register"),
    "operators.graph": ("aggregate_edges", "focus", "induced", "reachable"),
    "operators.validate": ("raise_if_invalid", "validate_graph"),
    "operators.messages": ("fault", "message_fault", "parse"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *__all__])
