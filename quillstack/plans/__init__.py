"""Registered queries."""


def load() -> None:
    """Register all queries."""
    from . import index, judging, mining, modes, pages, retrieval, statistics, stores, sweeps, tables  # noqa: F401
