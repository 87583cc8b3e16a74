"""Registered queries, each next to the SQL that states the same result."""

from cellview.catalog.base import REGISTRY


def registry():
    from cellview.catalog import answers, blocks, networks, preparation, releases, workloads  # noqa: F401

    return REGISTRY
