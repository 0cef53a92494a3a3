"""The queries over the driver's tables, by operator id."""

from __future__ import annotations


def registry() -> dict[str, tuple]:
    """name -> (function of a session and a folder, SQL or None)."""
    from . import files, kernels, paths, spatial

    return {**spatial.QUERIES, **paths.QUERIES, **kernels.QUERIES, **files.QUERIES}
