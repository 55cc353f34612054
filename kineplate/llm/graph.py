"""Connected components of a link table, kept in an operator's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import connected
from .workspace import SLIM, Workspace


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id reachable from every id that occurs in edges(a, b), in logarithmically many rounds."""
    return connected(edges.select("a", "b"), keep=lambda df: ws.table(df, f"{name}-labels", SLIM))
