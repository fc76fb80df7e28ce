"""Connected components whose rounds are tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.llm import scratch
from millrace.operators.components import connected


def components(links: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """(node, component) for each node of a link; the component is its smallest node."""
    return connected(links, one, other, store=lambda df: scratch.table(df, "links"), drop=scratch.drop)
