"""A typed property graph as DataFrames, and path patterns that become chains of joins.

A pattern starts at a node label and hops along typed relationships. Every alias adds its node's columns as
``alias__column`` (relationship properties as ``alias__rel__column``), one row for each path, duplicates kept. An
optional hop is a left join whose predicate narrows the optional side only.

Inside one match a relationship is used once: where a type occurs a second time, paths that use one of its relationships
again are left out. Relationships are told apart by their columns (ends and properties), so parallel ones need a property in
which they differ. An optional hop is a match of its own, and `again` begins another one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Nodes:
    table: DataFrame
    key: str


@dataclass(frozen=True)
class Edges:
    source: str
    target: str
    table: DataFrame  # columns src, dst and any properties
    repeated: DataFrame | None = None  # the same, some more than once, where the table had to be made distinct

    @property
    def rows(self) -> DataFrame:
        """For what only asks whether there is a relationship."""
        return self.table if self.repeated is None else self.repeated


@dataclass(frozen=True)
class Graph:
    nodes: dict[str, Nodes] = field(default_factory=dict)
    edges: dict[str, Edges] = field(default_factory=dict)

    def match(self, alias: str, label: str, where: str | Column | None = None) -> Path:
        return Path(self, _aliased(self.nodes[label].table, alias, where), {alias: label})


def _aliased(table: DataFrame, alias: str, where: str | Column | None) -> DataFrame:
    kept = table.where(where) if where is not None else table
    return kept.select(*[F.col(c).alias(f"{alias}__{c}") for c in kept.columns])


@dataclass(frozen=True)
class Path:
    graph: Graph
    df: DataFrame
    labels: dict[str, str]
    #: Of the match so far: (type, columns that name its relationship).
    used: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def again(self) -> Path:
        """The same rows, at the begin of another match: relationships may be used once more."""
        return Path(self.graph, self.df, self.labels)

    def hop(self, start: str, rel: str, alias: str, back: bool = False, optional: bool = False, where: str | Column | None = None, rel_where: str | None = None) -> Path:
        """From alias `start` along `rel` (against its direction if back) to a node named `alias`.

        If the alias is bound already, the hop closes: only rows stay in which the relationship leads to that very node,
        and its properties are ``start__to__alias__rel__column``. A node that is bound takes no further predicate.
        """
        edge = self.graph.edges[rel]
        here, there = (edge.target, edge.source) if back else (edge.source, edge.target)
        if self.labels[start] != here:
            raise ValueError(f"{rel} does not leave {self.labels[start]}")
        closing = alias in self.labels
        if closing and (self.labels[alias] != there or where is not None):
            raise ValueError(f"{alias} is bound to {self.labels[alias]}, which {rel} does not lead to" if where is None else f"{alias} is bound already")
        prefix = f"{start}__to__{alias}__rel" if closing else f"{alias}__rel"
        links = edge.table.where(rel_where) if rel_where else edge.table
        near, far = ("dst", "src") if back else ("src", "dst")
        columns = tuple(f"{prefix}__{c}" for c in links.columns)
        links = links.toDF(*columns)
        node, own = self.graph.nodes[there], F.col(f"{start}__{self.graph.nodes[here].key}")
        on = own == F.col(f"{prefix}__{near}")
        if closing:
            side, on = links, on & (F.col(f"{alias}__{node.key}") == F.col(f"{prefix}__{far}"))
        else:
            side = links.join(_aliased(node.table, alias, where), F.col(f"{prefix}__{far}") == F.col(f"{alias}__{node.key}"))
        joined = self.df.join(side, on, "left" if optional else "inner")
        used = () if optional else self.used
        for kind, before in used:
            if kind == rel:
                same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(before, columns, strict=True)]
                joined = joined.where(~reduce(Column.__and__, same))
        return Path(self.graph, joined, self.labels | {alias: there}, self.used if optional else (*self.used, (rel, columns)))

    def where(self, condition: str | Column) -> Path:
        return Path(self.graph, self.df.where(condition), self.labels, self.used)

    def select(self, **columns: str | Column) -> DataFrame:
        return self.df.select(*[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


def last(df: DataFrame, *order: Column) -> list[Column]:
    """An order that every column of df takes part in, so that equal leading keys still have one order."""
    return [*order, *[F.col(c).asc_nulls_last() for c in df.columns]]


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*last(df, *order)).limit(n)
