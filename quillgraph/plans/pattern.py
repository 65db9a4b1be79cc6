"""Graph patterns lowered to DataFrame plans.

A query has one required path, optional paths that hang on its variables, and what to return. Two
rewrites are made here, since Catalyst can't: optional branches whose values are only collected or
counted distinctly are aggregated by their variable before they are joined, so that branches don't multiply each
other; and a sorted limit on the required path is taken before the branches are joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import EDGES, KEYS, Graph

#: A limit up to this size may be broadcast to the branches.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Node:
    var: str
    label: str | None = None
    props: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Path:
    """nodes[i] and nodes[i + 1] are joined by (type, forward) rels[i]."""

    nodes: tuple[Node, ...]
    rels: tuple[tuple[str | None, bool], ...] = ()


@dataclass(frozen=True)
class Item:
    """One returned value: var.prop, or an aggregate of it. fn: None, count, count_distinct, collect_distinct, label, type, node."""

    alias: str
    var: str | None
    prop: str | None = None
    fn: str | None = None
    most: int | None = None


@dataclass(frozen=True)
class Query:
    match: Path
    optional: tuple[Path, ...] = ()
    where: tuple[tuple[str, str, str, object], ...] = ()  # var, prop, operator, value
    items: tuple[Item, ...] = ()
    distinct: bool = False
    order: tuple[tuple[str, bool], ...] = ()  # alias or var.prop, descending
    limit: int | None = None
    params: dict = field(default_factory=dict, compare=False)


def _bound(graph: Graph, node: Node) -> DataFrame:
    """A label's table with columns named var.prop."""
    df = graph.node(node.label)
    out = df.select(*[F.col(c).alias(f"{node.var}.{c}") for c in df.columns])
    for prop, value in node.props:
        out = out.where(_c(node.var, prop) == value)
    return out


def _c(var: str, prop: str) -> Column:
    return F.col(f"`{var}.{prop}`")


def _path(graph: Graph, path: Path) -> DataFrame:
    """Inner joins along a path, from the end that has a property given."""
    nodes, rels = list(path.nodes), list(path.rels)
    if len(nodes) > 1 and nodes[-1].props and not nodes[0].props:
        nodes, rels = nodes[::-1], [(t, not f) for t, f in rels[::-1]]
    df = _bound(graph, nodes[0])
    for (kind, forward), a, b in zip(rels, nodes, nodes[1:], strict=False):
        near, far = ("src", "dst") if forward else ("dst", "src")
        edge = graph.edge(kind).select(F.col(near).alias("_near"), F.col(far).alias("_far"))
        df = df.join(edge, _c(a.var, KEYS[a.label]) == F.col("_near")).drop("_near")
        df = df.join(_bound(graph, b), F.col("_far") == _c(b.var, KEYS[b.label])).drop("_far")
    return df


def _where(df: DataFrame, conditions) -> DataFrame:
    ops = {"=": lambda c, v: c == v, "<>": lambda c, v: c != v, "not null": lambda c, v: c.isNotNull()}
    return reduce(lambda d, w: d.where(ops[w[2]](_c(w[0], w[1]), w[3])), conditions, df)


def _aggregate(item: Item, labels: dict[str, str]) -> Column:
    value = _c(item.var, item.prop or KEYS[labels[item.var]])
    if item.fn == "count":
        return F.count(value).alias(item.alias)
    if item.fn == "count_distinct":
        return F.count_distinct(value).alias(item.alias)
    got = F.array_sort(F.collect_set(value))
    return (F.slice(got, 1, item.most) if item.most else got).alias(item.alias)


def _sorted(df: DataFrame, order, limit, ties: list[str]) -> DataFrame:
    """Nulls count as greatest; what ties is ordered by the other columns given."""
    if order:
        keys = [F.desc_nulls_first(F.col(f"`{c}`")) if down else F.asc_nulls_last(F.col(f"`{c}`")) for c, down in order]
        df = df.orderBy(*keys, *[F.asc_nulls_last(F.col(f"`{c}`")) for c in ties])
    return df if limit is None else df.limit(limit)


def all_nodes(graph: Graph) -> DataFrame:
    parts = [graph.node(k).select(F.lit(k).alias("label"), F.col(KEYS[k]).cast("string").alias("id")) for k in graph.nodes]
    return reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], "label string, id string")


def count_by(graph: Graph, what: str, alias: str) -> DataFrame:
    """Nodes per label, or edges per type; each table is counted by itself, so no rows meet in a union."""
    tables = graph.nodes if what == "label" else graph.edges
    parts = [df.agg(F.count("*").alias("count")).select(F.lit(k).alias(alias), "count") for k, df in tables.items()]
    both = reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], f"{alias} string, count long")
    return both.where("count > 0").orderBy(F.desc("count"), alias)


def run(graph: Graph, q: Query) -> DataFrame:
    labels = {n.var: n.label for p in (q.match, *q.optional) for n in p.nodes if n.label}
    df = _where(_path(graph, q.match), q.where)
    required = {n.var for n in q.match.nodes}
    aggregates = [i for i in q.items if i.fn in ("count", "count_distinct", "collect_distinct")]
    plain = [i for i in q.items if i not in aggregates]
    if not aggregates:
        if q.optional:
            raise ValueError("optional paths are supported with aggregates only")
        return _rows(df, q, plain, labels)
    pre = all(i.fn != "count" or len(q.optional) <= 1 for i in aggregates)
    if not pre:
        raise ValueError("count() over several optional paths would count their product")
    grouped_by = {(i.var, i.prop) for i in plain}
    anchors = {_anchor(p, required) for p in q.optional}
    if anchors and len(anchors) == 1 and (a := next(iter(anchors))) is not None:
        return _branches(graph, df, q, plain, aggregates, a, grouped_by, labels)
    keys = [_c(i.var, i.prop).alias(i.alias) for i in plain]
    extra = [c for c, _ in q.order if "." in c and tuple(c.split(".")) not in grouped_by]
    out = df.groupBy(*keys, *[F.col(f"`{c}`") for c in extra]).agg(*[_aggregate(i, labels) for i in aggregates])
    return _sorted(out, _named(q, plain), q.limit, [i.alias for i in plain]).select(*[i.alias for i in q.items])


def _anchor(path: Path, required: set[str]) -> str | None:
    ends = [n.var for n in (path.nodes[0], path.nodes[-1]) if n.var in required]
    return ends[0] if len(ends) == 1 and len(path.nodes) == 2 else None


def _named(q: Query, plain: list[Item]) -> list[tuple[str, bool]]:
    """Sort keys as columns: an alias, or that of a returned property, or var.prop itself."""
    by = {f"{i.var}.{i.prop}": i.alias for i in plain}
    return [(by.get(c, c), down) for c, down in q.order]


def _rows(df: DataFrame, q: Query, items: list[Item], labels: dict[str, str]) -> DataFrame:
    columns = []
    for i in items:
        if i.fn == "node":
            mine = [c for c in df.columns if c.startswith(f"{i.var}.")]
            columns.append(F.struct(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in mine]).alias(i.alias))
        else:
            columns.append(_c(i.var, i.prop).alias(i.alias))
    hidden = [c for c, _ in q.order if "." in c and c not in {f"{i.var}.{i.prop}" for i in items}]
    ids = [f"{n.var}.{KEYS[n.label]}" for n in q.match.nodes]
    out = df.select(*columns, *[F.col(f"`{c}`") for c in dict.fromkeys([*hidden, *ids])])
    if q.distinct:
        return _sorted(out.select(*[i.alias for i in items]).distinct(), _named(q, items), q.limit, [i.alias for i in items])
    return _sorted(out, _named(q, items), q.limit, ids).select(*[i.alias for i in items])


def _branches(graph, df, q, plain, aggregates, anchor, grouped_by, labels) -> DataFrame:
    key = f"{anchor}.{KEYS[labels[anchor]]}"
    by_id = (anchor, KEYS[labels[anchor]]) in grouped_by
    order = [(c, d) for c, d in q.order]
    early = by_id and q.limit is not None and all("." in c and c.split(".")[0] == anchor for c, _ in order)
    needed = [f"{i.var}.{i.prop}" for i in plain] + [c for c, _ in order if "." in c]
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([key, *needed])]).distinct()
    if early:
        df = _sorted(df, order, q.limit, [key])
    few = early and q.limit <= BROADCAST_ROWS
    for p in q.optional:
        (kind, forward), (a, b) = p.rels[0], p.nodes
        other, near, far = (b, "src", "dst") if a.var == anchor else (a, "dst", "src")
        if not forward:
            near, far = far, near
        if other.var not in {i.var for i in aggregates}:
            continue
        edge = graph.edge(kind).select(F.col(near).alias("_near"), F.col(far).alias("_far"))
        if few:
            edge = edge.join(F.broadcast(df.select(F.col(f"`{key}`").alias("_near"))), "_near", "left_semi")  # at most BROADCAST_ROWS rows
        branch = edge.join(_bound(graph, other), F.col("_far") == _c(other.var, KEYS[other.label]))
        mine = [i for i in aggregates if i.var == other.var]
        df = df.join(branch.groupBy("_near").agg(*[_aggregate(i, labels) for i in mine]), F.col(f"`{key}`") == F.col("_near"), "left").drop("_near")
        for i in mine:
            df = df.withColumn(i.alias, F.coalesce(i.alias, F.array().cast(df.schema[i.alias].dataType) if i.fn == "collect_distinct" else F.lit(0)))
    own = [i for i in aggregates if i.var == anchor]
    if own:
        raise ValueError("aggregates of the variable that branches hang on aren't supported")
    out = df.select(F.col(f"`{key}`"), *[_c(i.var, i.prop).alias(i.alias) for i in plain], *[i.alias for i in aggregates], *[F.col(f"`{c}`") for c in dict.fromkeys(c for c, _ in order if "." in c) if c != key])
    if not by_id and len(plain) > 0 and any(i.fn == "collect_distinct" for i in aggregates):
        merged = [(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(i.alias)))), 1, i.most or 1 << 30) if i.fn == "collect_distinct" else F.sum(i.alias)).alias(i.alias) for i in aggregates]
        out = out.groupBy(*[i.alias for i in plain], *[F.col(f"`{c}`") for c, _ in order if "." in c and c not in {f"{i.var}.{i.prop}" for i in plain}]).agg(*merged)
        return _sorted(out, _named(q, plain), q.limit, [i.alias for i in plain]).select(*[i.alias for i in q.items])
    return _sorted(out, _named(q, plain), q.limit, [key]).select(*[i.alias for i in q.items])
