"""The named queries, composed from what hangs on a paper.

`BRANCHES` says how each kind of thing is joined to papers. The queries are of four shapes: papers by a branch,
elements of papers, papers with all their branches collected, and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.graph import KEYS, Graph
from .pattern import Item, Node, Path, Query, count_by, run

PAPER = Node("paper", "Paper")


@dataclass(frozen=True)
class Branch:
    """label and type of edge of what hangs on a paper; value: the property that is collected; inward: the edge ends at the paper."""

    label: str
    kind: str
    value: str = "name"
    inward: bool = False

    def node(self, key: object = None) -> Node:
        return Node(self.label.lower(), self.label, () if key is None else ((KEYS[self.label], key),))

    def path(self, key: object = None) -> Path:
        return Path((self.node(key), PAPER), ((self.kind, True),)) if self.inward else Path((PAPER, self.node(key)), ((self.kind, True),))


BRANCHES = {
    "topics": Branch("Topic", "INCLUDES", inward=True),
    "authors": Branch("Author", "WROTE", inward=True),
    "methods": Branch("Method", "PROPOSES"),
    "datasets": Branch("Dataset", "USES_DATASET"),
    "equations": Branch("Equation", "HAS_EQUATION", "latex"),
    "tables": Branch("Table", "HAS_TABLE", "content"),
    "figure_captions": Branch("Figure", "HAS_FIGURE", "caption"),
    "concepts": Branch("Concept", "MENTIONS"),
}
NEWEST = (("paper.published", True),)


def columns(node: Node, *names: str, **renamed: str) -> tuple[Item, ...]:
    """Properties under their own names; renamed: alias to property."""
    return tuple(Item(alias, node.var, prop) for alias, prop in [*((n, n) for n in names), *renamed.items()])


def papers(by: str | None, key: object, *names: str, order=NEWEST, limit: int | None = None, **renamed: str) -> Query:
    """Papers that hang on one thing, or all of them."""
    return Query(BRANCHES[by].path(key) if by else Path((PAPER,)), items=columns(PAPER, "arxiv_id", "title", *names, **renamed), order=order, limit=limit)


def elements(branch: str, items: Iterable[Item], paper: object = None, topic: object = None, where=(), order=(), limit: int | None = None) -> Query:
    """Tables, equations or figures with their papers: of one paper, of a topic's, or of all. where, order: of the element unless a variable is named."""
    node, kind = BRANCHES[branch].node(), BRANCHES[branch].kind
    mine = lambda c: c if "." in c else f"{node.var}.{c}"
    start = PAPER if paper is None else Node(PAPER.var, PAPER.label, ((KEYS["Paper"], paper),))
    path = Path((start, node), ((kind, True),))
    if topic is not None:
        first = BRANCHES["topics"].path(topic)
        path = Path((*first.nodes, node), (*first.rels, (kind, True)))
    return Query(path, where=tuple((node.var, *w) for w in where), items=tuple(items), order=tuple((mine(c), down) for c, down in order), limit=limit)


def contexts(names: Iterable[str], caps: dict[str, int], fields: tuple[str, ...], paper: object = None, topic: object = None, limit: int | None = None) -> Query:
    """Papers with the distinct values of their branches; caps: how many of them at most."""
    match = BRANCHES["topics"].path(topic) if topic is not None else Path((PAPER if paper is None else Node(PAPER.var, PAPER.label, ((KEYS["Paper"], paper),)),))
    collected = tuple(Item(n, BRANCHES[n].node().var, BRANCHES[n].value, "collect_distinct", caps.get(n)) for n in names)
    return Query(match, tuple(BRANCHES[n].path() for n in names), items=columns(PAPER, *fields) + collected, order=() if paper is not None else NEWEST, limit=limit)


def _methods_by_topic(topic) -> Query:
    first, method = BRANCHES["topics"].path(topic), BRANCHES["methods"].node()
    items = (Item("method", method.var, "name"), Item("papers", PAPER.var, "arxiv_id", "collect_distinct"), Item("paper_count", PAPER.var, None, "count_distinct"))
    return Query(Path((*first.nodes, method), (*first.rels, ("PROPOSES", True))), items=items, distinct=True, order=(("paper_count", True),))


def _all_topics() -> Query:
    topic = BRANCHES["topics"]
    return Query(Path((topic.node(),)), (topic.path(),), items=(Item("topic", "topic", "name"), Item("paper_count", PAPER.var, None, "count")), order=(("paper_count", True),))


def _datasets_for_method(method) -> Query:
    ends = Node("method", "Method", (("name", method),)), BRANCHES["datasets"].node()
    return Query(Path(ends, (("EVALUATED_ON", True),)), items=columns(ends[1], dataset="name"))


_table, _equation, _figure = (BRANCHES[n].node() for n in ("tables", "equations", "figure_captions"))
_every = [n for n in BRANCHES if n != "topics"]
_by_page, _newest_page = (("page_number", False),), (*NEWEST, ("page_number", False))
_is_benchmark = (("is_benchmark", "=", True),)
_of_paper = columns(PAPER, paper="title", arxiv_id="arxiv_id")

#: Each query from its parameters. Names of results are those that callers of the reference know.
CATALOG: dict[str, Callable[..., Query]] = {
    "papers_by_topic": lambda topic: papers("topics", topic, "abstract", "published", authors="authors_str"),
    "topic_papers": lambda topic: papers("topics", topic, "abstract", "published", order=()),
    "papers_by_dataset": lambda dataset: papers("datasets", dataset, "published"),
    "papers_by_method": lambda method: papers("methods", method, "published", order=()),
    "papers_by_author": lambda author: papers("authors", author, "published"),
    "fallback_papers": lambda: papers(None, None, "published", order=(("arxiv_id", False),), limit=20),
    "paper_by_id": lambda arxiv_id: Query(Path((Node(PAPER.var, PAPER.label, (("arxiv_id", arxiv_id),)),)), items=(Item("paper", PAPER.var, None, "node"),)),
    "all_topics": _all_topics,
    "methods_by_topic": _methods_by_topic,
    "datasets_for_method": _datasets_for_method,
    "tables_by_paper": lambda arxiv_id: elements("tables", columns(_table, "element_id", "content", "headers", "is_benchmark", page="page_number", cols="col_count", rows="row_count"), paper=arxiv_id, order=_by_page),
    "equations_by_paper": lambda arxiv_id: elements("equations", columns(_equation, "element_id", "latex", "source", page="page_number"), paper=arxiv_id, order=_by_page),
    "figures_by_paper": lambda arxiv_id: elements("figure_captions", columns(_figure, "element_id", "fig_number", "caption", "image_path", page="page_number"), paper=arxiv_id, order=_by_page),
    "benchmark_tables_by_topic": lambda topic: elements("tables", columns(PAPER, paper_title="title", arxiv_id="arxiv_id") + columns(_table, "element_id", "headers", "content", page="page_number"), topic=topic, where=_is_benchmark, order=NEWEST),
    "benchmark_tables": lambda limit=None: elements("tables", columns(PAPER, "title", "arxiv_id") + columns(_table, "headers", "content", page="page_number"), where=_is_benchmark, order=() if limit is None else _newest_page, limit=limit),
    "rich_tables": lambda: elements("tables", _of_paper + columns(_table, "headers", "content", "is_benchmark", page="page_number", rows="row_count", cols="col_count"), order=(("is_benchmark", True), *NEWEST), limit=10),
    "rich_equations": lambda: elements("equations", _of_paper + columns(_equation, "latex", "source", page="page_number"), order=_newest_page, limit=15),
    "rich_figures": lambda: elements("figure_captions", _of_paper + columns(_figure, "fig_number", "caption", "image_path", page="page_number"), where=(("image_path", "not null", None), ("image_path", "<>", "")), order=_newest_page, limit=12),
    "context_for_paper": lambda arxiv_id: contexts(_every, {"tables": 3, "figure_captions": 5}, ("title", "abstract", "published"), paper=arxiv_id),
    "context_for_topic": lambda topic, limit: contexts(["methods", "datasets", "authors"], {}, ("arxiv_id", "title", "abstract"), topic=topic, limit=limit),
    "context_all_papers": lambda limit: contexts(_every, {"equations": 3, "tables": 2, "figure_captions": 4}, ("arxiv_id", "title", "abstract", "published"), limit=limit),
}
#: Counts of nodes by label or edges by type: what is counted, and the name of the first column.
COUNTS = {"graph_stats": ("label", "label"), "relationship_stats": ("type", "relationship"), "type_stats": ("type", "type")}


def named(graph: Graph, name: str, **params) -> DataFrame:
    """A query of the catalogue; order is only kept if nothing regroups its rows."""
    return count_by(graph, *COUNTS[name]) if name in COUNTS else run(graph, CATALOG[name](**params))
