"""What a stored graph holds. python -m quillgraph.cli FOLDER"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.catalog import named
from .sources.sinks import read_graph

REPORT = (("Nodes by label", "graph_stats"), ("Relationships by type", "relationship_stats"), ("Topics", "all_topics"))


def report(spark: SparkSession, folder: str, rows: int = 100) -> str:
    """The counts by label and by type and the topics, as text of at most so many rows each."""
    graph, out = read_graph(spark, folder), []
    for title, name in REPORT:
        out += [title, *(f"  {r[0]}: {r[1]}" for r in named(graph, name).limit(rows).collect())]
    return "\n".join(out)


def main() -> None:
    print(report(SparkSession.builder.appName("quillgraph").getOrCreate(), sys.argv[1]))


if __name__ == "__main__":
    main()
