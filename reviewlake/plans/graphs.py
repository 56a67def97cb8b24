"""The graph of a training split, built and saved as tables, and read again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, graph


class GraphTables(NamedTuple):
    """nodes, edges: as graph.nodes() and graph.edges(); item_aspects, aspect_items: as graph.padded_adjacency()."""

    nodes: DataFrame
    edges: DataFrame
    item_aspects: DataFrame
    aspect_items: DataFrame


def build_and_save(rows: DataFrame, sentiment: DataFrame, gammas: DataFrame, vocabulary: DataFrame, path: str, width: int = 32) -> GraphTables:
    """Writes the four tables under path, over older ones, and reads them. rows: training interactions; sentiment: item, aspect,
    score; gammas: user_id, aspect, gamma; vocabulary: aspect, id."""
    items = clean.id_maps(rows)
    made = GraphTables(graph.nodes(rows, vocabulary), graph.edges(rows, sentiment, gammas), *graph.aspect_adjacency(sentiment, items, vocabulary, width))
    for name, table in zip(GraphTables._fields, made):
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    return load(rows.sparkSession, path)


def load(spark: SparkSession, path: str) -> GraphTables:
    return GraphTables(*(spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in GraphTables._fields))
