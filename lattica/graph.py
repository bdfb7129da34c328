"""A property graph as four DataFrames, with the scans that every operator starts from."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


@dataclass(frozen=True)
class Graph:
    """``kinds``, where the writer of the graph knows them: for every concept that has labels the types of the nodes that carry it."""

    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame
    kinds: dict[str, tuple[str, ...]] | None = None

    # ---- scans

    def nodes_of_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type)

    def nodes_for(self, *concepts: str) -> DataFrame:
        """The nodes on which labels of the concepts can stand; those of other types are left out where the types are known."""
        if self.kinds is None:
            return self.nodes
        return self.nodes.where(F.col("node_type").isin(*sorted({t for c in concepts for t in self.kinds.get(c, ())})))

    def nodes_with_concept(self, *concepts: str) -> DataFrame:
        """Distinct node ids that carry one of the concepts."""
        return self.labels.where(F.col("concept").isin(*concepts)).select("node_id").distinct()

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def out_edges(self, edge_type: str = "") -> DataFrame:
        return self.edges.where(F.col("edge_type") == edge_type) if edge_type else self.edges

    def expand(self, frontier: DataFrame, edge_type: str = "", reverse: bool = False) -> DataFrame:
        """frontier (node_id) joined to its edges; ``next`` is the other end. An empty type is any."""
        near, far = ("dst", "src") if reverse else ("src", "dst")
        edges = self.out_edges(edge_type)
        return frontier.select("node_id").join(edges, F.col("node_id") == edges[near]).select("node_id", F.col(far).alias("next"), "edge_type")

    def labels_of(self, ids: DataFrame) -> DataFrame:
        return self.labels.join(ids.select("node_id").distinct(), "node_id", "left_semi")

    # ---- writes: every change is a new graph

    def upsert_nodes(self, rows: DataFrame) -> Graph:
        """Rows replace nodes of the same id."""
        return replace(self, nodes=self.nodes.join(rows, "node_id", "left_anti").unionByName(rows), kinds=None)

    def append_edges(self, rows: DataFrame) -> Graph:
        return replace(self, edges=self.edges.unionByName(rows, allowMissingColumns=True))

    def append_labels(self, rows: DataFrame) -> Graph:
        return replace(self, labels=self.labels.unionByName(rows, allowMissingColumns=True), kinds=None)

    def add_flows_if_present(self, candidates: DataFrame) -> Graph:
        """FLOWS edges of candidates (src, dst) whose ends both exist."""
        return self.append_edges(flows_if_present(candidates, self.nodes))

    def subset(self, keep: Column, always: tuple[str, ...] = ("code.Import", "sbom.PackageVersion")) -> Graph:
        """The view of the nodes that fit a predicate; imports and packages are always visible."""
        nodes = self.nodes.where(F.coalesce(keep, F.lit(False)) | F.col("node_type").isin(*always))
        return replace(self, nodes=nodes, labels=self.labels.join(nodes.select("node_id"), "node_id", "left_semi"))

    # ---- storage

    def write(self, path: str) -> None:
        self.nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
        self.labels.write.mode("overwrite").partitionBy("concept").parquet(f"{path}/labels")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Graph:
        return Graph(*(spark.read.schema(s).parquet(f"{path}/{t}") for t, s in (("nodes", schema.NODES), ("edges", schema.EDGES), ("labels", schema.LABELS))))


@dataclass(frozen=True)
class Recording:
    """A graph and the labels that a phase writes to it: kept as they come, so that nothing is compared with the labels before."""

    graph: Graph
    written: DataFrame

    @staticmethod
    def of(graph: Graph) -> Recording:
        return Recording(graph, graph.labels.limit(0))

    def append_labels(self, rows: DataFrame) -> Recording:
        return Recording(self.graph.append_labels(rows), self.written.unionByName(rows, allowMissingColumns=True))


def flows_if_present(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node_id").distinct()
    found = candidates.select("src", "dst").join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return found.select(F.lit("FLOWS").alias("edge_type"), "src", "dst")


def new_labels(before: DataFrame, after: DataFrame) -> DataFrame:
    """The labels that a phase added, of graphs that nothing recorded (see Recording)."""
    return after.exceptAll(before)
