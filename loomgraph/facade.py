"""One object over the four tables: ingest, search, traverse."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import chunks as C
from loomgraph.operators import documents as D
from loomgraph.operators import edges as E
from loomgraph.operators import entities as N
from loomgraph.operators import retrieve as R
from loomgraph.operators import traverse as V
from loomgraph.operators.vector import ClusterIndex, IndexChoice
from loomgraph.plans.ingest import Pipeline, process
from loomgraph.runtime import cut
from loomgraph.schema import TABLES, QueryConfig
from loomgraph.sources.store import Versions


class GraphStore:
    """Documents, chunks, edges and entities. Changes make new tables; ``save`` publishes them.

    Rows added by ``process_and_insert`` and the ``insert_…`` methods are appended when saved; only a table that was
    changed otherwise, or set by the caller, is written whole.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.versions = Versions(spark, root) if root else None
        self.manifest: dict = {"version": 0, "tables": {}, "batches": {}}
        self.tables: dict[str, DataFrame] = {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
        self._reload()
        self.tables.update(tables or {})
        self.pipeline: Pipeline | None = None
        self.index = IndexChoice()
        self._clusters: ClusterIndex | None = None

    def _reload(self) -> None:
        if self.versions:
            self.manifest = self.versions.manifest()
            self.tables = self.versions.load(self.manifest)
        # the rows added to each table since, and the table that they make: one that is another was changed as a whole
        self._added: dict[str, DataFrame] = {}
        self._known = dict(self.tables)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows = rows.select(self.tables[name].columns)
        clean = self.tables[name] is self._known.get(name)
        self.tables[name] = self.tables[name].unionByName(rows)
        if clean:
            self._added[name] = self._added[name].unionByName(rows) if name in self._added else rows
            self._known[name] = self.tables[name]

    def set_pipeline(self, pipeline: Pipeline) -> None:
        self.pipeline = pipeline

    def use_default_pipeline(self) -> None:
        self.pipeline = Pipeline.default(500, 0.7)

    def change_index_type(self, kind: str, params: dict | None = None) -> None:
        self.index = IndexChoice.of(kind, params)
        self._clusters = None

    def process_and_insert(self, documents: DataFrame, link_mentions: bool = False, on_empty: str = "error") -> int:
        """Ingest documents (title, source, metadata, content, and id and rid if they have any); the number of chunks.

        Documents without ids are numbered after the largest, those without rids get new ones. Content that is null or
        empty is an error before anything is inserted, or, with ``on_empty="skip"``, the document is left out; so is a
        title that is missing, or an id or rid that is there already, as a document inserted again would double its chunks.
        """
        if self.pipeline is None:
            raise RuntimeError("no pipeline is set")
        empty = F.coalesce(F.col("content"), F.lit("")) == ""
        if on_empty == "skip":
            documents = documents.filter(~empty)
        elif documents.filter(empty).limit(1).count():
            raise ValueError("document content is empty")
        new = process(self._identified(documents), self.pipeline, link_mentions=link_mentions)
        if "entities" in new:
            ids = new["entities"].select(F.col("id").alias("new_id"), "name", "entity_type")
            merged = cut(N.upsert_entities(self.tables["entities"], new["entities"]))
            ids = ids.join(merged.select("id", "name", "entity_type"), ["name", "entity_type"]).select("new_id", "id").filter("id <> new_id")
            if "edges" in new:
                for end in ("source_entity_id", "target_entity_id"):
                    j = ids.select(F.col("new_id").alias(end), F.col("id").alias("_id"))
                    new["edges"] = new["edges"].join(j, end, "left").withColumn(end, F.coalesce("_id", end)).drop("_id")
            self.tables["entities"] = merged
        for name in ("documents", "chunks", "edges"):
            if name in new:
                self._append(name, new[name])
        self._clusters = None
        return new["chunks"].count()

    def _identified(self, documents: DataFrame) -> DataFrame:
        """Documents (id, rid, title, source, metadata, content), written out once, so that minted ids stay."""
        if documents.filter("title IS NULL").limit(1).count():
            raise ValueError("title must not be null")
        rid = F.coalesce(F.col("rid"), F.uuid()) if "rid" in documents.columns else F.uuid()
        d = cut(documents.withColumn("rid", rid))
        if "id" not in d.columns:
            numbered = D.insert_documents(self.tables["documents"].limit(0), d.select("title", "source", F.col("rid").alias("metadata")), rid=F.col("metadata"))
            top = self.tables["documents"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            d = cut(numbered.select((F.col("id") + top).alias("id"), "rid").join(d, "rid"))
        known = self.tables["documents"]
        for key in ("id", "rid"):
            if d.groupBy(key).count().filter("count > 1").limit(1).count() or d.join(known.select(key), key, "left_semi").limit(1).count():
                raise ValueError(f"a document with this {key} is there already")
        return d.select("id", "rid", "title", "source", "metadata", "content")

    def save(self, batch: tuple[str, int] | None = None) -> int:
        """Publish what was changed; the number of the version. ``batch`` is the stream and number of a batch to publish once."""
        if self.versions is None:
            raise RuntimeError("the store has no folder")
        replaced = {n: df for n, df in self.tables.items() if df is not self._known.get(n)}
        added = {n: df for n, df in self._added.items() if n not in replaced}
        version = self.versions.save(replaced, added, self.manifest, batch)
        self._reload()
        return version

    # single tables
    def insert_documents(self, rows: DataFrame) -> None:
        self.tables["documents"] = D.insert_documents(self.tables["documents"], rows)

    def update_documents(self, changes: DataFrame) -> None:
        self.tables["documents"] = D.update_documents(self.tables["documents"], changes)

    def delete_documents(self, rids: DataFrame) -> None:
        """The documents and their chunks."""
        self.tables["documents"], self.tables["chunks"] = D.delete_documents(self.tables["documents"], self.tables["chunks"], rids)

    def search_documents(self, term: str, limit: int = 100) -> DataFrame:
        return D.search_documents(self.tables["documents"], term, limit)

    def insert_chunks(self, rows: DataFrame, dim: int = 384) -> None:
        C.insert_chunks(self.tables["chunks"].limit(0), rows, self.tables["documents"], dim)  # refuses rows that may not be inserted
        self._append("chunks", rows.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding"))))

    def delete_chunks(self, ids: DataFrame) -> None:
        self.tables["chunks"] = C.delete_chunks(self.tables["chunks"], ids)

    def update_chunk_embeddings(self, changes: DataFrame) -> None:
        self.tables["chunks"] = C.update_chunk_embeddings(self.tables["chunks"], changes)

    def insert_edges(self, rows: DataFrame) -> None:
        E.insert_edges(self.tables["edges"].limit(0), rows)
        self._append("edges", rows)

    def delete_edges(self, ids: DataFrame) -> None:
        self.tables["edges"] = E.delete_edges(self.tables["edges"], ids)

    def update_edge_weights(self, changes: DataFrame) -> None:
        self.tables["edges"] = E.update_edge_weights(self.tables["edges"], changes)

    def insert_entities(self, rows: DataFrame) -> None:
        self.tables["entities"] = N.upsert_entities(self.tables["entities"], rows)

    def delete_entities(self, ids: DataFrame) -> None:
        self.tables["entities"] = N.delete_entities(self.tables["entities"], ids)

    def update_entity_metadata(self, changes: DataFrame) -> None:
        self.tables["entities"] = N.update_entity_metadata(self.tables["entities"], changes)

    def search_entities(self, term: str, entity_type: str | None = None, limit: int = 100) -> DataFrame:
        return N.search_entities(self.tables["entities"], term, entity_type, limit)

    def _chunks(self) -> DataFrame:
        return C.with_rid(self.tables["chunks"], self.tables["documents"])

    def _query(self, text_or_vector: str | Sequence[float]) -> Sequence[float]:
        if not isinstance(text_or_vector, str):
            return text_or_vector
        if self.pipeline is None or self.pipeline.embed is None:
            raise RuntimeError("no embedder is set")
        return [float(x) for x in self.pipeline.embed([text_or_vector])[0]]

    def search(self, query: str | Sequence[float], config: QueryConfig = QueryConfig()) -> DataFrame:
        if self.index.kind == "ivfflat":
            self._clusters = self._clusters or ClusterIndex(self._chunks(), self.index.params["lists"], folder=f"{self.versions.root}/index/{uuid.uuid4().hex}" if self.versions else None)
            hit = self._clusters.top_k(self._query(query), config.top_k, config.similarity_threshold, self.index.params["probes"], config.document_rids)
            return hit.select("id", F.col("similarity").alias("score"), F.col("similarity").alias("similarity_score"), F.lit(0).alias("graph_distance"), F.lit("vector").alias("retrieval_method"))
        return R.vector_only(self._chunks(), self._query(query), config)

    def contextual_search(self, query, config: QueryConfig = QueryConfig()) -> DataFrame:
        return R.contextual(self._chunks(), self.tables["edges"], self._query(query), config)

    def multi_hop_search(self, query, config: QueryConfig = QueryConfig()) -> DataFrame:
        return R.multi_hop(self._chunks(), self.tables["edges"], self._query(query), config)

    def hybrid_search(self, query, config: QueryConfig = QueryConfig()) -> DataFrame:
        return R.hybrid(self._chunks(), self.tables["edges"], self._query(query), config)

    def document_scoped_search(self, query, rids: Sequence[str], config: QueryConfig | None = None) -> DataFrame:
        """Without a configuration nothing is asked for, so nothing is found."""
        c = replace(QueryConfig(), top_k=0) if config is None else config
        return R.document_scoped(self._chunks(), self.tables["edges"], self._query(query), rids, c)

    def entity_centric_search(self, entity: str, config: QueryConfig = QueryConfig()) -> DataFrame:
        return R.entity_centric(self._chunks(), self.tables["edges"], entity, config)

    def _start(self, chunk: str) -> DataFrame:
        if not self.tables["chunks"].filter(F.col("id") == chunk).limit(1).count():
            raise KeyError(f"no chunk {chunk}")
        return self.spark.createDataFrame([(chunk, chunk)], "seed string, id string")

    def bfs_traversal(self, chunk: str, max_hops: int = 2, edge_types: Sequence[str] = (), direction: str = "out") -> DataFrame:
        return V.bfs(self._start(chunk), self.tables["chunks"], V.adjacency(self.tables["edges"], edge_types, direction), max_hops)

    def dfs_traversal(self, chunk: str, max_hops: int = 2, edge_types: Sequence[str] = (), direction: str = "out") -> DataFrame:
        return V.dfs(self._start(chunk), self.tables["chunks"], V.adjacency(self.tables["edges"], edge_types, direction), max_hops)

    def neighbors(self, chunk: str, edge_types: Sequence[str] = (), direction: str = "out") -> DataFrame:
        start = self.spark.createDataFrame([(chunk, chunk)], "seed string, id string")
        return V.neighbours(start, self.tables["chunks"], V.adjacency(self.tables["edges"], edge_types, direction)).select("id")

    def hierarchical_context(self, path: str, config: QueryConfig = QueryConfig()) -> DataFrame:
        """(id, src): ancestors, descendants and siblings as the configuration asks, each as often as it is related."""
        start = self.spark.createDataFrame([(path,)], "path string")
        return C.hierarchy(start, self.tables["chunks"], config.include_ancestors, config.include_descendants, config.include_siblings).select("id", "src")

    def chunks_for_entity(self, entity: str) -> DataFrame:
        return C.with_rid(N.chunks_for_entity(self.tables["edges"], self.tables["chunks"], entity), self.tables["documents"]).orderBy("created_at", "id")
