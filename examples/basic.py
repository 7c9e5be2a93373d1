"""Ingest three documents, search them, follow their edges: python examples/basic.py [FOLDER]."""

import os
import sys
import tempfile

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomgraph.facade import GraphStore
from loomgraph.schema import QueryConfig

DOCUMENTS = [
    ("Tides", "notes", "{}", "The tide at Holm Bay turns twice a day. Fishers from Holm Bay follow it. Boats leave before noon."),
    ("Bread", "notes", "{}", "Flour and water make dough. An oven in Ostby bakes it. The baker Una Lund sells it with Mara Venn."),
    ("Maps", "notes", "{}", "A map of Holm Bay hangs in Ostby. See Section 2 and [4] for the scale."),
]


def main() -> None:
    spark = SparkSession.builder.master("local[2]").appName("basic").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    store = GraphStore(spark, sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp())
    store.use_default_pipeline()
    n = store.process_and_insert(spark.createDataFrame(DOCUMENTS, "title string, source string, metadata string, content string"), link_mentions=True)
    print(f"{n} chunks, version {store.save()}")
    store.hybrid_search("when does the tide turn at Holm Bay", QueryConfig(top_k=3, similarity_threshold=0.1)).show(truncate=False)
    for entity in store.search_entities("Holm").collect():
        print(entity.name, [c.path for c in store.chunks_for_entity(entity.id).collect()])
    spark.stop()


if __name__ == "__main__":
    main()
