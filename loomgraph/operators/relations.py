"""Entities and relations found in chunks: a pluggable extractor, citations, co-occurrence."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of citations and their names.
CITATIONS = {
    "numeric_citation": r"\[(\d+)\]",
    "author_year_citation": r"\(([A-Z][a-z]+(?:\s+et\s+al\.)?)\s+(\d{4})\)",
    "section_reference": r"(?i)\b(?:section|chapter)\s+(\d+(?:\.\d+)*)\b",
    "inline_section_reference": r"\b(?:Section|Chapter|Figure|Table)\s+(\d+(?:\.\d+)*)\b",
    "doi_reference": r"doi:\s*(\S+)",
    "url_reference": r"https?://\S+",
}
_GROUPS = {k: re.compile(p).groups for k, p in CITATIONS.items()}

Extractor = Callable[[str], list[tuple[str, str, float, int, int]]]
Relator = Callable[[DataFrame, DataFrame], DataFrame]
#: Columns of an edge before it is stored, and of a mention.
EDGE = ["source_chunk_id", "target_chunk_id", "source_entity_id", "target_entity_id", "edge_type", "weight", "bidirectional", "metadata"]
MENTION = "chunk_id string, pos int, name string, entity_type string, confidence double, start int, end int, entity_id string"
_TYPES = dict(zip(EDGE, ["string"] * 5 + ["double", "boolean", "string"]))


def _as_edges(df: DataFrame) -> DataFrame:
    """The columns ``EDGE`` of ``df``, null where it lacks one."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in _TYPES.items()])


def citations(chunks: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, citation_pattern, pos, citation_text, reference_id, reference_year): every match of every pattern.

    The same place may match two patterns. Ids and years are null where a pattern has no such group.
    """
    none = F.lit(None).cast("string")
    text = F.col(content)

    def matches(name: str, pattern: str) -> Column:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(_GROUPS[name] + 1)]
        has = lambda x, g: x[f"g{g}"] if g < len(groups) else none
        one = lambda x, i: F.struct(F.lit(name).alias("citation_pattern"), i.alias("pos"), has(x, 0).alias("citation_text"), has(x, 1).alias("reference_id"), has(x, 2).alias("reference_year"))
        return F.transform(F.arrays_zip(*groups), one)

    found = [matches(n, p) for n, p in CITATIONS.items()]
    return chunks.filter(text.isNotNull()).select(key, F.explode(F.concat(*found)).alias("c")).select(key, "c.*")


def citation_edges(chunks: DataFrame) -> DataFrame:
    """Reference edges of weight 0.7 from what chunks (path, content) cite; their source is the chunk of ``extracted_from``."""
    c = citations(chunks, "path")
    meta = F.to_json(F.struct("citation_text", F.lit("pattern_supplement").alias("detection_type"), "citation_pattern", F.col("path").alias("extracted_from"), "reference_id", "reference_year"))
    return _as_edges(c.select(F.lit("reference").alias("edge_type"), F.lit(0.7).alias("weight"), F.lit(False).alias("bidirectional"), meta.alias("metadata")))


def normal_type(entity_type: Column) -> Column:
    """A tagger's type without ``B-`` or ``I-``."""
    return F.regexp_replace(entity_type, "^(B-|I-)", "")


def capitalised_extractor(text: str) -> list[tuple[str, str, float, int, int]]:
    """A rule-based stand-in for a token classifier: runs of capitalised words inside sentences, typed by their words."""
    out = []
    for m in re.finditer(r"(?<![.!?]\s)(?<!^)\b[A-Z][\w'-]+(?:\s+(?:of|and|the|[A-Z][\w'-]+))*(?<!\sof)(?<!\sand)(?<!\sthe)", text):
        words = m[0].split()
        org = {"University", "Institute", "Company", "Corporation", "Bank", "Museum", "Association", "Academy"}
        kind = "ORG" if org & set(words) else "LOC" if re.search(r"\b(?:in|at|near|from|to)\s$", text[: m.start()]) else "PER" if len(words) == 2 else "MISC"
        out.append((m[0], kind, 0.5, m.start(), m.end()))
    return out


def extract_entities(chunks: DataFrame, extractor: Extractor = capitalised_extractor, key: str = "id", content: str = "content") -> DataFrame:
    """(chunk_id, pos, name, entity_type, confidence, start, end): what the extractor finds, with offsets in the chunk."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *e) for k, t in zip(pdf["k"], pdf["t"]) for i, e in enumerate(x for x in extractor(t) if x[1] != "O" and x[0].strip())]
            yield pd.DataFrame(rows, columns=["chunk_id", "pos", "name", "entity_type", "confidence", "start", "end"])

    texts = chunks.select(F.col(key).alias("k"), F.col(content).alias("t")).filter("t IS NOT NULL")
    found = texts.mapInPandas(run, f"chunk_id {kind}, pos int, name string, entity_type string, confidence double, start int, end int")
    return found.withColumn("name", F.trim("name")).withColumn("entity_type", normal_type(F.col("entity_type")))


def extracted_citations(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Reference edges from works and persons that an extractor found (MISC, PER), weighted by confidence."""
    hit = mentions.filter(F.col("entity_type").isin("MISC", "PER")).join(chunks.select(F.col("id").alias("chunk_id"), F.col("path").alias("extracted_from")), "chunk_id")
    meta = F.to_json(F.struct(F.col("name").alias("citation_text"), F.lit("ner_model").alias("detection_type"), "entity_type", "confidence", "extracted_from", "start", "end"))
    return _as_edges(hit.select(F.lit("reference").alias("edge_type"), F.col("confidence").alias("weight"), F.lit(False).alias("bidirectional"), meta.alias("metadata")))


def cooccurrence_edges(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges in both directions between the entities (entity_id) of mentions that begin less than 100 apart in a chunk."""
    of = mentions.select("chunk_id", "pos", "entity_id", "entity_type", "name")
    end = lambda n, pos, role: of.select("chunk_id", F.col("pos").alias(pos), F.col("entity_id").alias(role), F.col("entity_type").alias(f"entity{n}_type"), F.col("name").alias(f"entity{n}_name"))
    both = cooccurrence(mentions).join(end(1, "a", "source_entity_id"), ["chunk_id", "a"]).join(end(2, "b", "target_entity_id"), ["chunk_id", "b"])
    both = both.join(chunks.select(F.col("id").alias("chunk_id"), F.col("path").alias("context")), "chunk_id")
    meta = F.to_json(F.struct("distance", "context", "entity1_type", "entity2_type", "entity1_name", "entity2_name"))
    return _as_edges(both.select("source_entity_id", "target_entity_id", F.lit("entity_mention").alias("edge_type"), "weight", F.lit(True).alias("bidirectional"), meta.alias("metadata")))


def default_relations(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """The default relation extractor: citations by what was extracted and by patterns, and co-occurrence of entities.

    ``chunks`` has id, path and content, ``mentions`` the columns ``MENTION``. Citations have no target.
    """
    return extracted_citations(mentions, chunks).unionByName(citation_edges(chunks)).unionByName(cooccurrence_edges(mentions, chunks))


def per_chunk(relate: Callable[[str, str, list[dict]], list[dict]]) -> Relator:
    """A relation extractor of a plain function of a chunk's text, path and entities (dicts of a mention's columns).

    The function gives dicts with any of the keys ``EDGE``; metadata may be a dict. It runs in Arrow batches, on the
    entities of one chunk at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, path, found in zip(pdf["content"], pdf["path"], pdf["m"]):
                for e in relate(text, path, sorted((m if isinstance(m, dict) else m.asDict() for m in (() if found is None else found)), key=lambda m: m["pos"])):
                    meta = e.get("metadata")
                    rows.append([(json.dumps(meta) if isinstance(meta, dict) else meta) if c == "metadata" else e.get(c) for c in EDGE])
            yield pd.DataFrame(rows, columns=EDGE, dtype=object)

    def extractor(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
        m = mentions.groupBy(F.col("chunk_id").alias("id")).agg(F.collect_list(F.struct("pos", "name", "entity_type", "confidence", "start", "end", "entity_id")).alias("m"))
        return chunks.select("id", "path", "content").join(m, "id", "left").select("path", "content", "m").mapInPandas(run, ", ".join(f"{c} {t}" for c, t in _TYPES.items()))

    return extractor


def link_extracted(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges (columns ``EDGE``) of which those without a source take the chunk at the path in their ``extracted_from``, if it is there."""
    at = F.when(F.coalesce("source_chunk_id", "source_entity_id").isNull(), F.get_json_object("metadata", "$.extracted_from"))
    ids = chunks.groupBy(F.col("path").alias("_path")).agg(F.min("id").alias("_id"))
    return edges.withColumn("_path", at).join(ids, "_path", "left").withColumn("source_chunk_id", F.coalesce("source_chunk_id", "_id")).select(*EDGE)


def cooccurrence(mentions: DataFrame, reach: int = 100) -> DataFrame:
    """(chunk_id, a, b, distance, weight): pairs of mentions (chunk_id, pos, start) of a chunk that begin less than ``reach`` apart.

    The join is on chunk and on blocks of ``reach`` offsets, so that only near mentions meet. ``a`` and ``b`` are the
    places of the mentions in the chunk's list, a < b; weight is 1 - distance / 200.
    """
    m = mentions.select("chunk_id", "pos", F.col("start").cast("int").alias("start")).withColumn("block", F.floor(F.col("start") / reach))
    left = m.select("chunk_id", F.col("pos").alias("a"), F.col("start").alias("sa"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    right = m.select("chunk_id", F.col("pos").alias("b"), F.col("start").alias("sb"), "block")
    distance = F.abs(F.col("sa") - F.col("sb"))
    near = left.join(right, ["chunk_id", "block"]).filter((F.col("a") < F.col("b")) & (distance < reach))
    return near.select("chunk_id", "a", "b", distance.alias("distance"), F.greatest(F.lit(0.0), 1 - distance / 200.0).alias("weight"))
