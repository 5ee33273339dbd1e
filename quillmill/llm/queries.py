"""The queries of the nine problems over the project's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill.llm import encoding, harmonise, mixing, names, packing, reading, responses, splitting
from quillmill.runtime import ship_package


def _read(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    ship_package(spark)
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment, glossary = _read(spark, sf_dir, "segment", "glossary_entry")
    return segment.select(F.lit("segment").alias("table_name"), "id", F.col("source_text").alias("raw")).unionByName(
        glossary.select(F.lit("glossary_entry").alias("table_name"), "id", F.col("source_term").alias("raw"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonise.look_alike_pairs(harmonise.harmonise(_texts(spark, sf_dir)))


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its one form."""
    return harmonise.harmonise(_texts(spark, sf_dir)).select("table_name", "id", "form").distinct()


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with others that look the same: its class, and how many of them are written otherwise."""
    return harmonise.look_alike_classes(harmonise.harmonise(_texts(spark, sf_dir)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entity_pairs(names.link_entries(*_read(spark, sf_dir, "glossary_entry", "nickname")))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry with the entity it names and the number of entries that name it."""
    linked = names.link_entries(*_read(spark, sf_dir, "glossary_entry", "nickname"))
    sizes = linked.groupBy("root").agg(F.count("*").alias("entries"))
    return linked.join(sizes, "root").select("project_id", "id", "kind", F.col("root").alias("entity_id"), "entries")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entries meet in, with the rarity that decides whether they are linked."""
    return names.scored_links(*_read(spark, sf_dir, "glossary_entry", "nickname"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.defects(*_read(spark, sf_dir, "segment", "translator_trace", "project"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_pieces(*_read(spark, sf_dir, "segment", "split_policy")).where("host_part = 0").select("segment_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_pieces(*_read(spark, sf_dir, "segment", "split_policy"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.truncated(*_read(spark, sf_dir, "segment", "translator_trace", "project")).select("table_name", "record_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.truncation_rates(*_read(spark, sf_dir, "segment", "translator_trace", "project"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that the packer had to divide."""
    calls = packing.helper_calls(*_read(spark, sf_dir, "segment", "intake_options"))
    return calls.where("part = 1").select("segment_id")


def p6_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.helper_calls(*_read(spark, sf_dir, "segment", "intake_options"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chapter has of each call, beside its target."""
    return packing.call_shares(packing.helper_calls(*_read(spark, sf_dir, "segment", "intake_options")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.token_ids(*_read(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(*_read(spark, sf_dir, "documents", "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = _read(spark, sf_dir, "documents", "mix_target")
    return mixing.shares(mixing.mix(documents, targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).where("level >= 4").select("doc_id")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(*_read(spark, sf_dir, "documents", "reading_label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_unified, p1_classes, p2_found, p2_entities, p2_links, p3_found, p4_found, p4_pieces, p5_found, p5_rates,
        p6_found, p6_calls, p6_shares, p7_ids, p8_mix, p8_shares, p9_found, p9_levels,
    )
}

ORACLES: dict[str, str] = {
    "p4_found": """
        SELECT DISTINCT s.id AS segment_id FROM segment s JOIN split_policy p ON p.project_id = s.project_id
        WHERE length(s.source_text) > p.max_chars
    """,
    "p6_found": """
        SELECT DISTINCT s.id AS segment_id FROM segment s JOIN intake_options o ON o.project_id = s.project_id
        WHERE greatest(1, length(s.source_text) // 4) > o.chunk_max_tokens
    """,
}
