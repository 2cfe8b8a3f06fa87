"""Summaries of pipeline stages: gates, reconciliation, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile_summary(records: DataFrame, *key: str) -> DataFrame:
    """One row: canonical records (distinct keys), records merged away, and groups that had duplicates."""
    groups = records.groupBy(*key).agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("canonical_records"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merged_away_records"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def gate_summary(pages: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One row: total_pages, parsed_products, and for each gate the pages it is the first to stop."""
    first = F.coalesce(*(F.when(stops, name) for name, stops in gates.items()), F.lit("parsed_products"))
    rows = pages.withColumn("_gate", first)
    return rows.agg(F.count("*").alias("total_pages"), *(F.count_if(F.col("_gate") == g).alias(g) for g in ("parsed_products", *gates)))


def run_source(source, pages: DataFrame) -> DataFrame:
    """A source's own hooks over its parsed pages, in order: stage, reconcile, then its facts joined by page_id.

    A hook is a function from rows to rows; one that the source doesn't have changes nothing.
    """
    staged = source.stage(pages) if source.stage else pages
    whole = source.reconcile(staged) if source.reconcile else staged
    if not source.structured_facts:
        return whole
    facts = source.structured_facts(pages)
    clash = (set(facts.columns) & set(whole.columns)) - {"page_id"}
    if "page_id" not in facts.columns or clash:
        raise ValueError(f"facts need a page_id and columns of their own, not {sorted(clash) or facts.columns}")
    return whole.join(facts, "page_id", "left")


def usefulness(images: DataFrame, roles) -> DataFrame:
    """One row: total, useful, and a count for each role."""
    return images.agg(F.count("*").alias("total"), F.count_if("useful").alias("useful"), *(F.count_if(F.col("role") == r).alias(f"role_{r.replace('-', '_')}") for r in roles))


def usage_totals(attempts: DataFrame, key: str) -> DataFrame:
    """Tokens over all attempts, as extraction counts them, and of the last one, as completion does."""
    return attempts.groupBy(key).agg(F.sum("total_tokens").alias("total_tokens"), F.max_by("total_tokens", "attempt").alias("last_tokens"))
