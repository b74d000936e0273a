"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import decontam, htmltext, linededup, packing, pii, quality, sharding, simhash, toxicity, warc
from lathe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def documents(f: Callable[..., DataFrame], *others: str) -> Query:
        return lambda spark, d: f(table(spark, d, "documents"), *[table(spark, d, t) for t in others])

    return {
        "op1_simhash_neardedup": documents(simhash.duplicates),
        "op2_warc_merkle_audit": lambda spark, d: warc.audited(table(spark, d, "pages")),
        "op3_best_two_fit_packing": documents(packing.packed),
        "op4_pii_weak_supervision": documents(pii.spans),
        "op5_toxicity_nb_ngrams": documents(toxicity.scores, "labels"),
        "op6_html_layout_text": lambda spark, d: htmltext.rendered(table(spark, d, "pages")),
        "op7_quality_line_rules": documents(quality.cleaned),
        "op8_line_dedup_windows": documents(linededup.deduplicated),
        "op9_benchmark_decontamination": documents(decontam.contaminated, "benchmark"),
        "op10_histogram_sort_shards": documents(sharding.shards),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_merkle_audit": warc.SQL,
        "op7_quality_line_rules": quality.SQL,
        "op8_line_dedup_windows": linededup.SQL,
    }
