"""Panel inputs as typed tables: targets, adapters, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TARGETS = "panel_id bigint, target string, aln_id bigint, sites array<int>"
ADAPTERS = "panel_id bigint, i int, forward string, reverse string"
PARAMS = (
    "panel_id bigint, primer_primer_distance int, primer_target_distance int, "
    "target_len_min int, target_len_max int, binding_len_min int, binding_len_max int, "
    "ideal_binding_size int, max_binding_target_len int, target_tm double, max_tm_deviation double"
)
SCHEMAS = {"targets": TARGETS, "adapters": ADAPTERS, "params": PARAMS}


def load_panel_table(spark: SparkSession, path: str, name: str, fmt: str = "json") -> DataFrame:
    """One of the panel tables with its declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(path)


def load_panel_tables(spark: SparkSession, root: str, fmt: str = "json") -> dict[str, DataFrame]:
    return {name: load_panel_table(spark, f"{root}/{name}", name, fmt) for name in SCHEMAS}
