"""Expectation suites, contracts and metadata rules from YAML."""

from __future__ import annotations

from collections.abc import Iterator
import re
from typing import Any
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.operators.catalog import Rule
from govspark.operators.expectations import Expectation

try:
    import yaml
except ImportError:  # the YAML readers then fail on use, the rest of the package works
    yaml = None

SUITE_SCHEMA = "suite_name string, position int, expectation_type string, kwargs string"

# The suites of the three lower layers (there is none for platinum).
DEFAULT_SUITES = """
default_bronze:
  - {expectation_type: expect_table_row_count_to_be_between, kwargs: {min_value: 1}}
  - {expectation_type: expect_column_values_to_not_be_null, kwargs: {column: id}}
  - {expectation_type: expect_column_values_to_be_of_type, kwargs: {column: id, type_: string}}
default_silver:
  - {expectation_type: expect_table_row_count_to_be_between, kwargs: {min_value: 1}}
  - {expectation_type: expect_column_values_to_not_be_null, kwargs: {column: id}}
  - {expectation_type: expect_column_values_to_be_unique, kwargs: {column: id}}
  - {expectation_type: expect_column_values_to_not_be_null, kwargs: {column: created_at}}
  - {expectation_type: expect_column_values_to_match_strftime_format, kwargs: {column: created_at, strftime_format: "%Y-%m-%dT%H:%M:%S"}}
default_gold:
  - {expectation_type: expect_table_row_count_to_be_between, kwargs: {min_value: 1}}
  - {expectation_type: expect_column_values_to_not_be_null, kwargs: {column: id}}
  - {expectation_type: expect_column_values_to_be_unique, kwargs: {column: id}}
  - {expectation_type: expect_column_values_to_not_be_null, kwargs: {column: created_at}}
  - {expectation_type: expect_column_values_to_not_be_null, kwargs: {column: updated_at}}
  - {expectation_type: expect_column_values_to_match_strftime_format, kwargs: {column: created_at, strftime_format: "%Y-%m-%dT%H:%M:%S"}}
  - {expectation_type: expect_column_values_to_match_strftime_format, kwargs: {column: updated_at, strftime_format: "%Y-%m-%dT%H:%M:%S"}}
"""

# The metadata rules that ship by default.
DEFAULT_RULES = (
    Rule("detect_cpf", "on_ingest", "column matches cpf|ssn|social_security", "set_pii=true", True),
    Rule("detect_email", "on_ingest", "column matches email|e_mail", "set_pii=true", True),
    Rule("detect_phone", "on_ingest", "column matches phone|telefone|celular", "set_pii=true", True),
    Rule("tag_financial", "on_ingest", "column matches revenue|amount|price|cost", "add_tag=financial", False),
    Rule("tag_temporal", "on_ingest", "column matches created_at|updated_at|timestamp|date", "add_tag=temporal", True),
)


def default_suite_records() -> dict[str, list[dict[str, Any]]]:
    """The default suites as they stand in their files."""
    return yaml.safe_load(DEFAULT_SUITES)


def default_suites() -> dict[str, list[Expectation]]:
    return {name: [Expectation.of(r) for r in items] for name, items in default_suite_records().items()}


def _texts(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Name and text of the YAML files below a path of any file system; of a path that does not exist, none.

    Only a path that is truly absent gives none: a store that cannot be reached raises. Files are named by their
    folder ``suite_name=...`` (see ``write_suites``), else by their own name.
    """
    try:
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    found = files.select(F.col("_metadata.file_path").alias("path"), "value").collect()  # configuration, a few kilobytes
    return sorted((_stem(r["path"]), r["value"]) for r in found)


def _stem(path: str) -> str:
    folder = re.search(r"/suite_name=([^/]+)/", path)
    return unquote(folder[1]) if folder else unquote(path.rsplit("/", 1)[-1].rsplit(".", 1)[0])


def read_suites(spark: SparkSession, folder: str) -> dict[str, list[Expectation]]:
    """All suites of a folder by file name; a file without a list of expectations is an empty suite."""
    found = {}
    for name, text in _texts(spark, folder):
        data = yaml.safe_load(text)
        items = data.get("expectations") or [] if isinstance(data, dict) else []
        found[name] = [Expectation.of(r) for r in items]
    return found


def write_suites(spark: SparkSession, suites: dict[str, list[dict[str, Any]]], folder: str) -> None:
    """One YAML file per suite (a list of expectation records), in a folder ``suite_name=...`` each."""
    rows = [(name, yaml.safe_dump({"expectations": items})) for name, items in suites.items()]
    texts = spark.createDataFrame(rows, "suite_name string, value string")
    texts.write.partitionBy("suite_name").text(folder)


def pick_suite(suites: dict[str, list[Expectation]], suite_name: str, layer: str) -> list[Expectation]:
    """The named suite, else the layer's default, else no expectations."""
    return suites.get(suite_name, suites.get(f"default_{layer}", []))


def suite_table(spark: SparkSession, suites: dict[str, list[Expectation]]) -> DataFrame:
    """Suites as rows; a suite without expectations has one row with null position."""
    rows: list[tuple[str, int | None, str | None]] = []
    for name, items in suites.items():
        rows += [(name, i, item.kind) for i, item in enumerate(items)] or [(name, None, None)]
    return spark.createDataFrame(rows, "suite_name string, position int, expectation_type string")


def resolve_suites(datasets: DataFrame, suites: DataFrame, keys: list[str]) -> DataFrame:
    """One row per dataset (``suite``, ``layer``) and expectation of the suite that applies to it."""
    names = suites.select(F.col("suite_name").alias("_name")).distinct()
    named = datasets.join(names, F.col("suite") == F.col("_name"), "left")
    fallback = F.concat(F.lit("default_"), "layer")
    resolved = named.withColumn("suite_name", F.coalesce("_name", fallback)).drop("_name")
    joined = resolved.join(suites, "suite_name").where("position IS NOT NULL")
    return joined.select(*keys, "suite_name", "position", "expectation_type")


CONTRACT_SCHEMA = (
    "path string, name string, dataset_id string, domain_id string, owner_id string, jurisdiction string, "
    "freshness_hours double, completeness_threshold double, availability_percent double, "
    "columns array<struct<name:string,data_type:string,nullable:boolean,description:string,pii:boolean>>, "
    "primary_key array<string>"
)

_CONTRACT_FIELDS = ["path", "name", "dataset_id", "domain_id", "owner_id", "jurisdiction", "freshness_hours",
                    "completeness_threshold", "availability_percent", "columns", "primary_key"]


def _contract(path: str, text: str) -> dict[str, Any]:
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ValueError(f"not a YAML mapping: {path}")
    for field in ("dataset_id", "domain_id", "owner_id"):
        if field not in raw:
            raise ValueError(f"{field} missing in {path}")
    schema, sla = raw.get("schema") or {}, raw.get("sla") or {}
    column = {"nullable": True, "description": "", "pii": False}
    return {
        "path": path,
        "name": raw.get("name", _stem(path)),
        **{f: raw[f] for f in ("dataset_id", "domain_id", "owner_id")},
        "jurisdiction": raw.get("jurisdiction"),
        "freshness_hours": sla.get("freshness_hours"),
        "completeness_threshold": float(sla.get("completeness_threshold", 0.95)),
        "availability_percent": float(sla.get("availability_percent", 99.0)),
        "columns": [{**column, **c} for c in schema.get("columns") or []],
        "primary_key": schema.get("primary_key") or [],
    }


def parse_contracts(texts: DataFrame) -> DataFrame:
    """One contract per row of ``path`` and YAML text ``value``, in parallel over the rows."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                [_contract(p, t) for p, t in zip(batch["path"], batch["value"])], columns=_CONTRACT_FIELDS
            )

    return texts.select("path", "value").mapInPandas(parse, CONTRACT_SCHEMA)


def read_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """The contract files of a folder, sorted by file name."""
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.yaml")
    return parse_contracts(texts.select(F.col("_metadata.file_path").alias("path"), "value")).orderBy("path")


def contract_columns(contracts: DataFrame) -> DataFrame:
    """One row per contract column, in contract order."""
    return contracts.select("dataset_id", F.posexplode("columns").alias("position", "c")).select(
        "dataset_id", "position", "c.*"
    )


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of one file, or of all files of a folder; only a path that does not exist means no rules."""
    found = [yaml.safe_load(text) or {} for _, text in _texts(spark, path)]
    return [Rule(**record) for data in found for record in data.get("rules", [])]
