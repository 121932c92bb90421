"""Metadata rules and the dataset catalog."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions.urns import DEFAULT_PLATFORM, PII_TAG, dataset_of_urn, dataset_urn

_CONDITION = "column matches "


@dataclass(frozen=True)
class Rule:
    name: str
    trigger: str
    condition: str
    action: str
    auto_approve: bool = False
    description: str = ""

    def matches(self, column: Column) -> Column:
        """Case-insensitive search; a condition of another form never matches."""
        if not self.condition.startswith(_CONDITION):
            return F.lit(False)
        return column.rlike("(?iu)" + self.condition.removeprefix(_CONDITION))


def rule_actions(columns: DataFrame, rules: Iterable[Rule], trigger: str | None = None) -> DataFrame:
    """One row per matching rule and column.

    Rules are configuration, a short list; they become expressions on the column table, so the theta join of
    rules and columns needs neither a shuffle nor a product.
    """
    chosen = [r for r in rules if trigger is None or r.trigger == trigger]
    outcome = "array<struct<rule_order:int,rule:string,action:string,auto_approve:string>>"
    found = F.array(
        *[
            F.when(
                rule.matches(F.col("name")),
                F.struct(
                    F.lit(order).alias("rule_order"),
                    F.lit(rule.name).alias("rule"),
                    F.lit(rule.action).alias("action"),
                    F.lit(str(rule.auto_approve)).alias("auto_approve"),
                ),
            )
            for order, rule in enumerate(chosen)
        ]
    ).cast(outcome)
    hits = F.filter(found, lambda a: a.isNotNull())
    return columns.withColumn("a", F.explode(hits)).select(*columns.columns, "a.*")


def apply_rules(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Fold the actions per column: automatic ones set the flag and tags, the rest become proposals.

    The sets hold at most one entry per rule, so they are bounded by the configuration.
    """
    parts = F.split("action", "=", 2)
    verb, value = parts[0], parts[1]
    auto = F.col("auto_approve") == "True"
    tag = F.when(verb == "add_tag", value)
    return actions.groupBy(*keys).agg(
        F.coalesce(F.bool_or(auto & (verb == "set_pii") & (value == "true")), F.lit(False)).alias("is_pii"),
        F.array_sort(F.collect_set(F.when(auto, tag))).alias("tags"),
        F.array_sort(F.collect_set(F.when(~auto, F.col("action")))).alias("proposals"),
    )


def upsert(catalog: DataFrame, changes: DataFrame, key: str = "dataset_id", updated_at: str = "updated_at") -> DataFrame:
    """Newest row per dataset of the catalog and the changes; on equal times the change wins."""
    merged = catalog.withColumn("_rank", F.lit(0)).unionByName(changes.withColumn("_rank", F.lit(1)))
    rest = [c for c in catalog.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(updated_at, "_rank")).alias("r")
    return merged.groupBy(key).agg(newest).select(key, "r.*").select(*catalog.columns)


def search(catalog: DataFrame, keyword: str, fields: list[str], limit: int = 20, order: str = "dataset_id") -> DataFrame:
    """Case-insensitive keyword search in each of ``fields``, first ``limit`` rows by ``order``."""
    held = [F.coalesce(F.contains(F.lower(f), F.lit(keyword.lower())), F.lit(False)) for f in fields]
    return catalog.where(reduce(or_, held)).orderBy(order).limit(limit)


def get(catalog: DataFrame, dataset_id: str, key: str = "dataset_id") -> DataFrame:
    """The row of one dataset, or no row."""
    return catalog.where(F.col(key) == dataset_id)


# Fixed value: type name that every field of a change record carries.
_FIELD_TYPE = "com.linkedin.schema.StringType"


def change_record(catalog: DataFrame, platform: str = DEFAULT_PLATFORM) -> DataFrame:
    """Catalog rows as schema-metadata change records: ``urn`` and JSON ``record``."""
    tags = lambda f: F.when(
        f["is_pii"], F.array(F.struct(F.lit(PII_TAG).alias("tag")))
    ).otherwise(F.array().cast("array<struct<tag:string>>"))
    fields = F.transform(
        "schema_fields",
        lambda f: F.struct(
            f["name"].alias("fieldPath"),
            f["data_type"].alias("nativeDataType"),
            F.struct(F.struct(F.expr("named_struct()").alias(_FIELD_TYPE)).alias("type")).alias("type"),
            f["description"].alias("description"),
            f["is_nullable"].alias("nullable"),
            F.struct(tags(f).alias("tags")).alias("globalTags"),
        ),
    )
    urn = dataset_urn(F.col("dataset_id"), platform=platform)
    aspect = F.struct(
        F.col("name").alias("schemaName"),
        F.lit(f"urn:li:dataPlatform:{platform}").alias("platform"),
        fields.alias("fields"),
        F.array().cast("array<string>").alias("primaryKeys"),
    )
    record = F.struct(
        F.lit("dataset").alias("entityType"),
        urn.alias("entityUrn"),
        F.lit("schemaMetadata").alias("aspectName"),
        aspect.alias("aspect"),
        F.lit("UPSERT").alias("changeType"),
    )
    return catalog.select(urn.alias("urn"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


RECORD_SCHEMA = (
    "entityUrn string, aspect struct<schemaName:string, fields:array<struct<fieldPath:string, "
    "nativeDataType:string, description:string, nullable:boolean, "
    "globalTags:struct<tags:array<struct<tag:string>>>>>>"
)


def catalog_rows(records: DataFrame, column: str = "record") -> DataFrame:
    """Change records back to catalog rows; absent keys take defaults, any tag marks personal data."""
    parsed = records.select(F.from_json(column, RECORD_SCHEMA).alias("m"))
    dataset = dataset_of_urn(F.coalesce("m.entityUrn", F.lit("")))
    fields = F.transform(
        F.coalesce("m.aspect.fields", F.array().cast("array<" + _FIELD + ">")),
        lambda f: F.struct(
            F.coalesce(f["fieldPath"], F.lit("")).alias("name"),
            F.coalesce(f["nativeDataType"], F.lit("string")).alias("data_type"),
            F.coalesce(f["description"], F.lit("")).alias("description"),
            (F.coalesce(F.size(f["globalTags"]["tags"]), F.lit(0)) > 0).alias("is_pii"),
            F.coalesce(f["nullable"], F.lit(True)).alias("is_nullable"),
        ),
    )
    return parsed.select(
        dataset.alias("dataset_id"),
        F.coalesce("m.aspect.schemaName", dataset).alias("name"),
        F.lit("unknown").alias("domain_id"),
        F.lit("unknown").alias("owner_id"),
        fields.alias("schema_fields"),
    )


_FIELD = (
    "struct<fieldPath:string, nativeDataType:string, description:string, nullable:boolean, "
    "globalTags:struct<tags:array<struct<tag:string>>>>"
)


def lineage_datasets(catalog: DataFrame, platform: str = DEFAULT_PLATFORM) -> DataFrame:
    """Catalog rows as lineage datasets with schema, quality and ownership facets."""
    fields = F.transform(
        "schema_fields",
        lambda f: F.struct(f["name"].alias("name"), f["data_type"].alias("type"), f["description"].alias("description")),
    )
    facets = F.struct(
        F.struct(F.lit(platform).alias("_producer"), F.lit(_FACETS + "SchemaDatasetFacet.json").alias("_schemaURL"),
                 fields.alias("fields")).alias("schema"),
        F.struct(F.lit(platform).alias("_producer"),
                 F.lit(_FACETS + "DataQualityMetricsInputDatasetFacet.json").alias("_schemaURL"),
                 F.col("quality_score").alias("qualityScore")).alias("dataQualityMetrics"),
        F.struct(F.lit(platform).alias("_producer"),
                 F.array(F.struct(F.col("owner_id").alias("name"), F.lit("DATAOWNER").alias("type"))).alias("owners"))
        .alias("ownership"),
    )
    return catalog.select(
        F.concat(F.lit(f"{platform}://"), "domain_id").alias("namespace"),
        F.col("dataset_id").alias("name"),
        facets.alias("facets"),
    )


# Fixed value: public address of the facet schemas.
_FACETS = "https://openlineage.io/spec/facets/1-0-0/"
