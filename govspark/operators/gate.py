"""Promotion between the layers."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from govspark.session import fresh_path
from govspark.sources import stored
from govspark.sources.layers import dataset_path, next_version, read_dataset, versions, write_dataset
from govspark.vocabulary import AUTOMATIC_PROMOTIONS, LAYERS, PROMOTION_THRESHOLDS


def _per_transition(source: Column, target: Column, value) -> Column:
    cases = [((source == s) & (target == t), value((s, t))) for s, t in PROMOTION_THRESHOLDS]
    first, *rest = cases
    return reduce(lambda chain, case: chain.when(*case), rest, F.when(*first))


def promotion_verdicts(requests: DataFrame, automatic: tuple = AUTOMATIC_PROMOTIONS,
                       thresholds: Mapping[tuple[str, str], float] = PROMOTION_THRESHOLDS) -> DataFrame:
    """Add ``verdict`` (invalid, refused, promoted, decision_required), flags and reason to each request.

    A promotion moves exactly one layer forward. A score equal to the threshold passes. A request whose
    dataset was checked by no expectation says so in its reason, if ``expectations_total`` is present.
    """
    source, target, score = F.col("source_layer"), F.col("target_layer"), F.col("dq_score")
    threshold = _per_transition(source, target, lambda pair: F.lit(thresholds[pair]))
    is_auto = _per_transition(source, target, lambda pair: F.lit(pair in automatic))
    move = F.concat(source, F.lit(" -> "), target)
    known = source.isin(*LAYERS) & target.isin(*LAYERS)
    verdict = (
        F.when(threshold.isNull(), "invalid")
        .when(score < threshold, "refused")
        .when(is_auto, "promoted")
        .otherwise("decision_required")
    )
    reason = (
        F.when(~known, F.lit("unknown layer"))
        .when(threshold.isNull(), F.concat(F.lit("not one layer forward: "), move))
        .when(score < threshold, F.concat(F.lit("score below threshold for "), move))
        .when(is_auto, F.concat(F.lit("automatic: score meets threshold for "), move))
        .otherwise(F.concat(F.lit("governance decision required for "), move))
    )
    if "expectations_total" in requests.columns:
        reason = F.when(F.col("expectations_total") == 0, F.concat(reason, F.lit(" (nothing checked)"))).otherwise(
            reason
        )
    return (
        requests.withColumn("threshold", threshold)
        .withColumn("verdict", verdict)
        .withColumn("promoted", F.col("verdict") == "promoted")
        .withColumn("reason", reason)
    )


def with_decision_id(verdicts: DataFrame) -> DataFrame:
    """Repeatable decision id (36 characters) for verdicts that need a governance decision."""
    digest = F.sha2(F.concat_ws("|", "domain_id", "dataset_id", "source_layer", "target_layer"), 256)
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    needed = F.col("verdict") == "decision_required"
    return verdicts.withColumn("governance_decision_id", F.when(needed, F.concat_ws("-", *pieces)))


_COPY = "promotion_id string, layer string, domain string, dataset string, source_version long, version long"


def promotion_id(move: Row, source_version: int) -> str:
    """Names one copy: what is promoted, where to, and from which version."""
    text = "|".join([move.domain_id, move.dataset_id, move.source_layer, move.target_layer, str(source_version)])
    return hashlib.sha256(text.encode()).hexdigest()


def promote(root: str, verdicts: DataFrame, at_once: int = 8) -> DataFrame:
    """Copy the promoted datasets one layer up; return the verdicts with ids.

    ``verdicts`` is a request batch of one operator call. It is decided once and stored in the shared folder. Only names
    reach the driver; each copy is a Spark job from one layer folder to the next, ``at_once`` of them side by side.

    A version of a dataset is copied once: before anything is copied, the table ``{root}/promotions`` gets the version number each
    copy will have, under an id made of the dataset, the layers and the source version. A repeated call finds the id, writes
    that number again if the copy was not finished, and copies nothing if it was.
    """
    spark = verdicts.sparkSession
    path = fresh_path(spark, "verdicts")
    with_decision_id(verdicts).write.parquet(path)
    decided = spark.read.parquet(path)
    moves = decided.where("promoted").select("domain_id", "dataset_id", "source_layer", "target_layer").distinct().collect()
    ledger = f"{root.rstrip('/')}/promotions"
    schema = spark.createDataFrame([], f"{_COPY}, {stored.BUCKET} int").schema
    newest = {move: versions(spark, root, move.source_layer, move.domain_id, move.dataset_id) for move in moves}
    for move, known in newest.items():
        if not known:
            raise FileNotFoundError(dataset_path(root, move.source_layer, move.domain_id, move.dataset_id))
    ids = {promotion_id(move, known[-1]): (move, known[-1]) for move, known in newest.items()}
    names = [r.dataset_id for r in moves]
    given = [r for r in stored.read_stored(spark, ledger, schema).where(F.col("dataset").isin(names)).collect()] if names else []
    numbers = {r.promotion_id: r.version for r in given}
    new = []
    for identity, (move, source_version) in ids.items():
        if identity not in numbers:
            place = (move.target_layer, move.domain_id, move.dataset_id)
            used = [r.version for r in given if (r.layer, r.domain, r.dataset) == place]
            numbers[identity] = max([next_version(spark, root, *place) - 1, *used]) + 1
            new.append((identity, *place, source_version, numbers[identity]))
    if new:
        stored.upsert(ledger, spark.createDataFrame(new, _COPY), ["promotion_id"], buckets=16)

    def copy(identity: str) -> None:
        move, source_version = ids[identity]
        if numbers[identity] not in versions(spark, root, move.target_layer, move.domain_id, move.dataset_id):
            data = read_dataset(spark, root, move.source_layer, move.domain_id, move.dataset_id, source_version)
            write_dataset(data, root, move.target_layer, move.domain_id, move.dataset_id, numbers[identity])

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(copy, ids))
    return decided


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; aggregated before the shuffle, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(picked).select(*keys, "row.*").select(*df.columns)
