"""Masking whole tables and noisy aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions.masking import Mask, email_mask, hash_mask, partial_mask, redact, tax_id_mask
from govspark.functions.noise import laplace, seeded_uniform
from govspark.functions.pii import is_pii, pii_type
from govspark.vocabulary import EPSILON, EPSILON_OTHERWISE

# Mask per detected type of personal data; ``flag`` is for columns that only a contract marks.
MASK_OF_TYPE: dict[str, Mask] = {
    "cpf": tax_id_mask,
    "email": email_mask,
    "phone": partial_mask,
    "address": redact,
    "name": redact,
    "birth_date": redact,
    "financial": partial_mask,
    "document": hash_mask,
    "flag": hash_mask,
}


def detect_pii(columns: DataFrame, name: str = "name") -> DataFrame:
    """Columns with a personal-data type; columns without a match are left out."""
    return columns.withColumn("pii_type", pii_type(F.col(name))).where("pii_type IS NOT NULL")


def classify_columns(columns: DataFrame, name: str = "name") -> DataFrame:
    """Every column with its flag, and the tag ``pii`` where the flag is set."""
    flagged = columns.withColumn("is_pii", is_pii(F.col(name)))
    return flagged.withColumn("suggested_tag", F.when(F.col("is_pii"), "pii"))


def mask_table(df: DataFrame, policy: Mapping[str, Mask]) -> DataFrame:
    """Replace the named columns by their masks in one projection."""
    missing = set(policy) - set(df.columns)
    if missing:
        raise ValueError(f"policy names unknown columns: {sorted(missing)}")
    return df.select(
        *[policy[c](F.col(f"`{c}`").cast("string")).alias(c) if c in policy else F.col(f"`{c}`") for c in df.columns]
    )


def policy_for(types: Mapping[str, str]) -> dict[str, Mask]:
    """Masks for columns by personal-data type (``flag`` for columns a contract marks without a type)."""
    return {column: MASK_OF_TYPE[kind] for column, kind in types.items()}


def policy_from_contract(columns: DataFrame) -> dict[str, Mask]:
    """Masks for one contract (``name``, ``pii``): by the detected type, or hashing where only the contract says so.

    The columns of one contract come to the driver, because a projection is built from them.
    """
    kinds = columns.where("pii").select("name", F.coalesce(pii_type(F.col("name")), F.lit("flag")).alias("kind"))
    return policy_for({row.name: row.kind for row in kinds.toLocalIterator()})


def epsilon_of(classification: Column) -> Column:
    pairs = [F.lit(v) for pair in EPSILON.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), classification), F.lit(EPSILON_OTHERWISE))


def noisy_metrics(metrics: DataFrame, value: str, sensitivity: float = 1.0, classification: Column | None = None,
                  epsilon: float | None = None, seed: int | None = None, identity: list[str] | None = None) -> DataFrame:
    """Add independent Laplace noise to each metric row.

    An explicit epsilon wins over the one of the class. Each row spends its own epsilon, so a caller that
    publishes k metrics about the same people spends k times epsilon. With ``seed`` the noise is repeatable,
    from a hash of the seed and the ``identity`` columns; that mode is for tests.
    """
    label = F.lit("confidential") if classification is None else classification
    spent = F.lit(float(epsilon)) if epsilon is not None else epsilon_of(label)
    uniform = None
    if seed is not None:
        uniform = seeded_uniform(F.lit(str(seed)), *[F.col(c).cast("string") for c in identity or []])
    return (
        metrics.withColumn("epsilon", spent)
        .withColumn("sensitivity", F.lit(float(sensitivity)))
        .withColumn("classification", label)
        .withColumn("mechanism", F.lit("laplace"))
        .withColumn("noisy_value", F.col(value) + laplace(F.col("sensitivity") / F.col("epsilon"), uniform))
    )


def spent_budget(noisy: DataFrame, keys: list[str]) -> DataFrame:
    """Epsilon spent in total on the released metrics of each group."""
    return noisy.groupBy(*keys).agg(F.count("*").alias("metrics"), F.sum("epsilon").alias("epsilon_total"))
