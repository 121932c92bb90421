"""Personal-data detection by column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order matters (the first match names the type), and some patterns are anchored.
TYPE_PATTERNS = (
    ("cpf", "^(cpf|cnpj|tax_id|ssn|social_security)"),
    ("email", "(email|e_mail)"),
    ("phone", "(phone|telefone|celular|mobile)"),
    ("address", "(address|endereco|street|cep|zip_code|postal)"),
    ("name", "^(full_name|first_name|last_name|nome)"),
    ("birth_date", "(birth|nascimento|dob)"),
    ("financial", "(credit_card|card_number|account_number|iban)"),
    ("document", "(passport|rg_number|driver_license)"),
)

# The second, unanchored set; it deliberately disagrees with the first.
FLAG_PATTERNS = (
    "cpf|ssn|social.?security",
    "e[-_.]?mail",
    "phone|telefone|celular",
    "address|endereco|cep|zip",
    "birth.?date|nascimento|dob",
    "passport|rg|identity",
    "credit.?card|cartao",
)


def pii_type(name: Column) -> Column:
    """Type of the first matching pattern, null if none matches."""
    chain = None
    for kind, pattern in TYPE_PATTERNS:
        test = name.rlike(f"(?iu){pattern}")
        chain = F.when(test, F.lit(kind)) if chain is None else chain.when(test, F.lit(kind))
    return chain


def is_pii(name: Column) -> Column:
    return name.rlike("(?iu)" + "|".join(f"({p})" for p in FLAG_PATTERNS))
