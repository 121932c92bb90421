from __future__ import annotations

import random

import pytest

from tests.conftest import SF

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have them too.
CLASHING = "part int, bucket string, key string, label string, leaks int, count int, held_out int, score string, _row int, _text int, _leak_text int, _language_text int"


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and letterless texts, repeated rows and texts, one very long text."""
    random.seed(5)
    words = ["".join(random.choice("aeioustrnl") for _ in range(random.randint(1, 8))) for _ in range(400)]
    prose = [" ".join(random.choice(words) for _ in range(random.randint(1, 120))) for _ in range(25)]
    passage = " ".join(random.choice(words) for _ in range(60))
    texts = [*prose, prose[3], prose[3].upper(), prose[4] + " more", f"{prose[5]}\n{passage}. {prose[6]}", f"x {passage} y",
             passage, "", None, " \t\n\x0b", "!!! 12 -- 3.14", "É ß ñ", "Ünder THE mit\tLicense under the MIT license",
             "the " * 90, " ".join(random.choice(words) for _ in range(30_000)), "\x00 nul \x1f\x85\xa0 odd blanks"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(rows[7][0], *rows[7][1:])] * 2
    rows += [(None, prose[8], None, None, None), (None, None, "en", "s1", 0), (9_000, prose[9], None, None, 5)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    plain = spark.createDataFrame(edge_rows(), DOCUMENT)
    names = [c.split()[0] for c in CLASHING.split(", ")]
    from pyspark.sql import functions as F

    return plain.withColumns({n: F.lit(7).cast(c.split()[1]) for n, c in zip(names, CLASHING.split(", "))}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df, *columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
