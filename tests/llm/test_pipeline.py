"""The pipeline and the registered queries."""

from __future__ import annotations

import subprocess
import sys
import textwrap

import pytest

import corpus_pipeline
from govspark.llm import language
from govspark.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SF
from tests.llm.test_copies import lowered, near_components
from tests.llm.test_texts import brute_leaks, check_bins
from tools.check_oracle import compare, duck


def test_pipeline_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    told = language.identify(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    gone = {r.doc_id for r in told if r.lang_pred == "und" or r.ambiguous}
    kept = [d for d in docs if d[0] not in gone]
    last = {}
    for doc_id, text in kept:
        last[lowered(text)] = max(doc_id, last.get(lowered(text), -1))
    kept = [d for d in kept if last[lowered(d[1])] == d[0]]
    least = {d: c for d, _, c in near_components(kept)}
    kept = [d for d in kept if least[d[0]] == d[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    leaky = {d for d, _ in brute_leaks(kept, items)}
    kept = [d for d in kept if d[0] not in leaky]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in kept} and len(kept) < len(docs)
    check_bins(rows, dict(kept), 2048)


def test_every_stage_takes_edges(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, edge, SF)
        assert got.count() > 0 and stage(spark, empty, SF).collect() == [], name
        assert name == "pack" or got.columns == edge.columns


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "decontaminate", "pack"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas().convert_dtypes()  # integers with nulls stay integers
    assert compare(got, duck(SF).execute(ORACLE[name]).df().convert_dtypes()) == ""


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_works_without_a_library():
    """Where a library of the subpackage is missing, the other queries are still there."""
    code = """
        import sys, warnings
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "ahocorasick":
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Gone())
        with warnings.catch_warnings(record=True) as told:
            warnings.simplefilter("always")
            import __spark_entry__ as e
        assert len(e.queries()) > 100 and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
        assert any("ahocorasick" in str(w.message) for w in told)
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=120)


def test_entry_works_without_the_subpackage():
    """With the subpackage and the pipeline missing, the other queries are still there."""
    code = """
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name.startswith("govspark.llm") or name == "corpus_pipeline":
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert len(e.queries()) > 100 and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=120)
