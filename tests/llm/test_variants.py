"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from govspark.llm import variants
from govspark.llm.streams import runs
from tests.llm.conftest import DOCUMENT, collected

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def counted(rows: list[tuple]) -> dict[str, int]:
    """Words and numbers of (doc_id, text) rows, one occurrence at a time."""
    number: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            number[run] += 1
    return {w: n for w, n in number.items() if n >= 3 and len(w) >= 5}


def grouped(number: dict[str, int]) -> list[tuple]:
    """Variants by the words that remain when a letter is left out."""
    holes = defaultdict(list)
    for word in number:
        for i in range(len(word)):
            holes[word[:i], word[i + 1 :]].append(word)
    near = defaultdict(set)
    for word in number:
        for i in range(len(word)):
            near[word] |= set(holes[word[:i], word[i + 1 :]]) - {word}
            if (short := word[:i] + word[i + 1 :]) in number:
                near[word].add(short)
                near[short].add(word)
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda u: (-number[u], u), default=None)
        if best and number[best] >= 2 * number[word]:
            form[word] = best

    def root(word: str) -> str:
        return root(form[word]) if word in form else word

    return sorted(((w, form.get(w), root(w), n, len(near[w]), number.get(form.get(w))) for w, n in number.items()), key=repr)


def test_variants_equal_brute_force(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert collected(variants.spelling_variants(documents), *COLUMNS) == grouped(counted(rows))


def test_edge_rows(spark, edge):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert collected(variants.spelling_variants(edge), *COLUMNS) == grouped(counted(rows))


def test_empty_table(empty):
    assert collected(variants.spelling_variants(empty), *COLUMNS) == []


def test_chains_long_words_and_ties(spark):
    """Chains of forms, words longer than what numpy compares, equal numbers, letters beyond ASCII."""
    long = "abcde" * 40
    number = {"spelt": 90, "spelts": 40, "speltss": 12, "speltsss": 3, "tiess": 3, "tiesa": 9, "tiesb": 9,
              long: 50, long + "x": 9, long[:100] + long[101:]: 7, "naïve": 30, "naive": 4, "straße": 12, "strasse": 3,
              "ÉTUDES": 8, "Étudesx": 3, "a" * 5000: 5, "a" * 5001: 20}
    rows = [(None, " ".join([w] * n), "en", "s", 1) for w, n in number.items()]
    docs = spark.createDataFrame(rows, DOCUMENT)
    assert collected(variants.spelling_variants(docs), *COLUMNS) == grouped(counted([(r[0], r[1]) for r in rows]))


@pytest.mark.parametrize("coarse, block, small", [(3, 1 << 16, 1 << 12), (4, 25, 10), (6, 7, 3)])
def test_pairs_for_any_shards_and_buckets(spark, monkeypatch, coarse, block, small):
    """Every pair once, however the words are dealt; a group of near words that holds a third of all."""
    random.seed(11)
    words = {"".join(random.choice("abcdeé") for _ in range(random.randint(5, 7))) for _ in range(250)}
    words |= {f"hotgroup{a}{b}" for a in "abcdefghijkl" for b in "abcdefghij"}
    monkeypatch.setattr(variants, "COARSE", ((coarse, 1 << 62),))
    vocabulary = spark.createDataFrame([(w, i + 3) for i, w in enumerate(sorted(words))], "word string, n long")
    pairs = [frozenset(r) for r in collected(variants.near_pairs(vocabulary, block, small), "word", "near")]
    want = {frozenset((a, b)) for a in words for b in words if variants.one_edit(a.encode("latin-1"), b.encode("latin-1"))}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_states_split_and_bisected_levels(monkeypatch):
    """Small limits on states and tables change nothing."""
    words = sorted({"".join(random.Random(i).choice("abc") for _ in range(6)) for i in range(200)})
    latin = [w.encode() for w in words]

    def reached() -> set:
        trie = variants.Trie(latin, 3)
        counts = variants.letter_counts(latin)
        levels = np.concatenate([variants.coarse_counts(counts, 3), counts], axis=1)
        return {(words[i], trie.latin[j]) for left, right in trie.reach(levels) for i, j in zip(left, right)}

    whole = reached()
    monkeypatch.setattr(variants, "STATES", 16)
    monkeypatch.setattr(variants, "TABLE", 0)
    assert reached() == whole


def test_crc32_of_many():
    texts = [b"", b"a", b"hello", bytes(range(256)), b"x" * 1000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    seeds = np.array([zlib.crc32(str(i).encode()) for i in range(len(texts))], dtype=np.uint32)
    got = variants.crc32_of(data, np.cumsum(lengths) - lengths, lengths, seeds)
    assert got.tolist() == [zlib.crc32(str(i).encode() + t) for i, t in enumerate(texts)]


def test_tallies_are_handed_on(monkeypatch):
    """Words counted in pieces add up."""
    monkeypatch.setattr(variants, "TALLY", 3)
    batch = pa.RecordBatch.from_pydict({"_id": ["1:", "2:"], "_text": ["alpha bravo charly delta alpha", "alpha delta foxtrot"]})
    total: Counter = Counter()
    for out in variants._count(iter([batch, batch])):
        for word, n in zip(out.column("word").to_pylist(), out.column("n").to_pylist()):
            total[word] += n
    assert total == Counter(("alpha bravo charly delta alpha alpha delta foxtrot ".split()) * 2)


def test_runs_of_sorted_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": k}) for k in ([1, 1, 2], [], [2, 2], [3])]
    assert [(key, piece.num_rows) for key, piece in runs(iter(batches), "k")] == [((1,), 2), ((2,), 1), ((2,), 2), ((3,), 1)]
