"""Repeated passages, exact copies and near copies against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from govspark.llm import exact, graph, phrases, simhash
from govspark.llm.words import BLANK_SEPARATED, run_hashes, slices
from tests.llm.conftest import collected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


# --- words -----------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["a bb  ccc\n", None, "", " \t", "über\x0bx", "x y", "bb ccc"]
    for size in (1, 8, 1 << 20):
        found, seen = [], {}
        for part in slices(pa.array(texts), BLANK_SEPARATED, size=size):
            words = [part.data[a:b].tobytes().decode() for a, b in zip(part.starts, part.ends)]
            found += [words[a:b] for a, b in zip(part.words[:-1], part.words[1:])]
            for word, value in zip(words, part.hashes()):
                assert seen.setdefault(word, value) == value
        assert found == [WORD.findall(t or "") for t in texts]
        assert len(set(seen.values())) == len(seen)


def test_run_hashes_depend_on_words_alone():
    hashes = np.array([3, 1, 2, 3, 1, 2, 9], dtype=np.uint64)
    runs = run_hashes(hashes, np.arange(5), 3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 4


# --- op 1 ------------------------------------------------------------------------------------------------------------


def without_repeats(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k)))
    return out


@pytest.mark.parametrize("settings", [{}, {"bucket_rows": 3, "range_bytes": 20_000}])
def test_repeats_equal_brute_force(edge, settings):
    rows = edge.select("doc_id", "text").collect()
    got = phrases.remove_repeats(edge, **settings)
    expected = [(r.doc_id, *x) for r, x in zip(rows, without_repeats([r.text for r in rows], 35))]
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(expected, key=repr)
    assert sum(e[2] for e in expected) > 300


def test_repeats_of_few_different_words(spark):
    """Windows over a tiny vocabulary share anchors in all ways."""
    random.seed(2)
    texts = [" ".join(random.choice("ab" if i % 2 else "abcde") for _ in range(random.randint(0, 60))) for i in range(60)]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = phrases.remove_repeats(data, window=7, phrase=3, bucket_rows=8, range_bytes=300)
    expected = [(i, *x) for i, x in enumerate(without_repeats(texts, 7))]
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(expected, key=repr)
    assert 0 < sum(e[2] for e in expected) < sum(e[1] for e in expected)


def test_a_missing_side_file_is_an_error(spark, monkeypatch):
    """A phrase file that is gone does not count as a bucket without phrases."""
    import os

    folders = []
    monkeypatch.setattr(phrases, "local_folder", lambda p: folders.append(p.removeprefix("file:")) or folders[-1])
    data = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(60))) for i in range(4)], "doc_id long, text string")
    result = phrases.remove_repeats(data)
    lost = next(f for f in os.listdir(folders[0]) if f.startswith("phrases-"))
    os.remove(f"{folders[0]}/{lost}")
    with pytest.raises(Exception, match="No such file"):
        result.collect()


def test_repeats_of_nothing(empty):
    assert phrases.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("length", [1, 2, 5, 24])
def test_leftmost_least(length):
    values = np.random.default_rng(1).integers(0, 6, 80).astype(np.uint64)
    got = phrases.leftmost_least(values, length)
    assert got.tolist() == [i + int(np.argmin(values[i : i + length])) for i in range(80 - length + 1)]


# --- op 3 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [exact.CAPACITY, 2_000])
def test_exact_groups_equal_brute_force(edge, capacity):
    rows = [(r.doc_id, lowered(r.text)) for r in edge.select("doc_id", "text").collect()]
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[text].append(doc_id)
    expected = []
    for doc_id, text in rows:
        keep = max((i for i in ids[text] if i is not None), default=None)
        expected.append((doc_id, keep, len(ids[text]), doc_id is not None and doc_id == keep,
                         hashlib.sha256(text.encode()).hexdigest()))
    got = exact.exact_groups(edge, capacity)
    assert collected(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(expected, key=repr)


def test_exact_stage_keeps_columns_and_one_of_each(edge, empty):
    kept = exact.drop_exact_copies(edge)
    assert kept.columns == edge.columns
    largest: dict = {}
    for r in edge.collect():
        known = [x for x in (largest.get(lowered(r.text)), r.doc_id) if x is not None]
        largest[lowered(r.text)] = max(known, default=None)
    assert Counter((lowered(r.text), r.doc_id) for r in kept.collect()) == Counter(largest.items())
    assert exact.exact_groups(empty).collect() == [] and exact.drop_exact_copies(empty).collect() == []


#: Repeated rows, null ids, ids with several texts, texts that differ in case alone.
TANGLED = [(5, "x"), (5, "x"), (None, "a"), (1, "A"), (7, "y"), (9, "y"), (7, "z z z"), (None, "n n"), (None, "n n"), (None, "N n"),
           (3, None), (3, ""), (None, None), (4, "Case"), (4, "case"), (6, "q"), (6, "q"), (6, "r")]


def test_exact_stage_decides_by_row(spark):
    kept = exact.drop_exact_copies(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(TANGLED)], "doc_id long, text string, _mark int"))
    got = Counter((r.doc_id, lowered(r.text)) for r in kept.collect())
    assert got == Counter([(5, "x"), (1, "a"), (9, "y"), (7, "z z z"), (None, "n n"), (3, ""), (4, "case"), (6, "q"), (6, "r")])
    again = exact.drop_exact_copies(spark.createDataFrame(TANGLED[::-1], "doc_id long, text string"))
    assert {r.text for r in again.collect() if r.doc_id == 4} == {r.text for r in kept.collect() if r.doc_id == 4}


def test_near_stage_decides_by_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other, far = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(1, text), (2, text), (2, other), (2, other), (None, far), (None, far), (None, text), (8, f"{other} "), (0, None), (None, "")]
    kept = simhash.drop_near_copies(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _id int"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, text), (2, other), (None, far), (0, None)])
    groups = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(groups, "doc_id", "fingerprint", "component_id") == sorted(near_components(rows), key=repr)


def test_directory_doubling():
    random.seed(1)
    sizes = {p: random.choice([0, 1, 5, 40, 400]) for p in range(64)}
    depth, directory = exact.plan_directory(sizes, 6, 100)
    assert len(directory) == 2**depth
    load, prefixes = defaultdict(int), defaultdict(set)
    for p in range(64):
        load[directory[p >> (6 - depth)]] += sizes[p]
        prefixes[directory[p >> (6 - depth)]].add(p)
    for bucket, total in load.items():
        assert total <= 100 or len(prefixes[bucket]) == 1  # overfull only where no bit is left
        assert max(prefixes[bucket]) - min(prefixes[bucket]) + 1 == len(prefixes[bucket])
    assert exact.plan_directory({0: 5}, 0, 1) == (0, [0])


def test_chains_compare_bytes():
    """Texts with one key and even one digest stay apart."""
    names = ["bucket", "_key", "_sha", "_copies", "_largest", "_text"]
    rows = [(0, 1, b"s", 2, 5, b"one"), (0, 1, b"s", 1, 7, b"two"), (0, 1, b"s", 3, None, b"one"), (0, 2, b"t", 1, 1, b"x")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    got = [tuple(r.values()) for b in exact._own(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert got == [(0, 1, 0, b"s", b"one", 5, 5), (0, 1, 1, b"s", b"two", 1, 7), (0, 2, 0, b"t", b"x", 1, 1)]


# --- op 10 -----------------------------------------------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    words = [w.encode() for w in WORD.findall(lowered(text))]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near_components(rows: list[tuple]) -> list[tuple]:
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int | None] = {}
    for i, (doc_id, _) in enumerate(rows):
        root = find(i)
        known = [x for x in (least.get(root), doc_id) if x is not None]
        least[root] = min(known, default=None)
    return [(d, format(p, "016x"), least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def test_near_groups_equal_brute_force(edge, empty):
    rows = [(r.doc_id, r.text if len(r.text or "") < 50_000 else r.text) for r in edge.select("doc_id", "text").collect()]
    got = simhash.near_groups(edge)
    assert collected(got, "doc_id", "fingerprint", "component_id") == sorted(near_components(rows), key=repr)
    assert simhash.near_groups(empty).collect() == []


def test_near_stage(edge):
    kept = simhash.drop_near_copies(edge)
    assert kept.columns == edge.columns
    told = near_components([(r.doc_id, r.text) for r in edge.collect()])
    named = {c for _, _, c in told if c is not None}
    assert None in {c for _, _, c in told} or sorted(r.doc_id for r in kept.collect()) == sorted(named)


def test_no_pair_within_the_radius_is_missed(spark):
    """Random walks of up to four flipped bits: every link's components come out, in one block and in many."""
    random.seed(3)
    prints = []
    for _ in range(40):
        now = random.getrandbits(64)
        for _ in range(random.randint(1, 12)):
            prints.append(now)
            for _ in range(random.randint(1, 6)):
                now ^= 1 << random.randrange(64)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    a, b = zip(*[(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    label = simhash.smallest_labels(len(prints), np.array(a), np.array(b))
    expected = {frozenset(signed[i] for i in np.flatnonzero(label == x)) for x in set(label.tolist()) if (label == x).sum() > 1}
    data = spark.createDataFrame([(p,) for p in signed], "_print long")
    for block in (simhash.BLOCK, 1):
        groups = defaultdict(set)
        for r in graph.components(simhash.link_edges(data, block)).collect():
            groups[r.root].add(r.node)
        assert {frozenset(g) for g in groups.values()} == expected


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3), (201, 200), (200, 201)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert collected(got, "node", "root") == sorted(
        [(i, 0) for i in range(61)] + [(i, 100) for i in range(100, 130)] + [(200, 200), (201, 200)], key=repr)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hot_fingerprint_is_one_row(spark):
    """A text that a third of all rows share is indexed once."""
    data = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c d e").otherwise(
        F.concat_ws(" ", "id", F.col("id") * 7, F.col("id") * 11, F.col("id") * 13, F.col("id") * 17)).alias("text"))
    got = simhash.near_groups(data).where("doc_id % 3 = 0").select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]
