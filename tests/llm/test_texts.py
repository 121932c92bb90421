"""Classifiers, personal data, licences, benchmark leaks, the language model and packing."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govspark.llm import arrays, decontaminate, kneser_ney, language, licenses, packing, pii, quality
from govspark.llm.words import ALPHANUMERIC, run_hashes, slices
from tests.llm.conftest import collected

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op 2 ------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(bad) > 10 and (good[:, None] > bad[None]).mean() > 0.95
    assert ((got.predicted == 1) == (got.score >= 0.5)).all()


def test_quality_never_sees_held_out_labels(spark, edge):
    labels = [(i, i % 2) for i in range(30)]
    flipped = [(i, 1 - q if language.is_held_out(i, 3, 1) else q) for i, q in labels]
    data = edge.select("doc_id", "text", "lang")
    frames = [spark.createDataFrame([*x, (None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, quality int") for x in (labels, flipped)]
    one, two = (collected(quality.score(data, f), "doc_id", "held_out", "score", "predicted") for f in frames)
    assert one == two and len(one) == edge.count() and all(0 <= r[2] <= 1 for r in one)
    assert all(r[1] == (r[0] is not None and language.is_held_out(r[0], 3, 1)) for r in one)


def test_quality_without_labels(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(edge, none).collect()} == {0.5}
    assert quality.score(empty, none).collect() == []


def test_dual_coordinate_descent_reaches_the_optimum():
    """The duality gap of the hinge-loss problem closes."""
    random = np.random.default_rng(0)
    sets = [np.sort(random.choice(40, 8, replace=False)) for _ in range(80)]
    values = [np.full(8, 8**-0.5) for _ in sets]
    sign = np.where([s.min() < 4 for s in sets], 1.0, -1.0)
    cost = np.full(80, 0.7)
    w, b = quality.dual_coordinate_descent(sets, values, sign, cost, epochs=400)
    margins = np.array([w[s] @ v + b for s, v in zip(sets, values)])
    norm = (w @ w + b * b) / 2
    primal = norm + (cost * np.maximum(0, 1 - sign * margins)).sum()
    other = np.random.default_rng(1)
    for _ in range(200):
        dw, db = other.normal(0, 0.05, len(w)) * (w != 0), other.normal(0, 0.05)
        moved = np.array([(w + dw)[s] @ v + b + db for s, v in zip(sets, values)])
        assert ((w + dw) @ (w + dw) + (b + db) ** 2) / 2 + (cost * np.maximum(0, 1 - sign * moved)).sum() > primal - 1e-2


# --- op 7 ------------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_edges(edge, empty):
    got = language.identify(edge, 50).collect()
    assert len(got) == edge.count()
    texts = {r.doc_id: r.text for r in edge.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            lettered = texts[r.doc_id] is not None and any(c.isalpha() for c in texts[r.doc_id])
            assert (r.lang_pred in ("en", "fr")) is lettered and (lettered or r.score == 0)
    assert language.identify(empty).collect() == []
    assert {r.lang_pred for r in language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.keep_identified(edge, 50)
    assert kept.columns == edge.columns
    gone = {r.doc_id for r in got if r.lang_pred == "und" or r.ambiguous} - {None}
    assert {r.doc_id for r in kept.collect()} - {None} == set(texts) - gone


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    least = {1: 0, 2: 1, 4: 4, 5: 8, 9: 8}[n]
    assert all((code[i] != code[j]).sum() >= least for i in range(n) for j in range(i))
    assert n == 1 or not (np.abs(code.sum(axis=0)) == n).any()


def test_decoding_trusts_better_bits_and_flags_ties():
    code = language.codewords(3)
    model = language.Model(["a", "b", "c"], code, np.full(code.shape, 1 / 3), np.eye(3, dtype=np.float32), np.zeros(3))
    best, score, lead = model.decode(np.array([code[1] * 5, code[2] * 5, np.zeros(3)], dtype=np.float32))
    assert best[:2].tolist() == [1, 2] and (score[:2] > 0.9).all() and lead[2] < language.AMBIGUITY


# --- op 4 ------------------------------------------------------------------------------------------------------------


def plain_base(text: str) -> list[tuple]:
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PIECES = ["a@b.c", "@", ".", "x.y@z-1.com", "1.2.3.4", "999.1.1.1", "0001.2.3.4.5", " ", "-", "4539578763621486", "49927398716",
          "+1 (017) 555-7713", "+", "(", "12", "é", "\n", "a@b@c.d", "+49 30 1234567", "4539 5787 6362 1486", "%", "٣"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_base_spans_equal_the_patterns(pieces):
    text = "".join(pieces)
    assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def field():
    return pii.Field().fit(pii.labelled_rows())


def test_field_tags_unseen_sentences(field):
    rows = pii.labelled_rows(200, seed=77)
    tags = [[pii.TAGS[t] for t in s] for s in field.decode([w for w, _ in rows])]
    assert sum(t == g for t, (_, g) in zip(tags, rows)) >= 190


def test_viterbi_finds_the_best_path(field):
    words = "call (017) 555-7713 or a.1@b.com".split()
    emit = np.array([field.emit[s].sum(axis=0) for s in pii.features(words)])
    best = max(itertools.product(range(len(pii.TAGS)), repeat=len(words)), key=lambda p: field.begin[p[0]] + emit[0, p[0]]
               + sum(field.step[a, b] + emit[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:]))))
    assert field.decode([["x"], words, words * 3])[1] == list(best)


def test_field_adds_what_patterns_miss(field):
    text = "Please call (017) 555-7713 today. Version 2.0 in 1999, é 9807915762804491 and x.1@mail.com here"
    base, every = next(pii.find_spans(pa.array([text]), field))
    assert base == plain_base(text) and set(base) <= set(every)
    assert [text[a:b] for k, a, b in set(every) - set(base)] == ["(017) 555-7713"]


def test_scan_columns(edge, empty):
    texts = [(r.doc_id, r.text or "") for r in edge.collect()]
    expected = []
    for doc_id, text in texts:
        base = plain_base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        expected.append((doc_id, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest()))
    got = pii.scan(edge)
    assert collected(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected, key=repr)
    assert pii.scan(empty).collect() == []


def test_base_spans_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000):
        pii.base_spans(text)


# --- op 5 ------------------------------------------------------------------------------------------------------------

BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def test_license_base_equals_brute_force(spark, edge, empty):
    extra = ["CC BY-NC CC by nc, cc; by. nc under the MIT license", "cc by nc by nc", "Apache License, Version 2.0 é",
             "This work is licensed under the GNU General Public License, version 3.", "mit license", "the the mit"]
    data = edge.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(extra, 500)), "doc_id long, text string"))
    expected = []
    for r in data.collect():
        words = PLAIN.findall((r.text or "").translate(LOWER))
        places = [(i, label) for label, phrase in BASE.items() for i in range(len(words))
                  if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        expected.append((r.doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted({x for _, x in places}))))
    got = licenses.scan(data)
    assert collected(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expected, key=repr)
    found = {r.doc_id: r for r in got.collect()}
    assert found[503].labels == "gpl-3" and found[503].base_labels == "" and found[503].score > 0.5
    assert found[500].labels == "cc-by-nc,mit" and found[505].labels == "" and found[505].score == 0
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in found.values())
    assert licenses.scan(empty).collect() == []


def test_license_scan_is_native(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_rarest_word_leads():
    idf = {w: 1.0 for w, _, _ in licenses.postings()} | {"mit": 9.0}
    assert "'mit'" in licenses._starts("under the mit license".split(), idf)._jc.toString()


# --- op 6 ------------------------------------------------------------------------------------------------------------


def brute_leaks(docs: list[tuple], items: list[tuple]) -> dict[tuple, float]:
    index, out = decontaminate.Index(items), {}
    for part in slices(pa.array([t for _, t in docs], pa.string()), ALPHANUMERIC, lower=True):
        hashes = part.hashes()
        for one in range(len(part)):
            a, b = part.words[one], part.words[one + 1]
            for item, (item_id, _) in enumerate(items):
                n = index.lengths[item]
                k = min(5, n)
                if not n or b - a < k:
                    continue
                runs = run_hashes(hashes[a:b], np.arange(b - a - k + 1), k)
                if not set(runs.tolist()) & set(index.shingles[item]):
                    continue
                for start in range(b - a):
                    some = runs[start : max(start, min(start + n, b - a) - k + 1)]
                    score = index.similarity(item, decontaminate._multiset(some)) if len(some) else 0
                    key = (docs[part.first + one][0], item_id)
                    if score >= 0.8:
                        out[key] = max(score, out.get(key, 0))
    return out


def test_leaks_equal_brute_force_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = brute_leaks([tuple(r) for r in docs.collect()], [tuple(r) for r in benchmark.orderBy("item_id").collect()])
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaked_pairs(docs, benchmark).collect()}
    assert len(got) > 10 and got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k]) for k in got)


def test_edited_copies_are_found(spark):
    """Copies with an edit near an edge, at any place; recall against brute force and no false match."""
    random.seed(4)
    words = ["w" + "".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(random.choice(words) for _ in range(n))) for i, n in enumerate([1, 3, 5, 8, 13, 20, 33, 47, 60, 90, 300, 400])]
    docs = []
    for i in range(240):
        copy = random.choice(items)[1].split()
        if len(copy) > 12 and i % 2:
            for _ in range(random.randint(1, max(1, len(copy) // 30))):
                at = random.choice([0, 1, len(copy) - 2, len(copy) - 1])
                copy[at : at + 1] = [[], ["changed"], [copy[at], "more"]][random.randint(0, 2)]
                at = random.randrange(len(copy))
        around = [random.choice(words) for _ in range(random.randint(0, 150))]
        cut = random.randint(0, len(around))
        docs.append((i, " ".join([*around[:cut], *copy, *around[cut:]]) if i % 5 else " ".join(around)))
    expected = brute_leaks(docs, items)
    data, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked_pairs(data, benchmark).collect()}
    exact = {k for k, s in expected.items() if s > 0.999}
    assert got <= expected.keys() and exact <= got and len(got) >= 0.95 * len(expected) and len(expected) > 100


def index_leaks(docs: list[tuple], items: list[tuple]) -> dict[tuple, float]:
    index, out = decontaminate.Index(items), {}
    for part in slices(pa.array([t for _, t in docs], pa.string()), ALPHANUMERIC, lower=True):
        for one, found in index.matches(part).items():
            out.update({(docs[part.first + one][0], items[i][0]): s for i, (s, _, _) in found.items()})
    return out


@pytest.mark.parametrize("n", [33, 50, 55, 59, 120])
def test_an_edit_at_every_place_is_found(n):
    """One changed, left out or added word at each place: the pairs and similarities of brute force."""
    random.seed(n)
    words = ["w" + "".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(random.choice(words) for _ in range(n))) for i in range(3)]
    docs = []
    for at, edit in itertools.product(range(n), range(3)):
        copy = items[at % 3][1].split()
        copy[at : at + 1] = [["changed"], [], [copy[at], "more"]][edit]
        around = [[random.choice(words) for _ in range(n + random.randint(0, 20))] for _ in range(2)]
        docs.append((3 * at + edit, " ".join([*around[0], *copy, *around[1]])))
    expected, got = brute_leaks(docs, items), index_leaks(docs, items)
    assert got.keys() == expected.keys() and len(got) > len(docs) // 6
    assert all(math.isclose(got[k], expected[k]) for k in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 90), st.integers(2, 40), st.integers(0, 8))
def test_many_edits_and_repeated_words_equal_brute_force(seed, n, vocabulary, edits):
    """Few different words, so that shingles repeat, and items that share a passage."""
    rng = random.Random(seed)
    draw = lambda m: [f"v{rng.randrange(vocabulary)}" for _ in range(m)]
    passage = draw(n // 3)
    items = [(i, " ".join([*passage, *draw(n - len(passage))])) for i in range(4)]
    docs = []
    for d in range(6):
        copy = rng.choice(items)[1].split()
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(vocabulary)}"
        docs.append((d, " ".join([*(f"f{i}" for i in range(n)), *copy, *draw(rng.randint(0, 60))])))
    expected, got = brute_leaks(docs, items), index_leaks(docs, items)
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k]) for k in got)


def test_leak_edges(spark, edge, empty):
    texts = [r.text for r in edge.collect() if r.text]
    passage = max((t for t in texts if len(t.split()) == 60), key=lambda p: sum(p in t for t in texts))  # the shared one
    benchmark = spark.createDataFrame([(1, passage.upper(), "x"), (1, passage, "y"), (2, None, "z"), (3, "", "z"), (None, "?!", "z")],
                                      "item_id long, text string, doc_id string")
    got = decontaminate.leaked_pairs(edge, benchmark).collect()
    holders = {r.doc_id for r in edge.collect() if r.text and passage in r.text}
    assert Counter((r.doc_id, r.item_id) for r in got) == {(d, 1): 2 for d in holders} and len(holders) == 3
    kept = decontaminate.drop_leaky(edge, benchmark)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 3
    assert decontaminate.leaked_pairs(empty, benchmark).collect() == []
    assert decontaminate.leaked_pairs(edge, benchmark.limit(0)).collect() == []


def test_benchmark_in_chunks(spark, edge, monkeypatch):
    """More items than a chunk holds: the same result."""
    items = [(i, r.text) for i, r in enumerate(edge.collect()) if r.text and 20 < len(r.text.split()) < 300]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = collected(decontaminate.leaked_pairs(edge, benchmark), "doc_id", "item_id", "first_word", "last_word")
    monkeypatch.setattr(decontaminate, "ITEMS", 6)
    assert {r[:2] for r in whole} == {r[:2] for r in collected(decontaminate.leaked_pairs(edge, benchmark), "doc_id", "item_id")}


def test_chunks_weigh_shingles_over_the_whole_benchmark(spark, monkeypatch):
    """Boilerplate of some items and passages of two: the chunk an item falls into does not change its similarity."""
    random.seed(6)
    draw = lambda n: " ".join(f"w{random.randrange(4000)}" for _ in range(n))
    boilerplate, passages = draw(14), [draw(12) for _ in range(20)]
    items = [(i, f"{draw(20)} {passages[i % 20]} {boilerplate if i % 3 else draw(9)}") for i in range(40)]
    docs = []
    for i, text in items:
        copy = text.split()
        copy[random.randrange(len(copy))] = "changed"
        docs.append((i, f"{draw(60)} {' '.join(copy)} {boilerplate if i % 2 else ''} {draw(30)}"))
        docs.append((100 + i, f"{draw(60)} {' '.join(text.split()[:-4])} {passages[i // 2]}"))
    data, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(docs, items)
    for most in (decontaminate.ITEMS, 16):
        monkeypatch.setattr(decontaminate, "ITEMS", most)
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaked_pairs(data, benchmark).collect()}
        assert got.keys() == expected.keys() and len(got) > 30
        assert all(math.isclose(got[k], expected[k]) for k in got)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**128 - 1), st.sets(st.integers(0, 127), max_size=decontaminate.RADIUS + 1))
def test_every_print_within_the_radius_is_a_candidate(value, flips):
    words = lambda v: np.array([[v & (2**64 - 1), v >> 64]], np.uint64)
    near = value
    for bit in flips:
        near ^= 1 << bit
    found = decontaminate.SizeClass(np.array([7]), words(value)).near(words(near))
    assert (len(found[0]) == 1) == (len(flips) <= decontaminate.RADIUS)


def plain_leaks(docs: list[tuple], items: list[tuple]) -> dict[tuple, float]:
    """Best similarity of every leak, from the texts alone: own words, weights and windows, nothing of the module."""
    def shingled(text: str) -> list[tuple]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        k = min(5, len(words))
        return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []

    own = [(i, len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")), Counter(shingled(t))) for i, t in items]
    having = Counter(s for _, _, c in own for s in c)
    weight = lambda s: math.log(1 + len(items) / having.get(s, 1))
    out: dict[tuple, float] = {}
    for doc_id, text in docs:
        shingles = shingled(text)
        for item_id, n, item in own:
            size = sum(item.values())
            if n < 5 or not item:
                continue
            for start in range(1 - size, len(shingles)):
                window = Counter(shingles[max(0, start) : start + size])
                both = sum(weight(s) * m for s, m in (window & item).items())
                either = sum(weight(s) * m for s, m in (window | item).items())
                if both >= 0.8 * either and both:
                    out[doc_id, item_id] = max(both / either, out.get((doc_id, item_id), 0.0))
    return out


def test_leaks_equal_plain_python(spark):
    """Copies with one to three edits anywhere, boilerplate, repeated phrases: recall and precision are whole."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    boilerplate = [rng.choice(words) for _ in range(8)]
    items = [(i, " ".join([rng.choice(words) for _ in range(n)] + boilerplate * (i % 2) + ["again"] * (i % 4)))
             for i, n in enumerate([6, 12, 20, 30, 45, 60])]
    docs = []
    for d in range(180):
        copy = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([["changed"], [], [copy[at], "more"]])
        docs.append((d, " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 40))), *copy, *boilerplate])))
    want = plain_leaks(docs, items)
    data, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaked_pairs(data, benchmark).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(math.isclose(got[k], want[k]) for k in want)


def test_many_items_are_one_pass(spark, monkeypatch):
    """A benchmark of several chunks adds no Python worker to a task."""
    monkeypatch.setattr(decontaminate, "ITEMS", 8)
    benchmark = spark.createDataFrame([(i, f"item {i} " * 6) for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some text", 5)], "doc_id long, text string, _text int")
    found = decontaminate.find_leaks(docs, benchmark)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and found.columns == ["doc_id", "text", "_text", "leaks"]


# --- op 9 ------------------------------------------------------------------------------------------------------------


def tokens(text: str | None) -> list:
    return [*WORD.findall((text or "").translate(LOWER)), None]


class Reference:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts: list) -> None:
        self.count, pairs = Counter(), Counter()
        for t in texts:
            words = tokens(t)
            self.count.update(words)
            pairs.update(zip([None, *words[:-1]], words))
        self.pairs, self.total = pairs, sum(self.count.values())
        self.continued = Counter(b for _, b in pairs)
        self.followers = defaultdict(Counter)
        for (a, _), n in pairs.items():
            self.followers[a][min(n, 3)] += 1
        self.d2, self.d1 = self.rates(pairs), self.rates(self.continued)
        self.freed = sum(self.d1[min(n, 3)] for n in self.continued.values()) / len(pairs) if pairs else 1.0

    @staticmethod
    def rates(counts: Counter) -> list[float]:
        n = [sum(v == k for v in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else 0.0 for k in (1, 2, 3))]

    def chance(self, before, word) -> float:
        c = self.continued[word]
        low = (max(c - self.d1[min(c, 3)], 0) / len(self.pairs) if self.pairs else 0) + self.freed / (len(self.count) + 1)
        if not self.count[before]:
            return low
        n = self.pairs[(before, word)]
        spare = sum(self.d2[k] * m for k, m in self.followers[before].items())
        return (max(n - self.d2[min(n, 3)], 0) + spare * low) / self.count[before]

    def row(self, text) -> tuple:
        words = tokens(text)
        base = sum(math.log10((self.count[w] + 0.1) / (self.total + 0.1 * (len(self.count) + 1))) for w in words)
        score = sum(math.log10(self.chance(a, b)) for a, b in zip([None, *words[:-1]], words))
        return len(words), sum(self.count[w] > 0 for w in words), self.total, base, score


@pytest.mark.parametrize("range_bytes", [kneser_ney.RANGE_BYTES, 20_000])
def test_language_model_equals_dictionaries(spark, edge, documents, range_bytes, monkeypatch):
    monkeypatch.setattr(kneser_ney.train, "__defaults__", (range_bytes,))
    data = edge.select("doc_id", "text").union(documents.where("doc_id < 40").select(F.col("doc_id") + 20_000, "text"))
    rows = [tuple(r) for r in data.collect()]
    held = lambda d: d is not None and language.is_held_out(d, 10, 0)
    reference = Reference([t for d, t in rows if not held(d)])
    assert math.isclose(sum(reference.chance("the", w) for w in [*reference.count, "unseen"]), 1, rel_tol=1e-9)
    expected = sorted(((d, held(d), *reference.row(t)) for d, t in rows), key=repr)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = collected(kneser_ney.score_held_out(data), *columns)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected):
        assert math.isclose(g[5], e[5], rel_tol=1e-9) and math.isclose(g[6], e[6], rel_tol=1e-9)


def test_language_model_of_nothing(edge, empty):
    assert kneser_ney.score_held_out(empty).collect() == []
    got = kneser_ney.score_documents(edge, empty.select("text")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isclose(r.score, 0, abs_tol=1e-9) for r in got)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
def test_packed_arrays(values):
    array = np.array(sorted(values), dtype=np.uint64)
    assert arrays.unpack_sorted(arrays.pack_sorted(array)).tolist() == array.tolist()
    assert arrays.unpack(arrays.pack(array[::-1])).tolist() == array[::-1].tolist()


# --- op 8 ------------------------------------------------------------------------------------------------------------


def check_bins(rows: list, texts: dict, capacity: int) -> None:
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[(r.shard, r.bin)].append(r)
        pieces[r.doc_id].append(r)
    for held in bins.values():
        total = sum(r.n_tokens for r in held)
        assert total <= capacity and {r.bin_tokens for r in held} == {total}
        sources = [r.source for r in held if r.source is not None]
        assert len(sources) == len(set(sources))
        copies = [texts[r.doc_id].translate(LOWER) for r in held if r.doc_id is not None]
        assert len(copies) == len(set(copies))
    for doc_id, text in texts.items():
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) % max(1, len(WORD.findall(text))) == 0
        assert all(r.first_token == r.piece * capacity for r in own)


def test_packing_places_everything(edge, empty):
    texts = {r.doc_id: r.text or "" for r in edge.collect() if r.doc_id is not None}
    for capacity, shard_rows in ((packing.CAPACITY, packing.SHARD_ROWS), (100, 40)):
        check_bins(packing.pack(edge, capacity, shard_rows).collect(), texts, capacity)
    assert len({(r.doc_id) for r in packing.pack(edge).collect()}) == len(texts) + 1
    assert packing.pack(empty).collect() == []


@pytest.mark.parametrize("doc_id", [7, None])
def test_repeated_rows_spread_over_the_shards(spark, doc_id):
    rows = [(doc_id, "one two three", "s")] * 2000 + [(i, f"text {i}", "t") for i in range(1000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), shard_rows=100)
    shards = Counter(r.shard for r in got.collect())
    assert sum(shards.values()) == 3000 and len(shards) == 30 and max(shards.values()) < 200


def test_tightest_compatible_bin():
    """Best fit as one would do it by looking at every bin."""
    random.seed(6)
    pieces = sorted(((random.randint(0, 50), random.randint(0, 5), random.choice([0, 0, 1, 2])) for _ in range(300)), reverse=True)
    bins, plain = packing.Bins(50), []
    for length, source, cluster in pieces:
        fits = [(50 - sum(p[0] for p in b), i) for i, b in enumerate(plain)
                if sum(p[0] for p in b) + length <= 50 and source not in {p[1] for p in b}
                and not (cluster and cluster in {p[2] for p in b})]
        at = min(fits)[1] if fits else len(plain)
        if not fits:
            plain.append([])
        plain[at].append((length, source, cluster))
        assert bins.place(length, 1 << source, 1 << cluster if cluster else 0) == at


def test_hot_source_fills_the_bins(documents):
    """With twenty sources and no conflict to speak of, bins are nearly full."""
    rows = packing.pack(documents).collect()
    used = {(r.shard, r.bin): r.bin_tokens for r in rows}
    assert sum(used.values()) / (len(used) * packing.CAPACITY) > 0.85
