"""Token alignment against the tokenizer libraries and one pair of tokens at a time."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from govspark.llm import alignment
from tests.llm.conftest import DOCUMENT, collected

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["word", "The", " ", "  ", "   ", "\n", "\n\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", "﻿",
       "'s", "'ll", "12", "3.5", "!?", "...", "é", "é", "日本語", "🎉", "<|endoftext|>", "<s>", "<0x0A>", "▁", "\x00", "ﬁ", "\r\n",
       "x" * 70, "def f(x):", "    return"]


@pytest.fixture(scope="module")
def libraries():
    tokenizer = tokenizers.Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.FILE_A}")
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.FILE_B}")


def spelling_a(tokenizer) -> dict[int, bytes]:
    alphabet = {}
    spare = 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            alphabet[chr(byte)] = byte
        else:
            alphabet[chr(spare)] = byte
            spare += 1
    return {i: bytes(alphabet.get(c, 0) for c in token) for token, i in tokenizer.get_vocab().items()}


def spelling_b(processor, i: int) -> bytes:
    piece = processor.id_to_piece(i)
    return bytes([int(piece[3:-1], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode()


def brute(rows: list[tuple], libraries) -> list[tuple]:
    tokenizer, processor = libraries
    bytes_a = spelling_a(tokenizer)
    found, count = [], Counter()
    for doc_id, text in rows:
        ids_a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = processor.encode(text) if text else []
        spans = []
        for ids, spelt in ((ids_a, [bytes_a[i] for i in ids_a]), (ids_b, [spelling_b(processor, i) for i in ids_b])):
            ends = np.cumsum([len(s) for s in spelt]).tolist()
            spans.append([(e - len(s), e, i) for i, e, s in zip(ids, ends, spelt)])
            if b"".join(spelt) != (" " + (text or "")).encode():
                spans = [[], []]
                break
        links = []
        low = 0
        for start, end, i in spans[0]:
            while low < len(spans[1]) and spans[1][low][1] <= start:
                low += 1
            for s, e, j in spans[1][low:]:
                if s >= end:
                    break
                links.append((i, j))
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ";".join(
            "|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans)
            for low, high in zip([0, *cuts], cuts)
        ) if len(spans[0]) < 3000 else None
        digest = "" if not spans[0] else None if groups is None else hashlib.sha256(groups.encode()).hexdigest()
        count.update(links)
        found.append((doc_id, len(spans[0]), len(spans[1]), len(cuts), links, digest))
    highest: Counter = Counter()
    for (_, j), n in count.items():
        highest[j] = max(highest[j], n)
    return [(d, a, b, g, len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), h)
            for d, a, b, g, links, h in found]


def compare(got: list[tuple], want: list[tuple]) -> None:
    """Digests of very long texts are left out of the comparison; those of the rest are not."""
    long = {row[1] for row in want if row[-1] is None}
    strip = lambda rows: sorted((r[:-1] + (None if r[1] in long else r[-1],) for r in rows), key=repr)
    assert strip(got) == strip(want)


def test_alignment_equals_brute_force(documents, libraries):
    some = documents.where(F.length("text") < 4000)
    rows = [tuple(r) for r in some.select("doc_id", "text").collect()]
    compare(collected(alignment.align_tokens(some.repartition(3)), *COLUMNS), brute(rows, libraries))


def test_edge_rows(edge, libraries):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    got = collected(alignment.align_tokens(edge), *COLUMNS)
    compare(got, brute(rows, libraries))
    assert (None, 0, 0, 0, 0, 0, 0, "") in got


def test_empty_table(empty):
    result = alignment.align_tokens(empty)
    assert result.columns == list(COLUMNS) and result.count() == 0


def test_odd_texts(spark, libraries):
    """White space and markers of all kinds; texts a tokenizer does not spell back count as empty."""
    random.seed(3)
    rows = [(i, "".join(random.choice(ODD) for _ in range(random.randint(1, 9)))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENT)
    want = brute(rows, libraries)
    assert any(w[1] == 0 for w in want)
    compare(collected(alignment.align_tokens(docs), *COLUMNS), want)


def test_stretches_are_forgotten_and_learnt_again(libraries, monkeypatch):
    tokenizer, processor = libraries
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    monkeypatch.setattr(alignment, "CALL", 3)
    known = alignment.Memory(*alignment.memory(alignment.FOLDER).vocabularies)
    random.seed(4)
    for _ in range(20):
        texts = [" " + "".join(random.choice(ODD[:20]) for _ in range(12)) + "y" * random.choice([1, 90]) for _ in range(3)]
        (ids_a, bounds_a), (ids_b, bounds_b) = known(texts)
        for k, text in enumerate(texts):
            assert ids_a[bounds_a[k] : bounds_a[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
            assert ids_b[bounds_b[k] : bounds_b[k + 1]].tolist() == processor.encode(text[1:])


@pytest.mark.parametrize("length", [1, 3, 512])
def test_lanes_change_nothing(length):
    """Random token ends; the links of all lanes are those of the whole texts."""
    rng = np.random.default_rng(length)
    ends, bounds = [], []
    sizes = [60, 1, 200, 7]
    for _ in range(2):
        parts = [np.unique(np.append(rng.integers(1, s + 1, s // 2), s)) for s in sizes]
        starts = np.cumsum([0, *sizes[:-1]])
        ends.append(np.concatenate([p + s for p, s in zip(parts, starts)]))
        bounds.append(np.cumsum([0, *map(len, parts)]))
    first_a, first_b = alignment.lanes(*ends, *bounds, length)
    assert (length == 512) == (len(first_a) == len(sizes))
    a, b, cut = alignment.lockstep(*ends, first_a, first_b)
    begins = [np.concatenate([[0], e[:-1]]) for e in ends]
    want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
            if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]}
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want
    assert sorted(ends[0][a[cut]].tolist()) == sorted(set(ends[0]) & set(ends[1]))


def test_a_pair_counts_in_all_chunks(spark):
    """Repeated texts in one chunk and in several count once for each row."""
    docs = spark.createDataFrame([(i, "same words here", "en", "s", 1) for i in range(40)], DOCUMENT).repartition(4)
    got = collected(alignment.align_tokens(docs), *COLUMNS)
    one = collected(alignment.align_tokens(docs.where("doc_id = 0")), *COLUMNS)[0]
    assert {r[4] for r in got} == {one[4]} and {r[6] for r in got} == {one[6] * 40}
