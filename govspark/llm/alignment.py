"""Token alignment of two tokenizers by lockstep merging of their token ends.

Both tokenizers spell the same bytes, one space and the text. For a whole batch of documents, one NumPy state vector
holds a pointer into the tokens of A and one into those of B per document. Each step links the two current tokens of
every document at once, moves the pointer whose token ends first, moves both and notes a cut where the ends meet, and
drops documents that are finished. Long documents are split beforehand at places where tokens of both begin, so that
a batch takes a bounded number of steps whatever its longest text.

How often a pair of ids is linked corpus-wide: every chunk of documents (one Arrow batch) stores its distinct pairs,
their numbers, and per document which of them it holds how often, all packed. The pairs are summed with Spark, joined
back to the chunks that hold them and evaluated chunk by chunk. What is shuffled are the distinct pairs of chunks and
the packed chunks, never single links; nothing is collected or broadcast.

Encoding: neither tokenizer has a token that goes on behind a space after anything but white space, and neither looks
across such a place. So the stretches between these places are independent, and every distinct one is encoded once
by the libraries, many in one call, and remembered.

Rows: texts that are null, empty, or not spelt back by either tokenizer have no tokens: zeros and ''. Null ids are
carried through, repeated rows count each time, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.arrays import pack, pack_sorted, unpack, unpack_sorted
from govspark.llm.words import bounded_batches
from govspark.session import fresh_path

#: Folder of the vocabulary files, and the two files.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of the texts that are aligned together, tokens between the places where long texts may be split, encoded
#: stretches a worker remembers, and the longest of them worth remembering.
SLICE_CHARS, LANE, REMEMBERED, LONGEST = 1 << 20, 512, 600_000, 64
#: Stretches that are encoded in one call.
CALL = 2000

#: Fixed value: where a byte-level vocabulary cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space in the sense of Unicode (Python's class has four separators more), white space but the space, and the rest.
_SPACE, _ODD, _REST = r"[^\S\x1c-\x1f]", r"[^\S\x1c-\x1f ]", r"[\S\x1c-\x1f]"
#: From a space to before the next one that follows anything but white space.
STRETCH = re.compile(f" +{_REST}*(?:{_ODD}{_SPACE}*{_REST}*)*")


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the other bytes in
    order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A tokenizer: how each token is spelt, and the ids of a text."""

    def __init__(self, spelling: list[bytes], encode: Callable[[str], list[int]]):
        self.spelling, self._encode = spelling, encode
        self.size = np.array([len(s) for s in spelling], dtype=np.int64)

    def spelt(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids.tolist()))

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all stretches in a row, how many each has, and whether they spell it."""
        if len(stretches) > CALL:
            parts = [self.encode(stretches[i : i + CALL]) for i in range(0, len(stretches), CALL)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        whole = "".join(stretches)
        ids = np.array(self._encode(whole), dtype=np.int32)
        if len(stretches) == 1:
            return ids, np.array([len(ids)]), np.array([self.spelt(ids) == whole.encode()])
        want = np.cumsum([len(s.encode()) for s in stretches])
        have = np.cumsum(self.size[ids])
        at = np.searchsorted(have, want)
        if len(ids) and have[-1] == want[-1] and (have[np.minimum(at, len(have) - 1)] == want).all() and self.spelt(ids) == whole.encode():
            return ids, np.diff(at, prepend=-1), np.ones(len(stretches), bool)
        half = len(stretches) // 2  # one of them is not spelt back: find it
        parts = [self.encode(stretches[:half]), self.encode(stretches[half:])]
        return tuple(np.concatenate(x) for x in zip(*parts))


def _byte_bpe(path: str) -> Vocabulary:
    """The vocabulary of the file; an id is also the rank of its merge, which is all that the faster of the two libraries
    that know this kind of vocabulary needs. Tests compare it with the other one."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["id"] for t in content["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in content["model"]["vocab"].items() if i not in special}
    spelling = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        spelling[i] = token
    return Vocabulary(spelling, tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)


def _piece_bpe(path: str) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)

    def spelt(i: int) -> bytes:
        piece = processor.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode()

    space = [processor.piece_to_id("▁")]
    # The model puts a space before what it is given, but not before nothing; every stretch begins with one.
    return Vocabulary([spelt(i) for i in range(processor.get_piece_size())], lambda text: processor.encode(text[1:]) or space)


class Memory:
    """What both tokenizers make of the stretches seen so far."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.vocabularies = (a, b)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32)] * 2
        self.ends = [np.zeros(1, np.int64)] * 2
        self.sound = [np.zeros(0, bool)] * 2

    def _learn(self, new: list[str]) -> None:
        self.known.update(zip(new, range(len(self.sound[0]), len(self.sound[0]) + len(new))))
        for k, vocabulary in enumerate(self.vocabularies):
            ids, sizes, sound = vocabulary.encode(new)
            self.ids[k] = np.concatenate([self.ids[k], ids])
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(sizes)])
            self.sound[k] = np.concatenate([self.sound[k], sound])

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer the ids of all texts in a row and where each text begins and the last ends. A text that
        is empty or that one of them does not spell back has none."""
        if len(self.sound[0]) > REMEMBERED:
            self._forget()
        flat, counts = [], []
        for text in texts:
            found = STRETCH.findall(text)
            flat += found
            counts.append(len(found))
        if new := list(set(flat).difference(self.known)):
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        for s in new:
            if len(s) > LONGEST:
                del self.known[s]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        holds = np.ones(len(texts), dtype=bool)
        for vocabulary, ids, ends, sound in zip(self.vocabularies, self.ids, self.ends, self.sound):
            wrong = np.concatenate([[0], np.cumsum(~sound[place])])[bounds]
            for k in np.flatnonzero(wrong[1:] != wrong[:-1]).tolist():
                own = place[bounds[k] : bounds[k + 1]].tolist()
                holds[k] &= b"".join(vocabulary.spelt(ids[ends[p] : ends[p + 1]]) for p in own) == texts[k].encode()
        kept = place[np.repeat(holds, counts)]
        bounds = np.concatenate([[0], np.cumsum(np.where(holds, counts, 0))])
        out = []
        for ids, ends in zip(self.ids, self.ends):
            first, sizes = ends[kept], ends[kept + 1] - ends[kept]
            stops = np.concatenate([[0], np.cumsum(sizes)])
            out.append((ids[np.repeat(first - stops[:-1], sizes) + np.arange(stops[-1])], stops[bounds]))
        return out


@lru_cache(maxsize=1)
def memory(folder: str) -> Memory:
    """The two tokenizers of a worker, and what it remembers."""
    return Memory(_byte_bpe(f"{folder}/{FILE_A}"), _piece_bpe(f"{folder}/{FILE_B}"))


# --- lockstep merging ---------------------------------------------------------------------------------------------


def lanes(end_a: np.ndarray, end_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray,
          length: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """First token of A and of B of every lane: where texts begin, and within long texts about every ``length`` tokens
    of A where a token of B begins too."""
    own = np.arange(len(end_a)) - np.repeat(bounds_a[:-1], np.diff(bounds_a))
    inner = np.flatnonzero((own % length == 0) & (own > 0))
    at = np.searchsorted(end_b, end_a[inner - 1])
    meets = end_b[at] == end_a[inner - 1]
    return np.union1d(bounds_a[:-1], inner[meets]), np.union1d(bounds_b[:-1], at[meets] + 1)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray,
             first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (token of A, token of B) whose byte ranges overlap, and whether both end there.

    ``end_a``, ``end_b``: byte ends of all tokens of all lanes; ``first_a``, ``first_b``: where the lanes begin. The
    links of a lane come in order, one per step.
    """
    a, b = first_a.astype(np.int32), first_b.astype(np.int32)
    stop = np.append(first_a[1:], len(end_a)).astype(np.int32)
    links_a, links_b, cuts = [], [], []
    while len(a):
        here_a, here_b = end_a[a], end_b[b]
        cut = here_a == here_b
        links_a.append(a)
        links_b.append(b)
        cuts.append(cut)
        a, b = a + (here_a <= here_b), b + (here_b <= here_a)
        alive = a < stop
        if not alive.all():
            a, b, stop = a[alive], b[alive], stop[alive]
    if not cuts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
    return np.concatenate(links_a), np.concatenate(links_b), np.concatenate(cuts)


def spelt_groups(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text. ``cut_a``, ``cut_b``: last tokens of the groups, in order; ``bounds``: where the
    texts begin among all tokens, those of A and of B counted together."""
    group_a = np.searchsorted(cut_a, np.arange(len(ids_a)))
    group_b = np.searchsorted(cut_b, np.arange(len(ids_b)))
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], cut_b + 1])[group_a]
    place_b = np.arange(len(ids_b)) + cut_a[group_b] + 1
    ids = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    ids[place_a], ids[place_b] = ids_a, ids_b
    behind = np.full(len(ids), ord(","), dtype=np.uint8)
    behind[place_a[cut_a]], behind[place_b[cut_b]] = ord("|"), ord(";")
    table, digits = decimal_table(int(ids.max(initial=0)))
    letters, sizes = table[ids], digits[ids]
    letters[np.arange(len(ids)), sizes] = behind
    spelt = letters[np.arange(letters.shape[1]) <= sizes[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])[bounds]
    return [spelt[x : y - 1] for x, y in zip(ends.tolist(), ends[1:].tolist())]


@lru_cache(maxsize=4)
def _decimals(width: int) -> tuple[np.ndarray, np.ndarray]:
    texts = [str(i).encode() for i in range(10**width)]
    table = np.array(texts, dtype=f"S{width + 1}").view(np.uint8).reshape(len(texts), -1)
    return table, np.array([len(t) for t in texts])


def decimal_table(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers up to at least ``most``, with room for one letter more, and how many there are."""
    return _decimals(len(str(most)))


class Aligned:
    """Alignment of some texts: per text the numbers of tokens, groups, links, the digest, and its pairs of ids."""

    def __init__(self, texts: list[str | None], known: Memory):
        a, b = known.vocabularies
        (ids_a, bounds_a), (ids_b, bounds_b) = known([f" {t}" if t else "" for t in texts])
        sizes_a, sizes_b = np.diff(bounds_a), np.diff(bounds_b)
        end_a, end_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
        some = np.flatnonzero(sizes_a)
        of_some = [np.append(x[some], x[-1]) for x in (bounds_a, bounds_b)]
        left, right, cut = lockstep(end_a, end_b, *lanes(end_a, end_b, *of_some))
        cut_a, cut_b = np.sort(left[cut]), np.sort(right[cut])
        self.n_a, self.n_b = sizes_a, sizes_b
        self.n_groups = np.diff(np.searchsorted(cut_a, bounds_a))
        text = np.repeat(np.arange(len(texts)), sizes_a)[left]
        self.n_links = np.bincount(text, minlength=len(texts))
        groups = spelt_groups(ids_a, ids_b, cut_a, cut_b, of_some[0] + of_some[1])
        self.digests = [""] * len(texts)
        for k, spelt in zip(some.tolist(), groups):
            self.digests[k] = hashlib.sha256(spelt).hexdigest()
        self.text, self.id_a, self.id_b = text, ids_a[left], ids_b[right]


# --- corpus-wide numbers ------------------------------------------------------------------------------------------

CHUNK = ("chunk long, doc_id array<long>, own array<int>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "digest array<string>, keys binary, totals binary, bag binary, times binary")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _align(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One row per batch. A pair's key is id_a * size of B + id_b; ``keys`` are the chunk's distinct ones in order,
    ``bag`` numbers (distinct text, key), ``times`` says how often each is linked."""
    known = memory(folder)
    a, b = known.vocabularies
    width = len(b.spelling)
    schema = None
    for number, batch in enumerate(batches):
        codes = batch.column("_text").dictionary_encode(null_encoding="encode")
        own = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers, digests, texts, keys, times, done = [], [], [], [], [], 0
        for part in _slices(codes.dictionary.to_pylist()):
            found = Aligned(part, known)
            key = found.id_a.astype(np.int64) * width + found.id_b
            pairs = np.sort(found.text * np.int64(len(a.spelling) * width) + key)
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            times.append(np.diff(np.append(first, len(pairs))))
            text, key = np.divmod(pairs[first], len(a.spelling) * width)
            texts.append(text + done)
            keys.append(key)
            numbers.append(np.stack([found.n_a, found.n_b, found.n_groups, found.n_links]))
            digests += found.digests
            done += len(part)
        key, times = np.concatenate(keys), np.concatenate(times)
        distinct, code = np.unique(key, return_inverse=True)
        copies = np.bincount(own, minlength=done)  # a text that repeats in the batch is linked once for each row
        totals = np.bincount(code, weights=times * copies[np.concatenate(texts)], minlength=len(distinct)).astype(np.int64)
        bag = np.concatenate(texts) * len(distinct) + code
        chunk = (TaskContext.get().partitionId() << 33) + number
        many = np.concatenate(numbers, axis=1)[:, own]
        values = [[chunk], [batch.column("_id")], [own.astype(np.int32)], *([n] for n in many), [[digests[i] for i in own.tolist()]],
                  [pack_sorted(distinct.astype(np.uint64))], [pack(totals)], [pack_sorted(bag.astype(np.uint64))], [pack(times)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), *[pa.binary()] * 4]
        schema = schema or pa.schema([pa.field(c.split()[0], k) for c, k in zip(CHUNK.split(", "), kinds)])
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], schema=schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each chunk, one per row."""
    for batch in batches:
        for chunk, keys, totals in zip(*(batch.column(c).to_pylist() for c in ("chunk", "keys", "totals"))):
            key, n = unpack_sorted(keys).astype(np.int64), unpack(totals).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk)), pa.array(key), pa.array(n)], names=["chunk", "key", "n"])


def _evaluate(chunks: pa.Table, counts: pa.Table) -> pa.Table:
    """Rows of one chunk, from its packed pairs and their corpus-wide numbers."""
    counts = counts.sort_by("key")
    n, best = counts["n"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False).astype(np.int64)
    [row] = chunks.to_pylist()
    own, bag, times = np.array(row["own"], np.int64), unpack_sorted(row["bag"]).astype(np.int64), unpack(row["times"]).astype(np.int64)
    text, code = np.divmod(bag, max(1, len(n)))
    size = int(own.max(initial=-1)) + 1

    def summed(values: np.ndarray) -> np.ndarray:
        bounds = np.searchsorted(text, np.arange(size + 1))
        return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])[own]

    columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], summed(times * best[code]), summed(times * n[code]), row["digest"]]
    kinds = [*[pa.int64()] * 7, pa.string()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in RESULT.split(", ")])


def align_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folder: str = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A is the byte-level vocabulary, B the piece vocabulary of ``folder``. Groups are what lies between the byte offsets
    at which tokens of both end; links are pairs of tokens whose bytes overlap; a pair of ids counts how many links hold
    it corpus-wide. n_best: links whose count is the highest of their B id; count_sum: the counts of all links.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = fresh_path(spark, "alignment-chunks")
    docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(
        partial(_align, folder=folder), CHUNK).write.parquet(path)
    chunks = spark.read.parquet(path)
    held = chunks.select("chunk", "keys", "totals").mapInArrow(_pairs, "chunk long, key long, n long")
    path = fresh_path(spark, "alignment-counts")
    held.groupBy("key").agg(F.sum("n").alias("n")).write.parquet(path)
    counts = spark.read.parquet(path).withColumn("b", F.col("key") % F.lit(len(_piece_bpe(f"{folder}/{FILE_B}").spelling)))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    ranked = counts.join(highest, "b").select("key", "n", (F.col("n") == F.col("highest")).alias("best"))
    known = held.select("chunk", "key").join(ranked, "key").select("chunk", "key", "n", "best")
    return chunks.drop("keys", "totals").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_evaluate, RESULT)
