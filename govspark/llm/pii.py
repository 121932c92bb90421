"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes for what they miss.

Base spans (e-mail, ip, card, phone) follow fixed patterns and always stay. The field is trained from a small labelled
table (``labelled_rows``: sentences made from a fixed list of templates and a seed) on shape features of a word and
its neighbours, and decoded by Viterbi in numpy batches. It adds spans of the same four kinds where a written form
escapes the patterns, such as a telephone number without a plus sign; added spans must hold as many digits as the kind
needs (a card also its check digit) and never touch a base span.

The field's sequences are the stretches of a text around words with a digit or an @: such words and ``CONTEXT`` words on
either side, joined where they meet. Elsewhere there is nothing of these kinds to find.

Scale: one pass over whole texts, no shuffle; the model is a table of ``FEATURES`` x tags floats.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark.llm.words import BLANK_SEPARATED, bounded_batches, slices

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES = 1 << 12
CONTEXT = 2
STEPS = 80

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def card_like(text: str) -> bool:
    number = digits(text)
    return 13 <= len(number) <= 19 and luhn(number)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the @ signs in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; code points, end exclusive. A failing match is dropped."""
    if not text:
        return []
    found: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if card_like(m[0])]
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return found


# --- the field -------------------------------------------------------------------------------------------------------

_TRAILING = ".,;:!?#$%&*\"'|"


def core(word: str) -> tuple[int, int]:
    """Bounds of a word without quotes in front and punctuation behind."""
    a, b = 0, len(word)
    while b and word[b - 1] in _TRAILING:
        b -= 1
    while a < b and word[a] in "\"'":
        a += 1
    return a, b


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@lru_cache(maxsize=1 << 16)
def word_traits(word: str) -> tuple[str, str, str]:
    """Shape with digit runs by length, coarse kind of content, and the word itself if it has no digit."""
    a, b = core(word)
    own = word[a:b]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 20)}>", own))[:60]
    number = digits(own)
    plain = not number and "@" not in own
    kind = "plain" if plain else "".join((
        "@" if "@" in own else "", "+" if own[:1] == "+" else "", "L" if card_like(own) else "",
        "x" if re.search(r"[^\W\d_]", own) else "", f"n{min(len(number), 20)}", f".{min(own.count('.'), 4)}",
    ))
    return shape if not plain else "a", kind, own.lower()[:20] if plain else "#"


def features(words: list[str]) -> list[list[int]]:
    """Feature slots of each word of a sequence: its own traits and those of its neighbours."""
    traits = [("", "", "")] + [word_traits(w) for w in words] + [("", "", "")]
    return [
        [_slot(f"{name}{at}={traits[i + at][j]}") for at in (-1, 0, 1) for j, name in enumerate(("s", "k", "w"))]
        + [_slot("bias"), _slot(f"k-1k={traits[i - 1][1]}|{traits[i][1]}"), _slot(f"kk+1={traits[i][1]}|{traits[i + 1][1]}")]
        for i in range(1, len(words) + 1)
    ]


SLOTS = 12

#: Labelled sentences: {kind} stands for a value of that kind in one of its written forms; {x...} for what is none.
TEMPLATES = (
    "please write to {email} before noon", "contact {email} or {phone}", "my address is {email}, thanks",
    "call {phone} after six", "tel {phone}", "phone: {phone}.", "reach me at {phone} today", "fax {phone} and {email}",
    "the server {ip} went down", "host {ip} answered", "from {ip} to {ip}", "login at {ip}, then {email}",
    "charge card {card} today", "card number {card}.", "paid with {card} and called {phone}",
    "the word {email} of", "the {phone} of and", "and {ip} the", "that {card} with", "{email}", "{phone}", "{ip}", "{card}",
    "released under version {xversion}", "the licence, version {xsmall}.", "cc by {xversion}.", "in {xyear} there were {xsmall}",
    "token = {xhex} of", "order {xlong} was sent", "the {xlong} and", "number {xlong}!!", "it cost {xmoney} in {xyear}",
    "chapter {xsmall} of {xsmall}", "on {xdate} at {xtime}", "he said @{xsmall} and left", "rate {xversion} % in {xyear}",
    "no numbers here at all", "the and of with", "room {xsmall}, floor {xsmall}", "see {xversion} and {xversion}.",
)


def labelled_rows(n: int = 400, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The labelled table: (words, tags) of ``n`` sentences."""
    random = np.random.default_rng(seed)

    def number(size: int) -> str:
        return "".join(map(str, random.integers(0, 10, size)))

    def checked(good: bool) -> str:
        stem = number(15)
        right = next(d for d in "0123456789" if luhn(stem + d))
        return stem + (right if good else str((int(right) + 1) % 10))

    def grouped(text: str, mark: str) -> str:
        return mark.join(text[i : i + 4] for i in range(0, len(text), 4))

    def name() -> str:
        return "".join(random.choice(list("abcdefghijklmnoprstuvw"), int(random.integers(2, 9))))

    def value(kind: str) -> str:
        pick = int(random.integers(0, 5))
        area, mid, end = number(3), number(3), number(4)
        if kind == "email":
            return f"{name()}{('.', '_', '', '+', '-')[pick]}{number(2) if pick else name()}@{name()}{pick}.{name()}.com"
        if kind == "ip":
            return ".".join(str(int(random.integers(0, 256))) for _ in range(4))
        if kind == "card":
            whole = checked(True)
            return (whole, whole, grouped(whole, " "), grouped(whole, "-"), grouped(whole, "."))[pick]
        if kind == "phone":
            return (f"+1 ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"+49 {area} {mid}{end}",
                    f"{area}.{mid}.{end}")[pick]
        return {"xversion": f"{number(1)}.{number(1)}", "xsmall": number(1 + pick % 2), "xyear": "20" + number(2),
                "xhex": '"' + "".join(random.choice(list("0123456789abcdef"), 40)) + '"', "xlong": checked(False),
                "xmoney": f"${number(3)}.{number(2)}", "xdate": f"20{number(2)}-{number(2)}-{number(2)}",
                "xtime": f"{number(2)}:{number(2)}"}[kind]

    rows = []
    for i in range(n):
        words, tags = [], []
        for piece in TEMPLATES[i % len(TEMPLATES)].split():
            slot = re.search(r"\{(\w+)\}", piece)
            if not slot:
                words.append(piece)
                tags.append("O")
                continue
            text = piece.replace(slot[0], value(slot[1])).split()
            words += text
            kind = slot[1]
            tags += ["O"] * len(text) if kind[0] == "x" else [f"B-{kind}"] + [f"I-{kind}"] * (len(text) - 1)
        rows.append((words, tags))
    return rows


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self) -> None:
        n = len(TAGS)
        self.emit = np.zeros((FEATURES, n))
        self.step = np.zeros((n, n))
        self.begin = np.zeros(n)
        for j, tag in enumerate(TAGS):  # I-k only after B-k or I-k
            if tag[0] == "I":
                self.begin[j] = -1e4
                for i, before in enumerate(TAGS):
                    if before[2:] != tag[2:] or before == "O":
                        self.step[i, j] = -1e4

    def fit(self, rows: list[tuple[list[str], list[str]]], steps: int = STEPS) -> Field:
        """Maximise the conditional likelihood with Adam; all sequences at once, forward and backward in numpy."""
        longest = max(len(w) for w, _ in rows)
        slots = np.zeros((len(rows), longest, SLOTS), dtype=np.int64)
        gold = np.zeros((len(rows), longest), dtype=np.int64)
        real = np.zeros((len(rows), longest), dtype=bool)
        for i, (words, tags) in enumerate(rows):
            slots[i, : len(words)] = features(words)
            gold[i, : len(words)] = [TAGS.index(t) for t in tags]
            real[i, : len(words)] = True
        allowed, start = self.step > -1e3, self.begin > -1e3
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.emit, self.step, self.begin)]
        one = np.eye(len(TAGS))[gold] * real[..., None]
        pairs = np.einsum("bti,btj->ij", one[:, :-1], one[:, 1:])
        for round_ in range(1, steps + 1):
            score = self.emit[slots].sum(axis=2)
            ahead, back = np.zeros_like(score), np.zeros_like(score)
            ahead[:, 0] = self.begin + score[:, 0]
            for t in range(1, longest):
                moved = _lse(ahead[:, t - 1, :, None] + self.step, 1) + score[:, t]
                ahead[:, t] = np.where(real[:, t, None], moved, ahead[:, t - 1])
            for t in range(longest - 2, -1, -1):
                moved = _lse(self.step[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(real[:, t + 1, None], moved, back[:, t + 1])
            total = _lse(ahead[:, -1], 1)
            chance = np.exp(ahead + back - total[:, None, None]) * real[..., None]
            joint = np.zeros_like(self.step)
            for t in range(longest - 1):
                both = ahead[:, t, :, None] + self.step + (score[:, t + 1] + back[:, t + 1])[:, None, :]
                joint += (np.exp(both - total[:, None, None]) * real[:, t + 1, None, None]).sum(axis=0)
            rise = np.zeros_like(self.emit)
            np.add.at(rise, slots, (one - chance)[:, :, None, :])
            grads = (rise - 0.02 * self.emit, (pairs - joint) * allowed - 0.02 * self.step * allowed,
                     (one[:, 0].sum(axis=0) - chance[:, 0].sum(axis=0)) * start)
            for p, g, (m, v) in zip((self.emit, self.step, self.begin), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += 0.1 * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.99**round_)) + 1e-8)
        return self

    def decode(self, sequences: list[list[str]], batch: int = 256) -> list[list[int]]:
        """Best tags of every sequence by Viterbi, in batches of similar length."""
        out: list[list[int]] = [[] for _ in sequences]
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            longest = max(len(sequences[i]) for i in some)
            score = np.zeros((len(some), longest, len(TAGS)))
            lengths = np.array([len(sequences[i]) for i in some])
            for row, i in enumerate(some):
                if sequences[i]:
                    score[row, : lengths[row]] = self.emit[np.array(features(sequences[i]))].sum(axis=1)
            best = self.begin + score[:, 0] if longest else np.zeros((len(some), len(TAGS)))
            origin = np.zeros((longest, len(some), len(TAGS)), dtype=np.int8)
            for t in range(1, longest):
                paths = best[:, :, None] + self.step
                origin[t] = paths.argmax(axis=1)
                moved = paths.max(axis=1) + score[:, t]
                best = np.where((t < lengths)[:, None], moved, best)
            tag = best.argmax(axis=1)
            tags = np.zeros((len(some), longest), dtype=np.int64)
            rows = np.arange(len(some))
            for t in range(longest - 1, -1, -1):
                tags[:, t] = np.where(t < lengths, tag, 0)
                if t:
                    tag = np.where(t < lengths, origin[t, rows, tag], tag)
            for row, i in enumerate(some):
                out[i] = tags[row, : lengths[row]].tolist()
        return out


def plausible(kind: str, text: str) -> bool:
    number = digits(text)
    if kind == "email":
        return "@" in text and "." in text.rpartition("@")[2]
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdecimal() and p.isascii() and int(p) <= 255 for p in parts)
    return card_like(text) if kind == "card" else 9 <= len(number) <= 15


def added_spans(text: str, words: list[tuple[int, int]], tags: list[int], taken: list[Span]) -> list[Span]:
    """Spans of a tagged sequence that are plausible and touch none of ``taken``."""
    found, at = [], 0
    while at < len(tags):
        name = TAGS[tags[at]]
        end = at + 1
        if name[0] == "B":
            while end < len(tags) and TAGS[tags[end]] == f"I-{name[2:]}":
                end += 1
            first, last = words[at], words[end - 1]
            a = first[0] + core(text[slice(*first)])[0]
            b = last[0] + core(text[slice(*last)])[1]
            if a < b and plausible(name[2:], text[a:b]) and not any(s < b and a < e for _, s, e in taken):
                found.append((name[2:], a, b))
        at = end
    return found


def _stretches(marked: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Word ranges around the marked words of one text, joined where they meet."""
    out: list[list[int]] = []
    for w in marked.tolist():
        a, b = max(low, w - CONTEXT), min(high, w + CONTEXT + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_spans(texts: pa.Array, field: Field) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; null counts as empty."""
    for part in slices(texts, BLANK_SEPARATED):
        sign = ((part.data >= 0x30) & (part.data <= 0x39)) | (part.data == 0x40)
        signs = np.concatenate([[0], np.cumsum(sign)])
        points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
        marked = np.flatnonzero(signs[part.ends] > signs[part.starts])
        bounds = np.searchsorted(marked, part.words)
        base, own, sequences = [], [], []
        for i in range(len(part)):
            if bounds[i] == bounds[i + 1]:
                base.append([])
                continue
            low, high = int(part.words[i]), int(part.words[i + 1])
            text = part.data[part.bounds[i] : part.bounds[i + 1]].tobytes().decode()
            base.append(base_spans(text))
            origin = points[part.bounds[i]]
            for a, b in _stretches(marked[bounds[i] : bounds[i + 1]], low, high):
                spans = [(int(points[part.starts[w]] - origin), int(points[part.ends[w]] - origin)) for w in range(a, b)]
                own.append((i, text, spans))
                sequences.append([text[x:y] for x, y in spans])
        every = [list(b) for b in base]
        for (i, text, spans), tags in zip(own, field.decode(sequences), strict=True):
            every[i] += added_spans(text, spans, tags, base[i])
        yield from zip(base, (sorted(s, key=lambda x: (KINDS.index(x[0]), x[1])) for s in every), strict=True)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added of every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and start, joined by commas; base_sha256 is
    the SHA-256 of the base spans joined so. Null and empty texts have none. Repeated rows are each scanned; a null id
    is carried through; an empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    field = Field().fit(labelled_rows())
    shared = docs.sparkSession.sparkContext.broadcast((field.emit, field.step, field.begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = Field()
        trained.emit, trained.step, trained.begin = shared.value
        for batch in batches:
            found = list(find_spans(batch.column("_text"), trained))
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
            base = [_joined(b) for b, _ in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                pa.array([_joined(e) for _, e in found], pa.string()),
                pa.array([len(e) - len(b) for b, e in found], pa.int64()),
            ], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long"
    )
