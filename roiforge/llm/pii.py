"""Personal data: base patterns, and further spans chosen by gradient-boosted trees over candidates.

High-recall generators propose overlapping spans of the base kinds in other forms (spelt-out addresses, IPv6, cards with odd separators,
national phone numbers) and of secrets (keys and tokens). Boosted trees score them from their format and the words around, with scores
calibrated on held-out cases; a threshold for each kind selects. The trees are fitted here, on generated cases of what is and
what only looks like personal data: the tables hold no labels for it.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roiforge.llm.common import sliced, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: the base ones, and one that only the trees add.
ALL_KINDS = (*KINDS, "secret")

# --- base patterns ---------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each @ in turn, the run of local characters before it and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by the base patterns, ordered by start and then kind."""
    found = [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 12 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_only_digits(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# --- candidates ------------------------------------------------------------------------------------------------------

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*+)"
_GENERATORS = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({{] ?at ?[\])}}] ?{_LABEL}(?: ?(?:[\[({{] ?dot ?[\])}}]|\.) ?{_LABEL})+", re.I), re.compile(r"[\[({] ?at ?[\])}]", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"), re.compile(r":[0-9A-Fa-f]{1,4}:")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"), re.compile(r"[0-9A-Fa-f]::[0-9A-Fa-f]")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,3}[0-9]{4}){3}(?![0-9])"), _DIGIT),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"), _DIGIT),
    ("phone", re.compile(r"(?<![0-9+.])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,4}){2,4}(?![0-9.])"), _DIGIT),
    ("phone", re.compile(r"(?<![0-9+.A-Za-z])0[0-9]{8,12}(?![0-9.A-Za-z])"), _DIGIT),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.-]{16,}+(?![A-Za-z0-9+/_.-])={0,2}"), _DIGIT),
)

# fixed values: words that speak for or against a kind when they stand near
_CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "ipv6", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "móvil", "appelez"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "auth", "bearer", "credential", "credentials"),
    "other": ("order", "invoice", "isbn", "version", "id", "ref", "item", "page", "total", "code", "serial", "date", "chapter", "commit", "checksum", "hash", "file", "revision", "etag", "parcel"),
}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_GROUPS = re.compile(r"[0-9]+")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of all generators."""
    return [(kind, *m.span()) for kind, pattern, hint in _GENERATORS if hint.search(text) for m in pattern.finditer(text)]


def _share(n: int, of: int) -> float:
    return n / of if of else 0.0


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate: the words within 40 characters before it and 25 after it."""
    span = text[start:end]
    digits = _only_digits(span)
    groups = _GROUPS.findall(span)
    sizes = [len(g) for g in groups]
    letters = [c for c in span if c.isalpha()]
    counts = [span.count(c) for c in set(span)]
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in counts)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])]
    around, last = set(before), before[-1:]
    after = {w.lower() for w in _WORD.findall(text[end : end + 25])}
    near = text[max(0, start - 4) : start].rstrip(" \"'")
    told = lambda words, k: float(any(w in words for w in _CONTEXT[k]))
    return [
        float(ALL_KINDS.index(kind)), float(len(span)), float(len(digits)), float(len(sizes)), float(max(sizes, default=0)), float(min(sizes, default=0)), *(float(n) for n in (sizes + [0, 0, 0, 0])[:4]),
        float(luhn(digits)) if digits else 0.0, float(len(set(digits))), float(min(int(groups[0][:6]), 9999)) if groups else 0.0, float(digits[:1] == "0"), float("(" in span), float(span.count("-")), float(span.count(".")), float(span.count("/")), float(span.count("_")), float(" " in span),
        _share(len(letters), len(span)), _share(sum(c.isupper() for c in letters), len(letters)), entropy, _share(switches, len(span)), float(all(c in "0123456789abcdefABCDEF" for c in span)),
        float(near[-1:] in ("=", ":")), float(text[start - 1 : start] in ("'", '"') and text[end : end + 1] in ("'", '"')), float(start > 0 and text[start - 1].isalnum()), float(end < len(text) and text[end].isalnum()), float(text[max(0, start - 1) : start] in ("/", "#", "$", "€", "£")),
        told(around, kind), told(last, kind), told(around, "other"), told(last, "other"), told(after, "other"),
    ]


# --- boosted trees ---------------------------------------------------------------------------------------------------


class Trees:
    """Gradient boosting of depth-limited trees on logistic loss, with scores calibrated by a logistic line."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.3, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.penalty = rounds, depth, rate, penalty
        self.trees: list[list[tuple]] = []
        self.line = (1.0, 0.0)

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes (feature, cut, left, right, value), a leaf having feature -1."""
        nodes: list[tuple] = []

        def build(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes.append((-1, 0.0, 0, 0, float(total_g / (total_h + self.penalty) * self.rate)))
            best = (1e-6, -1, 0.0)
            if depth < self.depth and len(rows) >= 20:
                base = total_g**2 / (total_h + self.penalty)
                for f in range(x.shape[1]):
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    v = x[order, f]
                    left_g, left_h = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                    gain = left_g**2 / (left_h + self.penalty) + (total_g - left_g) ** 2 / (total_h - left_h + self.penalty) - base
                    gain[v[1:] == v[:-1]] = -1
                    k = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[k] > best[0]:
                        best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
            if best[1] >= 0:
                goes = x[rows, best[1]] <= best[2]
                left, right = build(rows[goes], depth + 1), build(rows[~goes], depth + 1)
                nodes[at] = (best[1], best[2], left, right, 0.0)
            return at

        build(np.arange(len(x)), 0)
        return nodes

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            f, cut, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
            for _ in range(self.depth):
                inner = f[at] >= 0
                goes = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            out += value[at]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        held = np.arange(len(x)) % 4 == 0
        score = np.zeros(int((~held).sum()))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._tree(x[~held], y[~held] - p, p * (1 - p)))
            score = self.raw(x[~held])
        z, t, a, b = self.raw(x[held]), y[held], 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a -= 0.02 * float(((p - t) * z).mean() + 0.01 * (a - 1))
            b -= 0.2 * float((p - t).mean())
        self.line = (a, b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.line[0] * self.raw(x) + self.line[1])))


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card_number(rng: random.Random) -> str:
    head = "4" + _number(rng, 14)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


_SYLLABLES = ("ta", "re", "mi", "lo", "ven", "dor", "is", "an", "ku", "pe", "sol", "ti")
_HEX, _BASE62 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))


def _drawn(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def _real(rng: random.Random, kind: str) -> str:
    """Personal data of a kind, in one of the forms that the base patterns leave out."""
    n = functools.partial(_number, rng)
    sep = rng.choice([".", "-", " "])
    if kind == "email":
        dot = rng.choice([" [dot] ", "(dot)", " dot ".replace(" dot ", " {dot} "), "."])
        return f"{_word(rng)}{rng.choice(['', '.' + _word(rng), n(2)])}{rng.choice([' [at] ', '(at)', ' {at} '])}{_word(rng)}{dot}{rng.choice(['com', 'org', 'net', 'de', 'es'])}"
    if kind == "ip":
        parts = [f"{rng.randrange(1, 65536):x}" for _ in range(8)]
        return ":".join(parts) if rng.random() < 0.6 else ":".join(parts[: rng.randint(2, 4)]) + "::" + ":".join(parts[: rng.randint(1, 3)])
    if kind == "card":
        digits = _card_number(rng)
        return rng.choice([" - ", ".", "_", "/"]).join(digits[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        forms = (lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: sep.join((n(3), n(3), n(4))), lambda: f"0{n(rng.randint(8, 11))}", lambda: f"0{n(2)} {n(4)} {n(4)}", lambda: " ".join(["0" + n(1), *(n(2) for _ in range(4))]))
        return rng.choice(forms)()
    forms = (lambda: _drawn(rng, _HEX, rng.choice([32, 40, 64])), lambda: _drawn(rng, _HEX, rng.choice([32, 40, 64])).upper(), lambda: _drawn(rng, _BASE62, rng.randint(20, 64)), lambda: f"{rng.choice(['sk', 'pk', 'ghp', 'xoxb'])}{rng.choice('-_')}{_drawn(rng, _BASE62, rng.randint(20, 40))}", lambda: _drawn(rng, _BASE62 + "+/", 44))
    return rng.choice(forms)()


def _decoy(rng: random.Random, kind: str) -> str:
    """What the generators take for a kind and isn't: dates, prices, versions, references, hashes of files."""
    n = functools.partial(_number, rng)
    year = str(rng.randint(1900, 2030))
    if kind == "email":
        return f"{_word(rng)} (at) {_word(rng)}. {_word(rng).capitalize()}"
    if kind == "ip":
        return ":".join(f"{rng.randrange(100):02d}" for _ in range(8))
    if kind == "card":
        return rng.choice((lambda: n(rng.randint(13, 19)), lambda: rng.choice([" - ", ".", "_", "/"]).join((n(4), n(4), n(4), n(4)))))()
    if kind == "phone":
        forms = (lambda: f"{year}-{n(2)}-{n(2)}", lambda: f"{n(2)}.{n(2)}.{year}", lambda: f"{n(2)}/{n(2)}/{year}", lambda: f"978-{n(2)}-{n(4)}-{n(3)}", lambda: " ".join(n(rng.randint(2, 4)) for _ in range(rng.randint(3, 5))), lambda: f"{n(3)} {n(3)} {n(3)}", lambda: f"{n(4)}-{n(4)}-{n(4)}", lambda: f"{year} {year} {year}")
        return rng.choice(forms)()
    forms = (lambda: _drawn(rng, _HEX, rng.choice([32, 40, 64])), lambda: "-".join(_drawn(rng, _HEX, k) for k in (8, 4, 4, 4, 12)), lambda: f"{_word(rng)}_{_word(rng)}_{_word(rng)}_{n(3)}.{rng.choice(['jpg', 'pdf', 'py'])}", lambda: f"www.{_word(rng)}.org/{_word(rng)}/{_word(rng)}/{n(5)}", lambda: n(rng.randint(16, 30)), lambda: f"{year}-{n(2)}-{n(2)}-{_word(rng)}-{_word(rng)}")
    return rng.choice(forms)()


def generated_cases(n: int = 6000, seed: int = 3) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """Candidates in made-up sentences, with labels: 1 where the span was put there as personal data.

    Of the real ones most, and of the decoys some, follow a word that speaks for them; words near may belong to something else. A form that
    real ones and decoys share is personal data only where it is told to be.
    """
    rng = random.Random(seed)
    cases, labels = [], []
    while len(cases) < n:
        kind, real = rng.choice(ALL_KINDS), rng.random() < 0.5
        span = _real(rng, kind) if real else _decoy(rng, kind)
        if real:
            told = rng.choice(_CONTEXT[kind]) if rng.random() < 0.85 or kind in ("secret", "phone") else _word(rng)
        else:
            told = rng.choice(_CONTEXT["other"]) if rng.random() < 0.5 else _word(rng)
        joint = rng.choice([": ", " ", " = " if kind == "secret" else ": ", " = \"" if kind == "secret" else " "])
        quote = '"' if joint.endswith('"') else ""
        before, after = [_word(rng) for _ in range(rng.randint(1, 5))], [_word(rng) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.3:  # a telling word that belongs to something else
            before.insert(0, rng.choice(_CONTEXT[rng.choice(list(_CONTEXT))]))
        told = rng.choice((str, str.upper, str.capitalize))(told)
        text = " ".join([*before, f"{told}{joint}{span}{quote}", *after])
        at = text.index(span)
        for c in candidates(text):
            if c[0] == kind and c[1] < at + len(span) and c[2] > at:
                cases.append((text, *c))
                labels.append(float(real))
    return cases, np.array(labels)


@functools.cache
def trained(seed: int = 3, precision: float = 0.99) -> tuple[Trees, dict[str, float]]:
    """The fitted trees, and for each kind the least calibrated score that keeps the wished precision on other generated cases (0.5 at least)."""
    cases, y = generated_cases(seed=seed)
    trees = Trees().fit(np.array([features(*c) for c in cases]), y)
    others, truth = generated_cases(seed=seed + 1)
    p = trees.probability(np.array([features(*c) for c in others]))
    cuts = {}
    for kind in ALL_KINDS:
        mine = np.array([c[1] == kind for c in others])
        cuts[kind] = next((c for c in np.arange(0.5, 1.0, 0.005) if (p[mine] >= c).any() and truth[mine][p[mine] >= c].mean() >= precision), 1.1)
    return trees, cuts


def all_spans(text: str, trees: Trees, cuts: dict[str, float], base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Base spans and those that the trees add; an added span overlaps no base span, and of overlapping ones the likeliest stays."""
    base = base_spans(text) if base is None else base
    offered = [c for c in candidates(text) if all(c[2] <= s or c[1] >= e for _, s, e in base)]
    if offered:
        p = trees.probability(np.array([features(text, *c) for c in offered]))
        chosen: list[tuple[str, int, int]] = []
        for k in np.argsort(-p, kind="stable").tolist():
            kind, start, end = offered[k]
            if p[k] >= cuts[kind] and all(end <= s or start >= e for _, s, e in chosen):
                chosen.append(offered[k])
        base = sorted([*base, *chosen], key=lambda x: (x[1], ALL_KINDS.index(x[0])))
    return base


# --- Spark -----------------------------------------------------------------------------------------------------------


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points of every whole text; null texts have none.

    A row for each row, so repeated and null ids are kept. Columns other than doc_id and text are ignored. No shuffle.
    """
    model = trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            base, spans = [], []
            for text in b.column(1).to_pylist():
                mine = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in mine])
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in all_spans(text, *model, base=mine)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans make one, named by the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the personal data in text replaced, and n_chars, if there, counting the new text. Null texts stay null."""
    model = trained()
    names, schema = docs.columns, docs.schema
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t if t is None else redacted(t, all_spans(t, *model)) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            if count is not None:
                old = b.column(count)
                columns[count] = pa.array([o if t is None else len(t) for t, o in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the SHA-256 of their list, and the list of all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        for b in batches:
            base, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base]), pa.array([listed(x) for x in spans], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
