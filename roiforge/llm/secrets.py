"""Secrets in texts: a keyword automaton finds where to look, anchored patterns say what stands there, embedded checksums confirm it.

One Aho-Corasick pass over a text's bytes, letters lowered, yields the places of all keywords. Only there a pattern is tried, anchored
at the keyword. Formats that carry a checksum or a structure of their own (GitHub and npm tokens, signed web tokens, PEM keys, extended
wallet keys, cloud access keys) are checked against it. Runs of hex digits have no keyword: a run of 32 covers two neighbouring multiples
of 16 and all between, so those places are probed instead.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roiforge.llm.common import sliced, text_or_empty

#: Kinds of the base patterns, and those that formats with a keyword of their own add.
BASE = ("assign", "access", "hex")
ADDED = ("github", "npm", "jwt", "private_key", "wallet", "slack", "stripe", "google", "gitlab")
KINDS = (*BASE, *ADDED)
_SPANS = "array<struct<kind:string,start:long,end:long,checked:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("checked", pa.bool_())]))


# --- embedded checksums ----------------------------------------------------------------------------------------------

# fixed values: alphabets of base 62 and base 58
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_base62(data: bytes) -> bytes:
    """The CRC-32 of data as six digits of base 62."""
    n, out = zlib.crc32(data), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.encode()


def _crc_tail(token: bytes) -> bool:
    """The last six characters are the checksum of the thirty before them."""
    return crc_base62(token[-36:-6]) == token[-6:]


def _signed_json(token: bytes) -> bool:
    """Header and payload are JSON objects, and the header names an algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + b"=" * (-len(p) % 4))) for p in token.split(b".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def _key_block(token: bytes) -> bool:
    """A PEM body is a DER sequence as long as its header says, or a key of OpenSSH's own format."""
    try:
        body = base64.b64decode(b"".join(token.split(b"-----")[2].split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if body.startswith(b"openssh-key-v1\0"):
        return True
    if len(body) < 4 or body[0] != 0x30:
        return False
    wide = body[1] - 128 if body[1] > 128 else 0
    said = int.from_bytes(body[2 : 2 + wide], "big") if wide else body[1]
    return said == len(body) - 2 - wide


def _base58_check(token: bytes) -> bool:
    """78 bytes and the first four of their double SHA-256."""
    n = 0
    for c in token:
        n = n * 58 + _BASE58.index(c)
    if n >= 1 << 8 * 82:
        return False
    data = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:78]).digest()).digest()[:4] == data[78:]


def _base32_id(token: bytes) -> bool:
    """An access key id is 20 characters, those after the prefix of base 32."""
    return len(token) == 20 and all(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for c in token[4:])


#: kind -> (keywords, in lower case; pattern anchored at the keyword; check or None; whether a failed check drops the span).
_FORMATS: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[bytes], bool] | None, bool]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), None, False),
    "access": (("akia",), re.compile(rb"AKIA[A-Z0-9]+"), _base32_id, False),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _crc_tail, True),
    "npm": (("npm_",), re.compile(rb"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _crc_tail, True),
    "jwt": (("eyj",), re.compile(rb"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _signed_json, True),
    "private_key": (("-----begin ",), re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[\s]+[A-Za-z0-9+/=\s]+-----END \1PRIVATE KEY-----"), _key_block, True),
    "wallet": (("xprv",), re.compile(rb"(?<![A-Za-z0-9])xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), _base58_check, True),
    "slack": (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(rb"(?<![A-Za-z0-9])xox[abprs]-[0-9]+-[0-9A-Za-z-]{10,}"), None, False),
    "stripe": (("sk_live_", "rk_live_"), re.compile(rb"(?<![A-Za-z0-9])[sr]k_live_[0-9A-Za-z]{16,}"), None, False),
    "google": (("aiza",), re.compile(rb"(?<![A-Za-z0-9_-])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), None, False),
    "gitlab": (("glpat-",), re.compile(rb"(?<![A-Za-z0-9_-])glpat-[0-9A-Za-z_-]{20}(?![0-9A-Za-z_-])"), None, False),
}
_LEAST = {"assign": 8, "access": 16}

_automata: list = []


def _automaton():
    """Keywords of all formats -> (kind, keyword's length); built once for each process."""
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, (words, *_) in _FORMATS.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True


def _hex_runs(data: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least 32 hex digits."""
    digit = _HEX[np.frombuffer(data, dtype=np.uint8)]
    stops = digit[::16]
    done = 0
    for k in np.flatnonzero(stops[:-1] & stops[1:]).tolist():
        at = 16 * k
        if at < done or not digit[at : at + 17].all():
            continue
        start = at
        while start > done and digit[start - 1]:
            start -= 1
        after = np.flatnonzero(~digit[at:])
        done = at + int(after[0]) if len(after) else len(digit)
        if done - start >= 32:
            yield start, done


def _byte_spans(data: bytes) -> Iterator[tuple[str, int, int, bool | None]]:
    """Spans in bytes: for each kind leftmost ones that don't overlap; matches that fail are used up, without retries."""
    places: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(data.lower().decode("latin-1")):
        places.setdefault(kind, []).append(end + 1 - n)
    for kind, starts in places.items():
        _, pattern, check, drops = _FORMATS[kind]
        free = 0
        for at in sorted(starts):
            m = pattern.match(data, at) if at >= free else None
            if m is None:
                continue
            free = m.end()
            if len(m[1] if kind == "assign" else m[0]) < _LEAST.get(kind, 0):
                continue
            holds = check(m[0]) if check else None
            if not (drops and not holds):
                yield kind, at, free, holds
    if len(data) >= 32:
        yield from (("hex", s, e, None) for s, e in _hex_runs(data))


def secrets(text: str | None) -> list[tuple[str, int, int, bool | None]]:
    """(kind, start, end, checked) in code points, by start and then kind. checked: the embedded checksum holds, or null for formats without one."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = list(_byte_spans(data))
    if found and len(data) > len(text):
        point = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
        found = [(k, int(point[s]), int(point[e]), c) for k, s, e, c in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# --- Spark -----------------------------------------------------------------------------------------------------------


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end, checked) in code points of every whole text.

    base holds the kinds assign, access and hex; spans holds them and those of formats with keywords of their own, of which a failed
    checksum drops a match. Null and empty texts have no spans; a row for each row, so repeated and null ids are kept; an empty table gives
    none. Columns other than doc_id and text are ignored. A text is one row's work, in time proportional to its length. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            every = [secrets(t) for t in b.column(1).to_pylist()]
            rows = lambda kinds: pa.array([[dict(zip(("kind", "start", "end", "checked"), s, strict=True)) for s in x if s[0] in kinds] for x in every], _SPAN_TYPE)
            yield pa.RecordBatch.from_arrays([b.column(0), rows(BASE), rows(KINDS)], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {_SPANS}, spans {_SPANS}")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by its kind in brackets, overlapping ones by the first's; n_chars, if there, counts the new text. Null texts stay null."""
    names, schema = docs.columns, docs.schema
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, free = [], 0
        for kind, start, end, _ in secrets(text):
            if start >= free:
                out += [text[free:start], f"[{kind.upper()}]"]
            free = max(free, end)
        return "".join([*out, text[free:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [clean(t) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                old = columns[count]
                columns[count] = pa.array([o if t is None else len(t) for t, o in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the SHA-256 of their list, and the list of all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        for b in batches:
            base, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in x) for x in base], pa.int64()) for k in BASE]
            n_checked = pa.array([sum(bool(s["checked"]) for s in x) for x in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base], pa.string()), pa.array([listed(x) for x in spans], pa.string()), n_checked], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_checked"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")
