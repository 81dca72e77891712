"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near its
hits, then validation of embedded checksums.

One automaton finds all keywords in a block of texts, lower-cased over A-Z; an
expression is tried only where a keyword stands. A run of 24 hexadecimal digits
is a keyword too, over a view of the text in which every such digit is the same
letter. Tokens that embed a checksum count only if it fits.

Null texts count as empty and have no span; null ids pass through; repeated rows
are scanned each on its own; spans of different kinds with one start stand in the
order of the kinds; a very long text is scanned whole within its task, in time in
proportion to its length; empty tables give no rows; other columns, whatever their
names, are ignored by ``scan`` and kept by ``redact``. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratafold.llm import kernels as K

# The kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("github", "npm", "jwt", "pem", "slack", "google", "stripe")
KINDS = BASE_KINDS + MORE_KINDS
# Keywords (lower case) and the anchored expression of each kind.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
    "xoxa-": "slack",
    "xoxb-": "slack",
    "xoxp-": "slack",
    "xoxr-": "slack",
    "xoxs-": "slack",
    "aiza": "google",
    "sk_live_": "stripe",
}
PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(rb"-----BEGIN ([A-Z0-9]+ )?PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,]|-(?!----))*+-----END ([A-Z0-9]+ )?PRIVATE KEY-----"),
    "slack": re.compile(rb"xox[abprs]-[0-9A-Za-z-]{20,}"),
    "google": re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "stripe": re.compile(rb"sk_live_[0-9A-Za-z]{24,}"),
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

HEX_LEAST, ACCESS_LEAST, VALUE_LEAST = 24, 20, 6
_HEX = re.compile(rb"[0-9a-f]+")
_HEX_VIEW = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
_TOKEN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of body in six digits of base 62, as such tokens carry it at their end."""
    crc, out = zlib.crc32(body), b""
    for _ in range(6):
        crc, digit = divmod(crc, 62)
        out = BASE62[digit : digit + 1] + out
    return out


def _valid(kind: str, found: re.Match) -> bool:
    if kind == "assign":
        return len(found[2]) >= VALUE_LEAST
    if kind == "access":
        return len(found[0]) >= ACCESS_LEAST
    if kind in ("github", "npm"):
        return base62_crc(found[1][:30]) == found[1][30:]
    if kind == "jwt":
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(found[1] + b"=" * (-len(found[1]) % 4)))
        except (ValueError, binascii.Error, TypeError):
            return False
    return True


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def find(block: K.Block, machine: ahocorasick.Automaton) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (start, order of the kind, end) of each text that has any, in bytes from the start of the text."""
    raw = block.data.tobytes()
    out: dict[int, list[tuple[int, int, int]]] = {}
    hits = [(end - n + 1, kind) for end, (kind, n) in machine.iter(raw.lower().decode("latin-1"))]
    view, runs = raw.translate(_HEX_VIEW), []
    at = view.find(b"h" * HEX_LEAST)
    while at >= 0:
        runs.append(at)
        at = view.find(b"h" * HEX_LEAST, _HEX.match(raw, at).end())
    owner = np.searchsorted(block.offsets, [p for p, _ in hits], side="right") - 1 if hits else []
    ends = block.offsets
    done: dict[tuple[int, str], int] = {}
    for i, (start, kind) in sorted(zip(owner, hits), key=lambda x: x[1][0]):
        if start < done.get((i, kind), 0):
            continue
        if kind == "jwt" and start > ends[i] and raw[start - 1] in _TOKEN:
            continue  # within a token; trying each place of a long one would take its length squared
        if found := PATTERNS[kind].match(raw, start, int(ends[i + 1])):
            done[i, kind] = found.end()
            if _valid(kind, found):
                out.setdefault(int(i), []).append((start - int(ends[i]), KINDS.index(kind), found.end() - int(ends[i])))
    for run in runs:
        stop = _HEX.match(raw, run).end()
        i = int(np.searchsorted(ends, run, side="right")) - 1
        while run < stop:  # a run over the border of two texts is two runs
            end = min(stop, int(ends[i + 1]))
            if end - run >= HEX_LEAST:
                out.setdefault(i, []).append((run - int(ends[i]), KINDS.index("hex"), end - int(ends[i])))
            run, i = end, i + 1
    for i, spans in out.items():
        spans.sort()
        own = block.data[ends[i] : ends[i + 1]]
        if (own >= 128).any():
            points = np.concatenate([[0], np.cumsum(K.CODE_POINT[own])])
            out[i] = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the digest of their spans, and all spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part, block in K.blocks(batch, "text"):
                found = find(block, machine)
                counts = np.zeros((3, len(block)), dtype=np.int64)
                digests, texts = [nothing] * len(block), [""] * len(block)
                for i, spans in found.items():
                    base = [x for x in spans if x[1] < len(BASE_KINDS)]
                    for _, k, _ in base:
                        counts[k, i] += 1
                    digests[i], texts[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])

    return K.map_arrow(docs.select("doc_id", "text"), rows, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with each stretch of secret spans replaced by ``mark``; an n_chars column is recounted for changed texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for part, block in K.blocks(batch, "text"):
                if found := find(block, machine):
                    names = part.schema.names
                    texts = part.column(names.index("text")).to_pylist()
                    chars = part.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
                    for i, spans in found.items():
                        kept, at = [], 0
                        for a, _, b in spans:
                            if a >= at:
                                kept += [texts[i][at:a], mark]
                            at = max(at, b)
                        texts[i] = "".join([*kept, texts[i][at:]])
                        if chars:
                            chars[i] = len(texts[i])
                    columns = list(part.columns)
                    columns[names.index("text")] = pa.array(texts, part.schema.field("text").type)
                    if chars:
                        columns[names.index("n_chars")] = pa.array(chars, part.schema.field("n_chars").type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return K.map_arrow(docs, rows, docs.schema)
