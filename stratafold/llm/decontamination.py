"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are folded (letters of all scripts without case, everything
else below 128 that is no letter or digit is one space). An item of m folded bytes may differ in up
to ``m * rate`` edits; it is split into one piece more, so that any occurrence
within the budget holds a piece unchanged. An Aho-Corasick automaton finds all
pieces, hits are merged by diagonal, and Myers' bit-parallel algorithm gives the
least edit distance within each window.

The items go to the workers inside the function, in blocks of at most
``block_bytes`` of folded text each; a larger benchmark takes more passes over the
documents, and after each ``PASS_BLOCKS`` of them the result so far is settled and
their blocks are freed, so the driver never holds more. Null or empty items match
nothing; null texts count as empty; repeated rows and items are reported each; of
occurrences with equal distance the first counts; a very long text is searched whole
within its task; empty tables give no rows; other columns, whatever their names, are
ignored by ``leaks`` and kept by ``clean``. Items whose budget is 0 must occur
verbatim; those of fewer than ``LEAST_WORDS`` words besides between borders of words,
which in scripts without spaces are all places between characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from stratafold.llm import kernels as K

RATE = 0.08
LEAST_WORDS = 5
BLOCK_BYTES = 4 << 20
PASS_BLOCKS = 4
SCHEMA = "doc_id long, item_id long, distance long, folded_end long"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if K.ALNUM_WORD[c] else 32 for c in range(256))


def fold(text: bytes) -> bytes:
    if not text.isascii():
        text = text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    return b" ".join(text.translate(_FOLD).split())


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and the first end where it is reached."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(across | up) & full, up & across
        if plus & high:
            score += 1
        if minus & high:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        across = eq | down
        up, down = minus | ~(across | plus) & full, plus & across
        if score < best:
            best, end = score, j
    return best, end


#: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def border(text: bytes, at: int) -> bool:
    """Is the place in a folded text, before a character, no place within a word."""

    def within(c: str) -> bool:
        return bool(c) and (c.isalnum() or unicodedata.category(c)[0] == "M") and not _UNSPACED.match(c)

    before, after = text[max(at - 4, 0) : at].decode("utf-8", "ignore")[-1:], text[at : at + 4].decode("utf-8", "ignore")[:1]
    return not (within(before) and within(after))


class Items:
    """The folded items of one block and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]

    def machine(self) -> ahocorasick.Automaton:
        pieces: dict[bytes, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            step, extra = divmod(len(text), budget + 1)
            at = 0
            for p in range(budget + 1):
                size = step + (p < extra)
                pieces.setdefault(text[at : at + size], []).append((n, at))
                at += size
        machine = ahocorasick.Automaton()
        for piece, places in pieces.items():
            machine.add_word(piece.decode("latin-1"), (len(piece), places))
        if pieces:
            machine.make_automaton()
        return machine

    def matches(self, text: bytes, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
        """(item, distance, end) of each item that occurs in the folded text within its budget."""
        if not self.items or not text:
            return []
        diagonals: dict[int, set[int]] = {}
        for end, (size, places) in machine.iter(text.decode("latin-1")):
            for n, at in places:
                diagonals.setdefault(n, set()).add(end - size + 1 - at)
        out = []
        for n, found in diagonals.items():
            item, pattern, budget = self.items[n]
            best = (budget + 1, 0)
            if not budget and pattern.count(b" ") + 1 < LEAST_WORDS:
                whole = (d for d in sorted(found) if border(text, d) and border(text, d + len(pattern)))
                if (d := next(whole, None)) is not None:
                    out.append((item, 0, d + len(pattern)))
                continue
            spans: list[list[int]] = []
            for d in sorted(found):
                if spans and d - budget <= spans[-1][1]:
                    spans[-1][1] = d + len(pattern) + budget
                else:
                    spans.append([d - budget, d + len(pattern) + budget])
            for a, b in spans:
                a = max(a, 0)
                distance, end = myers(pattern, text[a : max(b, 0)])
                best = min(best, (distance, a + end))
            if best[0] <= budget:
                out.append((item, *best))
        return sorted(out)


def _blocks(benchmark: DataFrame, rate: float, block_bytes: int) -> Iterator[Items]:
    """The benchmark block by block, at least one; an item longer than a block is one of its own."""
    block: list[tuple[int, bytes]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        text = fold(row.text.encode())
        if not text:
            continue
        if size + len(text) > block_bytes and block:
            yield Items(block, rate)
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    yield Items(block, rate)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document and leaked item: the edit distance, and where the match ends in the folded text."""
    source = docs.select("doc_id", "text")

    def finder(items: Items):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = items.machine()
            for batch in batches:
                found = []
                for part, block in K.blocks(batch, "text"):
                    raw, ids = block.data.tobytes(), part.column(0).to_pylist()
                    for i, doc in enumerate(ids):
                        for item, distance, end in items.matches(fold(raw[block.offsets[i] : block.offsets[i + 1]]), machine):
                            found.append((doc, item, distance, end))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], [c.split()[0] for c in SCHEMA.split(", ")])

        return rows

    out = None
    for k, items in enumerate(_blocks(benchmark, rate, block_bytes), 1):
        part = K.map_arrow(source, finder(items), SCHEMA)
        out = part if out is None else out.unionByName(part)
        if k % PASS_BLOCKS == 0:
            out = K.settled(out)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""

    def keeper(items: Items):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = items.machine()
            for batch in batches:
                for part, block in K.blocks(batch, "text"):
                    raw = block.data.tobytes()
                    kept = [not items.matches(fold(raw[a:b]), machine) for a, b in zip(block.offsets[:-1], block.offsets[1:])]
                    yield part.filter(pa.array(kept, pa.bool_()))

        return rows

    for k, items in enumerate(_blocks(benchmark, rate, block_bytes), 1):
        docs = K.map_arrow(docs, keeper(items), docs.schema)
        if k % PASS_BLOCKS == 0:
            docs = K.settled(docs)
    return docs
