"""SentencePiece encoding and decoding by suffix-array matching.

A text is a row of units that no piece crosses: a run of spaces with the word after
it, or a line feed. The distinct units of a batch that were not met before are laid
end to end and indexed by a suffix array (prefixes up to the longest piece, by rank
doubling). Every piece of the vocabulary is looked up in it by binary search; the
occurrence ranges become edges from start to end, sorted by end. Relaxing them in
that order gives the segmentation: an edge extends the best segmentation of the
text before it only if its piece and the last piece before it stay apart when they
are merged by score, which for a pair-merge model holds for exactly one edge per
end. Results equal the public library's for models with byte fallback and identity
normalisation.

Null texts count as empty and have no ids; repeated rows, null ids and empty tables
pass through. A literal U+2581 is a space to this format, so such a text decodes
with a space in its place (``round_trip`` compares with that text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratafold.llm import kernels as K

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Units and pairs of pieces that a worker remembers; beyond either it starts anew, so its memory is bounded.
KNOWN_UNITS = 1 << 19
KNOWN_PAIRS = 1 << 20
#: Up to so many edges at one depth are relaxed one by one, as in the tail of a very long unit.
FEW_EDGES = 16
SCHEMA = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"
_UNIT = re.compile(rb" *[^ \n]+| +|\n")
_NONE, _BEGIN, _UNKNOWN = -3, -2, -1


class Pieces:
    """The ordinary pieces of a model with their scores, and the ids of the 256 byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
        self.score = {model.id_to_piece(i): (model.get_score(i), i) for i in ids if not special[i]}
        self.bytes_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelt = [b"" if special[i] and not model.is_byte(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]

        self.spelt_bytes = np.frombuffer(b"".join(self.spelt), dtype=np.uint8)
        self.spelt_at = np.r_[0, np.cumsum([len(x) for x in self.spelt])]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space that stands before every text is taken away."""
        raw = b"".join([self.spelt[i] for i in ids]).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw

    def restores(self, ids: np.ndarray, begin: np.ndarray, block: K.Block, texts: list[bytes]) -> np.ndarray:
        """Does each text's stretch of ids decode to it: all bytes at once, and what differs there (as texts with marks do) one by one."""
        first, size = self.spelt_at[ids], self.spelt_at[ids + 1] - self.spelt_at[ids]
        total = np.r_[0, np.cumsum(size)]
        got = self.spelt_bytes[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        ends = total[begin]
        full = np.diff(block.offsets) > 0
        want = np.insert(block.data, block.offsets[:-1][full], 32)
        edges = np.r_[0, np.cumsum(np.diff(block.offsets) + full)]
        same = np.diff(ends) == np.diff(edges)
        if len(got) == len(want):
            wrong = np.r_[0, np.cumsum(got != want)]
            same &= wrong[edges[1:]] == wrong[edges[:-1]]
            same &= ends[:-1] == edges[:-1]
        else:
            same[:] = False
        for i in np.flatnonzero(~same).tolist():
            same[i] = self.decode(ids[begin[i] : begin[i + 1]].tolist()) == texts[i].replace(MARK, b" ").decode()
        return same


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, first byte highest; zero after the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), dtype=np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


class SuffixArray:
    """Places of ``data`` sorted by what follows them, up to the separator (byte 255), over at least ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.n = len(data)
        ends = np.flatnonzero(data == 255)
        self.left = ends[np.searchsorted(ends, np.arange(self.n))] - np.arange(self.n)
        key = _words8(data)
        short = np.clip(8 - self.left, 0, 8).astype(np.uint64) * np.uint64(8)
        cut = np.where(short >= 64, np.uint64(0), ~((np.uint64(1) << np.minimum(short, np.uint64(63))) - np.uint64(1)))
        self.key = np.where(short >= 64, np.uint64(0), key & cut)
        order = np.flatnonzero((self.left > 0) & K.CODE_POINT[data])
        order = order[np.argsort(self.key[order], kind="stable")]
        # A rank for every place, also inside characters, is needed to look ahead.
        ranked, rank = np.unique(self.key, return_inverse=True)
        del ranked
        rank = rank.astype(np.int64)
        size = 8
        while size < depth:
            ahead = np.zeros(self.n, dtype=np.int64)
            ahead[:-size] = rank[size:] if self.n > size else 0
            ahead[self.left <= size] = -1
            if len(order):
                new = np.r_[True, rank[order[1:]] != rank[order[:-1]]]
                tied = ~new | np.r_[~new[1:], False]
                tied &= self.left[order] > size
                if not tied.any():
                    break
                own = order[~new | np.r_[~new[1:], False]]
                at = np.flatnonzero(~new | np.r_[~new[1:], False])
                order[at] = own[np.lexsort((ahead[own], rank[own]))]
            both = (rank + 1) * np.int64(self.n + 2) + ahead + 1
            rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
            size *= 2
        self.order = order
        self.sorted = self.key[order]

    def ranges(self, piece_keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pieces, as rows of 8-byte keys padded with zeros, the range of places that begin with each."""
        first = np.minimum(sizes, 8)
        spare = ((8 - first) * 8).astype(np.uint64)
        top = piece_keys[:, 0] | ((np.uint64(1) << spare) - np.uint64(1))
        low = np.searchsorted(self.sorted, piece_keys[:, 0], side="left")
        high = np.searchsorted(self.sorted, top, side="right")
        for level in range(1, piece_keys.shape[1]):
            rest = sizes - 8 * level
            open_ = np.flatnonzero((rest > 0) & (high > low))
            if not len(open_):
                break
            spare = ((8 - np.minimum(rest[open_], 8)) * 8).astype(np.uint64)
            want = piece_keys[open_, level]
            low[open_], high[open_] = (
                self._bisect(low[open_], high[open_], level, want, strict=False),
                self._bisect(low[open_], high[open_], level, want | ((np.uint64(1) << spare) - np.uint64(1)), strict=True),
            )
        return low, high

    def _bisect(self, low: np.ndarray, high: np.ndarray, level: int, want: np.ndarray, strict: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (live := low < high).any():
            middle = (low + high) // 2
            place = self.order[np.minimum(middle, len(self.order) - 1)]
            got = np.where(self.left[place] > 8 * level, self.key[np.minimum(place + 8 * level, self.n - 1)], np.uint64(0))
            less = (got <= want if strict else got < want) & live
            low = np.where(less, middle + 1, low)
            high = np.where(~less & live, middle, high)
        return low


class Encoder:
    """Ids of units, remembered for up to KNOWN_UNITS of them."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        names = sorted(pieces.score)
        self.names = names
        raw = [p.encode() for p in names]
        self.ids = np.array([pieces.score[p][1] for p in names])
        self.sizes = np.array([len(r) for r in raw])
        self.depth = int(self.sizes.max())
        width = -(-self.depth // 8)
        flat = np.frombuffer(b"".join(r.ljust(8 * width, b"\0") for r in raw), dtype=">u8").astype(np.uint64)
        self.keys = flat.reshape(len(raw), width)
        self.singles = {p for p in names if len(p) == 1}
        self.apart: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(1, dtype=np.int64)

    def _stay_apart(self, left: int, right: int) -> bool:
        """Does merging by score, leftmost first, leave the border between the two pieces; left is _BEGIN for a piece alone."""
        one = "" if left == _BEGIN else self.names[left]
        text = one + self.names[right]
        symbols, border = list(text), len(one)
        score = self.pieces.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = score.get(symbols[i] + symbols[i + 1])
                if found and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                break
            if border and len("".join(symbols[: at + 1])) == border:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols == ([one, self.names[right]] if one else [self.names[right]])

    def _fit(self, left: int, right: int) -> bool:
        if right == _UNKNOWN:
            return True
        code = ((_BEGIN if left == _UNKNOWN else left) + 3) << 32 | right
        known = self.apart.get(code)
        if known is None:
            known = self.apart[code] = self._stay_apart((code >> 32) - 3, right)
        return known

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # nothing merges with an unknown character; a piece after one has to be one piece by itself
        left = np.where(left == _UNKNOWN, _BEGIN, left)
        out = right == _UNKNOWN
        ask = np.flatnonzero(right != _UNKNOWN)
        code = (left[ask].astype(np.int64) + 3) * np.int64(1 << 32) + right[ask]
        codes, back = np.unique(code, return_inverse=True)
        apart = self.apart
        if len(apart) > KNOWN_PAIRS:
            apart.clear()
        got = np.zeros(len(codes), dtype=bool)
        for i, c in enumerate(codes.tolist()):
            known = apart.get(c)
            if known is None:
                known = apart[c] = self._stay_apart((c >> 32) - 3, c & 0xFFFFFFFF)
            got[i] = known
        out[ask] = got[back]
        return out

    def _segment(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and where each begins."""
        data = np.frombuffer(b"\xff".join(units) + b"\xff", dtype=np.uint8)
        suffixes = SuffixArray(data, self.depth)
        low, high = suffixes.ranges(self.keys, self.sizes)
        many = high - low
        piece = np.repeat(np.arange(len(many)), many)
        start = suffixes.order[np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())] if many.sum() else np.zeros(0, dtype=np.int64)
        end = start + self.sizes[piece]
        # characters without a piece of their own: one edge each
        chars = np.flatnonzero(K.CODE_POINT[data] & (data != 255))
        size = np.diff(np.r_[chars, len(data)])
        size = np.where(data[np.minimum(chars + size - 1, len(data) - 1)] == 255, size - 1, size)
        lone = np.zeros(len(data) + 1, dtype=bool)
        ones = end - start == np.where(data[start] < 128, 1, np.where(data[start] < 224, 2, np.where(data[start] < 240, 3, 4)))
        lone[start[ones]] = True
        odd = ~lone[chars]
        start, end, piece = np.r_[start, chars[odd]], np.r_[end, chars[odd] + size[odd]], np.r_[piece, np.full(odd.sum(), _UNKNOWN)]
        # relax by the number of characters before the end
        ends = np.flatnonzero(data == 255)
        begins = np.r_[0, ends[:-1] + 1]
        before = np.r_[0, np.cumsum(K.CODE_POINT[data] & (data != 255))]
        owner = np.searchsorted(ends, start)
        depth = before[end] - before[begins[owner]]
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        last = np.full(len(data) + 1, _NONE, dtype=np.int64)
        back = np.zeros(len(data) + 1, dtype=np.int64)
        last[begins] = _BEGIN
        for a, b in zip(cuts := np.r_[0, np.flatnonzero(depth[1:] != depth[:-1]) + 1].tolist() if len(depth) else [], [*cuts[1:], len(depth)]):
            if b - a <= FEW_EDGES:
                for s, e, p in zip(start[a:b].tolist(), end[a:b].tolist(), piece[a:b].tolist()):
                    left = int(last[s])
                    if left != _NONE and self._fit(left, p):
                        last[e], back[e] = p, s
                continue
            s, e, p = start[a:b], end[a:b], piece[a:b]
            alive = last[s] != _NONE
            s, e, p = s[alive], e[alive], p[alive]
            good = self._fits(last[s], p)
            last[e[good]] = p[good]
            back[e[good]] = s[good]
        # walk back from every end at once
        steps, at, unit = [], ends.copy(), np.arange(len(ends))
        while True:
            going = at > begins[unit]
            at, unit = at[going], unit[going]
            if not len(at):
                break
            steps.append((unit, last[at], back[at]))
            at = back[at]
        if not steps:
            return np.zeros(0, dtype=np.int32), np.zeros(len(units) + 1, dtype=np.int64)
        unit = np.concatenate([x[0] for x in steps])
        code = np.concatenate([x[1] for x in steps])
        place = np.concatenate([x[2] for x in steps])
        order = np.argsort(place, kind="stable")
        unit, code, place = unit[order], code[order], place[order]
        # unknown characters become one id per byte
        unknown = code == _UNKNOWN
        length = np.ones(len(code), dtype=np.int64)
        if unknown.any():
            size_at = np.zeros(len(data) + 1, dtype=np.int64)
            size_at[chars] = size
            length[unknown] = size_at[place[unknown]]
        first = np.r_[0, np.cumsum(length)]
        out = np.zeros(first[-1], dtype=np.int32)
        out[first[:-1][~unknown]] = self.ids[code[~unknown]]
        if unknown.any():
            spread = np.repeat(place[unknown], length[unknown]) + np.arange(length[unknown].sum()) - np.repeat(np.cumsum(length[unknown]) - length[unknown], length[unknown])
            slots = np.repeat(first[:-1][unknown], length[unknown]) + np.arange(length[unknown].sum()) - np.repeat(np.cumsum(length[unknown]) - length[unknown], length[unknown])
            out[slots] = np.array(self.pieces.bytes_ids)[data[spread]]
        per_unit = np.bincount(unit, weights=length, minlength=len(units)).astype(np.int64)
        return out, np.r_[0, np.cumsum(per_unit)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins."""
        if len(self.known) > KNOWN_UNITS:
            self._forget()
        rows: list[list[bytes]] = []
        for text in texts:
            if not text:
                rows.append([])
                continue
            if MARK in text:
                text = text.replace(MARK, b" ")
            plain = text.replace(b"\n", b" \n")
            # a unit goes by its text without its first space; "\nword" has none
            if b"  " in plain or plain[0] in b" \n" or plain[-1] == 32:
                rows.append(self._careful(text))
            else:
                rows.append(plain.split(b" "))
        known = self.known
        fresh = [u for u in dict.fromkeys(u for row in rows for u in row) if u not in known]
        if fresh:
            spelt = [(u if u[:1] == b"\n" else b" " + u).replace(b" ", MARK) for u in fresh]
            ids, begin = self._segment(spelt)
            base, n = len(self.flat), len(known)
            known.update((u, n + i) for i, u in enumerate(fresh))
            self.flat = np.concatenate([self.flat, ids])
            self.begin = np.concatenate([self.begin, base + begin[1:]])
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        unit = np.fromiter((known[u] for r in rows for u in r), dtype=np.int64, count=int(counts.sum()))
        first, size = self.begin[unit], self.begin[unit + 1] - self.begin[unit]
        total = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.repeat(first - total[:-1], size) + np.arange(total[-1])] if total[-1] else np.zeros(0, dtype=np.int32)
        return ids, total[np.r_[0, np.cumsum(counts)]]

    @staticmethod
    def _careful(text: bytes) -> list[bytes]:
        """Units of a text with runs of spaces, each without its first space where it has one."""
        out = []
        for u in _UNIT.findall(b" " + text):
            if u[0] == 32:
                out.append(u[1:])
            elif u[0] == 10:
                out.append(u)
            else:  # a word right after a line feed belongs to it
                out[-1] += u
        return out


#: One encoder a worker process and model: what a task learned about units and pairs serves the next.
_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document the ids of its whole text, their number, and whether decoding gives the text back."""
    pieces = Pieces(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(model) or _ENCODERS.setdefault(model, Encoder(pieces))
        for batch in batches:
            for part, block in K.blocks(batch, "text"):
                raw = block.data.tobytes()
                texts = [raw[a:b] for a, b in zip(block.offsets[:-1], block.offsets[1:])]
                ids, begin = encoder.encode(texts)
                same = pieces.restores(ids, begin, block, texts)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(np.diff(begin)), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return K.map_arrow(docs.select("doc_id", "text"), rows, SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with doc_id and token_ids; null ids count as none."""
    pieces = Pieces(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return K.map_arrow(encoded.select("doc_id", "token_ids"), rows, "doc_id long, text string")
