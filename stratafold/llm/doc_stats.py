"""Counts and ratios of whole texts and of their lines, by the block kernels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from stratafold.llm import kernels as K

#: The symbols that the quality contract counts.
SYMBOLS = K.table(b"#*$%&|<>")
_MARK, _PIPE, _DIGIT, _STOP = K.table(b"!"), K.table(b"|"), K.table(b"0123456789"), K.table(b".!?:;")
_UPPER = K.table(bytes(range(65, 91)))
_LETTER = K.table(bytes(range(65, 91)) + bytes(range(97, 123)))
_COMMA = K.table(b".,")

WINDOW = 5


@dataclass
class Lines:
    """Lines that hold a word: number of the text, words, and the share figures used as features."""

    owner: np.ndarray
    words: np.ndarray
    features: np.ndarray


LINE_FEATURES = ("bias", "short", "middle", "long", "symbols", "many symbols", "marks", "capitals", "pipes", "digits", "stop", "again", "echo", "much repeated", "some repeated", "long words", "short words")


class Stats:
    """What the quality operators need of one block; everything covers whole texts."""

    def __init__(self, block: K.Block):
        data, n = block.data, len(block)
        self.block = block
        starts, ends, owner = block.runs(K.SPACE_WORD[data])
        self.n_words = np.bincount(owner, minlength=n).astype(np.int64)
        self.owner = owner
        prefix = block.prefix_hash(K.BYTE_VALUES)
        self.words = block.span_hash(prefix, starts, ends)
        self.word_chars = block.per_text(K.SPACE_WORD[data] & K.CODE_POINT[data])
        self.n_symbols = block.per_text(SYMBOLS[data])
        line_start, line_end, line_owner = block.lines()
        first = np.searchsorted(starts, line_start)
        last = np.searchsorted(starts, line_end)
        full = last > first
        self.line_first, self.line_last = first[full], last[full]
        self.line_owner = line_owner[full]
        self.line_start, self.line_end = line_start[full], line_end[full]
        keys = block.span_hash(prefix, self.line_start, self.line_end) + (self.line_end - self.line_start).astype(np.uint64)
        _, self.line_again = K.repeated(keys, self.line_owner)
        self.n_dup_lines = np.bincount(self.line_owner, weights=self.line_again, minlength=n).astype(np.int64)
        grams, at = K.gram_hash(self.words, owner, WINDOW)
        many, _ = K.repeated(grams, owner[at])
        cover = np.zeros(len(owner) + WINDOW + 1, dtype=np.int32)
        hot = at[many]
        cover[hot] += 1
        np.subtract.at(cover, hot + WINDOW, 1)
        self.covered = np.cumsum(cover)[: len(owner)] > 0
        self.n_repeat_words = np.bincount(owner, weights=self.covered, minlength=n).astype(np.int64)
        self.echo = np.zeros(len(owner), dtype=bool)
        self.echo[1:] = (self.words[1:] == self.words[:-1]) & (owner[1:] == owner[:-1])

    def distinct_words(self) -> np.ndarray:
        _, later = K.repeated(self.words, self.owner)
        return self.n_words - np.bincount(self.owner, weights=later, minlength=len(self.block)).astype(np.int64)

    def document_features(self) -> np.ndarray:
        """Transformed statistics of each text, finite also for empty ones."""
        block, data = self.block, self.block.data
        words, chars = np.maximum(self.n_words, 1), np.maximum(self.word_chars, 1)
        lines = np.bincount(self.line_owner, minlength=len(block))
        letters = np.maximum(block.per_text(_LETTER[data]), 1)
        echo = np.bincount(self.owner, weights=self.echo, minlength=len(block))
        ratio = lambda part, whole: np.sqrt(np.minimum(part / whole, 4.0))
        return np.column_stack(
            [
                np.log1p(self.n_words),
                np.log1p(self.word_chars / words),
                ratio(self.n_symbols, chars),
                ratio(block.per_text(_MARK[data]), words),
                ratio(block.per_text(_UPPER[data]), letters),
                ratio(block.per_text(_PIPE[data]), words),
                ratio(block.per_text(_DIGIT[data]), chars),
                ratio(echo, words),
                ratio(self.n_repeat_words, words),
                ratio(block.per_text(_COMMA[data]), words),
                self.distinct_words() / words,
                np.log1p(self.n_words / np.maximum(lines, 1)),
            ]
        ).astype(np.float64)

    def lines(self) -> Lines:
        """Binary features of each line with a word, in the order of LINE_FEATURES."""
        data = self.block.data
        words = (self.line_last - self.line_first).astype(np.float64)

        def over_bytes(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(mask, out=total[1:])
            return total[self.line_end] - total[self.line_start]

        def over_words(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(mask) + 1, dtype=np.int64)
            np.cumsum(mask, out=total[1:])
            return total[self.line_last] - total[self.line_first]

        chars = np.maximum(over_bytes(K.SPACE_WORD[data] & K.CODE_POINT[data]), 1)
        letters = np.maximum(over_bytes(_LETTER[data]), 1)
        symbols, pipes = over_bytes(SYMBOLS[data]) / chars, over_bytes(_PIPE[data]) / np.maximum(words, 1)
        repeated = over_words(self.covered) / np.maximum(words, 1)
        tail = data[np.maximum(self.line_end - 1, 0)] if len(data) else np.zeros(0, dtype=np.uint8)
        mean = chars / np.maximum(words, 1)
        found = [
            np.ones(len(words), dtype=bool),
            words < 3,
            (words >= 3) & (words < 10),
            words >= 10,
            symbols > 0.03,
            symbols > 0.15,
            over_bytes(_MARK[data]) / np.maximum(words, 1) > 0.3,
            over_bytes(_UPPER[data]) / letters > 0.5,
            pipes > 0.2,
            over_bytes(_DIGIT[data]) / chars > 0.3,
            _STOP[tail] if len(tail) else np.zeros(0, dtype=bool),
            self.line_again,
            over_words(self.echo) / np.maximum(words, 1) > 0.3,
            repeated > 0.5,
            (repeated > 0.1) & (repeated <= 0.5),
            mean > 12,
            mean < 2.5,
        ]
        return Lines(self.line_owner, words.astype(np.int64), np.column_stack(found).astype(np.float64).reshape(len(words), len(LINE_FEATURES)))
