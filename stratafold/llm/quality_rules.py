"""Quality rules: base counts, and a linear-chain conditional random field over lines.

Every line that holds a word gets binary features; Viterbi decoding marks it as
content or boilerplate, and a text is kept if enough of its words stand in
content lines. The field is trained here on a bounded sample of labelled
documents (``sample`` documents of ``labels``, ``quality`` 1 or 0, and of each at
most ``lines`` lines in a row). Labels of documents become labels of lines by a weak
rule: a line's features have a probability in lines of kept and of rejected documents;
with even odds in rejected documents, and odds of 1 to 19 in kept ones, the
likelier class labels the line, so that documents of both classes hold lines of
both. The field learns from these by gradient ascent on the conditional likelihood
with exact forward-backward sums.

Null texts count as empty: no word, ``base_failed`` true. Null ids are passed
through, repeated rows are judged each on its own, ties of the decoding go to
content, a very long text is decoded whole within its task, empty tables give no
rows, and other columns, whatever their names, are ignored by ``judge`` and kept by
``keep``. Without labels of both classes the fixed prior weights below decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm import kernels as K
from stratafold.llm.doc_stats import LINE_FEATURES, Stats

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"
CONTENT_SHARE = 0.5
#: The training sample: documents, and lines of each.
SAMPLE, LINES = 2000, 500
#: Probability of boilerplate, before its features are seen, of a line of a rejected and of a kept document.
ODDS = (0.5, 0.05)
SEGMENT = 200
#: Weights towards content before training; zero where the data have to say it.
PRIOR = dict.fromkeys(LINE_FEATURES, 0.0) | {"bias": 1.0, "many symbols": -2.0, "marks": -2.0, "capitals": -1.0, "pipes": -2.0, "echo": -3.0, "much repeated": -1.0}


class LineField:
    """Weights of the two-state field: ``emit`` (features, scores of content), ``move`` (from, to) and ``begin``; state 1 is content."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None, begin: np.ndarray | None = None):
        self.emit = np.array(list(PRIOR.values())) if emit is None else emit
        self.move = np.array([[0.5, -0.5], [-0.5, 0.5]]) if move is None else move
        self.begin = np.zeros(2) if begin is None else begin

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Of each line and state; only the difference matters, so state 0 has none."""
        out = np.zeros((len(features), 2))
        out[:, 1] = features @ self.emit
        return out

    def decode(self, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The most likely state of each line; lines of a text are consecutive. Ties go to content."""
        n = len(owner)
        states = np.ones(n, dtype=bool)
        if not n:
            return states
        score = self.scores(features)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        length = np.diff(np.r_[first, n])
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        back = np.zeros((n, 2), dtype=bool)
        best = score[first] + self.begin
        steps = int(length[0])
        alive = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
        for t in range(1, steps):
            k = alive[t]
            ways = best[:k, :, None] + self.move[None]
            pick = ways[:, 1, :] >= ways[:, 0, :]
            back[first[:k] + t] = pick
            best[:k] = np.where(pick, ways[:, 1, :], ways[:, 0, :]) + score[first[:k] + t]
        state = best[:, 1] >= best[:, 0]
        for t in range(steps - 1, -1, -1):
            k = alive[t]
            own = first[:k] + t
            states[own] = state[:k]
            if t:
                state[:k] = back[own, state[:k].astype(int)]
        return states

    def fit(self, features: np.ndarray, owner: np.ndarray, content: np.ndarray, rounds: int = 60, ridge: float = 0.02) -> LineField:
        """Adam on the penalised mean log-likelihood; long texts are cut into segments of SEGMENT lines."""
        place = np.arange(len(owner)) - np.maximum.accumulate(np.where(np.r_[True, owner[1:] != owner[:-1]], np.arange(len(owner)), 0))
        sequence = np.cumsum(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] % SEGMENT == 0)]) - 1
        first = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        length = np.diff(np.r_[first, len(owner)])
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        steps, many = int(length[0]), len(first)
        alive = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
        y = content.astype(int)
        prior = np.concatenate([self.emit, self.move.ravel(), self.begin])
        w, m, v = prior.copy(), np.zeros_like(prior), np.zeros_like(prior)
        d = features.shape[1]
        seen_move = np.zeros((2, 2))
        for t in range(1, steps):
            own = first[: alive[t]] + t
            np.add.at(seen_move, (y[own - 1], y[own]), 1)
        seen = np.concatenate([features[y == 1].sum(0), seen_move.ravel(), np.bincount(y[first], minlength=2)])
        for step in range(1, rounds + 1):
            field = LineField(w[:d], w[d : d + 4].reshape(2, 2), w[d + 4 :])
            score = field.scores(features)
            ahead = np.zeros((len(owner), 2))
            ahead[first] = score[first] + field.begin
            for t in range(1, steps):
                own = first[: alive[t]] + t
                ahead[own] = np.logaddexp(ahead[own - 1, 0, None] + field.move[0], ahead[own - 1, 1, None] + field.move[1]) + score[own]
            behind = np.zeros((len(owner), 2))
            pair = np.zeros((2, 2))
            last = first + length - 1
            norm = np.logaddexp(ahead[last, 0], ahead[last, 1])
            for t in range(steps - 1, 0, -1):
                k = alive[t]
                own = first[:k] + t
                inner = (score[own] + behind[own])[:, None, :] + field.move[None]
                behind[own - 1] = np.logaddexp(inner[:, :, 0], inner[:, :, 1])
                pair += np.exp(ahead[own - 1][:, :, None] + inner - norm[:k, None, None]).sum(0)
            share = np.exp(ahead[:, 1] + behind[:, 1] - _spread(norm, first, len(owner)))
            expected = np.concatenate([features.T @ share, pair.ravel(), [np.sum(1 - share[first]), np.sum(share[first])]])
            slope = (seen - expected) / many - ridge * (w - prior)
            m = 0.9 * m + 0.1 * slope
            v = 0.99 * v + 0.01 * slope**2
            w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return LineField(w[:d], w[d : d + 4].reshape(2, 2), w[d + 4 :])


def _spread(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Each line gets the value of its sequence; sequences are consecutive but listed by length."""
    order = np.argsort(first)
    return np.repeat(values[order], np.diff(np.r_[first[order], n]))


def weak_labels(features: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Is each line content: by independent features of lines of kept and rejected documents, and the odds of its own document's class."""
    rate = [(features[kept == k].sum(0) + 1) / ((kept == k).sum() + 2) for k in (False, True)]
    ratio = features @ (np.log(rate[0]) - np.log(rate[1])) + (1 - features) @ (np.log1p(-rate[0]) - np.log1p(-rate[1]))
    return ratio <= np.where(kept, *(np.log((1 - p) / p) for p in reversed(ODDS)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> LineField:
    """Fit the field on at most ``sample`` labelled documents, those with the smallest hashed ids, and ``lines`` lines in a row of each, from a hashed place; these bounds also make the broadcast and the collecting safe."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    width = len(LINE_FEATURES)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in K.blocks(batch, "text"):
                found = Stats(block).lines()
                label = part.column(part.schema.get_field_index("label")).to_numpy()
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy()
                bits = (found.features @ (2.0 ** np.arange(width))).astype(np.int64)
                for i in range(len(block)):
                    own = bits[found.owner == i]
                    if len(own):
                        at = int(K.mix(np.array([ids[i]], dtype=np.int64).view(np.uint64))[0] % np.uint64(max(len(own) - lines, 0) + 1))
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i]]), pa.array([int(label[i])], pa.int32()), pa.array([own[at : at + lines].tolist()], pa.list_(pa.int64()))], ["doc_id", "label", "bits"])

    # of rows with one doc_id, one counts
    one = K.map_arrow(rows, described, "doc_id long, label int, bits array<long>").groupBy("doc_id", "label").agg(F.min("bits").alias("bits"))
    got = sorted(tuple(r) for r in one.collect())
    if len({label for _, label, _ in got}) < 2:
        return LineField()
    bits = np.concatenate([np.array(b, dtype=np.int64) for *_, b in got])
    owner = np.repeat(np.arange(len(got)), [len(b) for *_, b in got])
    kept = np.repeat([label == 1 for _, label, _ in got], [len(b) for *_, b in got])
    features = ((bits[:, None] >> np.arange(width)) & 1).astype(np.float64)
    return LineField().fit(features, owner, weak_labels(features, kept))


def _verdicts(block: K.Block, field: LineField, least: float) -> tuple[Stats, np.ndarray, np.ndarray, np.ndarray]:
    stats = Stats(block)
    lines = stats.lines()
    content = field.decode(lines.features, lines.owner)
    share = np.bincount(lines.owner, weights=lines.words * content, minlength=len(block)) / np.maximum(stats.n_words, 1)
    failed = (stats.n_words < 10) | (100 * stats.n_repeat_words > 20 * stats.n_words)
    return stats, share, failed, ~failed & (share >= least)


def judge(docs: DataFrame, field: LineField, least: float = CONTENT_SHARE) -> DataFrame:
    """Per document the base counts, the share of words in content lines, and the verdict."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in K.blocks(batch, "text"):
                stats, share, failed, kept = _verdicts(block, field, least)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *(pa.array(x) for x in (stats.n_words, stats.word_chars, stats.n_symbols, stats.n_dup_lines, stats.n_repeat_words, share, failed, kept))],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return K.map_arrow(docs.select("doc_id", "text"), rows, SCHEMA)


def keep(docs: DataFrame, field: LineField, least: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs, with all their columns, whose texts are kept."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in K.blocks(batch, "text"):
                kept = _verdicts(block, field, least)[3]
                yield part.filter(pa.array(kept))

    return K.map_arrow(docs, rows, docs.schema)
