"""Vectorised text kernels shared by the Arrow-based operators.

All of them work on one block of texts laid end to end as UTF-8 bytes. Words,
lines and shingles are located with table look-ups on the bytes and hashed with
a prefix polynomial modulo 2**64, so that no Python object is made per word.
Memory is about 40 bytes for each byte of a block; a block holds at most
``BLOCK_BYTES`` unless one single text is longer.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking 64-bit value for each byte; the hash of a word is a polynomial in them.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[_FOLD]

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SPACE_WORD = ~SPACE
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[48:58] = ALNUM_WORD[65:91] = ALNUM_WORD[97:123] = ALNUM_WORD[128:] = True
CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def table(chars: bytes) -> np.ndarray:
    """Look-up table that is true for the given bytes."""
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


class Block:
    """Texts laid end to end: ``data`` (uint8) and ``offsets`` (one more than texts)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, offsets, data = texts.buffers()
        n = len(texts)
        if n == 0 or offsets is None:
            self.offsets = np.zeros(n + 1, dtype=np.int64)
            self.data = np.zeros(0, dtype=np.uint8)
            return
        raw = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        self.data = whole[raw[0] : raw[-1]]
        self.offsets = raw.astype(np.int64) - int(raw[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def prefix_hash(self, values: np.ndarray) -> np.ndarray:
        up, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(values[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
        _, down = _powers(len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * down[starts])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes within one text: starts, ends, number of the text."""
        n = len(self.data)
        if n == 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (cut[:-1] | ~before))
        ends = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans between line feeds, empty ones included; every text has at least one."""
        breaks = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.offsets, breaks, side="right") - 1
        texts = np.arange(len(self))
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.offsets[1:]])
        # starts: each text's begin and what follows each break; ends: each break and each text's end
        start_owner = np.concatenate([texts, owner])
        order = np.lexsort((np.concatenate([np.full(len(texts), -1), breaks]), start_owner))
        end_owner = np.concatenate([owner, texts])
        order_end = np.lexsort((np.concatenate([breaks, np.full(len(texts), len(self.data) + 1)]), end_owner))
        return starts[order], ends[order_end], start_owner[order]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of a batch whose texts have about ``limit`` bytes, each with its block."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at, n = 0, len(sizes)
    while at < n:
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, stop - at), Block(texts.slice(at, stop - at))
        at = stop


def gram_hash(words: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words within one text, and the place of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    out = words[at].copy()
    for j in range(1, k):
        out *= np.uint64(0xC6A4A7935BD1E995)
        out ^= out >> np.uint64(29)
        out += words[at + j]
    return mix(out), at


def repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does its text have it twice or more; is this an occurrence after the first."""
    many = np.zeros(len(keys), dtype=bool)
    later = np.zeros(len(keys), dtype=bool)
    if len(keys):
        own = mix(keys ^ mix(owner.astype(np.uint64) + np.uint64(0x51ED27)))
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        later[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, later


def reachable(spark) -> None:
    """Let Python workers import this package where its folder is shared with them."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH", "")]))


def map_arrow(df, function: Callable, schema: str):
    """mapInArrow by workers that can import this package."""
    reachable(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_folder(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = known.get() if known.isDefined() else f"file://{tempfile.mkdtemp(prefix='stratafold-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df):
    """The rows of df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder while an operator runs, and removed after it."""

    def __init__(self, spark):
        import uuid

        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = 0

    def __enter__(self) -> Scratch:
        return self

    def put(self, df):
        """df written as Parquet and read again: its lineage is cut and any executor can read it."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
