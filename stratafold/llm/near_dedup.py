"""MinHash near-dedup: BagMinHash signatures, banding, verified multiset overlap, classes.

A text is the multiset of its runs of five words (words are stretches of letters,
digits and bytes above 127, A-Z lower-cased; texts of one to four words are one
run). BagMinHash: the weight axis is cut into the dyadic stretches [0,1), [1,2),
[2,4) ...; each run has one Poisson process per stretch, whose points come in
order of time, each with a component and a place on the stretch; a text sees the
points placed below the run's count, and only up to a time at which all its
components are filled. Two signatures agree in a component with the weighted
Jaccard similarity as probability.

Equal texts are one node, found by digest. Nodes that share a band's bucket are
checked first against hubs of the bucket; then, in buckets that still hold several
components, its members are dealt into blocks of bounded size, and each pair of
blocks is compared as a whole by one matrix product, which gives the overlap of
every pair without a row for it and yields at most a spanning tree of new links. So
each candidate pair is verified or lies within a class already. Before texts are fetched, pairs are screened by
four bits of each signature component: a pair stays unless it disagrees in five
standard deviations more components than the similarity asks for, so that the
screen loses fewer links than banding itself. Links are pairs of similarity 0.8 or
more; classes are connected components by alternating large and small stars.
All of that is aggregations and skew-splittable joins over tables in the shared
folder; nothing but counts reaches the driver.

Rows are numbered once and written with their numbers to the shared folder, so that a
lost executor or another split of the files cannot number them anew. A block holds
at most about ``BLOCK_RUNS`` runs and ``BLOCK_TEXTS`` texts, and members of a bucket
are screened by blocks too, so no task grows with a bucket.

Null texts count as empty; texts without a word are only alike if equal. Repeated
rows and null ids are classed like others; a class's id is its least doc_id (null
if all are null), its representative the first row with that id. A very long text is
signed and compared whole within its task. Other columns are kept by ``keep``,
whatever their names, and ignored by ``classes``. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm import kernels as K

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
HUBS = 3
NIBBLES = 16
#: Runs of words and texts in a block, on average, and columns of a matrix that are filled at a time.
BLOCK_RUNS, BLOCK_TEXTS = 200_000, 2_000
#: Members of a bucket in a block of the screening by sketches.
SCREENED = 4_000
WIDTH = 4096


def shingles(block: K.Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of k words; a shorter text with a word is one run."""
    starts, ends, owner = block.runs(K.ALNUM_WORD[block.data])
    words = block.span_hash(block.prefix_hash(K.FOLDED_VALUES), starts, ends)
    grams, at = K.gram_hash(words, owner, k)
    count = np.bincount(owner, minlength=len(block))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(owner, short)
        h = np.full(len(short), 0xA5A5, dtype=np.uint64)
        for j in range(k - 1):
            more = count[short] > j
            h[more] = K.mix(h[more] * np.uint64(31) + words[first[more] + j])
        return np.concatenate([grams, h]), np.concatenate([owner[at], short])
    return grams, owner[at]


def counted(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key): a combined key in rising order, the key, the text, how often."""
    own = K.mix(keys ^ K.mix(owner.astype(np.uint64) + np.uint64(0x51ED27)))
    order = np.argsort(own)
    ranked = own[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=np.int64)
    return ranked[first], keys[order[first]], owner[order[first]], np.diff(np.r_[first, len(ranked)])


def bag_signature(keys: np.ndarray, owner: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """Times of the first visible point of each component, for n texts; infinite for texts without keys."""
    weight = np.bincount(owner, weights=count, minlength=n)
    out = np.full((n, m), np.inf)
    limit = (np.log(m) + 3.0) / np.maximum(weight, 1)
    seeds, texts, seen, begin, length = [K.mix(keys)], [owner], [count], [np.zeros(len(keys), dtype=np.int64)], [np.ones(len(keys), dtype=np.int64)]
    low = 1
    while (more := np.flatnonzero(count > low)).size:
        seeds.append(K.mix(keys[more] + np.uint64(low * 0xD6E8FEB86659FD93 % (1 << 64))))
        texts.append(owner[more])
        seen.append(count[more])
        begin.append(np.full(len(more), low))
        length.append(np.full(len(more), low))
        low *= 2
    seeds, texts, seen, begin, length = (np.concatenate(x) for x in (seeds, texts, seen, begin, length))
    todo = np.flatnonzero(weight > 0)
    rows = np.arange(len(seeds))
    while len(todo):
        flat = np.full(n * m, np.inf)
        seed, text, time, step = seeds[rows], texts[rows], np.zeros(len(rows)), 0
        rate, top = 1.0 / (m * length[rows]), limit[texts[rows]]
        place, stop, wide = begin[rows], seen[rows], length[rows]
        while len(seed):
            step += 1
            u = K.mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
            live = time < top
            seed, text, time, rate, top, place, stop, wide, u = (x[live] for x in (seed, text, time, rate, top, place, stop, wide, u))
            v = K.mix(u ^ np.uint64(0xC2B2AE3D27D4EB4F))
            part = ((v >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            hit = place + (((v & np.uint64(0xFFFFFFFF)) * wide.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) < stop
            np.minimum.at(flat, text[hit] * m + part[hit].astype(np.int64), time[hit])
        flat = flat.reshape(n, m)
        out[todo] = flat[todo]
        todo = todo[np.isinf(out[todo]).any(1)]
        limit[todo] *= 2.5
        again = np.zeros(n, dtype=bool)
        again[todo] = True
        rows = np.flatnonzero(again[texts])
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    out = K.mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]))
    for r in range(rows):
        out = K.mix(out * np.uint64(0xFF51AFD7ED558CCD) + bits[:, :, r])
    return out.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each component, sixteen components in a long integer."""
    n, m = signature.shape
    bits = np.zeros((n, -(-m // NIBBLES) * NIBBLES), dtype=np.uint64)
    bits[:, :m] = K.mix(signature.view(np.uint64)) >> np.uint64(60)
    places = np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4)
    return (bits.reshape(n, -1, NIBBLES) << places).sum(2, dtype=np.uint64).view(np.int64)


def _sketch_names(m: int, prefix: str = "s") -> list[str]:
    return [f"{prefix}{i}" for i in range(-(-m // NIBBLES))]


def _close(m: int, similarity: float, one: str, two: str):
    """Do two sketches disagree in no more components than a pair of the similarity may."""
    ones = int("1" * NIBBLES, 16)
    different = F.lit(0)
    for a, b in zip(_sketch_names(m, one), _sketch_names(m, two)):
        x = F.col(a).bitwiseXOR(F.col(b))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        different = different + F.bit_count(x.bitwiseAND(F.lit(ones)))
    p = similarity + (1 - similarity) / NIBBLES
    return different <= int(m * (1 - p) + 5 * np.sqrt(m * p * (1 - p)))


def _fingerprints(numbered: DataFrame, bands: int, rows: int) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in K.blocks(batch, "text"):
                n = len(block)
                _, keys, owner, count = counted(*shingles(block))
                size = np.bincount(owner, weights=count, minlength=n).astype(np.int64)
                signature = bag_signature(keys, owner, count, n, bands * rows)
                hashes, sketch = band_hashes(signature, bands, rows), sketches(signature)
                raw = block.data.tobytes()
                digest = [hashlib.md5(raw[a:b], usedforsecurity=False).digest() for a, b in zip(block.offsets[:-1], block.offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(size > 0, bands, 0))], pa.int32()), pa.array(hashes[size > 0].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(size), lists, *(pa.array(c) for c in sketch.T)], ["rid", "doc_id", "digest", "n", "bands", *names])

    names = _sketch_names(bands * rows)
    return K.map_arrow(numbered, signed, f"rid long, doc_id long, digest binary, n long, bands array<long>, {', '.join(f'{c} long' for c in names)}")


def _verified(pairs: DataFrame, numbered: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have a multiset overlap of at least ``least``. Texts are fetched by a sort-merge join at every size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, total = 0, batch.num_rows
            while at < total:
                left = None
                for left, one in K.blocks(batch.slice(at), "ta", K.BLOCK_BYTES // 2):
                    break
                two = K.Block(left.column(left.schema.get_field_index("tb")))
                ka, _, oa, ca = counted(*shingles(one))
                kb, _, ob, cb = counted(*shingles(two))
                n = left.num_rows
                place = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
                same = kb[place] == ka if len(kb) else np.zeros(len(ka), dtype=bool)
                shared = np.bincount(oa[same], weights=np.minimum(ca[same], cb[place[same]]), minlength=n)
                whole = np.bincount(oa, weights=ca, minlength=n) + np.bincount(ob, weights=cb, minlength=n) - shared
                yield left.select(["a", "b"]).filter(pa.array((shared >= least * whole - 1e-9) & (whole > 0)))
                at += n

    both = pairs.select(F.col("a").alias("rid"), "a", "b").union(pairs.select("b", "a", "b"))
    found = both.join(numbered.select("rid", "text").hint("merge"), "rid").groupBy("a", "b").agg(F.min(F.struct("rid", "text")).alias("one"), F.max(F.struct("rid", "text")).alias("two"))
    return K.map_arrow(found.select("a", "b", F.col("one.text").alias("ta"), F.col("two.text").alias("tb")), rows, "a long, b long")


def _block_links(ids: np.ndarray, roots: np.ndarray, sides: np.ndarray, texts: pa.Array, least: float) -> list[tuple[int, int]]:
    """Links of at least the overlap between texts of different roots, one for each two roots of a spanning tree.

    Sides are 0 and 1; with both present only texts of different sides are compared.
    """
    keys, owner = shingles(K.Block(texts))
    keys, owner = _numbered_runs(keys, owner)
    names, at, often = np.unique(keys, return_inverse=True, return_counts=True)
    n = len(ids)
    size = np.bincount(owner, minlength=n)
    shared = np.zeros((n, n), dtype=np.float32)
    at = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[at]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, WIDTH):
        a, b = np.searchsorted(at, [low, low + WIDTH])
        part = np.zeros((n, WIDTH), dtype=np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        shared += part @ part.T
    whole = size[:, None] + size[None, :] - shared
    good = (shared >= least * whole - 1e-4) & (whole > 0) & (roots[:, None] < roots[None, :])
    if sides.any() and not sides.all():
        good &= sides[:, None] != sides[None, :]
    tree: dict[int, int] = {}

    def top(x: int) -> int:
        while tree.setdefault(x, x) != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    out = []
    one, two = np.nonzero(good)
    _, first = np.unique(np.stack([roots[one], roots[two]]), axis=1, return_index=True)
    for i, j in zip(one[first].tolist(), two[first].tolist()):
        x, y = top(int(roots[i])), top(int(roots[j]))
        if x != y:
            tree[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _numbered_runs(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset as a set: the second occurrence of a run in a text is another key than the first, and so on."""
    _, key, text, count = counted(keys, owner)
    row = np.repeat(np.arange(len(key)), count)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return K.mix(key[row] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), text[row]


def _between(members: DataFrame, numbered: DataFrame, least: float) -> DataFrame:
    """New links (a, b) between different roots within each bucket of members (bucket, rid, n, root)."""
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_RUNS, F.count("*") / BLOCK_TEXTS, F.lit(1.0))).cast("int")
    load = members.groupBy("bucket").agg(blocks.alias("blocks"))
    dealt = members.join(load, "bucket").withColumn("block", F.pmod(F.xxhash64("rid", "bucket"), F.col("blocks")).cast("int"))
    full = dealt.join(numbered.select("rid", "text").hint("merge"), "rid")
    pairs = full.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = pairs.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "rid", "root", "block", "text")

    def linked(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid").combine_chunks()
        sides = table["block"].to_numpy() != table["i"].to_numpy()
        texts = table["text"].combine_chunks()
        found = _block_links(table["rid"].to_numpy(), table["root"].to_numpy(), sides, texts, least)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    K.reachable(numbered.sparkSession)
    return tasks.groupBy("bucket", "i", "j").applyInArrow(linked, "a long, b long")


def components(scratch: K.Scratch, links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component."""
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = scratch.put(edges.union(edges.select("v", "u").toDF("u", "v")))
        least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        edges = scratch.put(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = scratch.put(edges.groupBy("u").agg(F.min("v").alias("m")))
        edges = scratch.put(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.toDF("node", "root")
        mark = tuple(now)


def _alike(a: str, b: str, least: float):
    """Texts of so different sizes cannot reach the similarity."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def _screened(scratch: K.Scratch, known: DataFrame, sketches_: DataFrame, m: int, similarity: float) -> DataFrame:
    """Members (bucket, rid, n, root) of buckets with several components that may be alike with one of another component.

    Members are dealt into blocks, and each pair of blocks is a key of its own.
    """
    parts = F.ceil(F.count("*") / SCREENED).cast("int")
    mixed = known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), parts.alias("parts")).where("low < high").select("bucket", "parts")
    dealt = known.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("nid", "bucket"), F.col("parts")).cast("int"))
    dealt = scratch.put(dealt.withColumnRenamed("nid", "y").join(sketches_, "y"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = dealt.withColumn("with", every)
    names = _sketch_names(m)
    other = dealt.select("bucket", F.col("part").alias("with"), every.alias("part"), F.col("n").alias("xn"), F.col("root").alias("xroot"), *(F.col("y" + c).alias("x" + c) for c in names))
    other = other.select(*(F.col(c).alias("o_" + c) for c in ("bucket", "part", "with")), "xn", "xroot", *("x" + c for c in names))
    keys = (F.col("bucket") == F.col("o_bucket")) & (F.col("part") == F.col("o_part")) & (F.col("with") == F.col("o_with"))
    maybe = keys & (F.col("root") != F.col("xroot")) & _alike("n", "xn", similarity) & _close(m, similarity, "xs", "ys")
    return scratch.put(one.join(other, maybe, "left_semi").select("bucket", F.col("y").alias("rid"), "n", "root").distinct())


def _classes(scratch: K.Scratch, numbered: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    m = bands * rows
    prints = scratch.put(_fingerprints(numbered, bands, rows))
    nodes = scratch.put(
        prints.groupBy("digest").agg(
            F.min("rid").alias("nid"),
            F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "rid")).alias("rep"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
            *(F.first(c).alias(c) for c in _sketch_names(m)),
        )
    )
    sketch = {p: nodes.select(F.col("nid").alias(p), *(F.col(c).alias(p + c) for c in _sketch_names(m))) for p in ("a", "b", "y")}
    placed = nodes.select("nid", "n", F.posexplode("bands").alias("band", "bucket"))
    rank = F.xxhash64("nid", F.col("band") % HUBS)
    hubs = scratch.put(placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(rank.alias("rank"), "nid", "n")).alias("hub")).where("size > 1").select("bucket", F.col("hub.nid").alias("hub"), F.col("hub.n").alias("hub_n")))
    mates = scratch.put(placed.select("bucket", "nid", "n").join(hubs, "bucket"))
    near = mates.where((F.col("nid") != F.col("hub")) & _alike("n", "hub_n", similarity))
    near = near.select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b")).distinct()
    pairs = scratch.put(near.join(sketch["a"], "a").join(sketch["b"], "b").where(_close(m, similarity, "as", "bs")).select("a", "b"))
    roots = components(scratch, scratch.put(_verified(pairs, numbered, similarity)))
    # What shares a bucket and is not yet in one component.
    known = scratch.put(mates.select("bucket", "nid", "n").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid")))
    left = _screened(scratch, known, sketch["y"], m, similarity)
    if not left.isEmpty():
        more = scratch.put(_between(left, numbered, similarity))
        if not more.isEmpty():
            roots = components(scratch, more.union(roots.select("node", "root")))
    rooted = scratch.put(nodes.select("digest", "nid", "rep").join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid")))
    best = rooted.groupBy("root").agg(F.min("rep").alias("best"), F.count("*").alias("n_texts"))
    named = scratch.put(rooted.join(scratch.put(best), "root").select("digest", F.col("best.doc_id").alias("class_id"), F.col("best.rid").alias("best"), "n_texts"))
    return K.settled(prints.select("rid", "doc_id", "digest").join(named, "digest").select("rid", "doc_id", "class_id", "n_texts", (F.col("rid") == F.col("best")).alias("representative")))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: rid (a number of its own), doc_id, class_id, n_texts (different texts in the class), representative (one row of each class)."""
    with K.Scratch(docs.sparkSession) as scratch:
        numbered = scratch.put(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
        return _classes(scratch, numbered, similarity, bands, rows)


def keep(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that represent their class."""
    number = "rid of the scan"
    numbered = K.settled(docs.withColumn(number, F.monotonically_increasing_id()))
    with K.Scratch(docs.sparkSession) as scratch:
        found = _classes(scratch, numbered.select(F.col(number).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), similarity, bands, rows)
    dropped = found.where("not representative").select(F.col("rid").alias(number))
    return numbered.join(dropped, number, "left_anti").select(*docs.columns)
