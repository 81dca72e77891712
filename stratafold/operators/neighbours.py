"""Spatial joins: radius, k nearest, sectors.

Points are binned into square cells and joined on cell numbers, so every join is a
hash equi-join with a distance filter. Without a radius the k nearest are found in
rounds of growing cells: a query leaves as soon as its k-th distance is covered by
its cells; later rounds only hold sparse queries. Equal distances are ordered by
the neighbour's id.

Where cells of the radius hold many points, no pair becomes a row: a search for a
bounded number of neighbours deals points to smaller cells and ranks each cell in
Arrow batches, and sums over all pairs are taken block against block. What is
shuffled then grows with the points, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions.scalar import sector
from stratafold.session import reachable, settled


#: Points of a cell, as a multiple of the neighbours wanted, from which on cells are made smaller, and how often.
CROWDED, CROWDED_ROUNDS = 32, 8
#: Points of a cell of the radius from which on no pair becomes a row, points of a cell at the densest place of a search, growth of cells between its rounds.
DENSE, DEALT, GROWTH = 64, 96, 3.0
#: Points of a block of pairs, and pairs computed at once.
BLOCK, AT_ONCE = 4096, 1 << 17


def distance(axes: Sequence[str], one: str = "q", two: str = "n") -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (F.pow(F.col(f"{one}.{c}") - F.col(f"{two}.{c}"), F.lit(2.0)) for c in axes)))


def _celled(points: DataFrame, axes: Sequence[str], size: float, spread: bool) -> DataFrame:
    """Cell numbers of each point; with spread, also those of the cells around it."""
    for c in axes:
        cell = F.floor(F.col(c) / size)
        cell = F.explode(F.array(cell - 1, cell, cell + 1)) if spread else cell
        points = points.withColumn(f"_cell_{c}", cell)
    return points


def radius_join(queries: DataFrame, points: DataFrame, radius: float, axes: Sequence[str] = ("x", "y"), strict: bool = False, other: bool = False, keep: Sequence[str] = ("value",), carry: Sequence[str] = ()) -> DataFrame:
    """(qid, nid, dist, the kept columns of the neighbour and the carried ones of the query, as q_name) for pairs within the radius; ``other`` leaves out equal ids."""
    q = _celled(queries.select("id", *dict.fromkeys((*axes, *carry))), axes, radius, True).alias("q")
    n = _celled(points.select("id", *dict.fromkeys((*axes, *keep))), axes, radius, False).alias("n")
    on = reduce(lambda a, b: a & b, (F.col(f"q._cell_{c}") == F.col(f"n._cell_{c}") for c in axes))
    found = q.join(n, on).select(F.col("q.id").alias("qid"), F.col("n.id").alias("nid"), distance(axes).alias("dist"), *(F.col(f"n.{c}").alias(c) for c in keep), *(F.col(f"q.{c}").alias(f"q_{c}") for c in carry))
    found = found.where(F.col("dist") < radius if strict else F.col("dist") <= radius)
    return found.where("qid <> nid") if other else found


def ranked(found: DataFrame, k: int | None = None, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Neighbours numbered from the nearest on, at most k of them."""
    out = found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("dist", "nid")).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def nearest_join(queries: DataFrame, points: DataFrame, k: int, axes: Sequence[str] = ("x", "y"), other: bool = False, keep: Sequence[str] = ("value",), rounds: int = 40) -> DataFrame:
    """The k nearest points of each query without a radius: (qid, nid, dist, kept columns, rank). Rows with a null or NaN coordinate are no points and find none."""
    queries, points = (df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in axes))) for df in (queries, points))
    ends = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{f.__name__}") for c in axes for f in (F.min, F.max))).first()
    n = ends["n"]
    want = min(k, n - 1 if other else n)
    spans = [(ends[f"{c}_max"] or 0.0) - (ends[f"{c}_min"] or 0.0) for c in axes]
    full = [s for s in spans if s > 0] or [1.0]
    area = reduce(lambda a, b: a * b, full)
    size = (area * 2.0 * max(want, 1) / max(n, 1)) ** (1 / len(full)) or 1.0
    out, left = None, queries.select("id", *axes)
    reach = reduce(lambda a, b: a + b, (s * s for s in spans)) ** 0.5
    # smaller cells while one of them is crowded, as with clusters or a far point
    for _ in range(CROWDED_ROUNDS):
        full_cell = points.groupBy(*(F.floor(F.col(c) / size) for c in axes)).count().agg(F.max("count")).first()[0] or 0
        if full_cell <= max(CROWDED * want, CROWDED):
            break
        size *= (max(CROWDED * want, CROWDED) / (4 * full_cell)) ** (1 / len(full))
    for _ in range(rounds):
        found = ranked(radius_join(left, points, size, axes, other=other, keep=keep), want)
        done = settled(found.withColumn("_n", F.count("*").over(W.partitionBy("qid"))).where(F.col("_n") >= want).drop("_n"))
        out = done if out is None else out.unionByName(done)
        left = settled(left.join(done.select(F.col("qid").alias("id")).distinct(), "id", "left_anti"))
        if want <= 0 or left.isEmpty():
            return out
        size *= 2
        far = left.crossJoin(F.broadcast(points.agg(*(f(c).alias(f"_{c}_{f.__name__}") for c in axes for f in (F.min, F.max)))))
        gap = F.sqrt(reduce(lambda a, b: a + b, (F.pow(F.greatest(F.abs(F.col(c) - F.col(f"_{c}_min")), F.abs(F.col(c) - F.col(f"_{c}_max"))), F.lit(2.0)) for c in axes)))
        if size > reach:
            size = max(size, far.agg(F.max(gap)).first()[0] * 1.0001 + 1e-9)
    raise RuntimeError(f"{left.count()} queries have not found {want} neighbours in {rounds} rounds")


def _cells(axes: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).alias(f"_cell_{c}") for c in axes]


def _finite(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Rows that have a place; others are within no distance of any."""
    return df.where(reduce(lambda a, b: a & b, (F.abs(F.col(c).cast("double")) < float("inf") for c in axes)))


def densest(points: DataFrame, axes: Sequence[str], size: float) -> int:
    """Points of the fullest cell."""
    return _finite(points, axes).groupBy(*_cells(axes, size)).count().agg(F.max("count")).first()[0] or 0


def radius_nearest(queries: DataFrame, points: DataFrame, k: int, radius: float, axes: Sequence[str] = ("x", "y"), strict: bool = True, other: bool = False, keep: Sequence[str] = ("value",), unlike: str | None = None) -> DataFrame:
    """At most k nearest points closer than the radius; with ``unlike`` only those that differ from the query in that column."""
    if densest(points, axes, radius) > max(DENSE, 4 * k):
        return _dealt_nearest(queries, points, k, radius, axes, strict, other, keep, unlike)
    if unlike is None:
        return ranked(radius_join(queries, points, radius, axes, strict, other, keep), k)
    found = radius_join(queries, points, radius, axes, strict, other, tuple(dict.fromkeys((*keep, unlike))), carry=(unlike,))
    return ranked(found.where(F.col(unlike) != F.col(f"q_{unlike}")).select("qid", "nid", "dist", *keep), k)


def _dealt_nearest(queries: DataFrame, points: DataFrame, k: int, radius: float, axes: Sequence[str], strict: bool, other: bool, keep: Sequence[str], unlike: str | None = None, sectors: int = 0) -> DataFrame:
    """radius_nearest, or with sectors the k nearest of each, by rounds of growing cells up to the radius.

    Queries and the points around them meet cell by cell in Arrow batches. A query leaves as soon as its k-th distance is
    covered by its cells. Of points at one place only the first ids can be found, so further copies are left out at once.
    """
    reachable(points.sparkSession)
    fold = [unlike] if unlike else []
    named = lambda df, extra: _finite(df, axes).select(F.col("id").alias("id"), *(F.col(c).cast("double").alias(f"_{c}") for c in axes), *(F.col(c).alias("_fold") for c in fold), *extra)
    place = [f"_{c}" for c in axes]
    p = named(points, [F.col(c).alias(f"_keep_{c}") for c in keep])
    left = named(queries, [])
    if unlike:
        p, left = p.where("_fold is not null"), left.where("_fold is not null")
    first = F.row_number().over(W.partitionBy(*place, *(["_fold"] if unlike else [])).orderBy("id"))
    p = settled(p.withColumn("_first", first).where(F.col("_first") <= k + other).drop("_first"))
    left = settled(left)
    d, size = len(axes), radius
    for _ in range(CROWDED_ROUNDS):
        full = densest(p, place, size)
        if full <= 2 * DEALT:
            break
        size *= (DEALT / full) ** (1 / d)
    kinds = dict(p.dtypes)
    schema = f"qid {kinds['id']}, nid {kinds['id']}, dist double, " + "".join(f"`{c}` {kinds[f'_keep_{c}']}, " for c in keep) + ("sector long, " if sectors else "") + "rank long"
    out = None
    while True:
        last = size >= radius
        size = radius * (1 + 1e-9) if last else size
        cells = [f"_cell__{c}" for c in axes]
        q = left.withColumns({c: F.floor(F.col(x) / size) for c, x in zip(cells, place)})
        n = _celled(p, place, size, True)
        if out is not None:
            n = n.join(q.select(*cells).distinct(), cells, "left_semi")
        search = _cell_search(k, (radius if last else size * (1 - 1e-9)), strict if last else False, last, other, place, bool(unlike), list(keep), sectors)
        found = settled(q.groupBy(*cells).cogroup(n.groupBy(*cells)).applyInArrow(search, schema))
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        left = settled(left.join(found.select(F.col("qid").alias("id")).distinct(), "id", "left_anti"))
        if left.isEmpty():
            return out
        size *= GROWTH


def _cell_search(k: int, limit: float, strict: bool, last: bool, other: bool, place: list[str], unlike: bool, keep: list[str], sectors: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Neighbours of the queries of a cell among the points around it; but in the last round only of queries that have found all they want. Columns are read by name: a join of a later round puts the cells first."""

    def search(q: pa.Table, n: pa.Table) -> pa.Table:
        n = n.take(pc.sort_indices(n.column("id")))
        ids, own = (t.column("id").to_numpy() for t in (q, n))
        at = [(q.column(c).to_numpy(), n.column(c).to_numpy()) for c in place]
        folds = [t.column("_fold").to_numpy() for t in (q, n)] if unlike else None
        parts = []
        step = max(1, (1 << 20) // max(len(own), 1))
        for i in range(0, len(ids), step) if len(own) else ():
            gaps = [b[None] - a[i : i + step, None] for a, b in at]
            dist = np.sqrt(reduce(lambda a, b: a + b, (g * g for g in gaps)))
            near = dist < limit if strict else dist <= limit
            if other:
                near &= ids[i : i + step, None] != own[None]
            if unlike:
                near &= folds[0][i : i + step, None] != folds[1][None]
            row, col = np.nonzero(near)
            dist = dist[row, col]
            key = row
            if sectors:
                theta = np.arctan2(gaps[1][row, col], gaps[0][row, col])
                theta = np.where(theta < 0, theta + 2 * np.pi, theta)
                key = row * sectors + np.minimum(np.floor(theta / (2 * np.pi / sectors)), sectors - 1).astype(np.int64)
            # stable, and columns are in the order of ids
            order = np.lexsort((dist, key))
            row, col, dist, key = row[order], col[order], dist[order], key[order]
            counts = np.bincount(key, minlength=len(gaps[0]) * max(sectors, 1))
            rank = np.arange(len(key)) - (np.cumsum(counts) - counts)[key] + 1
            taken = rank <= k
            if not last:
                taken &= (counts.reshape(len(gaps[0]), -1) >= k).all(axis=1)[row]
            parts.append((row[taken] + i, col[taken], dist[taken], key[taken] % max(sectors, 1), rank[taken]))
        row, col, dist, sector_, rank = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64))
        columns = [q.column("id").take(pa.array(row)), n.column("id").take(pa.array(col)), pa.array(dist), *(n.column(f"_keep_{c}").take(pa.array(col)) for c in keep)]
        columns += [pa.array(sector_)] if sectors else []
        return pa.table([*columns, pa.array(rank)], ["qid", "nid", "dist", *keep, *(["sector"] if sectors else []), "rank"])

    return search


def pair_sums(points: DataFrame, most: float, axes: Sequence[str], value: str, fold: Callable[..., pa.Table], schema: str) -> DataFrame:
    """Rows of ``fold`` for each two blocks of points with pairs up to the distance ``most``; every pair of different ids is in one of them, farther pairs may be.

    Points are dealt to cells of that distance and crowded cells to parts of about BLOCK points. A block goes to the blocks
    of the cells around it, and no pair becomes a row. ``fold`` gets two dicts of arrays (id, places, value, known), and
    which of their pairs count: None (all), or a function of a slice of the first giving a mask.
    """
    spark = points.sparkSession
    reachable(spark)
    place, cells = [f"_{c}" for c in axes], [f"_cell_{c}" for c in axes]
    p = _finite(points, axes).where("id is not null").select("id", *(F.col(c).cast("double").alias(f"_{c}") for c in axes), F.col(value).cast("double").alias("_value"))
    p = settled(p.withColumns({c: F.floor(F.col(x) / (most * (1 + 1e-9))) for c, x in zip(cells, place)}))
    parts = settled(p.groupBy(*cells).agg(F.count("*").alias("_n"), F.ceil(F.count("*") / BLOCK).cast("long").alias("_parts")))
    own = p.join(parts, cells).withColumn("_part", F.pmod(F.xxhash64("id"), "_parts")).drop("_n", "_parts")
    for c in cells:
        own = own.withColumn(f"_to{c}", F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    to = parts.select(*(F.col(c).alias(f"_to{c}") for c in cells), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_to_part"))
    a, b = F.struct(*cells, "_part"), F.struct(*(F.col(f"_to{c}").alias(c) for c in cells), F.col("_to_part").alias("_part"))
    dealt = own.join(to, [f"_to{c}" for c in cells]).select("id", *place, "_value", F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high"), (a > b).alias("_second"))
    blocks, rows = parts.agg(F.coalesce(F.sum("_parts"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    tasks = min(max(blocks * (blocks + 1) // 2, 1), 30 * (rows // BLOCK + 1), 2000)

    def summed(t: pa.Table) -> pa.Table:
        second = t.column("_second").to_numpy()
        one = t.slice(0, 1)
        same = one.column("_low").to_pylist() == one.column("_high").to_pylist()

        def side(rows: np.ndarray) -> dict[str, np.ndarray]:
            v = t.column("_value").take(pa.array(rows))
            ids = t.column("id").take(pa.array(rows)).to_numpy()
            order = np.argsort(ids, kind="stable")
            known = pc.is_valid(v).to_numpy() if v.null_count else None
            out = {"id": ids[order], "value": pc.fill_null(v, 0.0).to_numpy()[order], "known": known if known is None else known[order]}
            return out | {c: t.column(f"_{c}").take(pa.array(rows)).to_numpy()[order] for c in axes}

        first = side(np.flatnonzero(~second))
        other = first if same else side(np.flatnonzero(second))
        counts = None
        if same:
            counts = lambda s: first["id"][s, None] < first["id"][None]
        elif len(np.intersect1d(first["id"], other["id"])):
            counts = lambda s: first["id"][s, None] != other["id"][None]
        return fold(first, other, counts)

    return dealt.repartition(tasks, "_low", "_high").groupBy("_low", "_high").applyInArrow(summed, schema)


def slices(first: dict[str, np.ndarray], second: dict[str, np.ndarray]):
    """Slices of the first block whose pairs with the second are few enough for one turn."""
    step = max(1, AT_ONCE // max(len(second["id"]), 1))
    return (slice(i, i + step) for i in range(0, len(first["id"]), step))


def with_fallback(queries: DataFrame, points: DataFrame, k: int, radius: float, least: int, axes: Sequence[str] = ("x", "y"), keep: Sequence[str] = ("value",)) -> DataFrame:
    """Points within the closed radius, k at most; a query with fewer than ``least`` takes the k nearest of all."""
    near = radius_nearest(queries, points, k, radius, axes, strict=False, keep=keep)
    enough = near.groupBy("qid").count().where(F.col("count") >= least).select("qid")
    poor = queries.join(enough.withColumnRenamed("qid", "id"), "id", "left_anti")
    return near.join(enough, "qid", "left_semi").unionByName(nearest_join(poor, points, k, axes, keep=keep))


def sector_join(queries: DataFrame, points: DataFrame, radius: float, sectors: int, per_sector: int, keep: Sequence[str] = ("value",)) -> DataFrame:
    """Nearest points of each sector around a query: (qid, nid, dist, kept columns, sector, rank)."""
    if densest(points, ("x", "y"), radius) > max(DENSE, 4 * sectors * per_sector):
        return _dealt_nearest(queries, points, per_sector, radius, ("x", "y"), False, False, keep, sectors=sectors)
    found = radius_join(queries, points, radius, keep=("x", "y", *keep)).withColumnsRenamed({"x": "nx", "y": "ny"})
    found = found.join(queries.select(F.col("id").alias("qid"), "x", "y"), "qid")
    found = found.withColumn("sector", sector(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), sectors).cast("long"))
    return ranked(found, per_sector, ("qid", "sector")).select("qid", "nid", "dist", *keep, "sector", "rank")


def interval_join(left: DataFrame, right: DataFrame, key: str, bin_: float | None = None) -> DataFrame:
    """Half-open intervals (from, to) of one key that overlap, with the length of the overlap.

    Intervals are dealt to bins of the depth, so a long hole is many keys; a pair meets in each bin it shares and counts
    in the first. Without ``bin_`` a bin is four times the mean length of the right side's intervals.
    """
    if bin_ is None:
        bin_ = (right.where(F.col("to") > F.col("from")).agg(F.avg(F.col("to") - F.col("from"))).first()[0] or 1.0) * 4
    low = lambda side: F.floor(F.col(f"{side}.from") / bin_)
    dealt = lambda df: df.where(F.col("to") > F.col("from")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("from") / bin_), F.greatest(F.floor(F.col("from") / bin_), F.ceil(F.col("to") / bin_) - 1))))
    a, b = dealt(left).alias("a"), dealt(right).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._bin") == F.col("b._bin")) & (F.col("a.from") < F.col("b.to")) & (F.col("a.to") > F.col("b.from"))
    overlap = F.least(F.col("a.to"), F.col("b.to")) - F.greatest(F.col("a.from"), F.col("b.from"))
    return a.join(b, on).where(F.col("a._bin") == F.greatest(low("a"), low("b"))).withColumn("overlap", overlap)


def pairs(points: DataFrame, axes: Sequence[str] = ("x", "y"), keep: Sequence[str] = ("value",), most: float | None = None) -> DataFrame:
    """Each pair of different points once, smaller id first; with ``most``, by cells and only up to that distance."""
    if most is not None:
        both = tuple(dict.fromkeys((*axes, *keep)))
        out = radius_join(points, points, most, axes, keep=both, carry=both).where("qid < nid")
        return out.select(F.col("qid").alias("i"), F.col("nid").alias("j"), "dist", *(F.col(f"q_{c}").alias(f"{c}_i") for c in both), *(F.col(c).alias(f"{c}_j") for c in both))
    q, n = points.alias("q"), points.alias("n")
    columns = [F.col(f"{s}.{c}").alias(f"{c}_{t}") for c in (*axes, *keep) for s, t in (("q", "i"), ("n", "j"))]
    return q.join(n, F.col("q.id") < F.col("n.id")).select(F.col("q.id").alias("i"), F.col("n.id").alias("j"), distance(axes).alias("dist"), *columns)
