"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Its posting goes on the
inverted lists of the first of them; vectors that meet on a list and share enough pivots are
candidates, and their cosine is verified in double precision. Pivots grow with the square root of
the vectors, so lists stay short. Vectors so close to one pivot that all of them are linked are a
ball: its links are counted, not compared, so a large group of near copies costs no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintype.llm.shared import matrices
from tintype.llm.simhash import _stars as stars
from tintype.operators.components import connected_components
from tintype.plans.worktables import drop_table, write_table

LEAST = 0.95

#: Pivots are 2 * sqrt(vectors), within these; they are taken from a sample of twice as many, and no two have more than this cosine.
FEWEST, MOST, APART = 16, 8192, 0.8

#: Pivots that describe a vector, lists that its posting goes on, and pivots that a candidate pair shares at least.
NEAREST, POSTED, SHARED = 12, 6, 3

#: Postings that are compared in one piece; longer lists are cut into such pieces, which meet in pairs.
PIECE = 1024

#: Piece plans that are broadcast; more are joined by shuffle.
PLANS_IN_PLACE = 100_000


def usable(vector: Column) -> Column:
    """Whether a vector can have a cosine: not null or zero, all components there and finite."""
    there = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(there & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first, so that nothing overflows."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, most: int, least: float = LEAST) -> np.ndarray:
    """Unit vectors of the sample that are apart from each other, each moved to the middle of the sample vectors that link with it."""
    chosen = np.empty((min(most, len(sample)), sample.shape[1]))
    n = 0
    for v in sample:
        if n == len(chosen):
            break
        if not n or (chosen[:n] @ v).max() < APART:
            chosen[n] = v
            n += 1
    chosen = chosen[:n]
    for at in range(0, n, 512):
        near = chosen[at : at + 512] @ sample.T >= least
        chosen[at : at + 512] = units(near.astype(np.float64) @ sample)
    return chosen


def described(own: DataFrame, pivots: np.ndarray, least: float = LEAST) -> DataFrame:
    """``own`` (node, copies, vector) with pivots (int array, nearest first), dim, and ball: the nearest pivot if half the linking angle reaches it, else -1."""
    reach = np.cos(acos(least) / 2 - 1e-6)
    dim = pivots.shape[1]
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                nearest = np.empty((len(b), min(NEAREST, len(pivots))), dtype=np.int32)
                ball, dims = np.full(len(b), -1, dtype=np.int32), np.empty(len(b), dtype=np.int32)
                for rows, m in matrices(b.column(2)):
                    d = min(m.shape[1], dim)
                    near = units(m)[:, :d] @ pivots[:, :d].T
                    first = np.argpartition(-near, nearest.shape[1] - 1, axis=1)[:, : nearest.shape[1]]
                    first = np.take_along_axis(first, np.lexsort((first, -np.take_along_axis(near, first, 1)), axis=1), 1)
                    nearest[rows], dims[rows] = first, m.shape[1]
                    if m.shape[1] == dim:
                        best = np.take_along_axis(near, first[:, :1], 1)[:, 0]
                        ball[rows] = np.where(best >= reach, first[:, 0], -1)
                ends = pa.array(np.arange(len(b) + 1) * nearest.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(nearest.ravel())), pa.array(dims), pa.array(ball)], names=[*b.schema.names, "pivots", "dim", "ball"])

    return own.select("node", "copies", "vector").mapInArrow(describe, f"node bigint, copies bigint, vector {kinds['vector']}, pivots array<int>, dim int, ball int")


def _meetings(points: DataFrame, piece: int) -> DataFrame:
    """Postings dealt into the groups in which they are compared: (g, list, second, node, copies, vector, pivots, ball).

    A list of up to ``piece`` postings is one group. A longer one is cut into pieces, and every two
    of them meet in a group. Balls of over half a piece have pieces of their own, which never meet
    each other, as their links are known: so a ball's postings are dealt once for each other piece.
    """
    posted = points.select("*", F.explode(F.slice("pivots", 1, POSTED)).alias("list"))
    sizes = points.select("dim", "ball", F.explode(F.slice("pivots", 1, POSTED)).alias("list")).groupBy("list", "dim", "ball").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("total", F.sum("n").over(Window.partitionBy("list", "dim"))).where(F.col("total") > piece)
    apart = F.when((F.col("ball") >= 0) & (F.col("n") > piece // 2), F.col("ball")).otherwise(-1)
    cut = sizes.groupBy("list", "dim", apart.alias("of")).agg(F.ceil(F.sum("n") / piece).cast("int").alias("k"))
    before = Window.partitionBy("list", "dim").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0)).cast("int"))
    plans = write_table(cut.groupBy("list", "dim").agg(F.collect_list(F.struct("of", "start", "k")).alias("plan"), F.sum("k").cast("int").alias("pieces")), "list-plans")
    if plans.agg(F.coalesce(F.sum(F.size("plan")), F.lit(0))).first()[0] <= PLANS_IN_PLACE:
        plans = F.broadcast(plans)
    rows = posted.join(plans, ["list", "dim"], "left").withColumn("plan", F.coalesce("plan", F.expr("array(named_struct('of', -1, 'start', 0, 'k', 1))"))).fillna(1, ["pieces"])
    rows = rows.withColumn("mine", F.expr("coalesce(get(filter(plan, x -> x.of >= 0 and x.of = ball), 0), get(filter(plan, x -> x.of = -1), 0))"))
    rows = rows.withColumn("p", F.expr("mine.start + cast(pmod(xxhash64(node), mine.k) as int)"))
    others = F.expr("filter(sequence(0, pieces - 1), q -> mine.of = -1 or q < mine.start or q >= mine.start + mine.k)")
    rows = rows.select("*", F.explode(others).alias("q"))
    group = F.xxhash64("list", "dim", F.least("p", "q"), F.greatest("p", "q"))
    return rows.select(group.alias("g"), "list", (F.col("p") > F.col("q")).cast("int").alias("second"), "node", "copies", "vector", "pivots", "ball")


def _compare(group: pa.Table, least: float) -> tuple[np.ndarray, ...]:
    """(linked nodes, their numbers of linked copies) and the links as stars (a, b), of one list's piece or of two pieces that meet.

    A pair that meets on several lists counts on the first of them only.
    """
    column = lambda name: group.column(name).to_numpy()
    node, second, ball, here = column("node"), column("second"), column("ball"), group.column("list")[0].as_py()
    pivots = np.stack(group.column("pivots").combine_chunks().flatten().to_numpy().reshape(len(group), -1))
    vectors = units(next(matrices(group.column("vector").combine_chunks()))[1])
    x = np.flatnonzero(second == 0)
    y = np.flatnonzero(second) if second.any() else x
    empty = node[:0]
    if not len(x):
        return empty, empty, empty, empty
    seen, place = np.unique(pivots, return_inverse=True)
    place = place.reshape(pivots.shape)
    has = np.zeros((len(group), len(seen)), dtype=np.float32)
    np.put_along_axis(has, place, 1, axis=1)
    candidates = has[x] @ has[y].T >= min(SHARED, pivots.shape[1])
    candidates &= (ball[x][:, None] != ball[y][None, :]) | (ball[x] < 0)[:, None]
    if y is x:
        candidates = np.triu(candidates, 1)
    if not candidates.any():
        return empty, empty, empty, empty
    links = np.zeros((len(group), len(group)), dtype=bool)
    links[np.ix_(x, y)] = candidates & (vectors[x] @ vectors[y].T >= least)
    if links.any():
        before = np.zeros_like(has)
        np.put_along_axis(before, place[:, :POSTED], 1, axis=1)
        before[:, seen >= here] = 0
        links[np.ix_(x, y)] &= before[x] @ before[y].T == 0
    links |= links.T
    counts = links @ column("copies")
    linked = np.flatnonzero(counts)
    return node[linked], counts[linked], *stars(node, links)


def _compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by g to (a, b, n): n links of a for null b, else a link."""

    def result(rows: pa.Table) -> pa.RecordBatch:
        g = rows.column("g").to_numpy()
        ends = np.flatnonzero(np.r_[g[1:] != g[:-1], True]) + 1
        found = [_compare(rows.slice(s, e - s), least) for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True) if e - s > 1]
        nodes, counts, a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in range(4))
        other = pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(b)])
        return pa.RecordBatch.from_arrays([pa.array(np.r_[nodes, a]), other, pa.array(np.r_[counts, np.zeros_like(a)])], names=["a", "b", "n"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if held[0].column(0)[0].as_py() == b.column(0)[-1].as_py():
            continue  # one group so far
        g = b.column(0).to_numpy()
        cut = len(g) - int(np.argmax(g[::-1] != g[-1])) if g[0] != g[-1] else 0
        yield result(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
        held = [b.slice(cut)]
    if held:
        yield result(pa.Table.from_batches(held))


def vector_links(points: DataFrame, least: float = LEAST, piece: int = PIECE) -> DataFrame:
    """(a, b, n) from described vectors: for null b that a has n linked copies on some list, else that a and b are in one component."""
    return _meetings(points, piece).repartition("g").sortWithinPartitions("g").mapInArrow(lambda batches: _compared(batches, least), "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = LEAST, piece: int = PIECE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the least id reachable over links, itself included) and kept (whether it is that id).

    Vectors are linked if their cosine is at least ``least``. A vector that is null, empty or zero or
    has a null or non-finite component links with nothing, as do vectors of different lengths. Equal
    vectors (rows repeated or not) are linked and handled once, by 128 bits of hashes; each counts as
    a link. A null id is never a component's id, unless no other is there, and never kept. Labels and
    other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(vectors[id].alias("vec_id"), vectors[vector].alias("vector"))
    good = rows.where(usable(F.col("vector"))).select("vec_id", "vector", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("k"))
    bad = rows.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    own = good.groupBy("h", "k").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    own = write_table(own.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    n = own.count()
    sizes = own.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1
    most = min(max(2 * isqrt(n), FEWEST), MOST)
    sample = own.where(F.size("vector") == dim).orderBy(F.xxhash64("h"), "k").select("vector").limit(2 * most).toArrow().column(0).combine_chunks()
    pivots = choose_pivots(units(next(matrices(sample))[1]), most, least) if n else np.ones((1, 1))
    points = write_table(described(own, pivots, least), "described-vectors")
    found = write_table(vector_links(points, least, piece), "vector-links")
    balls = write_table(points.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("all"), F.min("node").alias("lead")), "balls")
    in_balls = points.where("ball >= 0").select("node", "copies", "ball").join(balls, "ball")
    edges = found.where("b is not null").select("a", "b").unionAll(in_balls.select("node", "lead"))
    components = connected_components(edges)
    counts = found.where("b is null").select("a", "n").unionAll(in_balls.select("node", F.col("all") - F.col("copies"))).groupBy("a").agg(F.sum("n").alias("n"))
    named = own.select("h", "k", "node", "least", "copies").join(counts, F.col("a") == F.col("node"), "left").drop("a").join(components, "node", "left")
    named = write_table(named.select("h", "k", "least", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "named-vectors")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(names, "component").select("h", "k", "n_links", "component_id")
    every = good.select("vec_id", "h", "k").join(known, ["h", "k"]).select("vec_id", "n_links", "component_id").unionAll(bad)
    drop_table(points)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
