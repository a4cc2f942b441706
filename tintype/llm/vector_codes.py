"""Product codes of vectors, by integer k-means whose bounds are norms of sums.

Each part of a vector has a codebook. Every round assigns parts to their nearest entries and moves
the entries to the floors of their parts' means. A part keeps, for each group of entries, a lower
bound of its distance to the group's other entries and the round in which the bound was exact. With
the history of the codebooks the bound is lowered by how far entries really are from where they
stood then (the norm of the summed moves, not the sum of their norms), and only groups whose bound
doesn't clear the part's own entry are scanned again. All distances that decide are exact integers.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from math import floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintype.llm.shared import matrices
from tintype.plans.worktables import drop_table, write_table

PARTS, ENTRIES, ROUNDS, GROUPS = 16, 64, 2, 4

#: Integers below SMALL are compared in doubles, which is exact up to parts of 1024 components; entries over FAR are farther from such parts than any small entry.
SMALL, FAR = 1 << 20, 1 << 26

#: Rows of a batch that are assigned at a time.
ROWS = 4096

_MOST = (1 << 63) - 1


def whole(x: float) -> int:
    """floor(256 * x), exactly."""
    return floor(x * 256) if abs(x) < 1 << 53 else int(x) * 256


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries: doubles that hold exact integers, or Python integers for object arrays."""
    return ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


class Codebooks:
    """The codebooks of all rounds so far, as (parts, entries, width) arrays of Python integers."""

    def __init__(self, history: list[np.ndarray]):
        self.history, self.now = history, len(history) - 1
        parts, k, width = history[0].shape
        self.groups = [g for g in np.array_split(np.arange(k), min(GROUPS, k))]
        self.exact = history[-1]
        large = (np.abs(self.exact) >= SMALL).any(axis=2)
        far = (np.abs(self.exact) >= FAR).any(axis=2)
        #: Parts whose small rows are compared in doubles: far entries are left out, and there is a small one in their place.
        self.plain = ((large == far).all(axis=1)) & (~large).any(axis=1) & (width <= 1024)
        self.doubles = np.where(far[:, :, None], np.inf, np.where(far[:, :, None], 0, self.exact).astype(np.float64))
        self.clear = float(FAR - SMALL)
        #: By round, part and group: how far an entry of the group is at most from where it stood in the round.
        self.moved = np.zeros((len(history), parts, len(self.groups)))
        for r, old in enumerate(history):
            net = np.sqrt(np.minimum(((self.exact - old) ** 2).sum(axis=2), 10**300).astype(np.float64))
            for g, own in enumerate(self.groups):
                self.moved[r, :, g] = net[:, own].max(axis=1)

    def assign(self, part: int, v: np.ndarray, own: np.ndarray, lower: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, ...]:
        """(entry, squared distance, lower bounds, their rounds) of small rows ``v``; ``own`` is -1 where nothing is known yet.

        Ties go to the lower index: a group that isn't scanned is farther by more than any rounding.
        """
        c = self.doubles[part]
        n, rows = len(v), np.arange(len(v))
        best = np.where(own < 0, 0, own)
        d_own = np.where(own < 0, np.inf, ((v - c[best]) ** 2).sum(axis=1))
        reach = np.sqrt(d_own)
        drift = self.moved[stamp, part, np.arange(len(self.groups))[None, :]]
        bound = lower - drift
        scan = ~(bound > reach[:, None] + 1e-6 * (1 + lower + drift))
        first, index, second = np.full((n, len(self.groups)), np.inf), np.zeros((n, len(self.groups)), dtype=np.int64), np.full((n, len(self.groups)), np.inf)
        for g, entries in enumerate(self.groups):
            at = np.flatnonzero(scan[:, g])
            if not len(at):
                continue
            d = _distances(v[at], c[entries])
            mine = (own[at] >= entries[0]) & (own[at] <= entries[-1])
            d[np.flatnonzero(mine), own[at][mine] - entries[0]] = np.inf
            least = d.argmin(axis=1)
            first[at, g], index[at, g] = d[np.arange(len(at)), least], entries[least]
            d[np.arange(len(at)), least] = np.inf
            second[at, g] = d.min(axis=1)
        g = first.argmin(axis=1)
        d_new, new = first[rows, g], index[rows, g]
        change = (d_new < d_own) | ((d_new == d_own) & (new < best))
        entry, distance = np.where(change, new, best), np.where(change, d_new, d_own)
        bounds, since = np.where(scan, np.sqrt(first), lower), np.where(scan, self.now, stamp)
        r = np.flatnonzero(change)
        bounds[r, g[r]] = np.sqrt(second[r, g[r]])
        left = r[own[r] >= 0]  # the entry that such a part leaves is one of the others now
        of = np.searchsorted([x[-1] for x in self.groups], own[left])
        now_bound = np.where(since[left, of] == self.now, bounds[left, of], bound[left, of])
        bounds[left, of], since[left, of] = np.minimum(now_bound, reach[left]), self.now
        return entry, distance, np.minimum(bounds, self.clear), since  # far entries are that far at least

    def scanned(self, part: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of rows of Python integers, by a scan of all entries."""
        d = _distances(v, self.exact[part])
        entry = np.array([min(range(d.shape[1]), key=row.__getitem__) for row in d], dtype=np.int64)
        return entry, d[np.arange(len(v)), entry]


def _integers(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floors of 256 times the components as doubles, rows for which these are small)."""
    with np.errstate(over="ignore"):
        v = np.floor(m * 256)
    return v, (np.abs(v) < SMALL).all(axis=1)


def _assigned(books: Codebooks, b: pa.RecordBatch, states: bool) -> list[pa.Array]:
    """code, error, lower bounds and stamps of a batch whose columns from the fourth on are the last ones, if ``states``."""
    n, parts, groups = len(b), len(books.exact), len(books.groups)
    width = books.exact.shape[2]
    m = next(matrices(b.column(2)))[1]
    v, small = _integers(m)
    own, lower, stamp = np.full((n, parts), -1), np.zeros((n, parts, groups)), np.zeros((n, parts, groups), dtype=np.int64)
    if states:
        raw = [np.frombuffer(b"".join(b.column(name).to_pylist()), dtype=kind) for name, kind in (("code", np.uint8), ("lower", np.float32), ("stamp", np.uint8))]
        own[:], lower[:], stamp[:] = raw[0].reshape(own.shape), raw[1].reshape(lower.shape), raw[2].reshape(stamp.shape)
    code, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=object)
    for p in range(parts):
        of = slice(p * width, (p + 1) * width)
        plain = np.flatnonzero(small) if books.plain[p] else np.zeros(0, dtype=np.int64)
        code[plain, p], d, lower[plain, p], stamp[plain, p] = books.assign(p, v[plain, of], own[plain, p], lower[plain, p], stamp[plain, p])
        error[plain] += d.astype(np.int64)
        rest = np.setdiff1d(np.arange(n), plain)
        if len(rest):
            code[rest, p], d = books.scanned(p, np.array([[whole(x) for x in row] for row in m[rest, of].tolist()], dtype=object).reshape(len(rest), width))
            error[rest] += d
            lower[rest, p] = -np.inf
    down = np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
    binary = lambda a: pa.array([row.tobytes() for row in a], pa.binary())
    return [binary(code), pa.array([min(int(x), _MOST) for x in error], pa.int64()), binary(down), binary(stamp.astype(np.uint8))]


def _assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, vector, code, error, lower, stamp) of rows with or without the last four."""
    states = "code" in rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector {kinds['vector']}, code binary, error bigint, lower binary, stamp binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *_assigned(books, b, states)], names=["vec_id", "label", "vector", "code", "error", "lower", "stamp"])

    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, place, limb, total): sums of the parts of each entry by component, and their number at place -1.

    Tasks add up what they read. A sum is handed on in digits of base 2**32 from -2**31 on, which again
    add up without overflow; but for huge components there is one.
    """
    parts, k, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, small_sums, others = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, width), dtype=np.int64), defaultdict(int)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.slice(at, ROWS)
                m = next(matrices(b.column(0)))[1]
                v, small = _integers(m)
                code = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(len(b), parts)
                for p in range(parts):
                    counts[p] += np.bincount(code[:, p], minlength=k)
                    np.add.at(small_sums[p], code[small, p], v[small, p * width : (p + 1) * width].astype(np.int64))
                for i in np.flatnonzero(~small):
                    for j, x in enumerate(m[i].tolist()):
                        others[j // width, int(code[i, j // width]), j % width] += whole(x)
        for p, e in zip(*np.nonzero(counts), strict=True):
            others[int(p), int(e), -1] += int(counts[p, e])
            for j in range(width):
                others[int(p), int(e), j] += int(small_sums[p, e, j])
        out = []
        for key, total in others.items():
            limb = 0
            while total:
                digit = (total + (1 << 31)) % (1 << 32) - (1 << 31)
                out.append((*key, limb, digit))
                total, limb = (total - digit) >> 32, limb + 1
        kinds = (pa.int32(),) * 4 + (pa.int64(),)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["part", "entry", "place", "limb", "total"])

    each = rows.select("vector", "code").mapInArrow(run, "part int, entry int, place int, limb int, total bigint")
    return each.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"))


def _moved(old: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The entries at the floors of their parts' means; unused ones stay. The sums are as many as the codebooks have numbers."""
    total: dict[tuple[int, int, int], int] = defaultdict(int)
    for r in sums.toArrow().to_pylist():
        total[r["part"], r["entry"], r["place"]] += r["total"] << 32 * r["limb"]
    new = old.copy()
    for (p, e, place), n in list(total.items()):
        if place < 0:
            new[p, e] = [total[p, e, j] // n for j in range(old.shape[2])]
    return new


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits a part), error, label_error and codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped, as are those of another
    length than the vector of the least id whose length ``parts`` divides. Codebooks start with the
    vectors of the least ids (fewer vectors, fewer entries), rows of one id by their components;
    vectors without id come last. Repeated rows count each. Components of any size are exact; an
    error over 2**63 - 1 is given as that. Null labels are one label; other columns are ignored; an
    empty table gives no rows.
    """
    rows = vectors.select(vectors[id].alias("vec_id"), vectors[label].alias("label"), vectors[vector].alias("vector"))
    finite: Column = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.coalesce(finite, F.lit(False)) & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    ordered = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    first = ordered.select(F.size("vector").alias("n")).limit(1).collect()
    length = first[0]["n"] if first else parts
    kept = kept.where(F.size("vector") == length)
    start = [r["vector"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    width = length // parts
    assert all(isfinite(x) for v in start for x in v)
    history = [np.array([[[whole(x) for x in v[p * width : (p + 1) * width]] for v in start] for p in range(parts)], dtype=object).reshape(parts, len(start), width)]
    state = kept
    for _ in range(rounds if start else 0):
        last, state = state, write_table(_assign(state, Codebooks(history)), "vector-states")
        if last is not kept:
            drop_table(last)
        history.append(_moved(history[-1], _sums(state, history[0].shape)))
    if start:
        state = write_table(_assign(state, Codebooks(history)).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "vector-codes")
    else:
        state = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    numbers = hashlib.sha256(",".join(str(x) for x in history[-1].ravel()).encode()).hexdigest()
    by_label = state.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST)).cast("long").alias("label_error"))
    found = state.join(by_label.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(numbers).alias("codebooks_sha256"))
