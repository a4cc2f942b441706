"""SimHash near-duplicates, compared bit-sliced.

Fingerprints of 64 bits are made distinct and dealt by every choice of two of five bit blocks: two
fingerprints that differ in at most three bits agree on at least two whole blocks, so no link is
lost. Crowded buckets are dealt anew by four of seven blocks. Within a bucket fingerprints stand as bit planes (a plane has one bit of each); the
differences of many lanes at once run through carry-save counters, plane by plane, and a set of
lanes is abandoned once every count is over the radius. Each bucket hands on its links as stars.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintype.llm.shared import slices
from tintype.operators.components import connected_components
from tintype.plans.worktables import write_table

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42



def masks_of(blocks: int) -> list[int]:
    """Bucket keys as masks: every choice of all but RADIUS of so many bit blocks of about equal width."""
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    return [sum((1 << b) - (1 << a) for a, b in chosen) for chosen in combinations(list(zip(edges, edges[1:], strict=False)), blocks - RADIUS)]


#: Ten keys of 25 or 26 bits, and 35 of 36 or 37 bits for the fingerprints of buckets that are large under those.
MASKS = [*masks_of(5), *masks_of(7)]
COARSE = slice(0, len(masks_of(5)))
FINE = slice(COARSE.stop, len(MASKS))

#: Fingerprints of a bucket that are compared in one piece; those of larger buckets are dealt anew by finer keys, and what is larger still is cut into such pieces, which meet in pairs.
PIECE = 1024


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's 3-word shingles, A-Z lower-cased, repeats counted; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):  # in steps, so that a very long text needs no more memory
        part = words[at : min(at + (1 << 15), n) + SHINGLE - 1]
        joined = [b" ".join(part)] if len(part) < SHINGLE else map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        h = np.array([digest(x, SEED) for x in joined], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", with_hash: bool = False) -> DataFrame:
    """(doc_id, fp) for every row, and th, a hash of the text, if ``with_hash``; fp is the fingerprint as a signed long."""
    rows = docs.select(docs[id].alias("doc_id"), docs[text].alias("text"), *[F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("th")] * with_hash)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["doc_id", "fp", *["th"] * with_hash])

    return rows.mapInArrow(make, f"doc_id {rows.schema[0].dataType.simpleString()}, fp bigint" + ", th bigint" * with_hash)


def within(planes: Iterable[np.ndarray], shape: tuple[int, ...], radius: int = RADIUS) -> np.ndarray | None:
    """Lanes of which at most ``radius`` planes have the bit set, as packed words; None once there is none.

    Counters start so high that the carry out of the top counter plane means "over the radius".
    """
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(shape, ones if start >> k & 1 else 0, dtype=np.uint64) for k in range(depth)]
    over = np.zeros(shape, dtype=np.uint64)
    for i, carry in enumerate(planes):
        for k in range(depth):
            carried = counters[k] & carry
            counters[k] ^= carry
            carry = carried
        over |= carry
        if i % 4 == 3 and (over == ones).all():
            return None
    return ~over


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row b holds bit b of all of them, 64 lanes a word, the last word padded with zeros."""
    lanes = -(-len(fps) // 64) * 64
    full = np.zeros(lanes, dtype=np.uint64)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def links_between(x: np.ndarray, y: np.ndarray, free: list[int]) -> np.ndarray:
    """Boolean matrix of which of ``x`` and ``y`` differ in at most RADIUS of the bits ``free`` (they agree on the others)."""
    planes, out = planes_of(y), np.zeros((len(x), len(y)), dtype=bool)
    for at in range(0, len(x), 64):
        q = x[at : at + 64]
        masks = ((np.uint64(0) - ((q[None, :] >> np.array(free, dtype=np.uint64)[:, None]) & np.uint64(1)))[:, :, None]).astype(np.uint64)
        near = within((planes[b][None, :] ^ m for b, m in zip(free, masks, strict=True)), (len(q), planes.shape[1]))
        if near is not None:
            out[at : at + 64] = np.unpackbits(np.ascontiguousarray(near).view(np.uint8).reshape(len(q), -1), axis=1, bitorder="little")[:, : len(y)].astype(bool)
    return out


def _pair_links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) differ in at most RADIUS bits."""
    near = within(planes_of(a ^ b), (-(-len(a) // 64),)) if len(a) else None
    return np.zeros(len(a), dtype=bool) if near is None else np.unpackbits(near.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def _stars(fps: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint with the least of its component in the matrix, so that links grow with the rows, not the pairs."""
    label = np.arange(len(fps))
    links = links | links.T | np.eye(len(fps), dtype=bool)
    while True:
        new = np.where(links, label[None, :], len(fps)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    hung = np.flatnonzero(label != np.arange(len(fps)))
    return fps[hung], fps[label[hung]]


def _compare(group: np.ndarray, second: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of one piece (``second`` all false) or of two that meet."""
    free = [b for b in range(BITS) if not MASKS[table] >> b & 1]
    links = np.zeros((len(group), len(group)), dtype=bool)
    if second.any():
        i, j = np.flatnonzero(~second), np.flatnonzero(second)
        if not len(i):
            return group[:0], group[:0]
        links[np.ix_(i, j)] = links_between(group[i], group[j], free)
    else:
        links = links_between(group, group, free)
    return _stars(group, links)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, t, second, fp) sorted by g to links (a, b). Small groups are compared across the whole batch, by distance in row order."""

    def links(g, t, second, fp):
        ends = np.flatnonzero(np.r_[g[1:] != g[:-1], True]) + 1
        starts = np.r_[0, ends[:-1]]
        size = ends - starts
        out = []
        crossed = np.add.reduceat(second, starts) > 0
        small = (size <= 16) & ~crossed
        for s, e in zip(starts[~small], ends[~small], strict=True):
            out.append(_compare(fp[s:e], second[s:e].astype(bool), int(t[s])))
        rows = np.repeat(small, size)
        gs, fs = g[rows], fp[rows]
        for d in range(1, int(size[small].max(initial=1))):
            same = np.flatnonzero(gs[d:] == gs[:-d])
            a, b = fs[same], fs[same + d]
            near = _pair_links(a, b)
            out.append((a[near], b[near]))
        a = np.concatenate([x for x, _ in out]) if out else fp[:0]
        b = np.concatenate([y for _, y in out]) if out else fp[:0]
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(cols[0]):
            continue
        held.append((cols[0], cols[1], cols[2].astype(np.int64), cols[3].view(np.uint64)))
        if held[0][0][0] == cols[0][-1]:
            continue  # one group so far
        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(joined[0], joined[0][-1]))
        yield links(*(x[:cut] for x in joined))
        held = [tuple(x[cut:] for x in joined)]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _dealt(fps: DataFrame, keys: slice) -> tuple[DataFrame, DataFrame]:
    """(t, key, fp) of each fingerprint under the keys, and (t, key, n) of the buckets of two or more."""
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS[keys]]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("i", "key")).select((F.col("i") + keys.start).alias("t"), "key", "fp")
    return keyed, keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")


def fingerprint_links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints at most RADIUS bits apart, enough of them to give all components.

    Bucket sizes are counted before rows are dealt. The fingerprints of buckets of more than PIECE
    are compared in the buckets of finer keys instead, which lose no link either; one that is large
    even there is cut into pieces of about that size, and every two pieces meet in a group of their
    own, so the largest group is of two pieces whatever the bucket's size.
    """
    own = write_table(fps.select(F.col(fp).alias("fp")).distinct(), "distinct-fingerprints")
    keyed, sizes = _dealt(own, COARSE)
    sizes = write_table(sizes, "bucket-sizes")
    crowded = write_table(keyed.join(sizes.where(F.col("n") > PIECE), ["t", "key"], "left_semi").select("fp").distinct(), "crowded-fingerprints")
    finer, finer_sizes = _dealt(crowded, FINE)
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    dealt = [rows.join(n, ["t", "key"]).select("t", "key", "fp", pieces.alias("k"), F.pmod(F.xxhash64("fp"), pieces).cast("int").alias("p")) for rows, n in ((keyed, sizes.where(F.col("n") <= PIECE)), (finer, finer_sizes))]
    met = dealt[0].unionAll(dealt[1]).select("t", "key", "fp", "p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"))
    met = met.select(F.xxhash64("t", "key", F.least("p", "q"), F.greatest("p", "q")).alias("g"), "t", (F.col("p") > F.col("q")).alias("second"), "fp")
    return met.repartition("g").sortWithinPartitions("g").mapInArrow(_link_batches, "a bigint, b bigint")


def classes_of(own: DataFrame) -> DataFrame:
    """(fp, component) of every distinct fingerprint of ``own``; a component is named by one of its fingerprints."""
    nodes = connected_components(fingerprint_links(own)).select(F.col("node").alias("fp"), "component")
    return own.select("fp").distinct().join(nodes, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links, itself included).

    Texts without a word (null, empty) have fingerprint zero and are linked like any other; equal
    texts share a fingerprint and so a component; repeated rows give repeated results; texts under
    one id have each its own. A bit that is set in exactly half the hashes is 0. Null ids are given
    a component, but are never its name. A very long text is hashed in steps of bounded size. Other
    columns are ignored; an empty table gives an empty result.
    """
    own = write_table(fingerprints(docs, id, text), "fingerprints")
    named = own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes_of(own), "fp")
    named = write_table(named, "classes")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their columns, one row of each component: that of the least id, and of one id the text of least hash.

    Rows without id come last. Unrelated texts under one id are in components of their own, so none
    is lost; of rows that are equal in id and text any one stays.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = write_table(fingerprints(docs, id, text, with_hash=True), "fingerprints")
    first = own.join(classes_of(own), "fp").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("f"))
    chosen = first.select(F.xxhash64("f.doc_id", "f.th").alias("_key")).distinct()  # where two keys are equal by chance a row more stays
    rows = docs.select(F.col(id).alias("_id"), F.xxhash64(whole).alias("_th"), F.struct("*").alias("row")).withColumn("_key", F.xxhash64("_id", "_th"))
    rows = rows.join(chosen, "_key", "left_semi").dropDuplicates(["_key", "_id", "_th"])
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
