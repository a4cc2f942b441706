"""Near-duplicate images by the Hamming distance of perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tintype.functions.scalars import let
from tintype.operators.components import connected_components
from tintype.plans.worktables import write_table

#: Bits of a word of a hash; hashes are longs of up to MOST_LONG bits, or hex strings of any length.
WORD, MOST_LONG = 48, 62

#: Bits that a bucket key should have at least, and most keys of a hash.
KEY_BITS, MOST_KEYS = 18, 80

#: Most keys of a hash that stands in a crowded bucket.
FINE_KEYS = 220

#: Hashes of a bucket that are compared in one piece; larger buckets are cut into such pieces, and pieces meet in pairs.
PIECE = 1000


def _words(hash: Column, kind: T.DataType, bits: int) -> list[Column]:
    """A hash as longs, its first bits first."""
    if not isinstance(kind, T.StringType):
        if bits > MOST_LONG:
            raise ValueError(f"a long holds {MOST_LONG} bits of a hash at most; longer ones are hex strings")
        return [hash.cast("long")]
    digits = WORD // 4
    padded = F.lpad(hash, -(-bits // 4), "0")
    return [F.conv(F.substring(padded, at + 1, min(digits, -(-bits // 4) - at)), 16, 10).cast("long") for at in range(0, -(-bits // 4), digits)]


def _blocks(words: list[Column], bits: int, many: int) -> list[Column]:
    """The bits cut into ``many`` blocks of about equal size, each as a number."""
    width = WORD if len(words) > 1 else bits
    sizes = [min(width, bits - i * width) for i in range(len(words))]
    out = []
    for lo, hi in ((i * bits // many, (i + 1) * bits // many) for i in range(many)):
        parts = []
        for i, size in enumerate(sizes):
            a, b = max(lo, i * width), min(hi, i * width + size)
            if a < b:
                parts.append(F.shiftright(words[i], i * width + size - b).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        out.append(parts[0] if len(parts) == 1 else F.xxhash64(*parts))
    return out


def _choice(bits: int, max_dist: int) -> tuple[int, int]:
    """(blocks, blocks in a key): as many equal blocks as a near pair is sure to have, so that keys are long but not too many."""
    equal = 1
    while equal * bits // (max_dist + equal) < KEY_BITS and comb(max_dist + equal + 1, equal + 1) <= MOST_KEYS and max_dist + equal + 1 <= bits:
        equal += 1
    return max_dist + equal, equal


def _finer(bits: int, max_dist: int) -> tuple[int, int]:
    """The choice for hashes of crowded buckets: as many more equal blocks as FINE_KEYS keys allow."""
    equal = _choice(bits, max_dist)[1]
    while comb(max_dist + equal + 1, equal + 1) <= FINE_KEYS and max_dist + equal + 1 <= bits:
        equal += 1
    return max_dist + equal, equal


def _keyed(own: DataFrame, words: list[str], bits: int, choice: tuple[int, int]) -> DataFrame:
    """Hashes (h, words) under every choice of equal blocks: with t, the number of the choice, and key."""
    many, equal = choice
    blocks = F.array(*[b.cast("long") for b in _blocks([F.col(w) for w in words], bits, many)])
    choices = F.lit([list(c) for c in combinations(range(many), equal)])
    keys = let(blocks, lambda b: F.transform(choices, lambda c: F.xxhash64(*[F.get(b, F.get(c, F.lit(i))) for i in range(equal)])))
    return own.select("*", F.posexplode(keys).alias("t", "key"))


def _meetings(df: DataFrame, hash: str, bits: int, max_dist: int) -> tuple[DataFrame, list[str]]:
    """Distinct hashes in the groups in which they are compared, (t, key, g, f, p, h, words), and the words' names.

    The bits are cut into ``max_dist`` + k blocks; two hashes that near agree on k blocks at least, so
    each pair meets under some choice of k blocks. Buckets are counted first. The hashes of those of
    more than PIECE are dealt by a finer choice instead, which finds all their pairs too; a bucket
    that is large even there is cut into pieces, every two of which (g <= f) are a group.
    """
    if max_dist + 1 > bits:
        raise ValueError("too many bits or blocks")
    own = df.where(F.col(hash).isNotNull()).select(F.col(hash).alias("h")).distinct()
    words = _words(F.col("h"), own.schema["h"].dataType, bits)
    names = [f"w{i}" for i in range(len(words))]
    own = write_table(own.select("h", *[w.alias(n) for n, w in zip(names, words, strict=True)]), "distinct-hashes")

    def counted(keyed: DataFrame) -> DataFrame:
        return keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")

    coarse = _keyed(own, names, bits, _choice(bits, max_dist))
    sizes = write_table(counted(coarse), "bucket-sizes")
    crowded = coarse.join(sizes.where(F.col("n") > PIECE), ["t", "key"], "left_semi").select("h", *names).distinct()
    finer = _keyed(write_table(crowded, "crowded-hashes"), names, bits, _finer(bits, max_dist))
    finer = finer.withColumn("t", F.col("t") + FINE_KEYS)
    rows = coarse.join(sizes.where(F.col("n") <= PIECE), ["t", "key"]).unionByName(finer.join(counted(finer), ["t", "key"]))
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    dealt = rows.select("t", "key", pieces.alias("k"), F.pmod(F.xxhash64("h"), pieces).cast("int").alias("p"), "h", *names)
    met = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return met.select("t", "key", F.least("p", "q").alias("g"), F.greatest("p", "q").alias("f"), "p", "h", *names), names


def hash_pairs(df: DataFrame, hash: str, bits: int, max_dist: int) -> DataFrame:
    """(a, b, dist): pairs of distinct hash values at most ``max_dist`` bits apart, a < b.

    The column is a long or a hex string of ``bits`` bits. Pairs are of values, not of rows: however
    many images share a hash, it is one value.
    """
    met, names = _meetings(df, hash, bits, max_dist)
    group = ["t", "key", "g", "f"]
    left = met.where("p = g").select(*group, F.col("h").alias("a"), *[F.col(w).alias(f"a{w}") for w in names])
    right = met.where("p = f").select(*group, F.col("h").alias("b"), *[F.col(w).alias(f"b{w}") for w in names])
    dist = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in names), F.lit(0))
    near = left.join(right, group).where(((F.col("a") < F.col("b")) | ((F.col("g") < F.col("f")) & (F.col("a") != F.col("b")))) & (dist <= max_dist))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), dist.cast("int").alias("dist")).distinct()


def _stars(words: np.ndarray, max_dist: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row with a near one, except the first of each component of them, and the first of its component."""
    n = len(words)
    near = np.zeros((n, n), dtype=bool)
    for at in range(0, n, 128):
        apart = sum(np.bitwise_count(words[at : at + 128, None, i] ^ words[None, :, i]).astype(np.int16) for i in range(words.shape[1]))
        near[at : at + 128] = apart <= max_dist
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    hung = np.flatnonzero(label != np.arange(n))
    return hung, label[hung]


def hash_links(df: DataFrame, hash: str, bits: int, max_dist: int) -> DataFrame:
    """(a, b): links between distinct near hash values, enough of them to give all components.

    A group hands on its links as stars, so at most as many as it has hashes, however many pairs.
    """
    met, names = _meetings(df, hash, bits, max_dist)
    rows = met.select(F.xxhash64("t", "key", "g", "f").alias("group"), "h", *names)
    kind = rows.schema["h"].dataType.simpleString()

    def stars(batch: pa.Table) -> pa.RecordBatch:
        group = batch.column("group").to_numpy()
        ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
        words = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in names], axis=1)
        hung, on = [], []
        for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True):
            h, o = _stars(words[s:e], max_dist)
            hung.append(h + s)
            on.append(o + s)
        h = batch.column("h").combine_chunks()
        return pa.RecordBatch.from_arrays([h.take(pa.array(np.concatenate(x))) for x in (hung, on)], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of a partition that is sorted by them."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            g = b.column(0).to_numpy()
            if held[0].column(0)[0].as_py() == g[-1]:
                continue
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            yield stars(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield stars(pa.Table.from_batches(held))

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(compare, f"a {kind}, b {kind}")


def near_dup_components(df: DataFrame, name: str, hash: str, bits: int, max_dist: int) -> DataFrame:
    """(name, component): images by the least name reachable over near hashes; an image without a near one is its own."""
    rows = write_table(df.select(name, hash), "hashes")
    values = connected_components(hash_links(rows, hash, bits, max_dist)).withColumnRenamed("node", "h")
    named = rows.groupBy(F.col(hash).alias("h")).agg(F.min(name).alias("least")).join(values, "h", "left").select("h", "least", F.coalesce("component", "h").alias("c"))
    named = write_table(named, "hash-classes")
    least = named.groupBy("c").agg(F.min("least").alias("component"))
    by_hash = named.join(least, "c").select(F.col("h").alias(hash), "component")
    return rows.join(by_hash, hash, "left").select(name, F.coalesce("component", name).alias("component"))


def leak_near(df: DataFrame, hash: str, bits: int, max_dist: int, split: str = "split") -> DataFrame:
    """(a, b, dist, split_a, split_b): near hash values that stand in different splits, equal values included."""
    by = df.where(F.col(hash).isNotNull()).select(F.col(hash).alias("h"), F.col(split).alias("s")).distinct()
    pairs = hash_pairs(df, hash, bits, max_dist)
    across = pairs.join(by.select(F.col("h").alias("a"), F.col("s").alias("split_a")), "a").join(by.select(F.col("h").alias("b"), F.col("s").alias("split_b")), "b")
    same = by.select(F.col("h").alias("a"), F.col("s").alias("split_a")).join(by.select(F.col("h").alias("a"), F.col("s").alias("split_b")), "a").where("split_a < split_b")
    return across.where("split_a <> split_b").select("a", "b", "dist", "split_a", "split_b").unionByName(same.select("a", F.col("a").alias("b"), F.lit(0).alias("dist"), "split_a", "split_b"))
