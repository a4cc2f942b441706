"""Near-duplicate lines across documents by a deletion-neighbourhood join; the earliest line stays.

A line is a sequence of words (lower case, white space collapsed). Two lines of at least five words
are near if one word substituted, added or left out makes them equal, which for such lines is a
similarity of 0.8 or more; shorter lines can only be equal, from as many words on as the caller
says. Two near lines share a variant: the line
itself or the line less one word. Variants are emitted as hashed keys, equal keys are joined, and
each pair found is verified on its words.

Before that, lines that can't have a partner are left out: of two near lines, the one half that the
edit doesn't touch is equal, so a line none of whose halves occurs elsewhere needs no variants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintype.llm.line_quality import without_lines
from tintype.llm.shared import maybe_in, membership_filter, slices
from tintype.plans.worktables import write_table

MIN_WORDS = 5

#: Base of the rolling hash of word sequences (odd, so that it has an inverse modulo 2**64).
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def near(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two word sequences is at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variant_keys(words: list[str]) -> np.ndarray:
    """Hashes of a word sequence (first) and of it less each word in turn, in time linear in its length."""
    n = len(words)
    h = np.array([xxhash.xxh64_intdigest(w) | 1 for w in words], dtype=np.uint64)
    powers = np.ones(n, dtype=np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(h * powers, dtype=np.uint64)]
    less = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
    raw = np.r_[sums[-1:], less] + np.r_[np.uint64(n), np.full(n, n - 1, dtype=np.uint64)]
    raw ^= raw >> np.uint64(31)
    return (raw * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _lowered(docs: DataFrame, id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("doc_id"), F.xxhash64(whole).alias("th"), F.lower(whole).alias("text"))


def _words_by_line(text: str, least_words: int = MIN_WORDS) -> Iterator[tuple[int, list[bytes]]]:
    """Number and words of every line with ``least_words`` words."""
    for pos, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.split()
        if len(words) >= least_words:
            yield pos, words


def _line_key(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, 42)


def _half_keys(words: list[bytes]) -> list[int]:
    """Hashes of both halves of a line, for a partner no shorter and for one a word shorter."""
    keys = []
    for m in (len(words), len(words) - 1):
        p = m // 2
        keys += [xxhash.xxh64_intdigest(b"%d<%b" % (m, b" ".join(words[:p]))), xxhash.xxh64_intdigest(b"%d>%b" % (m, b" ".join(words[len(words) - (m - p) :])))]
    return keys


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def lines_of(docs: DataFrame, id: str, text: str, least_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, pos, lk, halves) of every line with ``least_words`` words: text hash, line number, hash of the normal form, half keys (none under MIN_WORDS words)."""
    rows = _lowered(docs, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            of, places, keys, halves, ends = [], [], [], [], [0]
            for i, t in enumerate(b.column(2).to_pylist()):
                for pos, words in _words_by_line(t, least_words):
                    of.append(i)
                    places.append(pos)
                    keys.append(_line_key(b" ".join(words)))
                    if len(words) >= MIN_WORDS:
                        halves += _half_keys(words)
                    ends.append(len(halves))
            at = pa.array(of, pa.int64())
            some = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(halves)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(places, pa.int32()), pa.array(_signed(keys)), some], names=["doc_id", "th", "pos", "lk", "halves"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, th bigint, pos int, lk bigint, halves array<bigint>")


def _texts_of(docs: DataFrame, chosen: DataFrame, id: str, text: str) -> DataFrame:
    """(lk, line) of the chosen line keys: their normal forms, read again from the documents.

    A filter of fixed size lets the chosen keys and few others through, each once a batch; the join
    with the chosen keys is exact.
    """
    bits = docs.sparkSession.sparkContext.broadcast(membership_filter(chosen, "lk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            found = {}
            for t in b.column(0).to_pylist():
                for _, words in _words_by_line(t):
                    line = b" ".join(words)
                    found[_line_key(line)] = line
            keys = _signed(list(found))
            some = np.flatnonzero(maybe_in(bits.value, keys))
            lines = list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array([lines[i].decode("utf-8", "replace") for i in some], pa.string())], names=["lk", "line"])

    again = _lowered(docs, id, text).select("text").mapInArrow(run, "lk bigint, line string")
    return again.join(chosen, "lk", "left_semi").groupBy("lk").agg(F.min("line").alias("line"))


def _variants(candidates: DataFrame) -> DataFrame:
    """(key, at, lk) for each variant of each candidate (lk, line); ``at`` is the word left out, -1 for none."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):  # a batch of long lines has many variants
                part = b.slice(at, 512)
                keys = [variant_keys(x.split(" ")) for x in part.column(1).to_pylist()]
                sizes = [len(k) for k in keys]
                places = np.concatenate([np.arange(-1, n - 1, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(places), part.column(0).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))], names=["key", "at", "lk"])

    return candidates.select("lk", "line").mapInArrow(emit, "key bigint, at int, lk bigint")


def _later_near(candidates: DataFrame) -> DataFrame:
    """Keys (lk) of the candidates (lk, first, line) that have an earlier near line.

    Only variants that two lines have are kept. Lines that share one with the same word left out
    are all near each other, so each need only meet the earliest of them; the line that is the
    variant itself is near to all. Pairs so grow with the variants, not with the squares of their
    groups.
    """
    all_variants = _variants(candidates)
    twice = all_variants.groupBy("key").agg(F.min("lk").alias("a"), F.max("lk").alias("b")).where("a <> b").select("key")
    variants = all_variants.join(twice, "key", "left_semi").join(candidates.select("lk", "first"), "lk")
    variants = write_table(variants.select("key", "at", "lk", "first"), "variants")
    groups = write_table(variants.groupBy("key", "at").agg(F.min(F.struct("first", "lk")).alias("least")), "variant-groups")
    keys = groups.groupBy("key").agg(F.min(F.when(F.col("at") == -1, F.col("least"))).alias("base"), F.min(F.when(F.col("at") >= 0, F.col("least"))).alias("shorter"))
    met = variants.join(keys, "key").join(groups, ["key", "at"])
    left_out = F.col("at") >= 0
    others = F.filter(F.array(F.when(left_out, F.col("least")), F.when(left_out, F.col("base")), F.when(~left_out, F.col("shorter"))), lambda o: F.coalesce(o["first"] < F.col("first"), F.lit(False)))
    pairs = met.select("lk", F.explode(others).alias("o")).select("lk", F.col("o.lk").alias("other")).distinct()
    words = candidates.select("lk", "line")
    both = pairs.join(words, "lk").join(words.select(F.col("lk").alias("other"), F.col("line").alias("other_line")), "other")

    @F.pandas_udf("boolean")
    def verified(a, b):
        import pandas as pd

        return pd.Series([near(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype=bool)

    return both.where(verified("line", "other_line")).select("lk").distinct()


def removed_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, pos) of every line that repeats an earlier one or is near to an earlier one.

    Lines are ordered by document id (null first), text hash and number. A line goes if any earlier
    line of the table is near to it, whether that line stays itself or not. Equal lines are found
    from ``least_words`` words on (1: all lines with a word), near ones from MIN_WORDS. Rows with
    equal id and text are one document; a null text has no lines.
    """
    own = F.struct("doc_id", "th", "pos")
    lines = write_table(lines_of(docs, id, text, least_words), "lines")
    halves = lines.select("lk", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("lk").alias("a"), F.max("lk").alias("b")).where("a <> b").select("half")
    chosen = write_table(halves.join(met, "half", "left_semi").select("lk").distinct(), "chosen-lines")
    distinct = write_table(lines.groupBy("lk").agg(F.min(own).alias("first"), F.count("*").alias("n")), "distinct-lines")
    candidates = write_table(_texts_of(docs, chosen, id, text).join(distinct.select("lk", "first"), "lk"), "candidates")
    late = write_table(_later_near(candidates), "late-lines")
    doubtful = distinct.join(late.withColumn("late", F.lit(True)), "lk", "left").where("late or n > 1")
    hit = lines.select("doc_id", "th", "pos", "lk").join(doubtful, "lk").where(F.coalesce("late", F.lit(False)) | (own != F.col("first")))
    return hit.select("doc_id", "th", "pos")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", drop_emptied: bool = False, least_words: int = MIN_WORDS, count_as: str | None = "removed_lines") -> DataFrame:
    """The documents with their columns, repeated lines taken out of the text (and n_chars, where present, set anew), and how many in the column ``count_as`` (None: no such column).

    A document without such lines is as it was; with ``drop_emptied`` one that loses its last word
    that way goes. Null texts stay null; an empty table gives an empty result; a column of the
    documents that is called as ``count_as`` is an error, never replaced. A very long line has as
    many variants as words, which leave in parts; its cost is linear in its words.
    """
    if count_as in docs.columns:
        raise ValueError(f"the documents have a column {count_as}; name another in count_as")
    cut = removed_lines(docs, id, text, least_words).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("cut"))
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[id].alias("r_id"), F.xxhash64(whole).alias("r_th"), docs[text].alias("text"), F.struct("*").alias("row"))
    rows = rows.join(cut, F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_th") == F.col("th")), "left")
    rows = rows.withColumn("new", F.when(F.col("cut").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("cut"))))
    if drop_emptied:
        rows = rows.where(F.col("cut").isNull() | F.col("new").rlike("[^ \\t-\\r]"))
    fields = [(F.col("new") if c == text else F.length("new").cast(t) if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c, t in docs.dtypes]
    return rows.select(*fields, *([F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias(count_as)] if count_as else []))
