"""What text filters take from each other: every order of them, from additive counts of failure masks.

A row's mask is the string of the letters of the filters it fails. Four of them look at the row
alone. The fifth fails a text that a smaller id has too; its ids are found after a duplicate
prepass: a counting Bloom filter, kept as a table of counters, clears texts that are surely
unique, and only the others are shuffled whole, for the least id of each full text. The orders are
played on the counts of masks, not on the rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintype.llm.shared import maybe_in, membership_filter, words_of
from tintype.plans.worktables import write_table

FILTERS = "ABCDE"

#: Counters for each row of the Bloom filter, and how many of them a text counts in.
CELLS_A_ROW, HASHES = 16, 3


def own_failures(text: str) -> Column:
    """The letters of A to D that a text (not null) fails: few words, few distinct words, capitals, symbols."""
    words = words_of(F.col(text))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = {
        "A": F.size(words) < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        "C": F.lit(100) * capitals > F.lit(2) * F.length(text),
        "D": F.col(text).rlike("[#$%&*|]"),
    }
    return F.concat(*[F.when(fails, F.lit(letter)).otherwise("") for letter, fails in tests.items()])


def _cells(h: Column, rows: int) -> Column:
    """The counters of a text's hash, each once."""
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(i), h), F.lit(CELLS_A_ROW * max(rows, 1))) for i in range(HASHES)]))


def possible_repeats(hashes: DataFrame, rows: int) -> DataFrame:
    """The distinct hashes ``h`` that may occur more than once; none that does is left out.

    Each row counts in HASHES of CELLS_A_ROW * ``rows`` counters; the tasks' sketches are merged by
    adding counters. A hash with a counter below two is unique. The counters are a table dealt by
    cell: they grow with the rows and are never all in one place.
    """
    placed = hashes.select("h", F.explode(_cells(F.col("h"), rows)).alias("cell"))
    shared = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    full = placed.join(shared, "cell", "left_semi").groupBy("h").agg(F.count_distinct("cell").alias("n"))
    return full.where(F.col("n") == F.size(_cells(F.col("h"), rows))).select("h")


def failures(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row; mask holds the letters of the filters that the row fails.

    Null texts are empty, null parts the empty string. Equal rows of one id are no repeats of each
    other; a row without id is no repeat and makes none.
    """
    rows = docs.select(docs[id].alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256))).withColumn("h", F.xxhash64("key"))
    flags = write_table(rows.select("doc_id", "part", "key", "h", own_failures("text").alias("own")), "flags")
    repeats = write_table(possible_repeats(flags, flags.count()), "possible-repeats")
    bits = docs.sparkSession.sparkContext.broadcast(membership_filter(repeats, "h"))  # of fixed size; a full one lets more texts through

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(bits.value, np.ascontiguousarray(h.to_numpy(dtype=np.int64))))

    whole = rows.select("doc_id", "key", "h", "text").where(may_repeat("h"))
    least = whole.groupBy("key", "text").agg(F.min("doc_id").alias("doc_id")).select("key", "doc_id", F.lit("").alias("repeat"))
    seen = flags.withColumn("maybe", may_repeat("h"))
    joined = seen.where("maybe and doc_id is not null").join(least, ["key", "doc_id"], "left")  # by id too, so no text is a hot key
    marked = joined.select("doc_id", "part", F.concat("own", F.coalesce("repeat", F.lit("E"))).alias("mask"))
    return marked.unionAll(seen.where("not maybe or doc_id is null").select("doc_id", "part", F.col("own").alias("mask")))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each mask, and how many have a label of quality 1 and of toxic 1 (any, if an id has several)."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = failed.join(known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def all_orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included, from the counts of masks.

    A row is gone once a filter before the step is in its mask. A part has at most 32 masks, so this
    works on some 19,200 rows a part, however many rows the part has.
    """
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    played = counts.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    played = played.withColumns({"filter": F.expr("substring(filter_order, step, 1)"), "before": F.expr("substring(filter_order, 1, step - 1)")})
    played = played.withColumns({"fails": F.expr("instr(mask, filter) > 0"), "gone": F.expr("translate(before, mask, '') <> before")})
    total = lambda condition, of="n": F.coalesce(F.sum(F.when(condition, F.col(of))), F.lit(0)).alias
    fails, gone = F.col("fails"), F.col("gone")
    steps = played.groupBy("part", "filter_order", "step", "filter").agg(
        total(~gone & ~fails)("kept"),
        total(~gone & fails)("removed"),
        total(gone & fails)("redundant"),
        total(F.col("mask") == F.col("filter"))("unique_fails"),
        total(~gone & fails, "good")("good_lost"),
        total(~gone & fails, "toxic")("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part of the documents, every order of the five filters and every step: what it keeps and removes, and what that loses.

    kept and removed count the part's rows after and at the step; redundant are rows that fail its
    filter and were removed before; unique_fails fail no other filter; good_lost and toxic_lost are
    removed rows with a label of quality 1 and toxic 1; shapley is the filter's removed summed over
    all orders. Null texts and parts are empty; rows without id have no label and are no repeats;
    repeated rows each count; of labels of one id any counts; other columns are ignored; very long
    texts are judged whole; an empty table gives no rows.
    """
    return all_orders(write_table(mask_counts(failures(docs), labels), "mask-counts"))
