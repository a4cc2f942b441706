"""Quality rules with cross-document line frequency, in DataFrame operations only.

Lines are normalised (lower case, white space collapsed) and hashed with their host. For every host
the distinct documents that hold a line are counted. Lines in more documents than the limits are
removed; a document that loses most of its words is rejected as depleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintype.llm.shared import SPACE_RUN, let, words_of
from tintype.plans.worktables import write_table

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of eight words that the text holds twice or more.

    Windows are hashed by three rounds of pairing (1, 2, 4, 8 words). Only where a hash repeats are
    the windows sorted, so the cost stays n log n for any text.
    """

    def paired(h: Column, step: int) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))

    def covered(w: Column) -> Column:
        def count(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: F.coalesce((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), F.get(s, i - 1)["h"] == e["h"], F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
            starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
            return let(
                starts,
                lambda q: F.aggregate(
                    F.transform(q, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - x, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ranked, count))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    windows = let(hashed, lambda h: let(paired(h, 1), lambda p: let(paired(p, 2), lambda q: let(paired(q, 4), covered))))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(windows).cast("long")


def word_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """One row per document: its id, a hash of its text, word counts and whether the counts reject it."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    rows = docs.select(
        F.col(id).alias("doc_id"),
        F.xxhash64(whole).alias("th"),
        let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(whole, SPACE_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, r = F.col("w.n_words"), F.col("w.n_repeat_words")
    return rows.select("doc_id", "th", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), ((n < min_words) | (r * 100 > n * max_repeat)).alias("base_failed"))


def _host(host: str | None) -> Column:
    return F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))) if host else F.lit(0).cast("long")


def document_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str | None = "source", fold_digits: bool = False) -> DataFrame:
    """(doc_id, th, hh, pos, lk, words) for every line with a word: text hash, host hash, line number, line key, words."""
    whole = F.lower(F.coalesce(F.col(text), F.lit("")))
    if fold_digits:
        whole = F.regexp_replace(whole, "[0-9]+", "0")
    return (
        docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), _host(host).alias("hh"), F.posexplode(F.split(whole, "\n")).alias("pos", "line"))
        .select("doc_id", "th", "hh", "pos", F.btrim(F.regexp_replace("line", SPACE_RUN, " "), F.lit(" ")).alias("line"))
        .where("line <> ''")
        .select("doc_id", "th", "hh", "pos", F.xxhash64("hh", "line").alias("lk"), (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).alias("words"))
    )


def frequent_lines(lines: DataFrame, document: Column, min_docs: int = 10, max_share: float = 0.01, max_docs: int = 1000, hosts: DataFrame | None = None) -> DataFrame:
    """Keys (lk) of the lines in more than ``min_docs`` documents of their host that are also more than ``max_share`` of the host's documents, or more than ``max_docs``.

    ``document`` says what counts as one; ``hosts`` (hh, all_docs) may give the hosts' numbers of them. Counts are taken over all rows; both counts are summed
    before they are shuffled, so a line or a host with a third of the rows costs each task one row.
    """
    seen = lines.select("hh", "lk", document.alias("d")).distinct().groupBy("hh", "lk").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    if hosts is None:
        hosts = lines.select("hh", document.alias("d")).distinct().groupBy("hh").agg(F.count("*").alias("all_docs"))
    return seen.join(hosts, "hh").where((F.col("docs") > F.col("all_docs") * max_share) | (F.col("docs") > max_docs)).select("lk")


def near_classes(lines: DataFrame) -> DataFrame:
    """(th, class): texts that share most of their lines with a leader have its class, others their own.

    A leader is the least of the texts that have an equal minimum hash of their lines, under one of
    two hashes; a copy with one line of many changed keeps one of both nearly always. As one common
    line can be the minimum of texts that share nothing else, the lines of a text and its leader are
    counted: over half of those of the longer one have to be equal. With two such leaders the lesser
    gives the class.
    """
    sets = write_table(lines.select("th", "lk").distinct(), "line-sets")
    two = sets.groupBy("th").agg(F.min("lk").alias("one"), F.min(F.xxhash64("lk")).alias("two"), F.count("*").alias("size"))
    led = [two.groupBy(k).agg(F.min("th").alias(f"by_{k}")) for k in ("one", "two")]
    placed = write_table(two.join(led[0], "one").join(led[1], "two").select("th", "size", F.array_distinct(F.array("by_one", "by_two")).alias("leaders")), "leaders")
    asked = placed.select("th", "size", F.explode("leaders").alias("leader")).where("leader <> th")
    sizes = placed.select(F.col("th").alias("leader"), F.col("size").alias("leader_size"))
    met = asked.join(sets, "th").join(sets.withColumnRenamed("th", "leader"), ["leader", "lk"])
    common = met.groupBy("th", "leader").agg(F.count("*").alias("both"), F.first("size").alias("size"))
    near = common.join(sizes, "leader").where(2 * F.col("both") > F.greatest("size", "leader_size")).groupBy("th").agg(F.min("leader").alias("leader"))
    return placed.select("th").join(near, "th", "left").select("th", F.least("th", F.coalesce("leader", "th")).alias("class"))


def quality_rules(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str | None = "source",
    min_words: int = 20,
    max_repeat: int = 30,
    min_docs: int = 10,
    max_share: float = 0.01,
    max_docs: int = 1000,
    min_left: float = 0.3,
    copies_once: bool = False,
    fold_digits: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts and removed lines of all documents.

    Returns (verdicts, removed). ``verdicts`` has a row per input row: doc_id, th (hash of the text),
    the counts of ``word_rules``, removed_words and kept. ``removed`` has (doc_id, th, pos) of the
    lines above the limits. A document is kept unless the counts reject it or fewer than
    ``min_left`` of its words remain.

    Lines are counted by documents (id and text; repeated rows are one). With ``copies_once`` lines
    and the documents of a host are counted by groups of near-equal texts, so that whole or slightly
    changed copies neither make each other's lines frequent nor raise the limit. With
    ``fold_digits`` a number in a line counts as 0.

    A null text counts as empty and is rejected for want of words; a null host is a host of its
    own; rows with equal id and text get equal verdicts; null ids are an id like any other; an
    empty table gives empty results; other columns are ignored. A line at a limit stays. A very long
    text is one row as any other; its cost is n log n in its words.
    """
    lines = write_table(document_lines(docs, id, text, host, fold_digits), "lines")
    limits = min_docs, max_share, max_docs
    if copies_once:
        classes = write_table(near_classes(lines), "near-classes")
        hosts = lines.select("hh", "th").distinct().join(classes, "th").select("hh", "class").distinct().groupBy("hh").agg(F.count("*").alias("all_docs"))
        hosts = write_table(hosts, "hosts")
        often = write_table(frequent_lines(lines, F.col("th"), *limits, hosts), "candidate-lines")  # no class count is over that of texts
        held = lines.join(often, "lk", "left_semi").select("hh", "lk", "th").distinct().join(classes, "th")
        frequent = frequent_lines(held, F.col("class"), *limits, hosts)
    else:
        frequent = frequent_lines(lines, F.xxhash64("doc_id", "th"), *limits)
    removed = write_table(lines.join(frequent, "lk", "left_semi").select("doc_id", "th", "pos", "words").distinct(), "frequent-lines")
    lost = removed.groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).agg(F.sum("words").alias("lost"))
    base = word_rules(docs, id, text, min_words, max_repeat)
    left = F.col("n_words") - F.coalesce(F.col("lost"), F.lit(0))
    verdicts = base.join(lost, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left").select(
        *base.columns, F.coalesce("lost", F.lit(0)).alias("removed_words"), (~F.col("base_failed") & (left >= F.col("n_words") * min_left)).alias("kept")
    )
    return verdicts, removed.select("doc_id", "th", "pos")


def apply_quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str | None = "source", **limits) -> DataFrame:
    """The kept documents with their columns, lines above the limits taken out of the text (and n_chars, where present, set anew)."""
    verdicts, removed = quality_rules(docs, id, text, host, **limits)
    cut = removed.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("cut"))
    plan = verdicts.where("kept").select("doc_id", "th").distinct().join(cut.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "cut"), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left")
    return rebuilt(docs, plan.select("doc_id", "th", "cut"), id, text)


def without_lines(text: Column, cut: Column) -> Column:
    """A text without the lines whose numbers are in ``cut``, in time linear in its lines."""
    return let(F.split(text, "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), cut), lambda i: F.get(x, i)), "\n"))


def rebuilt(docs: DataFrame, plan: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that ``plan`` names by (doc_id, th), without the lines whose numbers are in ``cut`` (null: none)."""
    whole = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("k", F.xxhash64(whole)).join(plan, F.col(f"row.{id}").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("th")))
    rows = rows.withColumn("_new", F.when(F.col("cut").isNull(), F.col(f"row.{text}")).otherwise(without_lines(whole, F.col("cut"))))
    return rows.select(*[(F.col("_new") if c == text else F.length("_new").cast(t) if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c, t in docs.dtypes])
