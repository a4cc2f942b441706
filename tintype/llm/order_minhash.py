"""Order MinHash of documents, in DataFrame operations only.

The words of a text give k-mers; equal k-mers are numbered by occurrence, so that a multiset is
sketched. The hashes of the numbered k-mers lie on a circle, and each of m entries has its own
starting point there: it selects the l k-mers that come first from that point on, which are the l
least under the hash turned by that much. They are taken from the whole text, put back into text
order and hashed as a tuple: the entry changes when the k-mers change and when their order does,
which is what makes it follow edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tintype.llm.shared import let, words_of
from tintype.plans.worktables import write_table

#: Entries (2**6; the circle has as many arcs, each entry starts with one), k-mers selected by each, words in a k-mer, bits of a place in the text.
BUCKET_BITS, SELECTED, K, PLACE_BITS = 6, 2, 3, 29
RANK_BITS = 63 - PLACE_BITS


def _kmers(h: Column) -> Column:
    n = F.size(h)
    pairs = F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), lambda x, y: F.xxhash64(x, y))
    whole = let(pairs, lambda p: F.zip_with(F.slice(p, F.lit(1), n - 2), F.slice(h, F.lit(3), n - 2), lambda x, y: F.xxhash64(x, y)))
    return F.when(n >= K, whole).when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))


def _packed(h: Column, place: Column) -> Column:
    """The leading bits of a hash above the place, as a positive number; the first six bits are the arc."""
    return F.shiftleft(F.shiftrightunsigned(h, 64 - RANK_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _numbered(k: Column) -> Column:
    """Packed hashes of the occurrence-numbered k-mers; the first occurrence keeps the k-mer's hash."""
    plain = F.transform(k, lambda h, i: _packed(h, i))

    def numbered(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i - 1)["h"] != F.get(s, i)["h"], F.lit(True)))
        return let(
            starts,
            lambda q: F.flatten(
                F.transform(
                    q,
                    lambda a, j: F.transform(
                        F.slice(s, a + 1, F.coalesce(F.get(q, j + 1), F.size(s)) - a),
                        lambda e, o: _packed(F.when(o == 0, e["h"]).otherwise(F.xxhash64(e["h"], o)), e["i"]),
                    ),
                )
            ),
        )

    ranked = F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(k)) == F.size(k), plain).otherwise(let(ranked, numbered))


def order_minhash(text: Column) -> Column:
    """The sketch of a text as an array of 64 ints, one an entry.

    A null or empty text has an empty sketch; of one k-mer (a text of up to three words) it is the
    tuple. Of a very long text no more than two k-mers of an arc are kept before tuples are made.
    """

    def arc(v: Column) -> Column:
        return F.shiftright(v, 63 - BUCKET_BITS)

    def chosen(t: Column) -> Column:
        return F.filter(t, lambda v, i: F.coalesce(arc(F.get(t, i - SELECTED)) != arc(v), F.lit(True)))

    def entries(c: Column) -> Column:
        """All entries between one k-mer that is the first of its arc and the next such start with the latter."""
        heads = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.coalesce(arc(F.get(c, i - 1)) != arc(F.get(c, i)), F.lit(True)))
        pairs = F.transform(heads, lambda i: F.struct(arc(F.get(c, i)).cast("int").alias("arc"), _tuple(F.get(c, i), F.coalesce(F.get(c, i + 1), F.get(c, F.lit(0))), F.size(c)).alias("x")))
        return let(pairs, lambda p: F.flatten(F.concat(F.transform(p, lambda e, j: F.array_repeat(e["x"], e["arc"] - F.coalesce(F.get(p, j - 1)["arc"], F.lit(-1)))), F.array(F.array_repeat(F.get(p, F.lit(0))["x"], (1 << BUCKET_BITS) - 1 - F.element_at(p, -1)["arc"])))))

    def _tuple(a: Column, b: Column, n: Column) -> Column:
        place = F.lit((1 << PLACE_BITS) - 1)
        first, second = F.shiftright(a, PLACE_BITS), F.shiftright(b, PLACE_BITS)
        ordered = F.when(n == 1, F.xxhash64(first)).when(a.bitwiseAND(place) < b.bitwiseAND(place), F.xxhash64(first, second)).otherwise(F.xxhash64(second, first))
        return F.shiftright(ordered, 32).cast("int")

    hashed = F.transform(words_of(text), lambda x: F.xxhash64(x))
    empty = F.array().cast("array<int>")
    return let(hashed, lambda h: F.when(F.size(h) == 0, empty).otherwise(let(let(F.sort_array(let(_kmers(h), _numbered)), chosen), entries)))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text, eight hex digits an entry."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries; two empty sketches are alike, an empty one is like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / (1 << BUCKET_BITS)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same)


def neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, prev_id, prev_half): of each id the one before it, and the most half-lengths of that one's texts; the first id follows the last.

    The ids are dealt by range, numbered within their range only, and one row a range links the
    ranges, so no task sees all ids.
    """
    ids = docs.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg(F.max(F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 2)).cast("int").alias("half"))
    ranged = write_table(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    last = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "half")).alias("last"))
    over = W.partitionBy(F.lit(0)).orderBy("part")
    before = last.select("part", F.coalesce(F.lag("last").over(over), F.last("last").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before"))
    own = F.lag(F.struct("doc_id", "half")).over(W.partitionBy("part").orderBy("doc_id"))
    linked = ranged.withColumn("own", own).join(before, "part").select("doc_id", F.coalesce("own", "before").alias("p"))
    return linked.select("doc_id", F.col("p.doc_id").alias("prev_id"), F.col("p.half").alias("prev_half"))


def edited_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its sketch and that of its edited text, for ``compare_neighbours``.

    The edited text is the text whose second half is replaced by as much of the next document's
    beginning. Whole texts are shuffled once, by id; of the next document only the part that is
    needed moves. Among rows of one id the text of least hash stands for the id; rows without id
    have no neighbour and stay as they are. Null texts count as empty; other columns are ignored.
    """
    named = F.col(id) if id == "doc_id" else F.col(id).alias("doc_id")  # an alias of the same name would keep the two uses apart
    whole = docs.select(named, F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = write_table(neighbours(docs, id, text), "neighbours")
    linked = whole.where("doc_id is not null").join(links, "doc_id")  # the same filter on both uses, so one exchange serves both
    begins = linked.groupBy(F.col("prev_id").alias("doc_id")).agg(F.min(F.struct(F.xxhash64("text").alias("th"), F.substr("text", F.lit(1), F.col("prev_half")).alias("begin"))).alias("n"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("n.begin", F.lit("")), F.lit(1), half))
    rows = linked.join(begins, "doc_id", "left").select("doc_id", "prev_id", "text", edited.alias("edited"))
    alone = whole.where("doc_id is null").select("doc_id", F.col("doc_id").alias("prev_id"), "text", F.col("text").alias("edited"))
    rows = rows.unionAll(alone).withColumns({"th": F.xxhash64("text"), "n_chars": n.cast("long")})
    return rows.select("doc_id", "prev_id", "th", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), order_minhash(F.col("text")).alias("sketch"), order_minhash(F.col("edited")).alias("edited_sketch"))


def compare_neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and its edited text, with the likeness to the edited text and to the next document.

    A row without id has null as its likeness to the next document. An empty table gives an empty result.
    """
    done = write_table(edited_documents(docs, id, text), "sketches")
    following = done.where("prev_id is not null").groupBy(F.col("prev_id").alias("f_id")).agg(F.min(F.struct("th", "sketch")).alias("f"))
    return done.join(following, F.col("doc_id") == F.col("f_id"), "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("f.sketch")).alias("near_next"),
    )
