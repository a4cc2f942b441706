"""Personal data: fixed patterns, and contexts learned from what they find.

The fixed patterns give the seed entities. Every entity, and every other token that could be an
identifier (it has digits or an @), is a mention with its lexical contexts: words before, words on
either side, the word before or a label with the shape of what follows. Spark scores the graph
of contexts and instances in rounds: a context is as reliable as the share of its distinct
instances that are reliable; an instance that the fixed patterns missed is as reliable as the
contexts it stands in. Mentions in reliable contexts, of a form that suits the kind, are new spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintype.llm.shared import slices
from tintype.plans.worktables import drop_table, write_table

KINDS = ("email", "ip", "card", "phone")

_WORTH = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_FOLLOWER = re.compile(r"[().0-9-]+")
_NUMBER = re.compile(r"[+().0-9/-]+")
_DIGITS = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = "\"'()[]{}<>,;:.!?*#$%&|="


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; kinds are numbered as in KINDS.

    Emails are found from their @: the run of local characters before it is taken back to the end of
    the email before, which is what leftmost matching gives, without its cost on long runs.
    """
    if not _WORTH.search(text):
        return []
    found = []
    last = 0
    for m in _DOMAIN.finditer(text):
        s = m.start()
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            found.append((s, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 14 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


_NO_IP = re.compile(r"[^0-9a-fA-F.:]")
_NO_NUMBER = re.compile(r"[^0-9 ().+/-]")


def forms_of(word: str) -> int:
    """The kinds whose form a token has, if not the fixed pattern, as a bit set."""
    n = len(_DIGITS.findall(word))
    email = "@" in word.strip("@")
    ip = n >= 2 and (word.count(".") >= 2 or word.count(":") >= 2) and not _NO_IP.search(word)
    number = 7 <= n <= 19 and not _NO_NUMBER.search(word)
    return email | ip << 1 | (number and n >= 12) << 2 | (number and n <= 15) << 3


def chains(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each token with a digit or an @, together with the number tokens that follow it after single spaces."""
    start = end = -1
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        if not _WORTH.search(text, s, e):
            continue
        if start >= 0 and s == end + 1 and text[end] == " " and _FOLLOWER.fullmatch(text, s, e) and _DIGITS.search(text, s, e):
            end = e
            continue
        if start >= 0:
            yield start, end
        start, end = s, e
    if start >= 0:
        yield start, end


def _shape(word: str) -> str:
    """Digits as 0, letters as a or A, runs of letters as one."""
    return _LETTERS.sub(lambda m: "A" if m[0].isupper() else "a", _DIGITS.sub("0", word))


class _Words:
    """The words of a text, to be looked up by place."""

    def __init__(self, text: str):
        self.text, self.places = text, [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [s for s, _ in self.places], [e for _, e in self.places]
        self.known: dict[tuple[int, int], str] = {}

    def _word(self, s: int, e: int) -> str:
        if (s, e) not in self.known:
            self.known[s, e] = _DIGITS.sub("0", self.text[s:e]).lower()
        return self.known[s, e]

    def contexts(self, start: int, end: int) -> list[int]:
        """Hashes of the patterns about a place, digits counting as 0: the two words before, the words on either side, the word before with the
        shape of what stands there, and the label before a colon with that shape.

        Of a word that the place itself cuts, its 200 characters next to the place count.
        """
        before = []
        i = bisect_left(self.starts, start) - 1
        while i >= 0 and len(before) < 3:
            s, e = self.places[i]
            before.append(self._word(s, e) if e <= start else _DIGITS.sub("0", self.text[max(s, start - 200) : start]).lower())
            i -= 1
        k = bisect_right(self.ends, end)
        s, e = self.places[k] if k < len(self.places) else (end, end)
        after = "$" if s == e else self._word(s, e) if s >= end else _DIGITS.sub("0", self.text[end : min(e, end + 200)]).lower()
        before += ["^"] * (3 - len(before))
        shape = _shape(self.text[start:end])
        label = next((w for w in before if w.endswith(":")), None)
        found = [f"<{before[1]} {before[0]}", f"|{before[0]} {after}", f"#{before[0]} {shape}", *([f":{label} {shape}"] if label else [])]
        return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in found]


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of every token of a range, and of every run of its number tokens that has few enough digits to be an identifier."""
    run: list[tuple[int, int]] = []  # number tokens before this one: start, digits
    for m in _TOKEN.finditer(text, start, end):
        s, e = m.span()
        while s < e and text[s] in _EDGES:
            s += 1
        while e > s and text[e - 1] in _EDGES:
            e -= 1
        yield s, e
        if not (_NUMBER.fullmatch(text, s, e) and _DIGITS.search(text, s, e)):
            run = []
            continue
        total = own = len(_DIGITS.findall(text, s, e))
        for before, digits in reversed(run):
            total += digits
            if total > 19:
                break
            yield before, e
        run = [*run[-18:], (s, own)]


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int, list[int]]]:
    """(start, end, kind or -1, forms, instance, group, contexts) of seeds and candidates; forms is a bit set of the kinds a candidate suits.

    Every token of a chain and every run of number tokens in it is a candidate, less what the fixed
    patterns took. Those of one chain are alternatives: their group is the chain's hash.
    """
    if not _WORTH.search(text):
        return []
    out: list[tuple[int, int, int, int, int, int]] = []
    for s, k, e in base:
        own = xxhash.xxh64_intdigest(text[s:e].lower()) - (1 << 63)
        out.append((s, e, k, 0, own, own))
    cuts: list[tuple[int, int]] = []  # what the fixed patterns took, as disjoint ranges
    for s, _, e in base:
        if cuts and s < cuts[-1][1]:
            cuts[-1] = cuts[-1][0], max(cuts[-1][1], e)
        else:
            cuts.append((s, e))
    i = 0
    for first, end in chains(text):
        at, group = first, None
        while i < len(cuts) and cuts[i][1] <= at:
            i += 1
        k = i
        while at < end:
            stop, after = cuts[k] if k < len(cuts) and cuts[k][0] < end else (end, end)
            for s, e in _parts(text, at, stop):
                word = text[s:e]
                if forms := forms_of(word):
                    group = group or xxhash.xxh64_intdigest(text[first:end].strip(_EDGES).lower()) - (1 << 63)
                    out.append((s, e, -1, forms, xxhash.xxh64_intdigest(word.lower()) - (1 << 63), group))
            at, k = after, k + 1
    words = _Words(text) if out else None
    return [(*x, words.contexts(x[0], x[1])) for x in out]


_SPAN = "struct<start:int,kind:int,end:int>"
_MENTION = "struct<start:int,end:int,kind:int,forms:int,inst:bigint,grp:bigint,pats:array<bigint>>"


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, base, mentions): what the fixed patterns find in each row, and the mentions for the graph. th is a hash of the text."""
    rows = docs.select(docs[id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    names, kinds = ("start", "end", "kind", "forms", "inst", "grp"), (pa.int32(),) * 4 + (pa.int64(),) * 2

    def lists(rows: list[list[tuple]], names: tuple[str, ...], kinds: tuple[pa.DataType, ...], last: str = "") -> pa.Array:
        """Rows of structs from flat columns; ``last`` names a field that is itself a list."""
        flat = [x for row in rows for x in row]
        columns = [pa.array([x[i] for x in flat], k) for i, k in enumerate(kinds)]
        if last:
            at = np.cumsum([0, *(len(x[-1]) for x in flat)])
            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array([v for x in flat for v in x[-1]], pa.int64())))
        made = pa.StructArray.from_arrays(columns, [*names, *[last] * bool(last)])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), made)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = b.column(2).to_pylist()
            base = [base_spans(t) for t in texts]
            seen = [mentions(t, found) for t, found in zip(texts, base, strict=True)]
            spans = lists(base, ("start", "kind", "end"), (pa.int32(),) * 3)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), spans, lists(seen, names, kinds, "pats")], names=["doc_id", "th", "base", "mentions"])

    return rows.mapInArrow(find, f"doc_id {rows.schema[0].dataType.simpleString()}, th bigint, base array<{_SPAN}>, mentions array<{_MENTION}>")


def discovered(scanned: DataFrame, min_seeds: int = 3, min_pattern: float = 0.6, min_instance: float = 0.6) -> DataFrame:
    """(doc_id, th, more): new spans by row, from rounds of scoring contexts and instances that end when a round changes nothing.

    A context counts for a kind if at least ``min_seeds`` distinct instances of it are seeds or were
    found before, and their weight is at least ``min_pattern`` of (all its distinct instances + 1);
    of the alternatives in a chain the most reliable counts. What is found in a round so induces
    contexts for the next. Weights only grow, so the rounds end. Pairs of context and instance are
    made distinct before they are counted, so repeated documents add nothing and a common context is
    summed in part before each shuffle. Of accepted spans within each other the outer one stays.
    """
    each = write_table(scanned.where("size(mentions) > 0").select("doc_id", "th", F.explode("mentions").alias("m")).select("doc_id", "th", "m.*"), "mentions")
    pairs = write_table(each.select("inst", "grp", "kind", "forms", F.explode("pats").alias("pat")).distinct(), "contexts")
    sizes = write_table(pairs.select("pat", "grp").distinct().groupBy("pat").agg(F.count("*").alias("n")), "context-sizes")
    seeds = pairs.where("kind >= 0").select("inst", F.col("kind").alias("of"), F.lit(1.0).alias("w")).distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))])).alias("of")
    open_pairs = write_table(pairs.where("kind < 0").select("pat", "inst", "forms", kinds).where(F.expr("(forms & shiftleft(1, of)) <> 0")).select("pat", "inst", "of").distinct(), "open-pairs")
    accepted, found, state = seeds, None, (0, 0.0)
    while True:
        chains = pairs.select("pat", "grp", "inst").join(accepted, "inst").groupBy("pat", "of", "grp").agg(F.max(F.struct("w", "inst")).alias("best"))
        support = chains.groupBy("pat", "of").agg(F.sum("best.w").alias("sure"), F.count_distinct("best.inst").alias("many")).where(F.col("many") >= min_seeds)
        scores = support.join(sizes, "pat").select("pat", "of", (F.col("sure") / (F.col("n") + 1)).alias("score"))
        patterns = write_table(scores.where(F.col("score") >= min_pattern), "patterns")
        last = found
        found = open_pairs.join(patterns, ["pat", "of"]).groupBy("inst", "of").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("w")).where(F.col("w") >= min_instance)
        found = write_table(found, "instances")
        if last is not None:
            drop_table(last)
        many, total = found.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if many == state[0] and total - state[1] < 1e-6 * (many + 1):
            break
        drop_table(patterns)
        state = many, total
        accepted = seeds.unionByName(found).groupBy("inst", "of").agg(F.max("w").alias("w"))
    best = found.groupBy("inst").agg(F.max(F.struct("w", (-F.col("of")).alias("rank"))).alias("b")).select("inst", (-F.col("b.rank")).alias("of"))
    hits = each.where("kind < 0").join(best, "inst").select("doc_id", "th", "start", "end", "of", F.explode("pats").alias("pat"))
    spans = hits.join(patterns.select("pat", "of"), ["pat", "of"], "left_semi").select("doc_id", "th", "start", "end", "of").distinct()
    before = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.withColumn("reach", F.max("end").over(before)).where("reach is null or end > reach")
    return outer.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", F.col("of").alias("kind"), "end"))).alias("more"))


def _with_more(rows: DataFrame, more: DataFrame, broadcast_rows: int = 10_000) -> DataFrame:
    """``rows`` with the new spans of each (doc_id, th); few of them are broadcast, others are joined by shuffle."""
    more = write_table(more.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "more"), "new-spans")
    if more.agg(F.coalesce(F.sum(F.size("more")), F.lit(0))).first()[0] <= broadcast_rows:
        more = F.broadcast(more)
    return rows.join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left").drop("m_id", "m_th")


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per document: doc_id, th, base (spans of the fixed patterns) and spans (those and the discovered ones).

    Spans are structs of start, kind and end in code points, in order. Null and empty texts have
    none; rows with equal id and text have equal spans; rows of one id but other text don't share
    them; null ids and other columns do no harm; an empty table gives an empty result. Equally
    reliable kinds give the first of KINDS. A text is scanned whole in time linear in its length, but
    for what sorting its mentions takes.
    """
    scanned = write_table(scan(docs, id, text), "scanned")
    rows = _with_more(scanned.select("doc_id", "th", "base"), discovered(scanned, **limits))
    return rows.select("doc_id", "th", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more"))).alias("spans"))


def count_of(spans: str, kind: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span as its kind in angle brackets; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The documents with their columns, personal data in the text replaced by its kind (and n_chars, where present, set anew).

    Null texts stay null. The fixed patterns run again where the text is; only discovered spans are joined.
    """
    scanned = write_table(scan(docs, id, text), "scanned")
    rows = docs.select(docs[id].alias("doc_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("th"), docs[text].alias("text"), F.struct("*").alias("row"))
    rows = _with_more(rows, discovered(scanned, **limits)).select("row", "text", "more")

    @F.pandas_udf("string")
    def mask(texts, more):
        import pandas as pd

        return pd.Series([None if t is None else masked_text(t, [*base_spans(t), *((x["start"], x["kind"], x["end"]) for x in ([] if m is None else m))]) for t, m in zip(texts, more, strict=True)])

    rows = rows.withColumn("new", mask("text", "more"))
    return rows.select(*[(F.col("new") if c == text else F.length("new").cast(t) if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c, t in docs.dtypes])
