"""Document quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is of words, of order three. Its probabilities are written as additive weights of
n-grams: a seen n-gram adds what it gains over the next lower order, and as a context it adds the
logarithm of its back-off mass to the position that follows. The log probability of a text is then
a constant per word plus a sum over its n-grams of count times weight: a join of counts.

That join is sharded by n-gram: counts of a document meet the weights by shuffle. Before it, what
can't be in the model is left out by membership filters of fixed size, and the model's most
frequent n-grams, a fixed number, are looked up where the text is, so no key is hot.

N-grams are hashes, which don't compress, and there are more of them than the input has bytes to
spare. So they are taken in a fixed number of slices by the word in the middle: all trigrams of a
context, all that end in a bigram, and all bigrams of a context have the same one, so a slice has
its weights, and its part of every text's sum, from itself and the counts of words. The texts are
read once for each slice; of n-grams only a slice at a time is on disk.

Spark deals and joins the n-grams of a slice by parts, ranges of hashes whose number follows the
text. A row holds what one task has for a part, as arrays: the work on a part, small sorts and
sums, is numpy's, where a row for each n-gram took most of the time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintype.llm.shared import maybe_in, membership_filter, slices as parts_of
from tintype.plans.worktables import drop_table, freed_shuffles, write_table

#: Share of the trusted documents that trains the model, and most n-grams of a slice that are looked up in place (16 bytes each).
TRAIN_SHARE, IN_PLACE = 0.5, 1 << 19

#: Slices of the n-grams, and characters of training text up to which there is one.
SLICES, ONE_SLICE = 5, 1 << 23

#: Bytes of text that a task holds as words at once, if there are several texts.
BATCH = 2 << 20

#: Bytes of training text, and of text that is looked up, for each part of a slice's n-grams, and the least number of parts.
PART, LOOKED_UP, LEAST_PARTS = 4 << 20, 32 << 20, 8

#: Most texts that are looked up at once, as a text's number in a batch has two bytes.
MOST_DOCS = 1 << 14

#: A membership filter has 2**21 words of 64 bits (16 MB), whatever the number of n-grams.
WORD_BITS = 21

#: Types of the columns of packed rows (others: counts), and the columns of words: how many words precede one, how often it
#: occurs, and as a context its bigrams' counts and how many of them were counted once, twice and more often.
_TYPES = dict.fromkeys(("u", "v", "w", "x", "key", "key1", "head"), np.uint64) | dict.fromkeys(("gamma", "p", "weight", "weight1", "headweight"), np.float64) | {"doc": np.uint16}
WORD = "x c n all b1 b2 b3"
_NONE = np.empty(0)

#: What eight bytes are shifted by to leave the first 0 to 8 of them.
_SHIFTS = np.uint64(8) * np.arange(8, -1, -1, dtype=np.uint64)

#: Spaces: bytes, and by their first byte those that are several in UTF-8.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 32), 32])
_WIDE_SPACES: dict[int, list[bytes]] = {}
for _c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    _WIDE_SPACES.setdefault((_b := chr(_c).encode())[0], []).append(_b[1:])

#: Hashes of the marks before and after a text, and what tells a bigram as a context from one as an n-gram.
_BEGIN, _END, _CONTEXT = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("\x00begin", "\x00end", "\x00context"))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bigram's hash from those of its words."""
    return _turn(v, 21) ^ w


def _trigram(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _turn(_bigram(u, v), 42) ^ _bigram(v, w)


def _hashes(text: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, ``left`` bytes from ``start`` each, eight bytes at a time."""
    text = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) - 7,), "<u8", text.data, strides=(1,))
    found = _mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), eight, start, left)
    at = np.flatnonzero(left > 8)
    start, left = start[at] + 8, left[at] - 8
    while len(at):
        found[at] = _mixed(found[at], eight, start, left)
        more = left > 8
        at, start, left = at[more], start[more] + 8, left[more] - 8
    return found


def _mixed(x: np.ndarray, eight: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """``x`` with the next bytes of each word, eight at most."""
    x ^= eight[start] << _SHIFTS[np.minimum(left, 8)]
    for by, times in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(by)
        x *= np.uint64(times)
    x ^= x >> np.uint64(32)
    return x


def _words_in(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the bytes of texts that lie at ``bounds``: between spaces, those beyond ASCII included."""
    gap = _SPACE[text]
    for first, rest in _WIDE_SPACES.items():
        at = np.flatnonzero(text[: len(text) - len(rest[0])] == first)
        for more in rest if len(at) else ():
            here = at[np.all([text[at + k + 1] == b for k, b in enumerate(more)], 0)]
            for k in range(len(more) + 1):
                gap[here + k] = True
    edge = np.zeros(len(text) + 1, bool)  # between this byte and the one before
    edge[bounds] = True
    starts, stops = edge.copy(), edge
    starts[1:-1] |= gap[:-1]
    stops[1:-1] |= gap[1:]
    starts[:-1] &= ~gap
    stops[1:] &= ~gap
    starts[-1] = stops[0] = False
    return np.flatnonzero(starts), np.flatnonzero(stops)


def positions(texts: pa.Array) -> dict[str, np.ndarray]:
    """Positions of a batch of texts, marks included: the word's hash, the text's number, place from 0 (begin mark), whether it is the end mark; and the texts' words."""
    lower = pc.fill_null(pc.utf8_lower(texts.cast(pa.string())), "")
    bounds = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
    text = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    start, stop = _words_in(text, bounds := bounds - bounds[0])
    sizes = np.diff(np.searchsorted(start, bounds)) + 2
    ends = np.cumsum(sizes)
    u = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    last = np.zeros(len(u), bool)
    last[ends - 1] = True
    inner = ~last
    inner[ends - sizes] = False
    u[ends - sizes], u[ends - 1] = _BEGIN, _END
    u[inner] = _hashes(text, start, stop - start)
    place = np.arange(len(u)) - np.repeat(ends - sizes, sizes)
    return {"u": u, "doc": np.repeat(np.arange(len(texts)), sizes), "place": place, "last": last, "words": sizes - 2}


def _of_slice(u: np.ndarray, slice: int, slices: int) -> np.ndarray:
    return np.flatnonzero((u >> np.uint64(33)) % np.uint64(slices) == slice)


def _packed(columns: str) -> str:
    """The schema of packed rows: the values of many n-grams as one binary value a column, so that a row stands for all that goes to a part together."""
    return ", ".join(["part int", *(f"{c} binary" for c in columns.split())])


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash; it has a range of the first bits, and so of a filter."""
    return ((key >> np.uint64(64 - WORD_BITS)) * np.uint64(parts) >> np.uint64(WORD_BITS)).astype(np.uint16 if parts < 1 << 16 else np.uint32)


def _dealt(columns: str, by: np.ndarray, parts: int, **values: np.ndarray) -> pa.Table:
    """Packed rows of ``values``, a row for each part of ``by`` that has any; columns without values are empty."""
    part = _part(by, parts)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    rows = np.flatnonzero(np.diff(ends))
    bounds, arrays = np.append(ends[rows], ends[-1]), [pa.array(rows.astype(np.int32))]
    for c in columns.split():
        x = values[c][order] if c in values else np.empty(0, np.uint8)
        offsets = (bounds * x.itemsize if c in values else np.zeros_like(bounds)).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(x)]))
    return pa.table(arrays, names=["part", *columns.split()])


def _row(part: int, **values: np.ndarray) -> pa.Table:
    """One packed row."""
    return pa.table({"part": pa.array([part], pa.int32())} | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in values.items()})


def _values(table: pa.Table, columns: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table[c].to_pylist()), _TYPES.get(c, np.int64)) for c in columns.split()]


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, np.int64)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else x[:0]


def _counted(texts: DataFrame, slice: int, slices: int, parts: int, by_context: bool) -> DataFrame:
    """Packed trigrams (u, v, w, n) of a slice, dealt by their first two words or else by their last; a bigram that begins a text, which nothing precedes, has u = 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 0, BATCH):
            x = positions(batch.column(0))
            at = _of_slice(x["u"], slice, slices)
            at = at[~x["last"][at]]
            u, v, w = np.where(x["place"][at] > 0, x["u"][at - 1], np.uint64(0)), x["u"][at], x["u"][at + 1]
            _, first, n = np.unique(_trigram(u, v, w), return_index=True, return_counts=True)
            u, v, w = u[first], v[first], w[first]
            by = np.where(u > 0, _bigram(u, v), w) if by_context else _bigram(v, w)  # what begins a text has no context
            yield from _dealt("u v w n", by, parts, u=u, v=v, w=w, n=n.astype(np.int64)).to_batches()

    return texts.mapInArrow(count, _packed("u v w n"))


def _merged(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(u, v, w, n) of a part, a trigram once."""
    u, v, w, n = _values(table, "u v w n")
    order = np.argsort(key := _trigram(u, v, w))
    starts = _runs(key[order])
    first = order[starts]
    return u[first], v[first], w[first], _sums(n[order], starts)


def _words_of(table: pa.Table, parts: int) -> pa.Table:
    """What a part of bigrams adds to the counts of words, and how many bigrams and trigrams it has counted once to four times."""
    _, v, w, n = _merged(table)
    begins = v == _BEGIN
    of = [int(np.count_nonzero((n == k) & ~begins)) for k in (1, 2, 3, 4)]
    order = np.argsort(key := _bigram(v, w))
    starts = _runs(key[order])
    first, n = order[starts], _sums(n[order], starts)
    v, w, c = v[first], w[first], np.where(begins[first], n, np.diff(np.append(starts, len(order))))
    none, one = np.zeros(len(c), np.int64), np.ones(len(c), np.int64)
    after, before = [none, none, c, c == 1, c == 2, c > 2], [one, n, none, none, none, none]
    x, *sums = _by_word(np.concatenate([v, w]), *(np.concatenate([a, b]) for a, b in zip(after, before, strict=True)))
    found = _dealt(WORD, x, parts, **dict(zip(WORD.split(), [x, *sums], strict=True)))
    of = [*(int(np.count_nonzero(c == k)) for k in (1, 2, 3, 4)), *of]
    return found.append_column("of", pa.array([of] + [None] * (len(found) - 1), pa.list_(pa.int64())))


def _by_word(x: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The words once, and the sums of their counts."""
    order = np.argsort(x)
    starts = _runs(x[order])
    return [x[order][starts], *(_sums(c[order].astype(np.int64), starts) for c in counts)]


def _words(table: pa.Table) -> pa.Table:
    """A part's words with whole counts; of all, those that the discounts of words and the begin mark's mass are made of."""
    x, c, *more = _by_word(*_values(table, WORD))
    begin = np.flatnonzero(x == _BEGIN)
    of = [c.sum(), np.count_nonzero(c), *(np.count_nonzero(c == k) for k in (1, 2, 3, 4)), *(m[begin].sum() for m in more[1:])]
    return _row(table["part"][0].as_py(), **dict(zip(WORD.split(), [x, c, *more], strict=True))).append_column("of", pa.array([[int(k) for k in of]], pa.list_(pa.int64())))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of counts, from how many n-grams were counted once to four times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0
    return tuple(min(max(k - (k + 1) * y * more / less, 0.1), k - 0.05) if less and y else k / 2 for k, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


@dataclass
class Weights:
    """The weights of n-grams, made a slice at a time from the training texts, the counts of words and the discounts."""

    texts: DataFrame
    words: DataFrame
    d1: tuple[float, float, float]
    d2: tuple[float, float, float]
    d3: tuple[float, float, float]
    total: int
    unknown: float
    slices: int
    parts: int

    def of(self, slice: int, parts: int) -> DataFrame:
        """Packed n-grams (key, weight) of a slice, a row for each of ``parts``: by key, with the part's range of the filter and its most frequent n-grams."""
        d1, d2, d3, total_words, unknown, slices, own = self.d1, self.d2, self.d3, self.total or 1, self.unknown, self.slices, self.parts
        trigram, other = "v w key n all gamma", "key1 n1 weight1"

        def one(c: np.ndarray) -> np.ndarray:
            return (c - _discounted(c, d1)) / total_words + unknown

        def contexts(table: pa.Table) -> pa.Table:
            u, v, w, n = _merged(table)
            order = np.argsort(key := _bigram(u, v))
            u, v, w, n, key = (x[order] for x in (u, v, w, n, key))
            starts = _runs(key)
            total = _sums(n, starts)
            gamma = _sums(_discounted(n, d3), starts) / total
            size, there = np.diff(np.append(starts, len(n))), u[starts] > 0
            each = _dealt(f"{trigram} {other}", _bigram(v, w), own, v=v, w=w, key=_trigram(u, v, w), n=n, all=np.repeat(np.where(there, total, 0), size), gamma=np.repeat(gamma, size))
            key = key[starts[there]] ^ _CONTEXT
            return pa.concat_tables([each, _dealt(f"{trigram} {other}", key, own, key1=key, n1=total[there], weight1=np.log(gamma[there]))])

        def bigrams(table: pa.Table) -> pa.Table:
            v, w, *more = _values(table, trigram)
            order = np.argsort(b := _bigram(v, w))
            starts = _runs(b[order])
            first, size = order[starts], np.diff(np.append(starts, len(order)))
            key, n, total, gamma = (x[order] for x in more)
            n2 = _sums(n, starts)
            rest = dict(zip(other.split(), _values(table, other), strict=True))
            return _row(table["part"][0].as_py(), v=v[first], w=w[first], n2=n2, c=np.where(v[first] == _BEGIN, n2, size), size=size, key=key, n=n, all=total, gamma=gamma, **rest)

        def by_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    v, w, c = _values(pa.table(batch.slice(k, 1)), "v w c")
                    yield from _dealt("v w c", w, own, v=v, w=w, c=c).to_batches()

        def lower(table: pa.Table, words: pa.Table) -> pa.Table:
            (v, w, c), (x, before) = _values(table, "v w c"), _values(words, "x c")
            return _dealt("v w c p", v, own, v=v, w=w, c=c, p=one(before[np.searchsorted(x, w)]) if len(w) else np.empty(0))

        def second(table: pa.Table, words: pa.Table) -> pa.Table:
            (v, w, c, p), (x, before, n, total, *b) = _values(table, "v w c p"), _values(words, WORD)
            some = _of_slice(x, slice, slices)
            x, before, n, total, *b = (y[some] for y in (x, before, n, total, *b))
            gamma = np.where(total > 0, sum(d * y for d, y in zip(d2, b, strict=True)) / np.maximum(total, 1), 1.0)
            at = np.searchsorted(x, v)
            p2 = (c - _discounted(c, d2)) / total[at] + gamma[at] * p
            key = _bigram(v, w)
            two = _dealt(f"key p weight {other}", key, own, key=key, p=p2, weight=np.log(p2) - np.log(p) - np.log(gamma[at]))
            follows = before > 0
            weight = np.log(one(before[follows])) - np.log(unknown) + np.log(gamma[follows])
            return pa.concat_tables([two, _dealt(f"key p weight {other}", x[follows], own, key1=x[follows], n1=n[follows], weight1=weight)])

        def third(table: pa.Table, two: pa.Table) -> pa.Table:
            (n2, size, key, n, total, gamma), (key2, p, weight) = _values(table, "n2 size key n all gamma"), _values(two, "key p weight")
            order = np.argsort(key2)
            lower = np.repeat(p[order], size)
            real = total > 0  # the others begin a text
            key, n, total, gamma, lower = (x[real] for x in (key, n, total, gamma, lower))
            weight3 = np.log((n - _discounted(n, d3)) / total + gamma * lower) - np.log(lower) - np.log(gamma)
            more = zip(_values(table, other), _values(two, other), strict=True)
            key, n, weight = (np.concatenate(x) for x in zip((key2[order], n2, weight[order]), (key, n, weight3), *zip(*more, strict=True), strict=True))
            return _dealt("key n weight", key, parts, key=key, n=n, weight=weight)

        def part(table: pa.Table) -> pa.Table:
            key, n, weight = _values(table, "key n weight")
            order = np.argsort(key)
            key, n, weight = key[order], n[order], weight[order]
            head = np.sort(np.argsort(-n, kind="stable")[: IN_PLACE // parts])
            k = table["part"][0].as_py()
            return _row(k, key=key, weight=weight, bits=_bits(key, k, parts), head=key[head], headweight=weight[head])

        each = _counted(self.texts, slice, slices, own, True).groupBy("part").applyInArrow(contexts, _packed(f"{trigram} {other}"))
        three = write_table(each.groupBy("part").applyInArrow(bigrams, _packed(f"v w n2 c size key n all gamma {other}")), "trigrams")
        two = three.select("part", "v", "w", "c").mapInArrow(by_last, _packed("v w c")).groupBy("part")
        two = two.cogroup(self.words.select("part", "x", "c").groupBy("part")).applyInArrow(lower, _packed("v w c p")).groupBy("part")
        two = write_table(two.cogroup(self.words.drop("of").groupBy("part")).applyInArrow(second, _packed(f"key p weight {other}")), "bigrams")
        every = write_table(three.drop("v", "w", "c").groupBy("part").cogroup(two.groupBy("part")).applyInArrow(third, _packed("key n weight")), "every")
        for table in (three, two):
            drop_table(table)
        weights = write_table(every.groupBy("part").applyInArrow(part, _packed("key weight bits head headweight")), "weights")
        drop_table(every)
        return weights


def train(sample: DataFrame, text: str = "text") -> tuple[Weights, float, float]:
    """(weights, per_position, per_text) of the texts of ``sample``: the weights, and the constants of every position and text.

    An n-gram of two words is counted by the words that precede it, as is one of one word; n-grams
    that begin a text, which nothing precedes, by themselves.
    """
    with freed_shuffles(sample.sparkSession):
        texts = write_table(sample.select(F.col(text).cast("string").alias("text")), "training-texts")
        size = _size(texts)
        slices, parts = SLICES if size > ONE_SLICE else 1, max(LEAST_PARTS, size // PART)
        schema, found = _packed(WORD) + ", of array<bigint>", []
        for slice in range(slices):
            found.append(write_table(_counted(texts, slice, slices, parts, False).groupBy("part").applyInArrow(lambda t: _words_of(t, parts), schema), "words"))
        both = reduce(DataFrame.unionByName, found)
        of = _total(both, 8)
        words = write_table(both.drop("of").groupBy("part").applyInArrow(_words, schema), "word-counts")
        for table in found:
            drop_table(table)
        total, kinds, *n1, begins, b1, b2, b3 = _total(words, 10)
        d1, d2, d3 = (discounts(*x) for x in (n1, of[:4], of[4:]))
        unknown = (d1[0] * n1[0] + d1[1] * n1[1] + d1[2] * (kinds - n1[0] - n1[1])) / total / (kinds + 1) if kinds else 1.0
        # the mass that the begin mark leaves to words that don't follow it
        left = (d2[0] * b1 + d2[1] * b2 + d2[2] * b3) / begins if kinds else 1.0
    return Weights(texts, words, d1, d2, d3, total, unknown, slices, parts), float(np.log(unknown)), float(np.log(left))


def _size(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _total(table: DataFrame, n: int) -> list[int]:
    return [x or 0 for x in table.agg(*[F.sum(F.col("of")[k]) for k in range(n)]).first()]


def _first_word(part: int, parts: int) -> int:
    return -(-part * (1 << WORD_BITS) // parts)


def _bits(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    """A part's words of the membership filter, in which two bits of a key's word are set; a filter of fixed size passes more keys on as it fills, but loses none."""
    first, stop = _first_word(part, parts), _first_word(part + 1, parts)
    bits = np.zeros((stop - first) * 64, np.uint8)
    word, one, two = _places(keys)
    for bit in (one, two):
        bits[(word - first) * 64 + bit] = 1
    return np.packbits(bits, bitorder="little")


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key's word in the filter and its two bits there."""
    return (keys >> np.uint64(64 - WORD_BITS)).view(np.int64), *(((keys >> np.uint64(64 - WORD_BITS - k)) & np.uint64(63)).view(np.int64) for k in (6, 12))


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, one, two = _places(keys)
    mask = (np.uint64(1) << one.view(np.uint64)) | (np.uint64(1) << two.view(np.uint64))
    return bits[word] & mask == mask


def _summed(texts: DataFrame, weights: DataFrame, slice: int, slices: int, parts: int) -> DataFrame:
    """(h, logp, rows, n_words) of a slice, for each of (h, text) or several with the same h."""
    fixed = weights.select("part", "bits", "head", "headweight").toArrow().sort_by("part")  # parts are ranges of keys, so the heads are by key
    words = np.zeros(1 << WORD_BITS, np.uint64)
    for k, bits in zip(fixed["part"].to_pylist(), fixed["bits"].to_pylist(), strict=True):
        first = _first_word(k, parts)
        words[first : first + len(bits) // 8] = np.frombuffer(bits, np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast((*_values(fixed, "head headweight"), words))
    schema = "part int, id bigint, key binary, doc binary, weight binary, h binary, n binary"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, filter = shared.value
        for whole in parts_of(batches, 1, BATCH):
            for start in range(0, len(whole), MOST_DOCS):
                batch = whole.slice(start, MOST_DOCS)
                h = batch.column(0).to_numpy()
                x = positions(batch.column(1))
                at = _of_slice(x["u"], slice, slices)
                go, middle = ~x["last"][at], x["place"][at] > 0
                u, v, w = x["u"][at - 1], x["u"][at], x["u"][np.minimum(at + 1, len(x["u"]) - 1)]
                some = go & middle
                context = _bigram(u[some], v[some]) ^ _CONTEXT
                k = np.concatenate([v[middle], context, _bigram(v[go], w[go]), _trigram(u[some], v[some], w[some])])
                doc = np.concatenate([x["doc"][at[m]] for m in (middle, some, go, some)])
                there = np.flatnonzero(_maybe(filter, k))
                there = there[np.argsort(k[there])]  # a search for sorted keys takes a third of the time
                k, doc = k[there], doc[there]
                base = np.zeros(len(batch))
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    here = keys[i] == k
                    base += np.bincount(doc[here], weights=own[i[here]], minlength=len(batch))
                    k, doc = k[~here], doc[~here]
                id = xxhash.xxh64_intdigest(h.tobytes()) >> 1  # batches of equal texts share it
                late = _dealt("key doc weight h n", k, parts, key=k, doc=doc.astype(np.uint16))
                texts = _row(id % parts, key=_NONE, doc=_NONE, weight=base, h=h, n=x["words"])
                each = pa.concat_tables([late, texts])
                yield from each.add_column(1, "id", pa.array([id] * len(each), pa.int64())).to_batches()

    def weigh(found: pa.Table, weights: pa.Table) -> pa.Table:
        keys, own = _values(weights, "key weight")
        docs, sums = [], []
        for row in range(len(found)):
            key, doc = _values(one := found.slice(row, 1), "key doc")
            if not len(key):  # the texts' own row
                docs.append(b"")
                sums += one["weight"].to_pylist()
                continue
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            there = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            total = np.bincount(doc[there], weights=own[at[there]] if len(keys) else np.empty(0))
            some = np.flatnonzero(total)
            docs.append(some.astype(np.uint16).tobytes())
            sums.append(total[some].tobytes())
        return pa.table({"id": found["id"], "doc": pa.array(docs, pa.binary()), "weight": pa.array(sums, pa.binary()), "h": found["h"], "n": found["n"]})

    def add(table: pa.Table) -> pa.Table:
        own = table.filter(pc.greater(pc.binary_length(table["h"]), 0))
        h, words = _values(own.slice(0, 1), "h n")
        base, doc, late = *_values(own, "weight"), *_values(table.filter(pc.equal(pc.binary_length(table["h"]), 0)), "doc weight")
        total = base.reshape(len(own), -1).sum(0) + np.bincount(doc, weights=late, minlength=len(h))
        return pa.table({"h": h, "logp": total, "rows": np.full(len(h), len(own)), "n_words": words})

    found = texts.mapInArrow(look, schema).groupBy("part").cogroup(weights.select("part", "key", "weight").groupBy("part")).applyInArrow(weigh, "id bigint, doc binary, weight binary, h binary, n binary")
    summed = write_table(found.groupBy("id").applyInArrow(add, "h bigint, logp double, rows bigint, n_words bigint"), "sums")
    shared.destroy()
    return summed


def log_probabilities(docs: DataFrame, weights: Weights, per_position: float, per_text: float, id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc_id, lang, n_words, logp) of every row under the model; the end of a text is one more position than its words.

    Sums are those of a text's hash: equal texts, counted in every slice as often, share them.
    """
    hashed = F.xxhash64(docs[text].cast("string")).alias("h")
    texts = docs.select(hashed, docs[text].cast("string").alias("text"))
    sums = []
    with freed_shuffles(docs.sparkSession):
        parts = max(weights.parts, _size(texts) // LOOKED_UP)
        for slice in range(weights.slices):
            own = weights.of(slice, parts)
            sums.append(_summed(texts, own, slice, weights.slices, parts))
            drop_table(own)
        each = reduce(DataFrame.unionByName, sums).groupBy("h").agg((F.sum("logp") * weights.slices / F.sum("rows")).alias("logp"), F.max("n_words").alias("n_words"))
        each = each.select("h", "n_words", (F.col("logp") + (F.col("n_words") + 1) * per_position + per_text).alias("logp"))
        rows = docs.select(hashed, docs[id].alias("doc_id"), (docs[lang].cast("string") if lang else F.lit(None).cast("string")).alias("lang"))
        scored = write_table(rows.join(each, "h").select("doc_id", "lang", "n_words", "logp"), "scored")
        for table in sums:
            drop_table(table)
    return scored


def _of_ids(docs: DataFrame, chosen: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text) of the documents with a chosen ``doc_id``.

    A filter of fixed size keeps the texts of most others out of the join's shuffle; the join is exact.
    """
    hashed = F.xxhash64(F.col("doc_id"))
    bits = docs.sparkSession.sparkContext.broadcast(membership_filter(chosen.select(hashed.alias("key"))))

    @F.pandas_udf("boolean")
    def some(keys):
        import pandas as pd

        return pd.Series(maybe_in(bits.value, keys.to_numpy()), dtype=bool)

    return docs.select(docs[id].alias("doc_id"), docs[text].alias(text)).where(some(hashed)).join(chosen, "doc_id", "left_semi")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    train_share: float = TRAIN_SHARE,
    quantile: float = 0.995,
    slack: float = 0.05,
    least_rows: int = 50,
) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) of every row.

    Trusted text is that of documents labelled quality 1 and not toxic. The share ``train_share`` of
    them, drawn by a hash of the id, trains the model, so that its counts grow with the input; the
    others set a threshold for each language: the ``quantile`` of their perplexity, and ``slack`` of it more. A language with
    fewer than ``least_rows`` of them takes the threshold of all languages together.

    Null and empty texts have one position, the end; null languages are a language of their own;
    repeated rows are judged alike; without labels nothing is trusted and every row is kept, with
    null as threshold; an empty table gives an empty result; other columns are ignored. A text at its
    threshold is kept; a very long text is counted in parts and is one row as any other.
    """
    trusted = labels.groupBy(F.col(id).alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0 and doc_id is not null").select("doc_id")
    trusted = write_table(trusted, "trusted")
    drawn = F.pmod(F.xxhash64(F.lit("model sample"), F.col("doc_id")), F.lit(1_000_003)) < train_share * 1_000_003
    model = train(_of_ids(docs, trusted.where(drawn), id, text), text)
    scored = log_probabilities(docs, *model, id, text, lang).withColumn("ppl", F.exp(-F.col("logp") / (F.col("n_words") + 1)))
    held = scored.join(trusted.where(~drawn), "doc_id").where("n_words > 0")
    line = F.percentile_approx("ppl", quantile, 10_000) * (1 + slack)
    by_lang = held.groupBy("lang").agg(line.alias("own"), F.count("*").alias("rows")).where(F.col("rows") >= least_rows).select(F.col("lang").alias("l"), "own")
    every = held.agg(line.alias("every"))
    threshold = F.coalesce("own", "every")
    return scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").crossJoin(F.broadcast(every)).select("doc_id", "lang", "n_words", F.col("ppl").alias("perplexity"), threshold.alias("threshold"), F.coalesce(F.col("ppl") <= threshold, F.lit(True)).alias("kept"))
