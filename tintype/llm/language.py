"""Language identification by a convolutional network over bytes, trained in numpy.

Filters of several widths run over windows of fixed length; each filter's response is pooled by its
maximum over the window, and a softmax layer turns the pooled responses into languages. As the
input is a byte at each place, a filter is a table of weights by place and byte value, and a
convolution is a sum of table rows. A text's windows cover it whole; their probabilities are
averaged, weighted by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintype.llm.shared import slices

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16

#: Bounds of the training sample: documents of each language, documents of all (shared out evenly, one of each language at least), windows of each document.
PER_LANGUAGE, ALL_LANGUAGES, WINDOWS_EACH = 1500, 30_000, 6

#: More label values than this aren't languages; training on them is refused, none is left out.
MOST_LANGUAGES = 10_000

_LETTERISH = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTERISH.finditer(text))


def windows_of(raw: bytes) -> np.ndarray:
    """The bytes of a text as rows of WINDOW, the last one padded with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class ByteCnn:
    """The network: ``tables[w][k]`` (256, FILTERS) for place k of width w, biases, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), dtype=np.float32)

    def responses(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each width the responses (windows, places, filters)."""
        for i, w in enumerate(WIDTHS):
            places = WINDOW - w + 1
            total = np.take(self.tables[i][0], x[:, :places], axis=0)
            for k in range(1, w):
                total += np.take(self.tables[i][k], x[:, k : k + places], axis=0)
            yield i, total

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([r.max(axis=1) for _, r in self.responses(x)], axis=1)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        return np.concatenate([self._softmax(self.pooled(x[i : i + step])) for i in range(0, len(x), step)])

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the cross entropy; the gradient of the maximum flows to the place that gave it."""
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.bias, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb, yb = x[rows], y[rows]
                where, pooled = [], []
                for _, r in self.responses(xb):
                    where.append(r.argmax(axis=1))
                    pooled.append(np.take_along_axis(r, where[-1][:, None, :], axis=1)[:, 0])
                act = np.concatenate(pooled, axis=1) + self.bias
                hidden = np.maximum(act, 0)
                z = hidden @ self.dense + self.offset
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), yb] -= 1
                p /= len(rows)
                back = (p @ self.dense.T) * (act > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[i])
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    filters = np.broadcast_to(np.arange(FILTERS), part.shape)
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(xb, where[i] + k, axis=1), filters), part)
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                step += 1
                pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for w_, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w_ -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability for each text; 'und' and 0 for one that is null or has no letter."""
        found, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(some), 256):  # so many texts at once
            part = some[at : at + 256]
            raw = [texts[i].encode("utf-8", "replace") for i in part]
            sizes = [max(1, -(-len(b) // WINDOW)) for b in raw]
            p = self.probabilities(np.concatenate([windows_of(b) for b in raw]))
            starts = np.r_[0, np.cumsum(sizes)]
            for k, i in enumerate(part):
                weight = np.full(sizes[k], WINDOW, dtype=np.float64)
                weight[-1] = len(raw[k]) - WINDOW * (sizes[k] - 1)
                mean = weight @ p[starts[k] : starts[k + 1]] / weight.sum()
                best = int(mean.argmax())
                found[i], scores[i] = self.languages[best], float(min(mean[best], 1.0))
        return found, scores


def held_out(id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, id: str, text: str, lang: str, per_language: int, windows_each: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of a sample of labelled rows that aren't held out.

    Languages are counted over all rows; of each the documents of least id hash are drawn until
    about ``per_language`` are expected (fewer where there are very many languages), all of a rare
    language, with ``windows_each`` windows spread over each text.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id)))
    counts = [tuple(r) for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()]
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    most = min(per_language, max(1, ALL_LANGUAGES // len(counts)))
    shares = docs.sparkSession.createDataFrame([(c, min(1.0, max(most, 8) / n)) for c, n in counts], "_lang string, _share double")  # of few documents expected there may be none
    drawn = rows.select(F.col(id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(shares), F.col("lang") == F.col("_lang"))
    sample = drawn.where(F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1_000_003)) < F.col("_share") * 1_000_003).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for d, c, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not has_letter(t):
                    continue
                raw = t.encode("utf-8", "replace")
                many = min(windows_each, -(-len(raw) // WINDOW))
                for k in range(many):
                    at = k * max(0, len(raw) - WINDOW) // max(1, many - 1)
                    for o, v in zip(out, (str(d), c, raw[at : at + WINDOW]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["doc_id", "lang", "raw"])

    table = sample.mapInArrow(cut, "doc_id string, lang string, raw binary").toArrow()
    got = sorted(zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), table["raw"].to_pylist(), strict=True))
    names = sorted({c for _, c, _ in got})
    x = np.concatenate([windows_of(r) for _, _, r in got]) if got else np.zeros((0, WINDOW), np.uint8)
    return x, np.array([names.index(c) for _, c, _ in got], dtype=np.int64), names


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, windows_each: int = WINDOWS_EACH, seed: int = 0) -> ByteCnn | None:
    """A network trained on a bounded sample of labelled rows that aren't held out; None if there is no such row."""
    x, y, names = training_windows(docs, id, text, lang, per_language, windows_each)
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    short = x.copy()  # short texts are windows that are mostly padding
    for i, n in enumerate(rng.integers(8, WINDOW, len(short))):
        short[i, n:] = 0
    model = ByteCnn(names, seed)
    model.train(np.concatenate([x, short]), np.concatenate([y, y]), seed=seed, epochs=max(3, min(40, 60_000 // len(x))))
    return model


def identify(docs: DataFrame, model: ByteCnn | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text alone.

    Null texts and texts without a letter are 'und' with score 0, as is every text if nothing could
    be learned. Repeated rows get equal results; null ids are kept and count as not held out; an
    empty table gives an empty result; other columns are ignored. Equally likely languages give the
    first by name; a very long text is judged by all its windows, a bounded number at a time.
    """
    rows = docs.select(docs[id].alias("doc_id"), held_out(docs[id]).alias("held_out"), docs[text].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, 2):
            texts = b.column(2).to_pylist()
            found, scores = own.predict(texts) if own else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
