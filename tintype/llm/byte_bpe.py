"""Byte-level BPE with the tokenizers library over Arrow batches.

A text is cut at its spaces and before its line ends; every distinct piece is tokenized once in a
task and remembered, in a store of so many bytes that is gone with the task. Ids of a text are those
of its pieces in a row. Cutting there changes nothing, as the split pattern starts a match at every
such place; a text with three white characters in a row, or two at its end, is cut only at single
spaces. Long pieces (text without spaces) are tokenized where they stand and never stored.

Pieces, ids and the look-ups between them are Arrow arrays, so no Python object is made for a piece.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintype.llm.shared import give_back_memory, slices

#: Bytes of pieces and ids that a task remembers, in two halves of which the older one goes when the other is full; most bytes of a stored piece.
STORE_BYTES, LONGEST = 64 << 20, 200

_ODD_SPACE = re.compile(r"\s\s(?:\s|\Z)")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A space or line end, then no white space (all that Unicode counts as such); and one that ends in a letter and a full stop or comma.
_PLAIN = r"^[ \n][^\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"
_TAILED = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}][.,]$"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes a token, when merges of lower rank come first."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 1), i) for i in range(len(parts) - 1))
        if rank >= ranks[token]:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_of_ranks(path: str, pattern: str) -> str:
    """A tokenizers file (as text) that encodes each match of ``pattern`` by the ranks of a rank file, without special tokens."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(shown[h[0]], shown[h[1]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (h := _halves(t, ranks))]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    """An array of byte strings that lie in a row."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, dtype=np.int64)), pa.py_buffer(data)])


class PieceEncoder:
    """Ids of texts by a byte-level tokenizer and a store of pieces.

    A piece that begins with a line end stands as it is, any other one after a space.
    """

    def __init__(self, tokenizer: str, store_bytes: int = STORE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(tokenizer)
        self.added = sorted(t.content for t in self.own.get_added_tokens_decoder().values())
        self.store_bytes = store_bytes
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.older = (self.words, self.ids)  # as they were when they were last full
        space, line = byte_characters()[32], byte_characters()[10]
        self.begins = np.array([(t := self.own.id_to_token(i) or "").startswith(space) or t == line for i in range(self.own.get_vocab_size())])
        self.tails = pa.array(self._whole([".", ","]), pa.large_binary())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_ids(self, forms: pa.Array) -> pa.Array:
        """Ids of forms that have white space only as their first character; many are encoded in one go, and told apart by it."""
        out = []
        for at in range(0, len(forms), 1024):
            some = forms.slice(at, 1024)
            ids = np.array(self.own.encode_batch_fast(["".join(some.to_pylist())], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(some):
                out.append(_binary(4 * np.r_[starts, len(ids)], ids.tobytes()))
            else:
                out.append(pa.array(self._whole(some.to_pylist()), pa.large_binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def _fresh_ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct pieces, tokenized anew; a full stop or comma after a letter apart, as the split pattern takes it by itself."""
        forms = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words, pa.scalar("", pa.large_string())))
        plain = pc.match_substring_regex(forms, _PLAIN)
        tailed = pc.and_(plain, pc.match_substring_regex(forms, _TAILED))
        cores = pc.if_else(tailed, pc.utf8_slice_codeunits(forms, 0, -1), forms)
        some = pc.unique(cores.filter(plain))
        ids = self._plain_ids(some).take(pc.index_in(cores, some))
        tail = self.tails.take(pc.if_else(tailed, pc.if_else(pc.ends_with(forms, ","), 1, 0), pa.scalar(None, pa.int64())))
        ids = pc.if_else(tailed, pc.binary_join_element_wise(ids, tail, pa.scalar(b"", pa.large_binary())), ids)
        rest = pc.invert(plain)
        return pc.replace_with_mask(ids, rest, pa.array(self._whole(forms.filter(rest).to_pylist()), pa.large_binary()))

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """Ids of distinct pieces."""
        if self.words.nbytes + self.ids.nbytes > self.store_bytes // 2:  # what is still used comes back from the older half
            self.older = (self.words, self.ids)
            self.words, self.ids = self.words[:0], self.ids[:0]
        at = pc.index_in(words, self.words)
        new = words.filter(pc.is_null(at))
        back = pc.index_in(new, self.older[0])
        fresh = self._fresh_ids(new.filter(pc.is_null(back)))
        ids = pc.replace_with_mask(self.older[1].take(back), pc.is_null(back), fresh)
        found = pc.replace_with_mask(self.ids.take(at), pc.is_null(at), ids)
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        self.words = pa.concat_arrays([self.words, new.filter(short)])
        self.ids = pa.concat_arrays([self.ids, ids.filter(short)])
        return found

    def _encode(self, pieces: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and where those of the pieces at ``starts`` begin."""
        coded = pieces.dictionary_encode()
        joined = self._ids_of(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] // 4
        return np.frombuffer(joined.buffers()[2] or b"", "<u4"), ends[starts]

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column without nulls."""
        texts = texts.cast(pa.large_string())
        uncut = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            uncut |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if uncut.any():
            rest = self.encode_column(texts.filter(pa.array(~uncut)))
            for t, x in zip(texts.to_pylist(), uncut.tolist(), strict=True):
                yield np.frombuffer(self._whole([t])[0], "<u4") if x else next(rest)
            return
        odd = np.array([_ODD_SPACE.search(t) is not None for t in texts.to_pylist()], dtype=bool)
        marked = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        usual = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")
        begins = np.asarray(usual.offsets) - (usual.offsets[0].as_py() if len(usual) else 0)
        ids, bounds = self._encode(usual.flatten(), begins)
        cut = [_SAFE_SPACE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        heads = self._whole([c[0] for c in cut])  # a text's first piece has no space before it
        more, ends = self._encode(pa.array([p for c in cut for p in c[1:]], pa.large_string()), np.cumsum([0, *(len(c) - 1 for c in cut)]))
        seen = [0, 0]
        for x in odd.tolist():
            k = seen[x]
            seen[x] += 1
            if x:
                yield np.r_[np.frombuffer(heads[k], "<u4"), more[ends[k] : ends[k + 1]]]
            else:
                yield ids[bounds[k] + 1 : bounds[k + 1]]  # without the line end that was put before it

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit bytes."""
        return [x.tobytes() for x in self.encode_column(pa.array(texts, pa.string()))]


class ByteTable:
    """Bytes of ids: the vocabulary's strings with the byte characters read back."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(tokenizer)
        back = {c: b for b, c in enumerate(byte_characters())}
        shown = [own.id_to_token(i) for i in range(max(own.get_vocab().values()) + 1)]
        self.bytes = [None if s is None else bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s in shown]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes of a character may come from several ids, those of none are shown as U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each id in code points; ids that share a character share its place."""
        raw = np.frombuffer(self.decode_bytes(ids), np.uint8)
        ends = np.cumsum([len(self.bytes[i]) for i in ids], dtype=np.int64)
        starts = np.r_[0, ends[:-1]] if len(ids) else ends
        points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        inside = np.r_[(raw & 0xC0) == 0x80, False] if len(raw) else np.zeros(1, bool)
        return points[starts] - inside[starts], points[ends]


def _joined(values: pa.Array, ids: pa.Array) -> memoryview:
    """The chosen values in a row."""
    got = values.take(ids).buffers()[2]
    return memoryview(got or b"")


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(docs[id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends) of every row: token ids and their offsets in code points.

    ``tokenizer`` is a tokenizers file as text, see ``tokenizer_of_ranks``. Null and empty texts have
    no ids; repeated rows are encoded alike; null ids are kept; other columns are ignored. A very
    long text is encoded whole, by itself.
    """
    rows = _texts(docs, id, text)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = PieceEncoder(shared.value), ByteTable(shared.value)
        for b in slices(batches, 1):
            ids = [x.tolist() for x in own.encode_column(b.column(1))]
            places = [table.offsets(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), *(pa.array([p[k].tolist() for p in places], pa.list_(pa.int32())) for k in (0, 1))], names=["doc_id", "ids", "starts", "ends"])
        own = table = b = ids = None
        give_back_memory()

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give a null text, ids outside the vocabulary an error."""
    rows = encoded.select(encoded[id].alias("doc_id"), encoded[ids].alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ByteTable(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else table.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: what ``encode_documents`` gives and ``decode_documents`` makes of it, as digests, in one pass.

    Null and empty texts have no ids, so both digests are of nothing; repeated rows are encoded
    alike; null ids are kept; an empty table gives an empty result; other columns are ignored. A very
    long text is encoded whole, by itself.
    """
    rows = _texts(docs, id, text)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = PieceEncoder(shared.value), ByteTable(shared.value)
        written, meant = pa.array([f"{i} ".encode() for i in range(len(table.bytes))], pa.large_binary()), pa.array(table.bytes, pa.large_binary())
        for b in slices(batches, 1):
            counts, digests, decoded = [], [], []
            for x in own.encode_column(b.column(1)):
                ids = pa.array(x)
                counts.append(len(x))
                digests.append(hashlib.sha256(_joined(written, ids)[:-1]).hexdigest())
                decoded.append(hashlib.sha256(_joined(meant, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own = table = b = ids = None
        give_back_memory()

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
