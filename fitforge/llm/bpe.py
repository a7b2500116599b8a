"""Byte-level BPE with forced boundaries.

A merge joins neighbouring bytes into a token of the vocabulary, so two bytes
that are neighbours in no token can never end up in one token.  Between such
bytes a text can be cut for certain: its fragments are encoded independently and
the ids concatenated.  Most fragments are single words that come again and
again: within a slice of text each is looked up once, and a bounded memo holds
the ids of those met lately.

A cut must leave the tokenizer's own splitting into words alone as well.  It
looks ahead only behind white space and takes an apostrophe together with what
follows; no cut is made behind white space or before an apostrophe, and none
inside a character or a special token.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitforge.llm.textkernel import IS_SPACE, texts_of

#: Fragments in each of the two generations that a worker remembers, and the longest of them in bytes.
MEMO_ENTRIES = 250_000
MEMO_BYTES = 48

_SLICE = 8 << 20

# Fixed value: how the pre-tokenizer splits a text into words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# What the pre-tokenizer takes as one word besides runs of a kind.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# White space outside ASCII, by its last bytes.
_WIDE_SPACES = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself where
    it is one, the next free code point from 256 on where not."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryEncoder:
    """Encodes and decodes as the tokenizer of the file does, specials in texts included."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: forced boundaries need a byte-level vocabulary without normalisation")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take their surroundings are not supported")
        self.specials = [a["content"].encode() for a in spec["added_tokens"]]
        letters = _byte_of_letter()
        added = {a["id"] for a in spec["added_tokens"]}
        size = max([*spec["model"]["vocab"].values(), *added]) + 1
        self.token_bytes = [b""] * size
        inside = np.zeros((256, 256), bool)
        for token, i in spec["model"]["vocab"].items():
            raw = token.encode() if i in added else bytes(letters[x] for x in token)
            self.token_bytes[i] = raw
            if i not in added and len(raw) > 1:
                b = np.frombuffer(raw, np.uint8)
                inside[b[:-1], b[1:]] = True
        for a in spec["added_tokens"]:
            self.token_bytes[a["id"]] = a["content"].encode()
        #: forced[a, b]: bytes a and b are neighbours in no token
        self.forced = ~inside
        allowed = self.forced.copy()
        allowed[IS_SPACE] = False
        allowed[:, ord("'")] = False
        allowed[:, 0x80:0xC0] = False
        for x in _CONTRACTIONS:
            for a, b in zip(x.encode(), x[1:].encode(), strict=False):
                allowed[a, b] = False
        self._allowed = allowed.reshape(-1)
        self._encode_fragment = self._fragment_encoder(spec, path)
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise NotImplementedError("ids are kept as the machine's own 32-bit integers, little-endian ones")
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._memo_entries = memo_entries
        lengths = [len(x) for x in self.token_bytes]
        self._token_data = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self._token_ends = np.cumsum(lengths)

    def _fragment_encoder(self, spec: dict, path: str):
        """A function from a fragment to its ids.

        Where ids follow the order of merges, as is usual, they serve as ranks and
        the faster of the two libraries can take the vocabulary from the file."""
        vocab = spec["model"]["vocab"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
        first = vocab[merges[0]] if merges else 0
        if all(vocab.get(m) == first + i for i, m in enumerate(merges)):
            import tiktoken

            added = {a["content"]: a["id"] for a in spec["added_tokens"]}
            ranks = {self.token_bytes[i]: i for i in vocab.values() if i not in added.values()}
            words = tiktoken.Encoding("vocabulary", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens=added)
            return lambda text: [added[text]] if text in added else words.encode_ordinary(text)
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        return lambda text: whole.encode(text, add_special_tokens=False).ids

    def cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the fragments of the texts start, and the end of the last."""
        n = len(data)
        at = np.zeros(n + 1, bool)
        if n > 1:
            at[1:n] = self._allowed[(data[:-1].astype(np.uint16) << 8) | data[1:]]
            wide = np.flatnonzero(at[1:n] & (data[:-1] >= 0x80)) + 1
            for space in _WIDE_SPACES if len(wide) else ():
                raw = space.encode()
                hit = wide[wide >= len(raw)]
                for k, b in enumerate(reversed(raw)):
                    hit = hit[data[hit - 1 - k] == b]
                at[hit] = False
        raw = data.tobytes()
        for special in self.specials:
            p = raw.find(special)
            while p >= 0:
                end = p + len(special)
                # the texts lie end to end: what begins in one and ends in another is no special token
                whole = bounds[np.searchsorted(bounds, p, "right")] >= end
                if whole:
                    at[p + 1 : end] = False
                    at[p] = at[end] = True
                p = raw.find(special, end if whole else p + 1)
        at[bounds] = True
        at[0] = at[n] = True
        return np.flatnonzero(at)

    def _ids(self, fragments: list[bytes]) -> list[bytes]:
        new, old, out = self._new, self._old, []
        for f in fragments:
            ids = new.get(f)
            if ids is None:
                ids = old.get(f) or array("I", self._encode_fragment(f.decode())).tobytes()
                if len(f) <= MEMO_BYTES:
                    new[f] = ids
                    if len(new) >= self._memo_entries:
                        self._old = old = new
                        self._new = new = {}
            out.append(ids)
        return out

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the bounds of each text's among them."""
        at = self.cuts(data, bounds)
        edges = pa.py_buffer(at.astype(np.int64))
        fragments = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, edges, pa.py_buffer(data)]).dictionary_encode()
        found = self._ids(fragments.dictionary.to_pylist())
        ids, ends = ragged_take(
            np.frombuffer(b"".join(found), "<u4"),
            np.cumsum([len(x) // 4 for x in found], dtype=np.int64),
            fragments.indices.to_numpy(),
        )
        return ids, np.concatenate(([0], ends))[np.searchsorted(at, bounds)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the tokens stand for; not UTF-8 where a character's tokens are not all there."""
        return ragged_take(self._token_data, self._token_ends, ids)[0].tobytes()


def ragged_take(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate pieces of ``values`` (piece i ends at ``ends[i]``), and where each ends then."""
    if not len(which):
        return values[:0], np.zeros(0, np.int64)
    lengths = np.diff(ends, prepend=0)[which]
    out = np.cumsum(lengths)
    shift = ends[which] - out
    return values[np.repeat(shift, lengths) + np.arange(out[-1])], out


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    """The worker's own encoder for a file."""
    return ForcedBoundaryEncoder(path)


def encoded_texts(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text of a column, null as empty, a slice of texts at a time."""
    for texts in texts_of(column, _SLICE):
        ids, bounds = encoder(path).encode(texts.data, texts.bounds)
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            yield ids[a:b]


def _with_columns(df: DataFrame, added: list[T.StructField], drop: str, f) -> DataFrame:
    """``df`` without column ``drop`` and with what ``f(column)`` yields for each of its rows."""
    kept = [x for x in df.columns if x != drop]
    schema = T.StructType([df.schema[x] for x in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(f(batch.column(batch.schema.get_field_index(drop))))
            columns = [batch.column(batch.schema.get_field_index(x)) for x in kept]
            new = [pa.array([r[i] for r in rows], _arrow(a.dataType)) for i, a in enumerate(added)]
            yield pa.RecordBatch.from_arrays(columns + new, names=[*kept, *(a.name for a in added)])

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.IntegerType(): pa.int32()}[kind]


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace column ``text`` by ``ids`` (binary, little-endian unsigned 32-bit ids).

    Null and empty texts have no ids.  Other columns and repeated rows stay; a
    column that is named as ``ids`` already is replaced.
    """
    source = docs.drop(ids) if ids != text else docs
    return _with_columns(source, [T.StructField(ids, T.BinaryType())], text, lambda col: ((x.tobytes(),) for x in encoded_texts(col, path)))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replace binary column ``ids`` by the decoded ``text``; null decodes to the empty text."""
    source = rows.drop(text) if ids != text else rows

    def decoded(col):
        return ((encoder(path).decode(np.frombuffer(x or b"", "<u4")).decode(errors="replace"),) for x in col.to_pylist())

    return _with_columns(source, [T.StructField(text, T.StringType())], ids, decoded)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of what they decode to.

    Encodes and decodes in one pass, so that neither ids nor texts leave the task.
    Null text counts as empty and has no ids.  Very long texts are encoded whole, in a slice
    of their own.  Rows stay as they are, repeated ones and those without doc_id too;
    columns besides doc_id and text are left out, whatever their names; an empty table
    gives no rows.
    """
    from hashlib import sha256

    def digests(col):
        for ids in encoded_texts(col, path):
            text = encoder(path).decode(ids).decode(errors="replace")
            yield len(ids), sha256(ids.tobytes()).hexdigest(), sha256(text.encode()).hexdigest()

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with_columns(docs.select("doc_id", F.col("text")), added, "text", digests)
