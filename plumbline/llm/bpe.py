"""Operator 1, byte-level BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be merged over, so a text may be cut
between them and the fragments encoded one by one: the ids of the text are those of the fragments, concatenated.
Fragments repeat (they are mostly words), so a bounded memo holds their ids.  A text goes through in windows that
end at such a cut; memory is bounded by the window, not by the text.

Defined results: a null text counts as empty (no ids, empty decoded text).  Added tokens of the tokenizer inside a
text become their ids, as in the tokenizers library.  Rows are independent: repeated rows, ties in doc_id, null
doc_id and extra columns change nothing; an empty table gives an empty table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import empty_if_null, prepare, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"

#: Entries of the memo of fragments on each Python worker, and the longest fragment it keeps.
MEMO_ENTRIES, MEMO_LENGTH = 500_000, 48

#: Bytes of text encoded at once.
WINDOW = 1 << 20

#: Letters, digits and spaces below this code point are the same in every Unicode version; fragments beyond it are
#: encoded by the tokenizers library itself.
SETTLED = "\u0250"

#: The split of the byte-level pre-tokenizer (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary (a fixed value of the format)."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class ByteCodec:
    """The codec of one tokenizer file; one per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        as_bytes = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that reach beyond their own text")
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*as_bytes, *self.special.values()]) + 1
        self.token_bytes = [as_bytes.get(i, b"") for i in range(size)]
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.decimal = [str(i) for i in range(size)]
        self.table = self._cut_table(as_bytes.values())
        self.fast = self._ranked(model, as_bytes)
        self.memo: dict[bytes, list[int]] = {}

    @staticmethod
    def _cut_table(tokens) -> np.ndarray:
        """For each pair of bytes, 1: a certain cut; 2: one if the left character is no white space; 0: none.

        Beside never standing inside a token, a cut may not change what the pre-tokenizer sees: it never follows
        white space or an apostrophe, never parts a character, and precedes an apostrophe only after an ASCII
        letter or digit."""
        inside = np.zeros((256, 256), bool)
        for t in tokens:
            if len(t) > 1:
                b = np.frombuffer(t, np.uint8)
                inside[b[:-1], b[1:]] = True
        table = (~inside).astype(np.uint8)
        alnum = [b for b in range(128) if chr(b).isalnum()]
        table[128:][table[128:] == 1] = 2
        table[:0x21] = table[0x7F] = table[ord("'")] = 0
        quote = table[alnum, ord("'")].copy()
        table[:, ord("'")] = 0
        table[alnum, ord("'")] = quote
        table[:, 0x80:0xC0] = 0
        return table.reshape(-1)

    def _ranked(self, model: dict, as_bytes: dict[int, bytes]):
        """A compiled merger, where the order of the ids is that of the merges; else the library encodes all."""
        merged = [model["vocab"][(a + b) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"] for a, b in [m if isinstance(m, list) else m.split(" ")]]
        singles = sum(len(t) == 1 for t in as_bytes.values())
        if singles != 256 or merged != list(range(256, 256 + len(merged))):
            return None
        import tiktoken

        return tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks={t: i for i, t in as_bytes.items()}, special_tokens={})._core_bpe.encode_ordinary

    def cuts(self, data: bytes) -> np.ndarray:
        """The offsets at which data is cut, without its ends."""
        b = np.frombuffer(data, np.uint8)
        if len(b) < 2:
            return np.zeros(0, np.int64)
        kind = self.table[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        at = kind == 1
        if len(maybe := np.flatnonzero(kind == 2)):
            one, two = b[np.maximum(maybe - 1, 0)], b[np.maximum(maybe - 2, 0)]
            # two bytes: U+00C0 and up; three: U+4000 and up, after the last white space
            sure = (one >= 0xC3) & (one < 0xE0) | (one < 0xC0) & (one >= 0x80) & (two >= 0xE4)
            at[maybe[sure]] = True
        return np.flatnonzero(at) + 1

    def _fragment(self, data: bytes) -> list[int]:
        text = data.decode()
        if self.fast and (text.isascii() or max(text) < SETTLED):
            return self.fast(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def _encode(self, data: bytes) -> Iterator[list[int]]:
        """The ids of a text without added tokens, window by window."""
        start, size, memo = 0, WINDOW, self.memo
        while start < len(data):
            part = data[start : start + size]
            ends = self.cuts(part)
            if start + size < len(data):
                if not len(ends):
                    size *= 2
                    continue
                part = part[: ends[-1]]
            else:
                ends = np.append(ends, len(part))
            start, size = start + len(part), WINDOW
            ends = ends.tolist()
            fragments = [part[i:j] for i, j in zip([0, *ends], ends)]
            new = set(fragments).difference(memo)
            for f in new:
                memo[f] = self._fragment(f)
            yield list(chain.from_iterable(map(memo.__getitem__, fragments)))
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            for f in new:
                if len(f) > MEMO_LENGTH:
                    memo.pop(f, None)

    def windows(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, in order, a window at a time."""
        text = text or ""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield from self._encode(text[at : m.start()].encode())
            yield [self.special[m[0]]]
            at = m.end()
        yield from self._encode((text[at:] if at else text).encode())

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.windows(text)))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode(errors="replace")


@cache
def codec(path: str | None) -> ByteCodec:
    return ByteCodec(path or tokenizer_path(VOCABULARY))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs with a column of ids, array<int>.  Extra columns stay; one named `out` gives way, be it the text."""
    return _mapped(docs, text, out, T.ArrayType(T.IntegerType()), lambda c, x: c.encode(x), path)


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the text of a column of ids; null ids give an empty text, ids beyond the vocabulary raise."""
    return _mapped(docs, ids, out, T.StringType(), lambda c, x: c.decode(x or []), path)


def _mapped(docs: DataFrame, source: str, out: str, kind: T.DataType, f, path: str | None) -> DataFrame:
    prepare(docs.sparkSession)
    docs = docs.drop(out) if out != source else docs
    kept = [x.name for x in docs.schema.fields if x.name != out]
    to = pa.list_(pa.int32()) if isinstance(kind, T.ArrayType) else pa.string()

    def run(batches):
        c = codec(path)
        for b in batches:
            values = [f(c, x) for x in b.column(b.schema.get_field_index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in kept), pa.array(values, to)], [*kept, out])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[x] for x in kept), T.StructField(out, kind)]))


def round_trip_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, then decoded from the ids.  No shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for x in b.column(1).to_pylist():
                k, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for ids in c.windows(x):
                    if ids:
                        of_ids.update((b"," if k else b"") + ",".join(map(c.decimal.__getitem__, ids)).encode())
                        of_text.update(c.decode_bytes(ids).decode(errors="replace").encode())
                        k += len(ids)
                n.append(k)
                ids_hash.append(of_ids.hexdigest())
                text_hash.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), empty_if_null(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
