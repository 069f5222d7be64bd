"""Operator 2, packing documents into sequences of a fixed number of tokens.

First-fit decreasing with a tournament tree over the bins' free room, run independently in randomised groups of
pieces.  A document's ids are cut at every CAPACITY of them; full pieces fill a sequence each, and the rest are packed.
Only small rows (no text, no ids) are shuffled.  A piece's group comes from a row number, not from its content, so
copies spread evenly; the number of groups follows the input and a group's size does not.

Defined results: a null text counts as empty and gives the end token alone.  Repeated rows are packed each; null
doc_id and extra columns are harmless; an empty table gives an empty table.  Equal lengths are placed by doc_id, start
and row number."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SETTLED, byte_alphabet
from .common import empty_if_null, prepare, stored, tokenizer_path

VOCABULARY, END = "word_bpe_49k.json", 2

#: Tokens in a sequence, and pieces in a group on average.
CAPACITY, GROUP = 4096, 8192

#: Entries of the memo of words on each Python worker, and the longest word it keeps.
MEMO_ENTRIES, MEMO_LENGTH = 600_000, 48

#: Characters of text encoded at once.
WINDOW = 1 << 20

#: The split of the pre-tokenizer and white space as it sees them (fixed values of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, serial long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordCodec:
    """Encodes word by word: nothing in this tokenizer reaches over white space.  Ids are little-endian uint32."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or pattern != PATTERN or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a word-end BPE tokenizer")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = regex.compile(PATTERN).findall
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]))
        self.odd = re.compile("[\x1c-\x1f]")
        self.words = re.compile(f"[^{SPACE}]+")
        self.fast, self.id_of = self._ranked(model)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _ranked(model: dict):
        """A compiled merger over bytes.  The byte FF, which no UTF-8 text holds, ends a word: it joins the byte
        before it first, and so stands for the suffix."""
        import tiktoken

        byte_of = {c: b for b, c in enumerate(byte_alphabet())}

        def raw(token: str) -> bytes:
            stem = token.removesuffix("</w>")
            return bytes(byte_of[c] for c in stem) + b"\xff" * (stem != token)

        ranks = {bytes([b, 0xFF]): b for b in range(0xFF)}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks[raw(a + b)] = 256 + i
        for b in range(256):
            ranks.setdefault(bytes([b]), 256 + len(model["merges"]) + b)
        id_of = {ranks[t]: i.to_bytes(4, "little") for s, i in model["vocab"].items() if (t := raw(s)) in ranks}
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, id_of

    def _word(self, word: str) -> bytes:
        if word.isascii() or max(word) < SETTLED:
            low = word.lower()
            if max(low) < SETTLED:
                parts = [low] if low.isalpha() else self.pieces(low)
                return b"".join(self.id_of[r] for p in parts for r in self.fast(p.encode() + b"\xff"))
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def windows(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text, in order, a window of its words at a time."""
        text = text or ""
        if self.special.search(text):  # added tokens stand before words
            yield np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return
        at = 0
        while at < len(text):
            end = at + WINDOW
            if end < len(text):
                rest = re.compile(f"[{SPACE}]").search(text, end)
                end = rest.start() if rest else len(text)
            part = text[at:end] if at or end < len(text) else text
            at = end
            words = self.words.findall(part) if self.odd.search(part) else part.split()
            memo = self.memo
            new = set(words).difference(memo)
            for w in new:
                memo[w] = self._word(w)
            yield b"".join(map(memo.__getitem__, words))
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
            for w in new:
                if len(w) > MEMO_LENGTH:
                    memo.pop(w, None)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.windows(text)), "<u4").tolist()

    def pieces_of(self, text: str | None, end: int, capacity: int) -> tuple[list[tuple[int, int, int]], int]:
        """(start, length, crc32) of each piece of a text's ids with `end` after them, and their number."""
        found, held, start = [], b"", 0
        for ids in self.windows(text):
            held += ids
            while len(held) >= 4 * capacity:
                found.append((start, capacity, zlib.crc32(held[: 4 * capacity])))
                held, start = held[4 * capacity :], start + capacity
        held += end.to_bytes(4, "little")
        found.append((start, len(held) // 4, zlib.crc32(held)))
        return found, start + len(held) // 4


@cache
def codec(path: str | None) -> WordCodec:
    return WordCodec(path or tokenizer_path(VOCABULARY))


class Tournament:
    """The first of `n` bins with enough room, in a step per level of a tree of maxima."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts size into the first bin that has the room; that bin and its fill before."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        left = room[i]
        bin_, room[i] = i - self.leaves, left - size
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return bin_, left


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; no size may exceed the capacity.  Equal sizes go in the order given."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    tree = Tournament(len(sizes), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_, left = tree.place(sizes[i])
        out[i] = (bin_, capacity - left)
    return out


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document; `serial` numbers them over all tasks."""
    prepare(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        c, serial = codec(path), TaskContext.get().partitionId() << 36
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, total = c.pieces_of(x, end, capacity)
                for start, length, crc in found:
                    rows.append((i, start, length, crc, total, serial))
                    serial += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "serial"])

    return docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), empty_if_null(text).alias("text")).mapInArrow(run, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = 7) -> DataFrame:
    """Sequences of the pieces of `pieces`, which are stored first so that their row numbers hold."""
    cut = stored(cut, "pieces")
    groups = max(1, -(-cut.count() // group))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("serial", "ascending")])
        placed = first_fit_decreasing(table["length"].to_pylist(), capacity)
        base = table["_group"][0].as_py() << 32
        out = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("serial", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, PACKED)


def packed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    return pack(pieces(docs, doc_id, text, path, end, capacity), capacity, group)
