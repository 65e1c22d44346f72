"""Byte-level BPE encoding in linear time, and decoding.

Each piece is cut into tokens by backtracking from the longest match: an automaton over all tokens, with bytes as Latin-1 characters, gives the longest token at each place; a token is taken only if it is compatible with the one before, which means that the merges would not join the two any further; where no token fits, the one before is given up for its next shorter prefix. That is the sequence that the merges give. Compatibility of two adjacent tokens is found once and remembered.

Null texts count as empty, which encodes to no ids. Pieces and words of any length are encoded whole. Repeated rows give repeated results and an empty table none. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str | None = None) -> ByteBpe:
    """The encoder of a file of ranks; texts are cut by the public tokenizers' pattern if none is given."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return ByteBpe(path, pattern)


@lru_cache(maxsize=8)
def engine_class(pattern: str) -> str:
    """The inside of a regular expression's class with every code point that the tiktoken library's engine finds by a pattern. Its properties of characters are those of another version of Unicode than Python's."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    ranges: list[list[int]] = []
    for code in sorted(map(ord, bytes(probe.encode_ordinary(every)).decode())):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in ranges)


def plain_pattern(pattern: str) -> str:
    r"""A pattern with \p{L}, \p{N}, \s and \S written out, for Python's re."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern):
        if part.startswith("\\p") or part in (r"\s", r"\S"):
            members, outside = engine_class(part.lower() if part == r"\S" else part), "^" if part == r"\S" else ""
            out.append(members if inside else f"[{outside}{members}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


class ByteBpe:
    """Encoder and decoder for a file of ranks, for texts that a pattern cuts into contractions, words, numbers, other runs and white space."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.raw = [b""] * (max(self.tokens) + 1)
        for rank, token in self.tokens.items():
            self.raw[rank] = token.encode("latin-1")
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, (len(token), rank))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pattern = re.compile(plain_pattern(pattern))
        self.piece_ids = Memo(self._piece_ids, 300_000)
        self.word_ids = Memo(self._word_ids, 300_000)

    def merged(self, token: str) -> list[str]:
        """Plain merging of a short string: always the adjacent pair that makes the lowest rank, from the left."""
        parts = list(token)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            if len(parts) == 2:
                return [token]
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def split(self, token: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a token joins; None if it is one byte or its merges never make it."""
        if token not in self.halves:
            parts, ranks = list(token), self.ranks
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                if parts[best] + parts[best + 1] not in ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def makes_itself(self, token: str) -> bool:
        return len(token) == 1 or self.split(token) is not None

    def goes_with(self, left: str, right: str) -> bool:
        """Whether the merges of both together leave them apart: looks back from the later made of the two to the parts at their common edge."""
        if not (self.makes_itself(left) and self.makes_itself(right)):
            return False
        ranks, limit, a, b = self.ranks, 1 << 60, left, right
        while True:
            if ranks.get(a + b, 1 << 60) < limit:
                return False
            rank_a, rank_b = (ranks[a] if len(a) > 1 else -1), (ranks[b] if len(b) > 1 else -1)
            if rank_a > rank_b:
                limit, a = rank_a, self.split(a)[1]
            elif rank_b >= 0:
                limit, b = rank_b + 1, self.split(b)[0]
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        key = left, right
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > 600_000:
                self.compatible.clear()
            known = self.compatible[key] = self.goes_with(self.tokens[left], self.tokens[right])
        return known

    def backtrack(self, piece: str) -> list[int]:
        """The ids of a piece of bytes (as Latin-1)."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, ranks = len(piece), self.ranks
        longest = [0] * n
        for end, (length, _) in self.automaton.iter(piece):
            if length > longest[start := end - length + 1]:
                longest[start] = length
        ids: list[int] = []
        lengths: list[int] = []
        dead = bytearray(n + 1)
        at, length = 0, longest[0]
        while at < n:
            token = None
            while length:
                if (token := ranks.get(piece[at : at + length])) is not None and not dead[at + length] and (self.fits(ids[-1], token) if ids else self.makes_itself(piece[:length])):
                    break
                token, length = None, length - 1
            if token is not None:
                ids.append(token)
                lengths.append(length)
                at += length
                length = longest[at] if at < n else 0
            else:
                dead[at] = 1
                ids.pop()
                length = lengths.pop()
                at -= length
                length -= 1
        return ids

    def _piece_ids(self, piece: str) -> bytes:
        return np.array(self.backtrack(piece.encode().decode("latin-1")), "<u4").tobytes()

    def _word_ids(self, word: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.pattern.findall(word)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = text.split(" ")
        # No piece goes beyond a single space between two other characters, and the space belongs to what follows it.
        if "" in words or any(w[0].isspace() or w[-1].isspace() for w in words):
            return b"".join(map(self.piece_ids.__getitem__, self.pattern.findall(text)))
        first = self.word_ids[words[0]]
        return first + b"".join(map(self.word_ids.__getitem__, [" " + w for w in words[1:]]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, ids): the ids of each text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in batches:
            ids = pa.array([bpe.encode(x or "") for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    ids = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id {ids}, ids binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, ranks: str, ids_column: str = "ids") -> DataFrame:
    """The rows with a column `decoded`: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_column)).to_pylist()
            decoded = pa.array([None if x is None else bpe.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in batches:
            ids = [bpe.encode(x or "") for x in batch.column(1).to_pylist()]
            columns = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ids = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id {ids}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
