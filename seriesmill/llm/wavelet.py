"""Token ids in shards, each one compressed file that is a wavelet matrix.

Of every id the bits are kept in planes, from the highest to the lowest; after each plane the ids are put in order of its bit, zeros first, otherwise as they were. A directory with the number of ones before each block and compressed blocks of bits give `access` (the id at a place), `count` (of an id before a place) and `locate` (the place of its k-th occurrence) by rank and select on the planes, without the other blocks. `slice` reads all ids of a range of places.

File format, little-endian: magic `WVM1`; unsigned 64-bit number of ids n; unsigned 32-bit number of planes, and of documents; then a compressed block with the documents' ids (64-bit, with a byte each that says null), and one with their lengths (64-bit); then for each plane the number of zeros (64-bit) and for each of its blocks of 65,536 bits the number of ones before it (32-bit) and its offset (64-bit), one more offset than blocks; then the blocks. A block is stored with a byte before it, 1 if it is compressed by zstd, else 0, and its size when unpacked (32-bit).

Null texts count as empty; a document without text has the end id only. Documents of any length are cut over no two shards; a shard ends with the document that brings it to `SHARD_TOKENS`. Repeated rows are kept each; documents without an id come first. An empty table gives no shards. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .word_bpe import KNOWN, word_pieces

BLOCK_BITS = 1 << 16
SHARD_TOKENS = 1 << 21
END_ID = 1
SHARD_SCHEMA = "part int, shard int, first bigint, n_ids bigint, file binary"
SHARD_TYPES = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("file", pa.binary())])


@lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _pack(raw: bytes) -> bytes:
    small = _codec().compress(raw, asbytes=True)
    return struct.pack("<?I", True, len(raw)) + small if len(small) < len(raw) else struct.pack("<?I", False, len(raw)) + raw


def _unpack(raw: bytes) -> bytes:
    packed, size = struct.unpack_from("<?I", raw)
    return _codec().decompress(raw[5:], size, asbytes=True) if packed else bytes(raw[5:])


def write_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard: ids (unsigned) of its documents one after the other."""
    n, planes = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    values = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    names, sizes = _pack(names), _pack(np.array(lengths, "<i8").tobytes())
    out = [b"WVM1", struct.pack("<QII", n, planes, len(doc_ids)), struct.pack("<I", len(names)), names, struct.pack("<I", len(sizes)), sizes]
    heads, bodies, offset = [], [], 0
    for plane in range(planes - 1, -1, -1):
        bits = (values & values.dtype.type(1 << plane)) != 0
        packed = np.packbits(bits, bitorder="little").tobytes()
        before = np.concatenate(([0], np.cumsum([np.count_nonzero(bits[k : k + BLOCK_BITS]) for k in range(0, n, BLOCK_BITS)]))) if n else np.zeros(1, np.int64)
        blocks = [_pack(packed[k : k + BLOCK_BITS // 8]) for k in range(0, len(packed), BLOCK_BITS // 8)]
        offsets = offset + np.concatenate(([0], np.cumsum([len(x) for x in blocks]))).astype("<i8")
        offset = int(offsets[-1])
        heads.append(struct.pack("<Q", n - int(before[-1])) + before[:-1].astype("<u4").tobytes() + offsets.tobytes())
        bodies += blocks
        values = np.concatenate((np.compress(~bits, values), np.compress(bits, values)))
    return b"".join([*out, *heads, *bodies])


class WaveletMatrix:
    """Reads one shard's file."""

    def __init__(self, file: bytes):
        if file[:4] != b"WVM1":
            raise ValueError("not a shard")
        self.n, self.planes, docs = struct.unpack_from("<QII", file, 4)
        at = 20
        parts = []
        for _ in range(2):
            (size,) = struct.unpack_from("<I", file, at)
            parts.append(_unpack(file[at + 4 : at + 4 + size]))
            at += 4 + size
        names, null = np.frombuffer(parts[0], "<i8", docs), parts[0][8 * docs :]
        self.doc_ids = [None if gone else x for x, gone in zip(names.tolist(), null, strict=True)]
        self.lengths = np.frombuffer(parts[1], "<i8")
        blocks = -(-self.n // BLOCK_BITS)
        self.zeros, self.before, self.offsets = [], [], []
        for _ in range(self.planes):
            self.zeros += struct.unpack_from("<Q", file, at)
            self.before.append(np.frombuffer(file, "<u4", blocks, at + 8))
            self.offsets.append(np.frombuffer(file, "<i8", blocks + 1, at + 8 + 4 * blocks))
            at += 8 + 4 * blocks + 8 * (blocks + 1)
        self.file, self.base = memoryview(file), at
        self.cache: dict[tuple[int, int], np.ndarray] = {}

    def block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self.cache:
            if len(self.cache) >= 256:
                self.cache.clear()
            a, b = self.base + int(self.offsets[plane][k]), self.base + int(self.offsets[plane][k + 1])
            bits = np.unpackbits(np.frombuffer(_unpack(self.file[a:b]), np.uint8), bitorder="little")
            self.cache[plane, k] = bits[: self.n - k * BLOCK_BITS]
        return self.cache[plane, k]

    def ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        k, rest = divmod(i, BLOCK_BITS)
        return int(self.before[plane][k]) + int(self.block(plane, k)[:rest].sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit, ones = int(self.block(p, i // BLOCK_BITS)[i % BLOCK_BITS]), self.ones(p, i)
            value, i = value << 1 | bit, self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before a place stand after the last plane."""
        start = 0
        for p in range(self.planes):
            a, b = self.ones(p, start), self.ones(p, end)
            start, end = (self.zeros[p] + a, self.zeros[p] + b) if token >> self.planes - 1 - p & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before a place, the end of the shard where none is given."""
        if token >> self.planes:
            return 0
        start, end = self._range(token, self.n if end is None else end)
        return end - start

    def select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) zero or one of a plane."""
        places = np.arange(len(self.before[plane])) * BLOCK_BITS
        before = self.before[plane] if bit else places - self.before[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self.block(plane, block) == bit)[k - int(before[block])])

    def locate(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        start, end = (0, 0) if token >> self.planes else self._range(token, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> self.planes - 1 - p & 1
            i = self.select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        values = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(_unpack(self.file[self.base + int(a) : self.base + int(b)]) for a, b in zip(self.offsets[p], self.offsets[p][1:], strict=False))
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n].astype(bool)
            back = np.empty_like(values)
            back[~bits], back[bits] = values[: self.zeros[p]], values[self.zeros[p] :] | values.dtype.type(1 << self.planes - 1 - p)
            values = back
        return values

    def slice(self, start: int, end: int) -> list[int]:
        return [self.access(i) for i in range(start, end)]


#: In lower-cased ASCII, pieces that hold no letter or digit, and contractions: these are cut off where they stand, the leftmost first.
CUT_OFF = r"'s|'t|'re|'ve|'m|'ll|'d|[^a-z0-9\t\n\x0b\x0c\r ]+"
#: And single digits, which are pieces too. Whole texts are not cut at these, so a number is one stretch.
CUT_DIGITS = CUT_OFF + "|[0-9]"
LISTS = pa.large_list(pa.large_string())


class Known:
    """Different strings and their ids, as bytes, which `make` gives for those not yet known. Beyond `most` strings or bytes, only the first ones and those just asked for stay."""

    def __init__(self, make, most: int, first: dict[str, bytes], most_bytes: int = 48 << 20):
        self.make, self.most, self.most_bytes, self.first = make, most, most_bytes, len(first)
        self.names, self.ids = pa.array(first.keys(), pa.large_string()), pa.array(first.values(), pa.large_binary())

    def places(self, names: pa.LargeStringArray) -> np.ndarray:
        """Where in `ids` those of each of these different strings stand."""
        places = self._known(names)
        if new := int(np.count_nonzero(places < 0)):
            if len(self.names) + new > self.most or self.names.nbytes + self.ids.nbytes > self.most_bytes:
                stay = np.unique(np.concatenate((np.arange(self.first), places[places >= 0])))
                self.names, self.ids = self.names.take(pa.array(stay)), self.ids.take(pa.array(stay))
                places = self._known(names)
            made = names.filter(pa.array(places < 0))
            places[places < 0] = np.arange(len(self.names), len(self.names) + new)
            self.names, self.ids = pa.concat_arrays([self.names, made]), pa.concat_arrays([self.ids, self.make(made)])
        return places

    def _known(self, names: pa.LargeStringArray) -> np.ndarray:
        """The places of those that are known, else -1. The table that is looked up is made of what is asked for, which mostly is less."""
        found = pc.index_in(self.names, value_set=names).fill_null(-1).to_numpy()
        places, here = np.full(len(names), -1, np.int32), np.flatnonzero(found >= 0)
        places[found[here]] = here
        return places

    def joined(self, lists: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings one after the other, and where those of each list start, with the end."""
        words = lists.flatten().dictionary_encode()
        places = self.places(words.dictionary)
        taken = self.ids.take(pa.array(places[words.indices.to_numpy()]))
        starts = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        return np.frombuffer(_data(taken), "<u4"), (starts[np.asarray(lists.offsets) - lists.offsets[0].as_py()] - starts[0]) // 4


class Encoder:
    """The library's ids of whole texts. Stretches between ASCII white space, which no piece crosses, are encoded once and remembered, and so are the normalised pieces they are cut into; the ids of a batch are then taken from those of its different stretches."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cut = word_pieces(path)
        # The same model for words that are known to be normalised pieces: nothing is left but to cut them apart, and to name their bytes where these are not printable ASCII.
        cut_apart, name_bytes = {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.plain = Tokenizer.from_str(json.dumps(self.cut.config | {"normalizer": None, "pre_tokenizer": cut_apart}))
        self.normal = Tokenizer.from_str(json.dumps(self.cut.config | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [cut_apart, name_bytes]}}))
        vocabulary = self.cut.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces = Known(self.piece_ids, most, {"": b""})
        self.chunks = Known(self.chunk_ids, most, {"": b"", **{s: struct.pack("<I", i) for s, i in self.cut.special.items()}})

    def alone(self, chunks: list[str]) -> pa.LargeBinaryArray:
        return pa.array([np.array(x.ids, "<u4").tobytes() for x in self.cut.library.encode_batch_fast(chunks, add_special_tokens=False)], pa.large_binary())

    def together(self, pieces: list[str]) -> pa.LargeBinaryArray:
        """The ids of normalised pieces: all go to the library in one text, whose ids are cut at the tokens that end a piece."""
        text = " ".join(pieces)
        library = self.plain if text.isascii() and text.isprintable() else self.normal
        flat = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(pieces):
            raise ValueError("ids do not end with the pieces")
        return _binaries(flat, np.concatenate(([0], ends)))

    def piece_ids(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        ascii_ones, out, order = pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False), [], []
        for mask in (ascii_ones, ~ascii_ones):
            order.append(np.flatnonzero(mask))
            wanted = _strings(pieces.filter(pa.array(mask)))
            out += [self.together(wanted[k : k + 1000]) for k in range(0, len(wanted), 1000)]
        return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(order))))

    def chunk_ids(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each stretch: it is cut into normalised pieces, which many share; stretches outside of the blocks for which that is done here go to the library alone."""
        ascii_ones = pc.string_is_ascii(chunks)
        find, normal, inside = self.cut.pattern.findall, self.cut.normal, KNOWN.fullmatch
        others = _strings(chunks.filter(pc.invert(ascii_ones)))
        parts = [find(normal(c)) if inside(c) else None for c in others]
        lone = [c for c, p in zip(others, parts, strict=True) if p is None]
        cut = pa.concat_arrays([pc.ascii_split_whitespace(_spaced(pc.ascii_lower(chunks.filter(ascii_ones)), CUT_DIGITS)).cast(LISTS), pa.array([p for p in parts if p is not None], LISTS)])
        out = [_binaries(*self.pieces.joined(cut))] + [self.alone(lone)] * bool(lone)
        # Of those of `out`: ASCII ones, others in the known blocks, and those encoded alone.
        kind = np.zeros(len(chunks), np.int8)
        kind[~ascii_ones.to_numpy(zero_copy_only=False)] = [2 if p is None else 1 for p in parts]
        return pa.concat_arrays(out).take(pa.array(np.argsort(np.argsort(kind, kind="stable"))))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by end_id if one is given, and the number of ids of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        # Lower-cased and cut beforehand, ASCII texts have fewer different stretches. Special strings are lower-case only, so texts that may hold one stay as they are.
        marked = pc.match_substring(texts, "<|")
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(marked))
        if pc.any(plain).as_py():
            texts = pc.replace_with_mask(texts, plain, _spaced(pc.ascii_lower(texts.filter(plain)), CUT_OFF))
        if pc.any(marked).as_py():
            spaced = [self.cut.special_pattern.sub(r" \1 ", x) for x in texts.filter(marked).to_pylist()]
            texts = pc.replace_with_mask(texts, marked, pa.array(spaced, texts.type))
        ids, starts = self.chunks.joined(pc.ascii_split_whitespace(texts).cast(LISTS))
        lengths = np.diff(starts)
        if end_id is not None:
            ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
        return ids, lengths


def _spaced(texts: pa.LargeStringArray, pattern: str) -> pa.LargeStringArray:
    """Texts with spaces around all matches."""
    return pc.replace_substring_regex(texts, pattern, r" \0 ")


def _strings(values: pa.LargeStringArray) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _binaries(ids: np.ndarray, starts: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of ids between each start and the next."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def _data(values: pa.LargeBinaryArray) -> memoryview:
    """The bytes of all values, one after the other."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(values.buffers()[2] or b"")[offsets[0] : offsets[-1]] if len(values) else memoryview(b"")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _shards(tokenizer: str, end_id: int, each: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        library, part, number, first, total = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, 0
        ids, names, lengths = [], [], []

        def shard() -> pa.RecordBatch:
            row = {"part": part, "shard": number, "first": first, "n_ids": total, "file": write_shard(np.concatenate(ids), names, lengths)}
            return pa.RecordBatch.from_pylist([row], SHARD_TYPES)

        for batch in batches:
            for piece in slices(batch):
                found, sizes = library.encode(piece.column(1), end_id)
                found, ends, done = found.astype(each), np.cumsum(sizes), 0
                for k, (name, size, end) in enumerate(zip(piece.column(0).to_pylist(), sizes.tolist(), ends.tolist(), strict=True)):
                    names.append(name)
                    lengths.append(size)
                    total += size
                    if total >= shard_tokens or k + 1 == len(sizes):
                        ids.append(found[done:end])
                        done = end
                    if total >= shard_tokens:
                        yield shard()
                        ids, names, lengths, total, number, first = [], [], [], 0, number + 1, first + total
        if names:
            yield shard()

    return run


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch of (id, text) in parts of about so many bytes of text, a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def write_token_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts and write them, in ascending order of ids, as shards: a table (part, shard, first, n_ids, file) in which part and shard give the order, and first the number of ids before a shard in its part."""
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    each = "<u4" if word_pieces(tokenizer).library.get_vocab_size() > 1 << 16 else "<u2"
    # Texts are dealt out before they are encoded: finding the ranges reads the rows a first time, which must not encode them twice.
    # Rows of one id are dealt out by their texts too, and equal rows by where they were read, so no id is one task.
    order = [F.col("id"), F.xxhash64("text"), F.spark_partition_id()]
    ordered = source.repartitionByRange(*order).sortWithinPartitions("id", F.xxhash64("text"))
    shards = ordered.mapInArrow(_shards(tokenizer, end_id, each, shard_tokens), SHARD_SCHEMA)
    shards.write.option("compression", "uncompressed").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, start, n_tokens, ids_crc32) of (first, file)."""
    for batch in batches:
        for first, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = WaveletMatrix(file.as_py())
            ids = shard.ids().astype("<u4")
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(first + starts), pa.array(shard.lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def document_digests(shards: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from the shards' files. A part's first place comes from the totals of the parts before it, one row for each."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # As many rows as the writing job had partitions.
    placed = shards.join(F.broadcast(parts), "part").select((F.col("before") + F.col("first")).alias("first"), "file")
    return placed.mapInArrow(_read_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """Rows (part, shard, n) with the occurrences of a token in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [WaveletMatrix(x.as_py()).count(token) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["part", "shard", "n"])

    return shards.select("part", "shard", "file").mapInArrow(run, "part int, shard int, n bigint")


def locate_token(shards: DataFrame, token: int) -> DataFrame:
    """Rows (doc_id, place): every occurrence of a token, by its place in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                shard = WaveletMatrix(x.as_py())
                starts = np.cumsum(shard.lengths) - shard.lengths
                at = np.array([shard.locate(token, k) for k in range(shard.count(token))], np.int64)
                doc = np.searchsorted(starts, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(at - starts[doc])], ["doc_id", "place"])

    return shards.select("file").mapInArrow(run, "doc_id bigint, place bigint")
