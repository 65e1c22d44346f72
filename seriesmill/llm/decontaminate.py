"""Benchmark decontamination: containment search with MinHash sketches whose size follows the item's.

Texts are lower-cased (A-Z) words between white space; shingles are five words, each counted once. An item leaks into a document that holds at least 0.8 of the item's shingles. Items are partitioned by size, from one power of 1.5 to the next, and each partition has one MinHash sketch size, made for its largest items: the k smallest hashes of an item's shingles, k = floor(0.2 m) + 1 + `SPARE` for items of up to m shingles (all of a smaller item's). An item of n shingles that leaks misses at most floor(0.2 n) of them, so at least k - floor(0.2 n) of its sketch are in the document: that is what a candidate must hold, and no leak is lost, however long the document is. Partitions whose smallest item needs more shingles than a document has are left out for that document. Candidates are verified on the shingles themselves, not their hashes.

Items of fewer than five words have one shingle, the whole sequence. Items without words leak nowhere. Null texts count as empty. Repeated document rows are each searched; repeated rows of one item id with the same text give one pair, with different texts each is an item of its own and the largest containment counts. Rows with null ids are searched too. Empty tables give empty results. Only the named columns are read, so further columns may have any name.

Items come in blocks of bounded size (`BLOCK_SHINGLES`, or one longer item), each sent to all executors; a larger item table makes more passes over the documents, never a larger block, and what a pass finds is written before the next block is made.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, materialize

WORDS = 5
CONTAINMENT = 0.8
#: Hashes of a sketch beyond the least number; so many more of them must a document hold.
SPARE = 2
#: Shingles of the items that are sent to the executors at once; some 100 bytes each.
BLOCK_SHINGLES = 500_000
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Odd multipliers by which the hash of a shingle depends on the places of its words (fixed values).
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_list(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def shingle_set(words: list[str]) -> set[str]:
    if len(words) < WORDS:
        return {" ".join(words)} if words else set()
    return {" ".join(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)}


def least_shared(n: int) -> int:
    """Shingles of n that a document must hold."""
    return -(-n * 4 // 5)


class WordHashes(Memo):
    def __init__(self):
        from xxhash import xxh3_64_intdigest

        super().__init__(xxh3_64_intdigest)

    def shingles(self, words: list[str], n: int) -> np.ndarray:
        """A hash for each run of n words."""
        if len(words) < n:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out += hashes[k : len(hashes) - n + 1 + k] * WEIGHTS[k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def size_class(n: int) -> int:
    """The partition of an item of n shingles."""
    k = 0
    while most_in(k) < n:
        k += 1
    return k


def most_in(size: int) -> int:
    """Shingles of the largest items of a partition."""
    return int(1.5**size)


class Partition:
    """The sketches of items of one width of shingles and one class of sizes."""

    def __init__(self, size: int):
        self.size, self.least, self.hits, self.needs = size, most_in(size), defaultdict(list), {}

    def add(self, item: int, found: np.ndarray) -> None:
        sketch = found[: most_in(self.size) - least_shared(most_in(self.size)) + 1 + SPARE]
        self.least, self.needs[item] = min(self.least, least_shared(len(found))), len(sketch) - (len(found) - least_shared(len(found)))
        for h in sketch.tolist():
            self.hits[h].append(item)

    def candidates(self, own: list[int]) -> Iterator[int]:
        """Items with as many sketch hashes among a document's as they need."""
        counts = Counter(item for h in own for item in self.hits.get(h, ()))
        return (item for item, n in counts.items() if n >= self.needs[item])


class Sketches:
    """The sketches of one block of items, for a search in documents."""

    def __init__(self, items: list[tuple[int | None, str]]):
        hashes, parts = WordHashes(), {}
        self.items, self.partitions = [], defaultdict(list)
        for item_id, text in items:
            words = word_list(text)
            if not words:
                continue
            n = min(len(words), WORDS)
            found = np.unique(hashes.shingles(words, n))
            key = n, size_class(len(found))
            if key not in parts:
                self.partitions[n].append(parts.setdefault(key, Partition(key[1])))
            parts[key].add(len(self.items), found)
            self.items.append((item_id, shingle_set(words)))
        self.sorted, self.seen = {}, {}
        for n, partitions in self.partitions.items():
            self.sorted[n] = np.array(sorted({h for p in partitions for h in p.hits}), np.uint64)
            self.seen[n] = np.zeros(1 << 20, bool)
            self.seen[n][(self.sorted[n] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def search(self, text: str, hashes: WordHashes) -> list[tuple[int | None, int, int]]:
        """(item id, shingles shared, shingles of the item) of each item that leaks into the text."""
        words, candidates = word_list(text), set()
        for n, known in self.sorted.items():
            own = hashes.shingles(words, n)
            most = len(own)
            own = own[self.seen[n][(own & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            if len(own):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                own = np.unique(own[known[at] == own]).tolist()
                for part in self.partitions[n] if own else ():
                    if part.least <= most:
                        candidates.update(part.candidates(own))
        if not candidates:
            return []
        full, joined = shingle_set(words), " " + " ".join(words) + " "
        out = []
        for k in sorted(candidates):
            item_id, shingles = self.items[k]
            shared = len(shingles & full)
            if len(shingles) == 1 and not shared:  # a short item within a longer run of words
                shared = int(f" {next(iter(shingles))} " in joined)
            if shared >= least_shared(len(shingles)):
                out.append((item_id, shared, len(shingles)))
        return out


def item_blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator:
    """The number of blocks, then the items in blocks of bounded size, in order of a hash; one block is in the driver at a time."""
    table = items.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).distinct()
    sized = table.withColumn("size", F.size(F.split(F.trim("text"), "[\\x20\\x09-\\x0D]+")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    yield blocks
    for k in range(blocks):
        yield [(r.id, r.text) for r in sized.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).select("id", "text").toLocalIterator()]


def find_leaks(docs: DataFrame, items: DataFrame, doc_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_item, containment) for each item that leaks into a document."""
    parts = None
    source = docs.select(F.col(doc_column).alias("id"), F.col(text_column).alias("text"))
    blocks = item_blocks(items, item_column, text_column)
    several = next(blocks) > 1
    for block in blocks:
        part = source.mapInArrow(_search_with(Sketches(block)), "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint")
        part = materialize(part, "leaks") if several else part
        parts = part if parts is None else parts.union(part)
    best = parts.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", "m.containment")


def _search_with(sketches: Sketches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [(d, *x) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for x in sketches.search(text, hashes)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shared", "n_item"])

    return run


def without_leaks(docs: DataFrame, items: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, into which no item leaks. Each document is judged where it lies, so nothing is shuffled."""
    blocks = item_blocks(items, item_column, text_column)
    several = next(blocks) > 1
    for block in blocks:
        sketches = Sketches(block)
        at = docs.columns.index(text_column)

        def run(batches: Iterator[pa.RecordBatch], sketches=sketches, at=at) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                clean = [not (x and sketches.search(x, hashes)) for x in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = materialize(docs, "without-leaks") if several else docs
    return docs


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
s AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*)::DOUBLE / any_value(n_item) AS containment
FROM ds JOIN s USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 5 >= any_value(n_item) * 4
"""

