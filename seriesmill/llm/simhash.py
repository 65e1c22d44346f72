"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into five segments in a ring. If two fingerprints differ in at most four bits, then from at least one segment on, every chain of consecutive segments differs in no more than its proportional budget: 0 bits in the first, 1 in the first two, 2 in three, 3 in four, 4 in all. Candidates are joined on the chain of two (first segment equal, second with at most one bit changed), cut down by the budgets of longer chains, and then by the full Hamming distance. No candidate is lost, so the links are exact.

Groups of many near copies put many fingerprints under one key. Equal fingerprints count once. Every fingerprint is first compared with one hub of each of its keys only; the components so found are contracted; then only pairs of different components are compared under a key, and those between the key's most frequent component and itself are never made. Links inside a component are not needed to know it, so what is left out changes nothing in the result, and a group costs about its size.

Rows with a null or empty text, or without words, have fingerprint zero. Rows with the same id are each fingerprinted; their component is the smallest id reachable from their own fingerprint. Rows with a null id take part, and are named by no component; a component of only such rows has a null id. An empty table gives an empty result. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, sent_or_sorted
from .components import connected_components

#: Lowest bit and number of bits of each segment.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
MOST_BITS = 4
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes.maketrans(UPPER, UPPER.lower())
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    parts = WORD.findall(text.encode().translate(LOWER))
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        starts = np.concatenate(([0], np.cumsum(lengths)))
        view = memoryview(joined)
        hashes = [xxh64_intdigest(view[a:b], 42) for a, b in zip(starts[:-words].tolist(), (starts[words:] - 1).tolist(), strict=True)]
    total, ones = len(hashes), np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for k in range(0, total, 65536):
        bits = np.unpackbits(values[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fp, row): the 64 bits of each text's fingerprint as a signed long, and a hash of the whole row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x or "", words) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), batch.column(2)], ["id", "fp", "row"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), row_hash(docs).alias("row")).mapInArrow(run, "id bigint, fp bigint, row bigint")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind)


def _ordered(column: Column, kind: T.DataType) -> Column:
    """The column with maps, at any depth, as arrays of their entries in order, so that equal maps hash alike."""
    if not _holds_map(kind):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_ordered(column[f.name], f.dataType).alias(f"f{k}") for k, f in enumerate(kind))))
    entries = F.transform(F.map_entries(column), lambda e: F.struct(_ordered(e["key"], kind.keyType).alias("k"), _ordered(e["value"], kind.valueType).alias("v")))
    return F.array_sort(entries)


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*(_ordered(docs[f"`{f.name}`"], f.dataType) for f in docs.schema))


def _segment(j: int):
    low, bits = SEGMENTS[j % 5]
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))


def _key(j: int, second):
    return F.lit(j << 26).bitwiseOR(F.shiftleft(_segment(j), 13)).bitwiseOR(second)


def _index_keys():
    return F.array(*[_key(j, _segment(j + 1)).cast("bigint") for j in range(5)])


def _probe_keys():
    """Keys of the chains of two that start at each segment, with at most one bit of the second changed."""
    keys = []
    for j in range(5):
        second = _segment(j + 1)
        keys += [_key(j, second.bitwiseXOR(F.lit(flip)) if flip else second).cast("bigint") for flip in [0, *(1 << b for b in range(SEGMENTS[(j + 1) % 5][1]))]]
    return F.array(*keys)


def _linked(x: str, y: str, key: str):
    """Whether the pair under a key keeps the budgets of the chains of three and four from the key's segment on, and then the full distance."""
    different = F.col(x).bitwiseXOR(F.col(y))
    start = F.shiftright(key, 26)
    tests = F.lit(True)
    for length in (3, 4):
        budget = F.lit(None)
        for j in range(5):
            mask = 0
            for k in range(j, j + length):
                low, bits = SEGMENTS[k % 5]
                mask |= ((1 << bits) - 1) << low
            mask = mask - (1 << 64) if mask >> 63 else mask
            budget = F.when(start == j, F.bit_count(different.bitwiseAND(F.lit(mask)))).otherwise(budget)
        tests = tests & (budget <= length * MOST_BITS // 5)
    return tests & (F.bit_count(different) <= MOST_BITS)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Rows (node, component) for each fingerprint (column fp, distinct): component is the smallest fingerprint, as a signed long, reachable."""
    index = distinct.select("fp", F.explode(_index_keys()).alias("key"))
    probe = distinct.select("fp", F.explode(_probe_keys()).alias("key"))
    hubs = index.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n"))
    # Spark takes an exploded table for as small as the table before and would send it whole to the driver, so these joins are asked to sort.
    near = probe.join(hubs.select("key", "hub").hint("merge"), "key").where((F.col("fp") != F.col("hub")) & _linked("fp", "hub", "key"))
    first = materialize(connected_components(near.select("fp", "hub").distinct(), "fp", "hub"), "simhash-hubs")

    named = distinct.join(first, distinct.fp == first.node, "left").select("fp", F.coalesce("component", "fp").alias("comp"))
    named = materialize(named, "simhash-named")
    # The hub of a key has been compared with all that meet it there; what is left are the other members of keys with several.
    others = named.select("fp", "comp", F.explode(_index_keys()).alias("key")).join(hubs.where("n > 1").hint("merge"), "key").where("fp != hub")
    others = materialize(others.select("key", "fp", "comp"), "simhash-others")
    main = others.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    main = materialize(main, "simhash-main")
    members = others.join(main, "key").select("key", (F.col("comp") != F.col("main")).alias("aside"), F.col("fp").alias("y"), F.col("comp").alias("comp_y"))
    seekers = named.select(F.col("fp").alias("x"), F.col("comp").alias("comp_x"), F.explode(_probe_keys()).alias("key")).join(sent_or_sorted(main), "key")
    # Those of the main component seek only members aside of it, all others seek all members.
    sides = F.when(F.col("comp_x") == F.col("main"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    seekers = seekers.select("key", "x", "comp_x", F.explode(sides).alias("aside"))
    more = seekers.join(members, ["key", "aside"]).where((F.col("comp_x") != F.col("comp_y")) & _linked("x", "y", "key"))
    edges = more.select(F.col("comp_x").alias("a"), F.col("comp_y").alias("b")).distinct()
    second = connected_components(edges)
    joined = named.join(second, named.comp == second.node, "left").select(F.col("fp").alias("node"), F.coalesce("component", "comp").alias("component"))
    return materialize(joined, "simhash-components")


def near_duplicates(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fp, row, component, component_id): component_id is the smallest id reachable over links, itself included, component the smallest fingerprint as a signed long; row is a hash of the whole row."""
    prints = materialize(fingerprints(docs, words, id_column, text_column), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    links = link_fingerprints(distinct.select("fp"))
    classes = distinct.join(links, distinct.fp == links.node).select("fp", "least", "component")
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp").select("id", "fp", "row", "component", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, one of each group: a row with the smallest id of it. Of several rows with that id in the group, the one with the least fingerprint and hash of the row stays, once; a row of the same id in another group is judged there. Rows without an id all stay."""
    found = near_duplicates(docs, words, id_column, text_column)
    kept = found.where("id = component_id").groupBy("id", "component").agg(F.min(F.struct("fp", "row")).alias("m"))
    kept = materialize(kept.select(F.col("id").alias("__kept_id"), F.col("m.row").alias("__kept_row")), "simhash-kept")
    rows = docs.withColumn("__kept_id", docs[id_column].cast("bigint")).withColumn("__kept_row", row_hash(docs))
    with_id = rows.join(kept, ["__kept_id", "__kept_row"], "left_semi").dropDuplicates(["__kept_id", "__kept_row"])
    return with_id.unionByName(rows.where("__kept_id is null")).select(*(f"`{c}`" for c in docs.columns))
