"""Hard negatives: for each anchor and each of its positives, the best rows of other labels that score almost as much as the positive, by Kronecker-packed products.

Components become whole numbers, floor(SCALE * x), and a score is a whole inner product, so results are exact. The components of several candidates at one place, raised by a bias so that none is negative, are written into separated fields of one wide integer; so many candidates are one integer for each place. An anchor's components, biased too, multiply these integers, one multiplication each; the sum has every candidate's inner product in its field, as fields are wide enough for the largest. The bias is then taken away again: (a + A)(c + C) = ac + C a + A c + AC.

The anchors are a stated set of queries against all rows. Both are dealt out into blocks; each pair of a block of anchors and a block of candidates is a group of its own, of bounded size whatever the labels. Groups of one block of anchors that meet in a task keep only the best few for each anchor, so what is shuffled to merge is a few rows for each anchor and task. A first pass looks at rows of the anchor's own label only and finds the positives; a second one, knowing their scores, at rows of other labels.

Rows without an id or a label, and those whose vector is null or holds null or non-finite components, take no part; nor do those whose inner products could leave 64 bits. Rows meet rows with as many components only; empty vectors score 0. Of several rows of one id the one with the least label, then the least vector, takes part, so repeated rows count once. An empty table, or one without anchors, gives an empty result. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vector_codes import whole_numbers

SCALE = 256
#: Anchors and candidates of a block.
ANCHORS, CANDIDATES = 16384, 16384
ROW = "id bigint, label bigint, vec binary"


class Packed:
    """Candidates as one wide integer for each place of their vectors; a field has so many bytes."""

    def __init__(self, rows: np.ndarray, bias: int, field: int):
        self.n, self.bias, self.field = len(rows), bias, field
        self.sums = rows.sum(axis=1)
        raised = (rows + bias).astype("<u4" if field == 4 else "<u8")
        columns = (raised[:, k].tobytes() for k in range(rows.shape[1]))
        if field > 8:
            columns = (b"".join(x[k : k + 8].ljust(field, b"\0") for k in range(0, len(x), 8)) for x in columns)
        self.wide = [int.from_bytes(x, "little") for x in columns]

    def products(self, anchor: np.ndarray, bias: int) -> np.ndarray:
        """The inner product of the anchor with every candidate."""
        total = 0
        for a, wide in zip((anchor + bias).tolist(), self.wide, strict=True):
            total += a * wide
        raw = total.to_bytes(self.n * self.field, "little")
        if self.field == 4:
            fields = np.frombuffer(raw, "<u4").astype(np.int64)
        else:  # only the lowest 64 bits matter, as the result has no more
            fields = np.frombuffer(raw, "u1").reshape(self.n, self.field)[:, :8].copy().view("<i8")[:, 0]
        constant = self.bias * (int(anchor.sum()) + bias * len(anchor)) & (1 << 64) - 1
        return fields - bias * self.sums - np.array([constant], np.uint64).view(np.int64)


def scores(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[np.ndarray]:
    """The inner products of each anchor with all candidates, which are packed once."""
    if not anchors.shape[1] or not len(anchors) or not len(candidates):
        yield from np.zeros((len(anchors), len(candidates)), np.int64)
        return
    high = max(0, -int(anchors.min())), max(0, -int(candidates.min()))
    largest = (int(anchors.max()) + high[0]) * (int(candidates.max()) + high[1]) * anchors.shape[1]
    size = (max(largest, int(candidates.max()) + high[1]).bit_length() + 7) // 8
    packed = Packed(candidates, high[1], 4 if size <= 4 else max(8, size))
    for a in anchors:
        yield packed.products(a, high[0])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vec) of those that take part."""
    for batch in batches:
        found = whole_numbers(batch.column(2), SCALE)
        keep = [k for k, v in enumerate(found) if v is not None and (v * v).sum() < 2.0**62]
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([found[k].astype("<i4").tobytes() for k in keep], pa.binary())], ["id", "label", "vec"])


class Best:
    """The best (score, id) of each slot: higher scores first, ties by smaller ids."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def add(self, slot, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        if len(ids) > 4 * self.most:
            cut = np.partition(score, len(score) - self.most)[-self.most]
            near = score >= cut
            score, ids = score[near], ids[near]
        held = self.held.get(slot)
        if held is not None:
            score, ids = np.concatenate((held[0], score)), np.concatenate((held[1], ids))
        order = np.lexsort((ids, -score))[: self.most]
        self.held[slot] = score[order], ids[order]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The block of anchors and the rows of each group (block, chunk), of rows sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        block, chunk = rest.column("block").to_numpy(), rest.column("chunk").to_numpy()
        ends = (np.flatnonzero((block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            yield int(block[a]), rest.slice(a, b - a)
        rest = rest.slice(ends[-1]) if ends else rest
    if rest is not None and rest.num_rows:
        yield int(rest.column("block")[0].as_py()), rest


def _sides(group: pa.Table) -> Iterator[tuple]:
    """(anchor ids, labels, limits, vectors; candidate ids, labels, vectors) of each number of components in a group."""
    size = pc.binary_length(group.column("vec")).to_numpy()
    side = group.column("side").to_numpy()
    for n in np.unique(size[side == 0]).tolist():
        made = []
        for k in (0, 1):
            rows = group.take(pa.array(np.flatnonzero((size == n) & (side == k))))
            vec = np.frombuffer(b"".join(rows.column("vec").to_pylist()), "<i4").reshape(rows.num_rows, n // 4).astype(np.int64)
            made += [rows.column("id").to_numpy(), rows.column("label").to_numpy(), vec] + ([rows.column("limits").to_pylist()] if k == 0 else [])
        yield made


def _positives(most: int):
    """Rows (anchor, score, other): for each anchor the best rows of its label but itself, of what this task has."""

    def out(best: Best) -> pa.RecordBatch:
        flat = [(a, int(s), int(i)) for a, (score, ids) in best.held.items() for s, i in zip(score, ids, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], pa.int64()) for k in range(3)], ["anchor", "score", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = Best(most), None
        for block, group in _by_group(batches):
            if now is not None and block != now:
                yield out(best)
                best = Best(most)
            now = block
            for ids, labels, vec, _, other, other_labels, other_vec in _sides(group):
                for label in np.unique(labels).tolist():
                    mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(other_labels == label)
                    made = scores(vec[mine], other_vec[theirs])
                    for a, row in zip(ids[mine].tolist(), made, strict=True):
                        fine = other[theirs] != a
                        best.add(a, row[fine], other[theirs][fine])
        if best.held:
            yield out(best)

    return run


def _negatives(most: int, low: int):
    """Rows (anchor, limit, score, other): for each anchor and positive score the best rows of other labels that score at most as much and at least low hundredths of it."""

    def out(best: Best) -> pa.RecordBatch:
        flat = [(a, limit, int(s), int(i)) for (a, limit), (score, ids) in best.held.items() for s, i in zip(score, ids, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], pa.int64()) for k in range(4)], ["anchor", "limit", "score", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now = Best(most), None
        for block, group in _by_group(batches):
            if now is not None and block != now:
                yield out(best)
                best = Best(most)
            now = block
            for ids, labels, vec, limits, other, other_labels, other_vec in _sides(group):
                made = scores(vec, other_vec)
                for a, label, limit, row in zip(ids.tolist(), labels.tolist(), limits, made, strict=True):
                    least = min(-(-low * x // 100) for x in limit)
                    fine = np.flatnonzero((row >= least) & (row <= max(limit)) & (other_labels != label))
                    score, others = row[fine], other[fine]
                    for x in set(limit):
                        within = (score >= -(-low * x // 100)) & (score <= x)
                        best.add((a, x), score[within], others[within])
        if best.held:
            yield out(best)

    return run


def _dealt(rows: DataFrame, anchors: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Rows (block, chunk, side, id, label, limits, vec): each anchor in its block once for each chunk of candidates, and each candidate in its chunk once for each block."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, blocks = max(-(-n_rows // CANDIDATES), least), -(-n_anchors // ANCHORS)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(own(blocks).alias("block"), each(chunks).alias("chunk"), F.lit(0).alias("side"), "id", "label", "limits", "vec")
    right = rows.select(each(blocks).alias("block"), own(chunks).alias("chunk"), F.lit(1).alias("side"), "id", "label", F.lit(None).cast("array<bigint>").alias("limits"), "vec")
    return left.union(right).repartition("block", "chunk").sortWithinPartitions("block", "chunk")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | Column = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). is_anchor is a condition on the column id; label_column may be an expression."""
    label = F.col(label_column) if isinstance(label_column, str) else label_column
    source = vectors.select(F.col(id_column).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_column).cast("array<double>").alias("embedding")).where("id is not null and label is not null and embedding is not null")
    parts = source.mapInArrow(_numbers, ROW)
    rows = materialize(parts.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.*"), "negative-rows")
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return rows.select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score")).where("false")

    dealt = _dealt(rows, anchors.withColumn("limits", F.lit(None).cast("array<bigint>")), n_anchors, n_rows)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    near = dealt.mapInArrow(_positives(positives), "anchor bigint, score bigint, other bigint").withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    near = materialize(near.select("anchor", F.col("score").alias("limit"), F.col("other").alias("positive_id")), "positives")

    limits = near.groupBy("anchor").agg(F.collect_set("limit").alias("limits"))
    dealt = _dealt(rows, anchors.join(limits, F.col("id") == F.col("anchor")), n_anchors, n_rows)
    order = Window.partitionBy("anchor", "limit").orderBy(F.desc("score"), "other")
    hard = dealt.mapInArrow(_negatives(negatives, low), "anchor bigint, limit bigint, score bigint, other bigint").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    joined = near.join(hard, ["anchor", "limit"])
    return joined.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), F.col("limit").alias("positive_score"), F.col("score").alias("negative_score"))


#: The driver's table: some labels are changed first, every hundredth row is an anchor.
ORACLE_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS e FROM embeddings
WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""
