"""Compressed vectors: each is cut into parts, and a part is written as the number of its codebook's nearest entry, found by Orchard search.

Components become whole numbers, floor(SCALE * x), so all sums and distances are exact and do not depend on the order of rows. A part's codebook starts from the rows with the smallest ids. In each round every part goes to its nearest entry (squared distance, ties to the lower number) and each entry becomes the floored mean of its parts; an entry without parts stays. Rounds are jobs over a table of whole numbers in the shared folder; a task puts out one row of sums for each part and entry at most, and only the codebooks (entries times components) meet in the driver.

Orchard search: every entry has a list of the others, sorted by their distance from it. A search starts at an entry, walks its list and computes the distance of entries that it has not marked as visited; where one is nearer, it goes on with that entry's list. By the triangle inequality nothing beyond twice the current distance can be as near, so there it ends. All rows of a batch search at once.

Vectors that are null, or hold null or non-finite components, are dropped. The number of components is that of the row with the smallest id whose number the parts divide; rows with another one, or with components so large that sums of squares leave 64 bits, stay with a null code and error. Rows without an id are encoded but start no entry. Of fewer rows than entries, each starts one; repeated rows are rows like others and, with one id, start entries in a fixed order. An empty table gives an empty result. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import sent_if_small
from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The square of the largest component, times the number of components, stays below this: then four times a squared distance fits in 64 bits.
LARGEST = 1 << 56


def whole_numbers(column: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each list, None where it is null or holds a null or non-finite component."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = np.concatenate(([0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * scale)
    null = column.is_null().to_numpy(zero_copy_only=False)
    good = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    return [None if null[k] or good[b] > good[a] else scaled[a:b] for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))]


class Book:
    """The codebook of one part: entries as rows of whole numbers, and each one's list of the others."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = entries[:, None, :] - entries[None, :, :]
        self.apart = (gap * gap).sum(axis=2)
        n = len(entries)
        order = np.argsort(self.apart + np.where(np.eye(n, dtype=bool), np.iinfo(np.int64).min // 2, 0), axis=1, kind="stable")
        self.lists = order[:, 1:]
        self.by_first = np.argsort(entries[:, 0], kind="stable")
        self.first = entries[self.by_first, 0]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each part's nearest entry and its squared distance."""
        n, size = len(parts), len(self.entries)
        now = self.by_first[np.minimum(np.searchsorted(self.first, parts[:, 0]), size - 1)]
        gap = parts - self.entries[now]
        best = (gap * gap).sum(axis=1)
        visited = np.zeros((n, size), bool)
        visited[np.arange(n), now] = True
        at, rows = np.zeros(n, np.int64), np.arange(n if size > 1 else 0)
        while len(rows):
            other = self.lists[now[rows], at[rows]]
            go = self.apart[now[rows], other] <= 4 * best[rows]  # beyond twice the distance nothing is as near
            rows, other = rows[go], other[go]
            at[rows] += 1
            new = ~visited[rows, other]
            seen, met = rows[new], other[new]
            visited[seen, met] = True
            gap = parts[seen] - self.entries[met]
            reach = (gap * gap).sum(axis=1)
            better = (reach < best[seen]) | ((reach == best[seen]) & (met < now[seen]))
            moved = seen[better]
            now[moved], best[moved], at[moved] = met[better], reach[better], 0
            rows = rows[at[rows] < size - 1]
        return now, best


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def _kept(parts: int):
    """Rows (id, label, size, vec) of (id, label, embedding) that are not dropped; vec is null where components are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = whole_numbers(batch.column(2), SCALE)
            keep = [k for k, v in enumerate(found) if v is not None]
            fits = [len(found[k]) and len(found[k]) % parts == 0 and np.abs(found[k]).max() < (LARGEST / len(found[k])) ** 0.5 for k in keep]
            vec = pa.array([found[k].astype("<i8").tobytes() if ok else None for k, ok in zip(keep, fits, strict=True)], pa.binary())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), vec], ["id", "label", "vec"])

    return run


def _sums(books: list[np.ndarray]):
    """Rows (part, entry, at, total): of the parts that go to each entry, the sum of each component, and at -1 their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Book(b) for b in books]
        width = books[0].shape[1]
        totals = np.zeros((len(books), len(books[0]), width + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            for k, book in enumerate(made):
                part = x[:, k * width : (k + 1) * width]
                entry, _ = book.nearest(part)
                np.add.at(totals[k, :, :width], entry, part)
                totals[k, :, width] += np.bincount(entry, minlength=len(book.entries))
        part, entry, at = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part.astype(np.int32), entry.astype(np.int32), np.where(at == width, -1, at).astype(np.int32), totals[part, entry, at])], ["part", "entry", "at", "total"])

    return run


def _codes(books: list[np.ndarray], length: int):
    """Rows (id, label, code, error) of (id, label, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, width = [Book(b) for b in books], books[0].shape[1]
        for batch in batches:
            fit = [k for k, v in enumerate(batch.column(2).to_pylist()) if v is not None and len(v) == 8 * length]
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if fit:
                x = _matrix(batch.column(2).take(pa.array(fit, pa.int64())))
                found = [book.nearest(x[:, k * width : (k + 1) * width]) for k, book in enumerate(made)]
                entries, total = np.stack([e for e, _ in found], axis=1).astype(np.uint8), sum(d for _, d in found)
                for k, code, error in zip(fit, entries, total.tolist(), strict=True):
                    codes[k], errors[k] = code.tobytes().hex(), error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return run


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, code, error) and the codebooks. A code has two hexadecimal digits for each part, so at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    ids, labels = (vectors.schema[c].dataType.simpleString() for c in (id_column, label_column))
    source = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("embedding"))
    rows = materialize(source.mapInArrow(_kept(parts), f"id {ids}, label {labels}, vec binary"), "vector-numbers")
    named = rows.where("id is not null and vec is not null").select("id", "vec")
    first = named.orderBy("id", F.hex("vec")).limit(1).collect()
    if not first:
        return rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), []
    length = len(first[0].vec) // 8
    fit = rows.where(F.octet_length("vec") == 8 * length).select("id", "vec")
    whole = np.stack([np.frombuffer(r.vec, "<i8") for r in fit.where("id is not null").orderBy("id", F.hex("vec")).limit(entries).collect()])
    width = length // parts
    books = [whole[:, k * width : (k + 1) * width].copy() for k in range(parts)]
    for _ in range(rounds):
        found = fit.select("vec").mapInArrow(_sums(books), "part int, entry int, at int, total bigint").groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).toArrow()
        part, entry, at, total = (found.column(k).to_numpy() for k in range(4))
        sums = np.zeros((parts, len(whole), width + 1), np.int64)
        sums[part, entry, at] = total  # at -1 is the last place
        for k, book in enumerate(books):
            used = sums[k, :, width] > 0
            book[used] = sums[k, used, :width] // sums[k, used, width:]
    return rows.mapInArrow(_codes(books, length), f"id {ids}, label {labels}, code string, error bigint"), books


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for, in components of the vectors encoded."""
    return np.concatenate([book[int(code[2 * k : 2 * k + 2], 16)] for k, book in enumerate(books)]) / SCALE


def described(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256): label_error is the sum of the errors of all rows of the label, rows without one together."""
    codes = materialize(codes, "vector-codes")
    sums = sent_if_small(codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB, a table of codes and one of codebooks for each round."""
    steps = [
        f"""v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT vec_id, k AS part, e[k * (len(e) // {parts}) + 1 : (k + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) r(k))",
        f"h AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries})",
        "b0 AS (SELECT part, entry, x AS c FROM p JOIN h USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT vec_id, part, any_value(x) AS x, min((d, entry)) AS m FROM (
            SELECT vec_id, part, x, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM p JOIN b{k} USING (part)) GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, list(f ORDER BY i) AS c FROM (
                SELECT part, entry, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS f FROM (
                SELECT part, m[2] AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 1000) r(i) WHERE i <= len(x) GROUP BY 1, 2, 3)) GROUP BY 1, 2) n USING (part, entry))""")
    return f"""WITH {", ".join(x.replace("AS (", "AS MATERIALIZED (", 1) for x in steps)},
    c AS (SELECT vec_id, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
    s AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS y, unnest(range(len(c))) AS i FROM b{rounds}))
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (vec_id), s"""
