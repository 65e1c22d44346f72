import numpy as np
import pytest

from seriesmill.llm.vector_codes import Book, books_digest, decode, described, encode_vectors


@pytest.mark.parametrize("size", [1, 2, 16, 200])
def test_orchard_search_equals_comparing_all(size):
    rng = np.random.default_rng(size)
    for span in (2, 40, 100_000):
        entries, parts = rng.integers(-span, span, (size, 4)), rng.integers(-span, span, (500, 4))
        entry, far = Book(entries).nearest(parts)
        all_ = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert np.array_equal(entry, all_.argmin(axis=1)) and np.array_equal(far, all_.min(axis=1))


def plain(rows, parts, entries, rounds):
    """Codes, errors and codebooks of (id, vector) rows, all of one length."""
    whole = {i: np.array([int(np.floor(4096 * x)) for x in v], object) for i, v in rows}
    width = len(next(iter(whole.values()))) // parts
    cut = {i: [v[k * width : (k + 1) * width] for k in range(parts)] for i, v in whole.items()}
    books = [[cut[i][k] for i in sorted(whole)[:entries]] for k in range(parts)]
    near = lambda k, x: min((sum((x - e) ** 2), n) for n, e in enumerate(books[k]))
    for _ in range(rounds):
        for k in range(parts):
            to = {}
            for i in cut:
                to.setdefault(near(k, cut[i][k])[1], []).append(cut[i][k])
            books[k] = [np.array([int(s) // len(to[n]) for s in sum(to[n])], object) if n in to else e for n, e in enumerate(books[k])]
    found = {i: [near(k, x) for k, x in enumerate(v)] for i, v in cut.items()}
    return {i: ("".join(f"{n:02x}" for _, n in v), sum(d for d, _ in v)) for i, v in found.items()}, [np.array(b, np.int64) for b in books]


@pytest.mark.parametrize("n", [3, 16, 90])
def test_codes_equal_plain_k_means(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, rng.normal(size=6).round(1).tolist(), k % 3 or None) for k in range(n)]
    df = spark.createDataFrame([(k, v, lab, "x", 1) for k, v, lab in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    codes, books = encode_vectors(df, parts=3, entries=8, rounds=3)
    want, own = plain([(k, v) for k, v, _ in rows], 3, 8, 3)
    got = {r.id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in described(codes, books).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and all(np.array_equal(a, b) for a, b in zip(books, own, strict=True))
    for k, _, lab in rows:
        assert got[k][2] == sum(want[i][1] for i, _, other in rows if other == lab) and got[k][3] == books_digest(own)
    assert all(((decode(got[k][0], books) * 4096 - np.floor(4096 * np.array(v))) ** 2).sum() == got[k][1] for k, v, _ in rows)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [], 1), (6, [1.0], 1), (7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (None, [1.5, 2.0], None), (8, [1e300, 0.0], 2), (9, [0.0, 0.0, 0.0, 0.0], 2)]
    codes, books = encode_vectors(spark.createDataFrame(rows, schema), parts=2, entries=4)
    got = [(r.id, r.code, r.error, r.label_error) for r in described(codes, books).collect()]
    # All go to the first of two equal entries, whose mean then leaves the second to the rows of id 7.
    want = [(5, None, None, 0), (6, None, None, 0), (7, "0100", 0, 0), (7, "0100", 0, 0), (8, None, None, None), (9, None, None, None), (None, "0000", 0, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    codes, books = encode_vectors(spark.createDataFrame([], schema))
    assert books == [] and described(codes, books).count() == 0
    codes, books = encode_vectors(spark.createDataFrame(rows[:6], schema))
    assert [(r.id, r.code) for r in described(codes, books).orderBy("id").collect()] == [(5, None), (6, None)]
    with pytest.raises(ValueError):
        encode_vectors(spark.createDataFrame(rows, schema), entries=257)
