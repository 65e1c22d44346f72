import random

import seriesmill.llm.decontaminate as module
from seriesmill.llm.decontaminate import find_leaks, shingle_set, without_leaks, word_list


def brute(docs, items):
    out = {}
    for d, text in docs:
        full = shingle_set(word_list(text or ""))
        for i, item in items:
            shingles = shingle_set(word_list(item or ""))
            if shingles and len(shingles & full) * 5 >= len(shingles) * 4:
                out[d, i] = (len(shingles & full), len(shingles))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for k in range(20)] + [(20, None), (21, "")]
    docs = []
    for d in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if d % 2:
            passage = rng.choice(items[:20])[1].split()
            for _ in range(rng.randint(0, 2)):
                passage[rng.randrange(len(passage))] = "zz"
            text[10:10] = passage
        docs.append((d, " ".join(text).upper() if d % 3 else " ".join(text)))
    docs += [(200, None), (201, ""), (203, "w1 w2 w3"), (204, "w1"), (202, items[0][1] + " x" * 30000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in find_leaks(frame, bench).collect()} == want
    leaked = {d for d, _ in want}
    assert sorted(r.doc_id for r in without_leaks(frame, bench).collect()) == sorted(d for d, _ in docs if d not in leaked)


def test_blocks_and_long_items(spark, monkeypatch):
    """Several blocks of items, one of which is longer than a block, and documents that lack just a fifth of an item or a little more."""
    monkeypatch.setattr(module, "BLOCK_SHINGLES", 300)
    rng = random.Random(6)
    items = [(k, " ".join(f"v{rng.randrange(900)}" for _ in range(n))) for k, n in enumerate([5, 6, 7, 9, 14, 24, 54, 104, 104, 3000])]
    docs = []
    for k, text in items:
        words = text.split()
        for cut in (0, len(words) // 5, (len(words) - 4) // 5, (len(words) - 4) // 5 + 1, len(words) // 3):
            docs.append((len(docs), " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(40))) + " " + " ".join(words[cut:]) + " end"))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert 20 <= len(want) < len(docs)
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in find_leaks(frame, bench).collect()} == want
    assert sorted(r.doc_id for r in without_leaks(frame, bench).collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "one two three four", "a"), (1, "one two three four", "a"), (None, "x one two y", "b")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "two three"), (7, "two three"), (8, "one two three four five"), (9, " ")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()) == [(1, 7)]
    assert [r.doc_id for r in without_leaks(docs, items).collect()] == [None]
    assert find_leaks(docs, items.limit(0)).count() == 0
    assert find_leaks(docs.limit(0), items).count() == 0
    assert without_leaks(docs, items.limit(0)).count() == 3
