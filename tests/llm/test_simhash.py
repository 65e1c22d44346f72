import random
import re

import pytest
import xxhash

from seriesmill.llm.simhash import fingerprint, link_fingerprints, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {p: root(p) for p in prints}


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "Of", "É", "x.", "straße", "TION"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for text in [*texts, "", " \t\n", "one", "a b c", "A\x0bB c  d e", "word " * 30000]:
        assert fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("spread", [2, 3, 6])
def test_links_are_exact(spark, spread):
    rng = random.Random(spread)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            p = centre
            for _ in range(rng.randint(0, spread)):
                p ^= 1 << rng.randrange(64)
            prints.add(p - (1 << 64) if p >> 63 else p)
    found = link_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert {r.node: r.component for r in found.collect()} == brute_components(prints)


def test_edge_cases(spark):
    rows = [(5, "a b c d e f", "x"), (3, "A b c d e f", None), (9, None, "x"), (7, "", "x"), (8, " \n", "x"), (3, "A b c d e f", None), (None, "a B c d e f", "y"), (1, "quite another text with words in it", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "key")
    got = sorted((r.id, r.component_id) for r in near_duplicates(docs).collect() if r.id is not None)
    assert got == [(1, 1), (3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 7)]
    assert [r.component_id for r in near_duplicates(docs).where("id is null").collect()] == [3]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_maps_at_any_depth_are_hashed_by_content(spark):
    from seriesmill.llm.simhash import row_hash, without_near_duplicates

    text = " ".join(f"word{k}" for k in range(60))
    schema = "doc_id long, text string, m map<string,int>, deep array<struct<a:int,b:map<int,array<map<string,string>>>>>"
    one, two = {"a": 1, "b": 2}, {"b": 2, "a": 1}
    rows = [(1, text, one, [(1, {1: [{"x": "y", "z": None}], 2: None})]), (1, text, two, [(1, {2: None, 1: [{"z": None, "x": "y"}]})]), (1, text, {"a": 2}, None), (2, text, None, [None]), (3, "other words that nobody repeats here", {}, [])]
    docs = spark.createDataFrame(rows, schema)
    hashes = [r.h for r in docs.select("doc_id", row_hash(docs).alias("h")).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 4
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3}


def exploded_and_sent(plan):
    """How many explodes a physical plan has, and those of its broadcast parts that hold one."""
    lines = [x for x in plan.splitlines() if x.strip(" :+-")]
    depths = [re.search(r"[^ :+-]", x).start() for x in lines]
    sent = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((m for m in range(k + 1, len(lines)) if depths[m] <= depths[k]), len(lines))
            sent += ["\n".join(lines[k:end])] if any("Generate explode" in x for x in lines[k:end]) else []
    return sum("Generate explode" in x for x in lines), sent


def watch_plans(monkeypatch):
    """The physical plans of the tables that are written from now on."""
    from seriesmill.llm import components, simhash

    plans, write = [], simhash.materialize

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", watched)
    monkeypatch.setattr(components, "materialize", watched)
    return plans


def test_no_exploded_table_is_broadcast(spark, monkeypatch):
    plans = watch_plans(monkeypatch)
    rng = random.Random(1)
    link_fingerprints(spark.createDataFrame([(rng.getrandbits(63),) for _ in range(50)], "fp long")).collect()
    found = [exploded_and_sent(x) for x in plans]
    assert sum(n for n, _ in found) >= 5 and not any(sent for _, sent in found)
