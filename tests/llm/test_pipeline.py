"""The pipeline on the smallest tables, each stage against a plain version of it."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from seriesmill.llm.decontaminate import least_shared, shingle_set, word_list
from seriesmill.llm.secrets import MARK
from seriesmill.llm.simhash import without_near_duplicates

from .test_secrets import brute as brute_spans
from .test_simhash import brute_components, brute_fingerprint, exploded_and_sent, watch_plans

SMALL = "/root/testdata/sf0.001"


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, clashing names, and empty tables, through all stages."""
    long = " ".join(f"word{k % 97} and{k % 89} so{k % 83}" for k in range(4000))
    texts = {1: [long], 2: [long + " more"], 3: [None, "other text of the same id, which is no copy of anything else here"], 4: ["", ""], 5: [" \t"], 6: ["my token=abcdefgh12 stands here among six words or more"] * 2, 7: ["passage of the benchmark that leaked into this text word by word"]}
    rows = [(d, t, None, "s", None if t is None else len(t), "x", 1, None, 2.0, "y", b"z", "w") for d, ts in texts.items() for t in ts]
    rows += [(None, None, None, None, None, None, None, None, None, None, None, None), (None, "no id, but a text of its own that nobody repeats", "en", "s", 5, "x", 1, 2, 2.0, "y", b"z", "w")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, row long, score double, toxic string, spans binary, component_id string"
    root = f"file://{tmp_path}"
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "of the benchmark that leaked into this text"), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
        docs.write.parquet(path := corpus_pipeline.fresh_path(spark, "odd"))
        docs = spark.read.parquet(path)
        kept[name] = sorted((r.doc_id or 0) for r in docs.collect())
        if name != "byte_bpe":
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    assert kept["toxicity"] == [0, 0, 1, 2, 3, 3, 4, 4, 5, 6, 6, 7]
    # The texts without words are one group, whose smallest id is 3; 1 and 2 are near copies.
    assert kept["simhash_near_dedup"] == [0, 0, 1, 3, 3, 6, 7]
    assert kept["benchmark_decontamination"] == [d for d in kept["simhash_near_dedup"] if d != 7]
    assert kept["secret_scans"] == kept["byte_bpe"] == kept["benchmark_decontamination"]
    empty = f"{root}/empty"
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{table}.parquet").limit(0).write.parquet(f"{empty}/{table}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_no_exploded_table_is_broadcast(spark, monkeypatch):
    plans = watch_plans(monkeypatch)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SMALL)
    found = [exploded_and_sent(x) for x in [*plans, out._jdf.queryExecution().executedPlan().toString()]]
    assert sum(n for n, _ in found) >= 5 and not any(sent for _, sent in found)


def test_rows_of_one_id_are_judged_in_their_own_groups(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(60)) for _ in range(4)]
    rows = [(1, texts[0], 0), (1, texts[1], 0), (2, texts[1], 0), (2, texts[2], 0), (3, texts[3], 0), (3, texts[3], 0), (3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for part in (1, 3):
        got = sorted((r.doc_id, r.text) for r in without_near_duplicates(docs.repartition(part)).collect())
        assert got == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[3])])


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [shingle_set(word_list(r.text or "")) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        docs.write.mode("overwrite").parquet(path := f"{corpus_pipeline.fresh_path(spark, 'test')}/{k}")
        docs = spark.read.parquet(path)
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert docs.columns == columns
        out = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            clean = [d for d in rows if toxic.get(d) == 0]
            assert sum(d in out for d in clean) >= 0.95 * len(clean)
        elif name == "simhash_near_dedup":
            prints = {d: brute_fingerprint(t) for d, t in rows.items()}
            of = brute_components(sorted(set(prints.values())))
            least = {}
            for d in rows:
                least[of[prints[d]]] = min(d, least.get(of[prints[d]], d))
            assert out.keys() == set(least.values())
        elif name == "benchmark_decontamination":
            leaks = {d for d, t in rows.items() if any(s and len(s & shingle_set(word_list(t or ""))) >= least_shared(len(s)) for s in items)}
            assert out.keys() == rows.keys() - leaks
        else:
            assert out.keys() == rows.keys()
            assert all((MARK in (out[d] or "")) == bool(brute_spans(t)) or MARK in (out[d] or "") for d, t in rows.items())
            assert all(not brute_spans(t) for t in out.values())
        rows = out
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    got = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == rows.keys()
    for d, text in rows.items():
        ids = np.array(plain.encode_ordinary(text or ""), "<u4")
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
