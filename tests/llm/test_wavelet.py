import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seriesmill.llm.wavelet import BLOCK_BITS, Encoder, WaveletMatrix, count_token, document_digests, locate_token, read_token_shards, slices, write_shard, write_token_shards

from .test_tokens import texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 1000, BLOCK_BITS, BLOCK_BITS * 2 + 17])
def test_matrix_equals_the_plain_array(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(0.6, n) * 3).clip(0, 49407).astype(np.uint16)
    shard = WaveletMatrix(write_shard(ids, [4, None], [n, 0]))
    assert shard.doc_ids == [4, None] and shard.lengths.tolist() == [n, 0]
    assert (shard.ids() == ids).all()
    for i in rng.integers(0, n, 50).tolist() if n else []:
        assert shard.access(i) == ids[i]
        assert shard.count(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        places = np.flatnonzero(ids == ids[i])
        k = int(rng.integers(len(places)))
        assert shard.locate(int(ids[i]), k) == places[k]
    assert shard.count(1 << 20) == 0
    with pytest.raises(IndexError):
        shard.locate(5, n)


def test_encoder_equals_the_library():
    library, own = Tokenizer.from_file(PATH), Encoder(PATH, most=500)
    rows = [*texts(300, 40), None, "", "  ", "İ\u0307 ÀE\u0301 it's '\x00' ก็ ａｂ", "x " * 3000, "ab" * 4000]
    ids, lengths = own.encode(pa.array(rows), 1)
    ends = np.cumsum(lengths).tolist()
    for row, end, n in zip(rows, ends, lengths.tolist(), strict=True):
        assert ids[end - n : end].tolist() == [*library.encode(row or "", add_special_tokens=False).ids, 1]
    assert [len(x) for x in slices(pa.record_batch({"id": [1] * 7, "text": ["aaaa", "bbb", None, "c" * 50, "", "dd", "e"]}), 8)] == [3, 1, 3]


def test_encoder_of_odd_batches_equals_the_library():
    library, rng = Tokenizer.from_file(PATH), np.random.default_rng(3)
    marks = ["'", "'s", "'RE", "''ll", "\x00", "\x1c", "\x1f", "\x7f", "\x0b", "\x0c", "\n", " ", "  ", "!", "<", "<|", "|>", "\\0", "9", "Ab", "x", "don't", "</w>"]
    ascii_only = ["".join(rng.choice(marks, rng.integers(1, 12))) for _ in range(400)]
    batches = [[], [""], [None, None], ["  \n"], ["ａｂ ก็"], ["é"], ["'s"], ["<|endoftext|>"], ["<|EndOfText|> <|endoftext|>x"], ascii_only, [x + "é’" + y for x, y in zip(ascii_only, ascii_only[1:], strict=False)]]
    for most in (3, 1000):
        own = Encoder(PATH, most=most)
        for rows in batches * 2:
            ids, lengths = own.encode(pa.array(rows, pa.string()))
            want = [library.encode(row or "", add_special_tokens=False).ids for row in rows]
            assert lengths.tolist() == [*map(len, want)] and ids.tolist() == [i for x in want for i in x], (most, rows[:3])


def test_common_words_go_to_the_library_once():
    own, sent = Encoder(PATH, most=60), []
    together = own.together
    own.together = lambda pieces: sent.extend(pieces) or together(pieces)
    for k in range(20):
        own.encode(pa.array(["The end, (the) END. " + " ".join(f"{'abcdefghij'[k // 2]}{'xy'[k % 2]}{'klmnopqrst'[i]}q" for i in range(10))]))
    assert sent.count("the") == sent.count("end") == 1 and len({*sent}) == 206


def test_repeated_ids_keep_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(5, "again and again")] * 40 + [(5, "other"), (4, "before"), (6, "after")], "doc_id long, text string").repartition(6)
    write_token_shards(docs, PATH, f"file://{tmp_path}/r", shard_tokens=10)
    rows = sorted(document_digests(read_token_shards(spark, f"file://{tmp_path}/r")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [4, *[5] * 41, 6]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_round_trip(spark, tmp_path):
    texts = {7: "Hello, World's  end", 3: None, 9: "", 1: "déjà <|endoftext|> vu ￼ x" * 50, 12: "a" * 5000, 2: "long " * 20000}
    docs = spark.createDataFrame([(k, v, k) for k, v in texts.items()] + [(None, "no id", 0)], "doc_id long, text string, ids long").repartition(3)
    write_token_shards(docs, PATH, f"file://{tmp_path}/t", shard_tokens=100)
    shards = read_token_shards(spark, f"file://{tmp_path}/t")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in document_digests(shards).collect()}
    library, start, ids = Tokenizer.from_file(PATH), 0, {None: None}
    for k in [None, *sorted(texts)]:
        ids[k] = np.array(library.encode("no id" if k is None else texts[k] or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[k] == (start, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        start += len(ids[k])
    token = int(ids[2][0])
    assert sum(r.n for r in count_token(shards, token).collect()) == sum(int((x == token).sum()) for x in ids.values())
    assert sorted((r.doc_id, r.place) for r in locate_token(shards, 49407).collect()) == [(1, int(p)) for p in np.flatnonzero(ids[1] == 49407)]
    write_token_shards(docs.limit(0), PATH, f"file://{tmp_path}/e")
    assert document_digests(read_token_shards(spark, f"file://{tmp_path}/e")).count() == 0
