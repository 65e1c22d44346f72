"""Prefix counts and byte-level BPE against the libraries."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from seriesmill.llm.byte_bpe import byte_bpe, decode, digests, encode
from seriesmill.llm.common import char_class
from seriesmill.llm.token_counts import count_tokens, prefix_token_counts
from seriesmill.llm.word_bpe import KNOWN, prefix_counter

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = "abcrethinéÉÀßΣσİǅ'’ \n\t\x1c\x85 0123½①²!?.,-#$%&漢字かなйЖ́̈Å한𝒳😀ﬁ_—…  \n"


def texts(n, most):
    rng = random.Random(n)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most))) for _ in range(n)]
    return out + [x + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endof", "'re I'll don't"]) + x[:7] for x in out[: n // 4]]


def test_prefix_counts_equal_the_library():
    counter = prefix_counter(WORDS)
    for text in texts(60, 25):
        want = [len(counter.cut.library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert counter.prefixes(text) == want
        assert counter.tokens(text) == (want[-1] if want else 0)
        for budget in (0, 1, 4, 9):
            assert counter.fitting(text, budget) == max((k for k, n in enumerate(want, 1) if n <= budget), default=0)


def test_prefix_counts_of_marks_and_other_scripts():
    counter, rng = prefix_counter(WORDS), random.Random(5)
    marked = "aAeİé ก็ำเ가ᄀ\u1161\u11a8\u0301\u0323\u0345\u0327\u093c\u0915\u0344\u212b'sre<|ａﬁ𑄮\u0307"
    samples = ["".join(rng.choice(marked) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    samples += ["it'", "'re's'rex'll", "!!'s", "x's'", "'ve've", "a<|endoftext|>\u0301b", "!<|endoftext|><|startoftext|>.", "<|<|endoftext|>"]
    for text in samples:
        want = [len(counter.cut.library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert counter.prefixes(text) == want, ascii(text)


def test_prefix_counts_take_linear_time():
    counter = prefix_counter(WORDS)
    thai = "".join(random.Random(1).choice("กขคงจฉชซญดตถทธนบปผพฟมยรลวศสหอ็ำเแโ") for _ in range(20_000))
    runs = [thai, "a\u0301" * 5_000, "e" + "\u0301" * 10_000, "\u1100" + "\u1161" * 10_000, "x" + "\U0001f600" * 5_000, "a<|endoftext|>" * 700]
    counter.prefixes("ก\u0301")
    for text in runs:
        start = time.process_time()
        found = counter.prefixes(text)
        assert time.process_time() - start < 4
        assert len(found) == len(text) and found[-1] == counter.tokens(text)
        for k in (1, 17, len(text) // 2, len(text) - 1):
            assert found[k - 1] == len(counter.cut.library.encode(text[:k], add_special_tokens=False).ids)
        assert counter.fitting(text, found[-1] // 2) == max(k for k, n in enumerate(found, 1) if n <= found[-1] // 2)


def test_classes_of_characters_equal_the_library():
    cut = prefix_counter(WORDS).cut
    letters, digits = re.compile(f"[{char_class('L')}]"), re.compile(f"[{char_class('N')}]")
    for c in filter(KNOWN.fullmatch, map(chr, range(0x10000))):
        kind = "L" if letters.match(c) else "N" if digits.match(c) else "W" if cut.space.match(c) else "O"
        assert cut.kind[c] == kind, ascii(c)


def test_compatibility_equals_merging():
    counter, rng = prefix_counter(WORDS), random.Random(0)
    plain = [t for t in counter.vocabulary if not t.endswith("</w>") and not t.startswith("<|")]
    every = [t for t in counter.vocabulary if not t.startswith("<|")]
    for _ in range(3000):
        a, b = rng.choice(plain[:3000]), rng.choice(every)
        assert counter.goes_with(a, b) == (counter.merged([*a, *counter.symbols(b)]) == [a, b])


def test_count_table(spark):
    rows = [(1, "Hello, World's end"), (2, None), (3, ""), (3, ""), (4, "word " * 30000), (None, "x" * 3000)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, id int")
    library = prefix_counter(WORDS).cut.library
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, WORDS, 2048).collect())
    want = [(k or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert got == sorted((*w, w[2] > 2048) for w in want)
    assert [r.fitting_chars for r in count_tokens(docs.where("doc_id = 4"), WORDS, 2048).collect()] == [2048 * 5]
    assert [r.prefix_tokens for r in prefix_token_counts(docs.where("doc_id = 3"), WORDS).collect()] == [[], []]
    assert count_tokens(docs.limit(0), WORDS, 5).count() == 0


def test_byte_bpe_equals_the_library():
    own = byte_bpe(BYTES)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(BYTES), special_tokens={})
    runs = [c * n for c in ("a", "ab", "  ", "th", "=", "-", "\n", "é") for n in (1, 2, 3, 7, 50, 299)]
    for text in [*texts(400, 60), *runs, "x" * 20000, "the end " * 5000]:
        ids = np.array(plain.encode_ordinary(text), "<u4").tobytes()
        assert own.encode(text) == ids
        assert own.decode(ids) == text.encode()


def test_byte_bpe_of_every_code_point():
    own = byte_bpe(BYTES)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(BYTES), special_tokens={})
    for start in [*range(0x80, 0x32000, 512), 0xE0000]:
        text = " ".join(f"{chr(c)}'s1{chr(c)} {chr(c)}" for c in range(start, min(start + 512, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert own.encode(text) == np.array(plain.encode_ordinary(text), "<u4").tobytes(), hex(start)


def test_byte_bpe_tables(spark):
    docs = spark.createDataFrame([(1, "déjà vu", b"x"), (2, None, b"x"), (3, "", b"x"), (3, "", b"x"), (None, " a", b"x")], "doc_id long, text string, ids binary")
    encoded = encode(docs, BYTES)
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in decode(encoded, BYTES).collect()) == [(0, " a"), (1, "déjà vu"), (2, ""), (3, ""), (3, "")]
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(docs.where("doc_id = 2"), BYTES).collect()] == [(0, empty, empty)]
    assert digests(docs.limit(0), BYTES).count() == 0
