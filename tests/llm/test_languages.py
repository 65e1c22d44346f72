import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from seriesmill.llm.languages import Identifier, Lattice, Model, Pieces, fit, pieces, predict, words

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
TRIE = Pieces(["▁", "▁a", "a", "ab", "b", "ba", "bab", "▁ba"])


def cuts(word):
    """All segmentations of a word of the small trie, as numbers of pieces and bytes."""
    text, numbers = "▁" + word, {p: 256 + k for k, p in enumerate(["▁", "▁a", "a", "ab", "b", "ba", "bab", "▁ba"])}

    def rest(at):
        if at == len(text):
            yield ()
        if at < len(text) and text[at] not in numbers:
            for tail in rest(at + 1):
                yield (*text[at].encode(), *tail)
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in numbers:
                for tail in rest(end):
                    yield (numbers[text[at:end]], *tail)

    return [*rest(0)]


def test_forward_sums_and_expected_numbers_equal_all_segmentations():
    rng = np.random.default_rng(5)
    logs = np.log(rng.dirichlet(np.ones(TRIE.size), 3).T)
    found = ["".join(x) for n in range(1, 6) for x in product("abü", repeat=n)]
    times = rng.integers(0, 4, (len(found), 3)).astype(float)
    lattice = Lattice(found, TRIE)
    scores, expected = lattice.scores(logs), np.zeros_like(logs)
    for k, word in enumerate(found):
        ways = [np.exp(sum(logs[p] for p in way)) for way in cuts(word)]
        assert np.allclose(np.log(sum(ways)), scores[k])
        for way, chance in zip(cuts(word), ways, strict=True):
            for p in way:
                expected[p] += chance / sum(ways) * times[k]
    assert np.allclose(expected, lattice.expected(logs, times))


def test_very_long_words_are_exact_in_logarithms():
    logs = np.full((TRIE.size, 1), -np.log(TRIE.size))
    # Of "aaa..." each a but the first is one piece; the first may be one with the mark, or follow it.
    score = Lattice(["a" * 50_000], TRIE).scores(logs)[0, 0]
    assert np.isclose(score, -50_000 * np.log(TRIE.size) + np.log1p(1 / TRIE.size))


def test_words():
    assert words("ti,an4b") == ["ti", "an", "b"] and words("éte") == ["éte"] and words("12 ½ _ ́") == [] and words("") == []
    trie = pieces(VOCABULARY)
    assert trie.size > 10_000 and (np.diff(trie.keys) > 0).all()


def rows(n=240):
    rng = random.Random(2)
    parts = {"xa": ["ta", "ri", "mo"], "xb": ["sch", "ung", "er"], "xc": ["eau", "que", "le"]}
    out = []
    for k in range(n):
        lang = rng.choice([*parts])
        out.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    return out


def test_held_out_accuracy_and_what_is_learnt_from(spark):
    data = rows()
    make = lambda rs: spark.createDataFrame([(k, t, lang, 1, 0.5) for k, t, lang in rs], "doc_id long, text string, lang string, id int, score double")
    model = fit(make(data), VOCABULARY)
    got = {r.id: r for r in predict(make(data), model).collect()}
    out = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k, _, _ in data}
    assert model.languages == ["xa", "xb", "xc"] and all(got[k].held_out == out[k] for k in out)
    held = [(got[k].lang_pred, lang) for k, _, lang in data if out[k]]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0.0 <= r.score <= 1.0 for r in got.values())
    # Neither held out rows nor rows without a language are learnt from, and equal texts count once.
    other = [(k, t if not out[k] else "zu " + t, lang if not out[k] else "xd") for k, t, lang in data] + [(1000, "some text", None)]
    again = fit(make([*other, *[r for r in other if not out.get(r[0], True)]]), VOCABULARY)
    assert again.languages == model.languages and np.allclose(again.logs, model.logs)


def test_model_equals_plain_expectation_and_maximisation(spark):
    data = rows(24)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model, trie = fit(docs, VOCABULARY), pieces(VOCABULARY)
    logs = np.full((trie.size, len(model.languages)), -np.log(trie.size))
    counts = [Counter(w for k, t, x in data if x == lang and zlib.crc32(str(k).encode()) % 3 != 1 for w in t.split()) for lang in model.languages]
    for _ in range(4):
        sums = np.full_like(logs, 0.01)
        for k, count in enumerate(counts):
            for w, n in count.items():
                times = np.zeros((1, len(model.languages)))
                times[0, k] = n
                sums += Lattice([w], trie).expected(logs, times)
        logs = np.log(sums / sums.sum(axis=0))
    assert np.allclose(logs, model.logs)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string"
    data = [(0, "tari mota", "xa"), (3, "schung erung", "xb"), (5, None, "xa"), (6, "", "xb"), (7, "12 !? ½", "xa"), (None, "tari", "xa"), (8, "tari " * 40_000 + "x" * 100_000, "xb"), (8, "ungung", None), (8, "ungung", None)]
    docs = spark.createDataFrame(data, schema)
    model = fit(docs, VOCABULARY)
    got = predict(docs, model).collect()
    assert len(got) == len(data)
    assert [(r.lang_pred, r.score) for r in got if r.id in (5, 6, 7)] == [("und", 0.0)] * 3
    assert [r.held_out for r in got if r.id is None] == [False] and all(np.isfinite(r.score) for r in got)
    assert len({(r.lang_pred, r.score) for r in got if r.id == 8}) == 2
    assert predict(docs.limit(0), model).count() == 0
    none = fit(docs.limit(0), VOCABULARY)
    assert none.languages == [] and {(r.lang_pred, r.score) for r in predict(docs, none).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("remembered", [5, 400_000])
def test_what_is_remembered_does_not_matter(monkeypatch, remembered):
    from seriesmill.llm import languages

    monkeypatch.setattr(languages, "REMEMBERED", remembered)
    monkeypatch.setattr(languages, "GROUP", 40)
    trie = pieces(VOCABULARY)
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(trie.size), 2).T)
    texts = [t for _, t, _ in rows(30)] + ["", "(Tari), mota-ung x1y"]
    found = Identifier(Model(VOCABULARY, ["a", "b"], logs)).scores(texts)
    for k, text in enumerate(texts):
        own = [w for x in text.lower().split() for w in words(x)]
        assert np.allclose(found[k, :-1], sum(Lattice([w], trie).scores(logs)[0] for w in own) if own else 0) and found[k, -1] == len(own)
