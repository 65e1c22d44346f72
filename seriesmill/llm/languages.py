"""Language identification: unigram models of pieces, with every segmentation counted.

The pieces are those of a public vocabulary (a sentencepiece file, never trained here) that lower-cased words can have, a mark for the start of a word among them, and its 256 bytes for characters that are no piece. A language gives each piece a probability. A word's probability is the sum over all ways of cutting it into pieces of the products of their probabilities, by a forward algorithm in logarithms over the lattice of its pieces, so words of any length are exact; a text's is the product over its words, runs of letters and marks. All words that a group of texts has anew are one lattice, and all languages are summed at once.

Probabilities are fitted by expectation and maximisation in `ROUNDS` rounds from equal ones: forward and backward sums give the expected number of each piece over all segmentations. Each round is a job over a table of words and their numbers by language; only the sums by piece and language meet in the driver, as many as the model holds. Every piece counts as seen `SMOOTHING` times more.

Languages are learnt only from rows whose crc32 of the id, as text, leaves a remainder other than 1 modulo 3, from some `SAMPLE` texts of each language (the documented bound): of n such rows those whose text's hash is in the lowest SAMPLE / n of its range, equal texts once. Texts are predicted whole, from nothing but themselves: the language of the largest probability, all being as likely beforehand, ties to the first by name. The score is its share of the sum of all languages' probabilities.

Null texts and those without a letter are `und` with score 0, and so is everything if there is nothing to learn from. Rows without an id are not held out. Repeated rows get the same results. An empty table gives an empty result. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import sent_if_small
from .common import materialize

SAMPLE, ROUNDS, SMOOTHING = 1000, 4, 0.01
UNKNOWN = "und"
START = "▁"
#: Punctuation at the edges of stretches, where it parts no words.
EDGES = ".,;:!?()[]{}\"'-"
#: Characters of texts whose new words are one lattice, and stretches that a task remembers.
GROUP, REMEMBERED = 2_000_000, 400_000


class Pieces:
    """The usable pieces as a trie: sorted keys (node and character) with the nodes that they lead to, and each node's piece. Bytes are numbered 0 to 255, pieces from 256 on."""

    def __init__(self, usable: list[str]):
        self.size = 256 + len(usable)
        nodes, steps, number = {"": 0}, {}, [-1]
        for k, piece in enumerate(usable):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    number.append(-1)
                    steps[nodes[piece[: n - 1]] << 21 | ord(piece[n - 1])] = nodes[piece[:n]]
            number[nodes[piece]] = 256 + k
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.number = np.array(number, np.int64)

    def step(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The node after a character, -1 where there is none."""
        key = node << 21 | character
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=vocabulary)
    named = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k)))
    plain = {p: p.removeprefix(START) for p in named}
    return Pieces(sorted(p for p, x in plain.items() if p == p.lower() and (not x or _runs().fullmatch(x))))


@lru_cache(maxsize=1)
def _runs() -> re.Pattern:
    import regex

    return regex.compile(r"[\p{L}\p{M}]+")


def words(text: str) -> list[str]:
    """Runs of letters and marks that hold a letter."""
    if text.isalpha():
        return [text]
    return [w for w in _runs().findall(text) if any(map(str.isalpha, w))]


class Lattice:
    """All ways of cutting words into pieces, as arcs between places of words. A character that is no piece is an arc of its bytes."""

    def __init__(self, found: list[str], trie: Pieces):
        # A place for each character, the mark at the start included, and one for the end, which holds no character.
        text = "".join(f"{START}{w}\0" for w in found)
        place = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.size, self.virtual = len(place), trie.size
        self.last = np.flatnonzero(place == 0)
        self.first = np.concatenate(([0], self.last[:-1] + 1)) if found else self.last
        own = np.flatnonzero(place)
        begin, end, piece, at, node = [], [], [], own, np.zeros(len(own), np.int64)
        for length in range(1, 1 << 20):
            node = trie.step(node, place[at + length - 1])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            number = trie.number[node]
            begin.append(at[number >= 0])
            end.append(at[number >= 0] + length)
            piece.append(number[number >= 0])
            if length == 1:
                alone = np.setdiff1d(own, begin[0], assume_unique=True)
        if not begin:
            alone = own
        codes, spelt = np.unique(place[alone], return_inverse=True)
        self.spelt = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        self.begin, self.end = np.concatenate([*begin, alone]), np.concatenate([*end, alone + 1])
        self.piece = np.concatenate([*piece, spelt + self.virtual])
        self.word = np.searchsorted(self.first, self.begin, "right") - 1

    @staticmethod
    def _levels(depth: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arcs by depth, each level's sorted by node, with where its nodes begin."""
        order = np.lexsort((node, depth))
        out = []
        for arcs in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            if len(arcs):
                starts = np.concatenate(([0], np.flatnonzero(np.diff(node[arcs])) + 1))
                out.append((arcs, starts, node[arcs[starts]]))
        return out

    def weights(self, logs: np.ndarray) -> np.ndarray:
        """The log probability of every arc in every language, from those of bytes and pieces."""
        out = logs[np.where(self.piece < self.virtual, self.piece, 0)]
        if self.spelt:
            spelt = np.stack([logs[[*c]].sum(axis=0) for c in self.spelt])
            own = self.piece >= self.virtual
            out[own] = spelt[self.piece[own] - self.virtual]
        return out

    def sums(self, weights: np.ndarray, back: bool = False) -> np.ndarray:
        """The log of the summed probabilities of all ways from the start of a word to each place, or from there to its end."""
        made = np.zeros((self.size, weights.shape[1]))
        own, other, depth = (self.begin, self.end, self.last[self.word] - self.begin) if back else (self.end, self.begin, self.end - self.first[self.word])
        for arcs, starts, nodes in self._levels(depth, own):
            x = made[other[arcs]] + weights[arcs]
            top = np.maximum.reduceat(x, starts, axis=0)
            x -= np.repeat(top, np.diff(np.append(starts, len(arcs))), axis=0)
            made[nodes] = top + np.log(np.add.reduceat(np.exp(x), starts, axis=0))
        return made

    def scores(self, logs: np.ndarray) -> np.ndarray:
        """Log probabilities of the words."""
        return self.sums(self.weights(logs))[self.last]

    def expected(self, logs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The expected number of each byte and piece in each language, of words that occur so many times there."""
        weights = self.weights(logs)
        forward, backward = self.sums(weights), self.sums(weights, back=True)
        share = np.exp(forward[self.begin] + weights + backward[self.end] - forward[self.last][self.word]) * times[self.word]
        out = np.zeros_like(logs)
        plain = self.piece < self.virtual
        for k in range(logs.shape[1]):
            out[:, k] = np.bincount(self.piece[plain], share[plain, k], len(logs))
            for c, n in zip(self.spelt, np.bincount(self.piece[~plain] - self.virtual, share[~plain, k], len(self.spelt)), strict=True):
                np.add.at(out[:, k], [*c], n)
        return out


class Model:
    """Languages in order of name, and the log probability of each byte and piece in each."""

    def __init__(self, vocabulary: str, languages: list[str], logs: np.ndarray):
        self.vocabulary, self.languages, self.logs = vocabulary, languages, logs


class Identifier:
    def __init__(self, model: Model):
        self.model, self.trie = model, pieces(model.vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1))

    def _learn(self, new: list[str]) -> None:
        """Rows of stretches without white space: the log probability in each language, and how many words they hold."""
        held = [words(x) for x in new]
        every = sorted({w for ws in held for w in ws})
        place = {w: k for k, w in enumerate(every)}
        n = np.fromiter(map(len, held), np.int64, len(held))
        rows = np.zeros((len(new), self.table.shape[1]))
        if every:
            found = Lattice(every, self.trie).scores(self.model.logs)
            flat = np.fromiter((place[w] for ws in held for w in ws), np.int64, n.sum())
            some = np.flatnonzero(n)
            rows[some, :-1] = np.add.reduceat(found[flat], (np.cumsum(n) - n)[some], axis=0)
            rows[:, -1] = n
        start = len(self.places)
        while start + len(new) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[start : start + len(new)] = rows
        self.places.update(zip(new, range(start, start + len(new)), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log probabilities of whole texts, and last how many words they hold."""
        out, start = np.zeros((len(texts), len(self.model.languages) + 1)), 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= GROUP):
                size += len(texts[end])
                end += 1
            cut = [[x.strip(EDGES) for x in text.lower().split()] for text in texts[start:end]]
            new = set().union(*cut).difference(self.places)
            if len(self.places) + len(new) > REMEMBERED:
                self._forget()
                new = set().union(*cut)
            self._learn(sorted(new))
            for k, x in enumerate(cut):
                if x:
                    out[start + k] = self.table[np.fromiter(map(self.places.__getitem__, x), np.int64, len(x))].sum(axis=0)
            start = end
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        found = self.scores([x or "" for x in texts])
        logs = found[:, :-1]
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        known = found[:, -1] > 0
        return [self.model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, share, 0.0).tolist()


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, n) of (lang, text)."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in words(text.lower()))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array([*counts.values()], pa.int64())], ["lang", "word", "n"])


def _expect(model: Model):
    """Rows (piece, lang, n): what a partition's words are expected to hold of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: k for k, lang in enumerate(model.languages)}
        total, trie = np.zeros_like(model.logs), pieces(model.vocabulary)
        for batch in batches:
            found = batch.column(1).to_pylist()
            every = sorted({*found})
            place = {w: k for k, w in enumerate(every)}
            times = np.zeros((len(every), len(number)))
            np.add.at(times, ([place[w] for w in found], [number[x] for x in batch.column(0).to_pylist()]), batch.column(2).to_numpy())
            total += Lattice(every, trie).expected(model.logs, times)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    return run


def fit(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Models of all languages, from a bounded sample of rows that are not held out."""
    known = docs.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")).where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    rates = known.groupBy("lang").agg((F.lit(float(SAMPLE)) / F.count("*")).alias("rate"))
    drawn = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53)) < F.col("rate")
    sample = known.where("text is not null").join(sent_if_small(rates), "lang").where(drawn).select("lang", "text").distinct()
    counted = sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "language-words")
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    size = pieces(vocabulary).size
    logs = np.full((size, len(languages)), -np.log(size))
    for _ in range(ROUNDS if languages else 0):
        found = counted.mapInArrow(_expect(Model(vocabulary, languages, logs)), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full(logs.shape, SMOOTHING)
        counts[found.column(0).to_numpy(), found.column(1).to_numpy()] += found.column(2).to_numpy()
        logs = np.log(counts / counts.sum(axis=0))
    return Model(vocabulary, languages, logs)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, held_out, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(model)
        for batch in batches:
            languages, scores = identifier.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
