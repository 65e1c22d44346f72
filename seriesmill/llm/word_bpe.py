"""Texts cut into the pieces that a word-end BPE vocabulary encodes one by one, and exact token counts at every prefix of a piece."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache
from os.path import commonprefix

from .common import WHITE_SPACE, Memo, char_class

#: Blocks for which the normaliser below is used; texts with other characters go through the library's own.
KNOWN = re.compile(r"[\x00-ɏͰ-ԯḀ-ỿ -⁯₠-₿　-ヿ一-鿿가-힣]*")
#: Characters that str.split() takes for white space and the vocabulary does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Pieces of an apostrophe and letters (fixed values).
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


@lru_cache(maxsize=4)
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)


class WordPieces:
    """Cuts texts exactly as the tokenizers library does for a file whose normaliser is NFC, white space folding and lower-casing, and whose pieces are contractions, letters, single digits and runs of other characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.config = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in self.config["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        letters, digits, space = char_class("L"), char_class("N"), re.escape(WHITE_SPACE)
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")
        self.space = re.compile(f"[{space}]+")
        self.stretch = re.compile(f"[^{space}]+")
        self.kind = Memo(self._kind)
        self.normal_of = Memo(self.library.normalizer.normalize_str)
        self.stands_alone = Memo(stands_alone)

    def sections(self, text: str) -> list[str]:
        """The text cut at special strings; those are at the odd places."""
        return self.special_pattern.split(text) if "<|" in text else [text]

    def chunks(self, section: str) -> list[str]:
        """The section cut at white space, which no piece holds."""
        if ODD_SPACE.search(section):
            return [x for x in self.space.split(section) if x]
        return section.split()

    def normal(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def _kind(self, character: str) -> str:
        """How the library's pre-tokeniser takes a normalised character: letter L, number N, white space W, other O."""
        found = self.library.pre_tokenizer.pre_tokenize_str("a" + character * 2)
        return ("L" if found[-1][1][1] == 3 else "W") if len(found) == 1 else "O" if len(found) == 2 else "N"

    def pieces(self, chunk: str) -> list[str]:
        """The normalised pieces of a stretch without white space."""
        if KNOWN.fullmatch(chunk):
            return self.pattern.findall(self.normal(chunk))
        normal = self.library.normalizer.normalize_str(chunk)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]


@lru_cache(maxsize=1)
def second_characters() -> frozenset[str]:
    """The characters with which a canonical composition may end."""
    pairs = (unicodedata.decomposition(chr(code)).split() for code in range(sys.maxunicode + 1))
    vowels_and_finals = map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])
    return frozenset(chr(int(x[1], 16)) for x in pairs if len(x) == 2 and x[0][0] != "<").union(vowels_and_finals)


def stands_alone(character: str) -> bool:
    """Whether a character neither composes nor changes places with anything before it."""
    if character < "\u0300":
        return True
    first = unicodedata.normalize("NFD", character)[0]
    return not unicodedata.combining(first) and first not in second_characters()


@lru_cache(maxsize=4)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


class PrefixCounter:
    """Dynamic programming over the prefixes of a piece.

    A sequence of tokens is what the merges give exactly if each token merges to itself and each adjacent pair does not merge any further. So the encoding of a prefix is that of a shorter prefix with one more token, the only one that goes with its last token. Kept for each prefix are that token and the number of tokens; a prefix that ends the piece takes a token with the word-end mark instead.
    """

    END = "</w>"

    def __init__(self, path: str):
        self.cut = word_pieces(path)
        model = self.cut.config["model"]
        self.vocabulary = model["vocab"]
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.endings = {token[k:] for token in self.vocabulary for k in range(len(token))}
        self.longest = max(map(len, self.vocabulary))
        self.made: dict[str, tuple[int, str, str]] = {}
        for (a, b), rank in self.ranks.items():
            if a + b not in self.made or self._last_merge(a + b) == (a, b):
                self.made[a + b] = (rank, a, b)
        self.symbol = byte_symbols()
        self.compatible = {}
        self.whole = {}
        self.prefix: dict[str, tuple[str, int]] = {}
        self.piece_tokens = Memo(self._piece_tokens)
        self.chunk_tokens = Memo(self._chunk_tokens)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging: always the pair of the lowest rank, from the left."""
        ranks, parts = self.ranks, list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.END) and len(token) > len(self.END):
            return [*token[: -len(self.END) - 1], token[-len(self.END) - 1 :]]
        return list(token)

    def merges_to_itself(self, token: str) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.symbols(token)) == [token]
        return known

    def _last_merge(self, token: str) -> tuple[str, str] | None:
        """The merge that completes a token which more than one merge could make."""
        parts = self.symbols(token)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    def goes_with(self, left: str, right: str) -> bool:
        """Whether no merge joins the two: looks back from the later made of both to the parts at their common edge, which must not have merged before that token took its part in."""
        if (known := self.compatible.get((left, right))) is not None:
            return known
        if len(self.compatible) > 600_000:
            self.compatible.clear()
        a, b, limit, base, known = left, right, 1 << 60, (-1, "", ""), True
        while True:
            if self.ranks.get((a, b), 1 << 60) < limit:
                known = False
                break
            made_a, made_b = self.made.get(a, base), self.made.get(b, base)
            if made_a[0] > made_b[0]:
                limit, a = made_a[0], made_a[2]
            elif made_b[0] >= 0:
                limit, b = made_b[0] + 1, made_b[1]
            else:
                break
        known = known and self.merges_to_itself(left) and self.merges_to_itself(right)
        self.compatible[left, right] = known
        return known

    def mapped(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.symbol.__getitem__, piece.encode()))

    def _fitting(self, word: str, i: int, end: str, last: list[str], offset: int = 0) -> tuple[int, str]:
        """Start and token of the one token that ends at i and goes with the encoding before it; word may lack so many symbols at its start."""
        start, found, endings, vocabulary = i - 1, [], self.endings, self.vocabulary
        while start >= 0 and (token := word[start:i] + end) in endings:
            if token in vocabulary:
                found.append((start, token))
            start -= 1
        for start, token in reversed(found):
            if self.goes_with(last[start + offset], token) if start + offset else self.merges_to_itself(token):
                return start + offset, token
        raise ValueError(word)

    def _inner(self, word: str) -> tuple[list[str], list[int]]:
        """For each prefix of the symbols, without a word end: the last token and the number of tokens."""
        last, count, known = [""], [0], self.prefix
        for i in range(1, len(word) + 1):
            if (state := known.get(word[:i]) if i <= 12 else None) is None:
                start, token = self._fitting(word, i, "", last)
                state = token, count[start] + 1
                if i <= 12:
                    if len(known) > 400_000:
                        known.clear()
                    known[word[:i]] = state
            last.append(state[0])
            count.append(state[1])
        return last, count

    def _ended(self, word: str, i: int, last: list[str], count: list[int]) -> int:
        return count[self._fitting(word, i, self.END, last)[0]] + 1

    def _tail(self, piece: Piece, size: int) -> tuple[str, int]:
        offset = max(0, size - self.longest)
        return "".join(piece.symbols[offset:size]), offset

    def grow(self, piece: Piece, size: int, character: str) -> int:
        """The piece's symbols after the first `size` are replaced by those of a character; their new number."""
        del piece.symbols[size:], piece.last[size + 1 :], piece.count[size + 1 :]
        for symbol in self.mapped(character):
            piece.symbols.append(symbol)
            size += 1
            word, offset = self._tail(piece, size)
            start, token = self._fitting(word, len(word), "", piece.last, offset)
            piece.last.append(token)
            piece.count.append(piece.count[start] + 1)
        return size

    def ended(self, piece: Piece, size: int) -> int:
        """Tokens of a piece that ends after so many symbols."""
        word, offset = self._tail(piece, size)
        return piece.count[self._fitting(word, len(word), self.END, piece.last, offset)[0]] + 1

    def _piece_tokens(self, piece: str) -> int:
        word = self.mapped(piece)
        if word + self.END in self.vocabulary and self.merges_to_itself(word + self.END):
            return 1
        return self._ended(word, len(word), *self._inner(word[:-1]))

    def _chunk_tokens(self, chunk: str) -> int:
        return sum(map(self.piece_tokens.__getitem__, self.cut.pieces(chunk)))

    def tokens(self, text: str) -> int:
        """Tokens of the whole text."""
        total = 0
        for k, section in enumerate(self.cut.sections(text)):
            total += 1 if k % 2 else sum(map(self.chunk_tokens.__getitem__, self.cut.chunks(section)))
        return total

    def prefixes(self, text: str) -> list[int]:
        """Tokens of text[:k] for each k from 1 to its length."""
        out, total, walk = [], 0, PrefixWalk(self)
        for k, section in enumerate(self.cut.sections(text)):
            if k % 2:  # until it is whole, a special string is ordinary text that goes on with what stands before it
                out += [*map(walk.push, section[:-1]), total + 1]
                total += 1
                walk = PrefixWalk(self, total)
            elif section:
                out += map(walk.push, section)
                total = out[-1]
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most so many tokens: stretches between white space are counted whole until one goes beyond the budget, and only of that one the prefixes are."""
        total = 0
        for m in self.cut.stretch.finditer(text):
            if total >= budget:
                return m.start()
            here = self.tokens(m[0]) if "<|" in m[0] else self.chunk_tokens[m[0]]
            if total + here > budget:
                return m.start() + max((k for k, n in enumerate(self.prefixes(m[0]), 1) if total + n <= budget), default=0)
            total += here
        return len(text)


class Piece:
    """A growing piece: its symbols, and for each of its prefixes the last token and the number of tokens."""

    def __init__(self):
        self.symbols, self.last, self.count = [], [""], [0]


class PrefixWalk:
    """Reads a text character by character and says how many tokens the text so far has.

    Every prefix is normalised by itself, but a character that composes with nothing before it leaves all before it as it was. So only what follows the last such character (the open stretch) is normalised again, and where that changes what was read, the states since are given up. A state names the piece it is in and how far, so what stands is not encoded again. Only among the marks between two letters is the time more than linear in their number, and only if they are put in another order.
    """

    def __init__(self, counter: PrefixCounter, total: int = 0):
        self.counter, self.cut = counter, counter.cut
        # Of the open stretch, and the one before it: tokens so far, tokens before the piece, its class, the piece and its symbols, the start of a contraction, and tokens before that.
        self.states: list[tuple[int, int, str, Piece | None, int, str, int]] = [(total, total, "W", None, 0, "", 0)]
        self.open = self.normal = ""

    def push(self, character: str) -> int:
        if self.cut.stands_alone[character]:
            normal = self._start(character)
        elif self._follows_its_like(character):
            normal = self.normal + self.cut.normal_of[character]
        else:
            self.open += character
            normal = self.cut.library.normalizer.normalize_str(self.open)
            if normal == self.normal + character and not unicodedata.combining(character):
                normal = self._start(character)
        same = len(self.normal) if normal.startswith(self.normal) else len(commonprefix([normal, self.normal]))
        del self.states[same + 1 :]
        for c in normal[same:]:
            self.states.append(self._next(self.states[-1], c))
        self.normal = normal
        return self.states[-1][0]

    def _start(self, character: str) -> str:
        self.open, self.normal, self.states = character, "", self.states[-1:]
        return self.cut.normal_of[character]

    def _follows_its_like(self, character: str) -> bool:
        """Whether it is a mark that comes after one of the same class, which stays, and keeps it from all before."""
        order = unicodedata.combining(character)
        if not order or not self.normal or order != unicodedata.combining(self.normal[-1]) or unicodedata.normalize("NFD", character) != character:
            return False
        self.open += character
        return True

    def _next(self, state: tuple, c: str) -> tuple:
        total, before, kind, piece, size, quote, mark = state
        now = self.cut.kind[c]
        if now == "W":
            return total, total, now, None, 0, "", 0
        if now == "N":
            total += self.counter.piece_tokens[c]
            return total, total, now, None, 0, "", 0
        if quote and quote + c in CONTRACTIONS:
            total = mark + self.counter.piece_tokens[quote + c]
            return total, total, "C", None, 0, "", 0
        if now == kind:
            quote = ""
        else:
            before, piece, size = total, Piece(), 0
            if c == "'":
                quote, mark = c, total
            else:
                quote = "'" + c if quote == "'" and now == "L" else ""
        size = self.counter.grow(piece, size, c)
        return before + self.counter.ended(piece, size), before, now, piece, size, quote, mark


def byte_symbols() -> list[str]:
    """A printable character for each byte: the byte's own where it is printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]
