"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks, the stretches of text between block-level tags. Each block is a vector: hashed elements of its tag path with their classes and ids (weighted towards the leaf), hashed words, and a few measures of its form (length, share of linked text, punctuation, place in the page). A bidirectional LSTM in numpy reads the sequence of a page's blocks, so each is labelled main text or not with the whole document as context.

The labeller is trained here on a bounded sample of pages (`SAMPLE`, those with the smallest hashes of their ids). Its labels come from what pages say of themselves: text in an article or main element is main text, unless an element on its path is a menu, header, footer, sidebar, form, notice, advert or comment by its name, class or id; pages that say nothing of the kind are not learnt from. So that the labeller does not depend on one way of naming things, each page is also learnt from in changed forms: main elements renamed to divisions with usual classes, path names left out at random, and blocks of the kinds that do not belong put in between, made of the page's own words.

Tags are read as HTML has them, in time linear in the page: quotes count only where a value begins, what a head cannot hold ends it, a block ends a select, and what is left open ends with what it lies in. Scripts, styles, comments, head, templates and controls of forms are never text; all else is, formulas and fallback contents included. Character references are decoded, white space inside a block becomes one space, and blocks are joined in page order by a line feed. Null html counts as empty. A page without blocks has an empty text. All words of a block count, and pages of any length are read whole, each as one sequence, so every block has the whole page as context. In training a page is learnt from whole, in pieces of `TRAIN_STEPS` blocks. Repeated rows give repeated results. An empty table gives an empty result; without pages to learn from, all blocks that no name on their path rules out are main text. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

SAMPLE = 160
PATH_SIZE, WORD_SIZE, FORM_SIZE, HIDDEN = 48, 24, 8, 16
INPUT = PATH_SIZE + WORD_SIZE + FORM_SIZE
ROUNDS, BATCH, RATE, SEED = 5, 32, 0.02, 7
#: Blocks of a sequence in training; a page is learnt from whole, in as many sequences as it takes.
TRAIN_STEPS = 64
#: Pages and steps times pages of one pass; a page of more steps goes alone.
PASS_PAGES, PASS_CELLS = 128, 65_536

#: A comment, declaration or tag. As HTML has it, quotes matter only where a value begins, so one inside an unquoted value or a name ends nothing and hides nothing.
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]++)?)?+)*+)(?:>|\Z))""", re.DOTALL)
NAMED = re.compile(r"""(?:^|[\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Elements whose content is not text of the page.
OPAQUE = {"script", "style", "template", "textarea", "title", "iframe", "select", "head"}
RAW = {"script", "style", "textarea", "title", "iframe"}
#: What a head can hold; anything else ends one that is open. So does any block in a select.
IN_HEAD = {"base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
IN_SELECT = {"option", "optgroup", "hr", "script", "template"}
#: Elements within which all others are inline.
FOREIGN = {"math", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "object", "q", "rp", "rt", "ruby", "s", "samp", "select", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr"}
#: Elements that the start of some others closes.
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "section", "article", "aside", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "main", "figure", "dl", "hr"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
OUTSIDE = re.compile(r"\b(nav|navbar|navigation|menu|header|masthead|banner|footer|aside|sidebar|widget|form|button|dialog|advert|advertisement|ads?|sponsored|promo|promotion|cookie|cookies|consent|notice|popup|modal|newsletter|subscribe|breadcrumbs?|pagination|pager|share|social|related|recommended|comments?|comment-list|replies|reply|respond|disqus|copyright|toolbar|search|login|signup|legal|skip|tags|meta|byline)\b|^(ad|advert|comment|sidebar|menu|nav|footer|header|cookie|promo|sponsor|related|share|social|widget)[-_]|[-_](ad|ads|nav|menu|sidebar|footer|comments?|notice|banner|widget|promo)$", re.IGNORECASE)
INSIDE = re.compile(r"^(article|main)$|\b(article|main|content|post|entry|story|body-text|article-body|post-content|entry-content)\b", re.IGNORECASE)


class Path:
    """The open elements about a block, each as name, classes, ids and role; equal ones under one parent are one, and each knows what holds of all above it."""

    __slots__ = ("label", "parent", "within", "outside", "inside", "own", "total")

    def __init__(self, label: str | None = None, parent: Path | None = None):
        self.label, self.parent, self.within, self.own, self.total = label, parent, {}, None, None
        self.outside = parent is not None and (parent.outside or any(map(OUTSIDE.search, label.split(" "))))
        self.inside = parent is not None and (parent.inside or bool(INSIDE.search(label)))

    def under(self, label: str) -> Path:
        made = self.within.get(label)
        if made is None:
            made = self.within[label] = Path(label, self)
        return made

    @classmethod
    def of(cls, labels) -> Path:
        path = cls()
        for label in labels:
            path = path.under(label)
        return path

    def __iter__(self) -> Iterator[str]:
        found, at = [], self
        while at.parent is not None:
            found.append(at.label)
            at = at.parent
        return reversed(found)


def blocks(page: str) -> list[tuple[Path, str, float]]:
    """(path, text, share of linked text) of each block with text. Every tag is read once, and takes as long however deep it lies."""
    out: list[tuple[Path, str, float]] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter = Counter()
    root = Path()
    parts: list[str] = []
    linked = opaque = at = 0

    def leave(name: str) -> None:
        """Close elements up to the innermost one of that name, which is open."""
        nonlocal opaque
        while True:
            gone, _ = stack.pop()
            opened[gone] -= 1
            opaque -= gone in OPAQUE
            if gone == name:
                return

    def text(piece: str) -> None:
        nonlocal linked
        if opaque and stack[-1][0] == "head" and piece.strip():
            leave("head")
        if not opaque and piece:
            parts.append(piece)
            if opened["a"]:
                linked += len(piece)

    def close() -> None:
        nonlocal linked
        if parts:
            whole = " ".join(html.unescape("".join(parts)).split())
            if whole:
                out.append((stack[-1][1] if stack else root, whole, min(1.0, linked / len(whole))))
        parts.clear()
        linked = 0

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        foreign = any(opened[x] for x in FOREIGN)
        inline = name in INLINE or foreign
        if m[1]:
            if not inline:
                close()
            if opened[name]:
                leave(name)
            continue
        if opened["head"] and name not in IN_HEAD and not opened["template"] and not opened["noscript"]:
            leave("head")
        if name == "br":
            text(" ")
        if name == "br" or (name == "body" and opened["body"]):
            continue
        if not inline:
            if opened["select"] and name not in IN_SELECT:
                leave("select")
            close()
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                leave(stack[-1][0])
        if name in VOID or (foreign and m[3].endswith("/")):
            continue
        above = stack[-1][1] if stack else root
        if not inline:
            above = above.under(" ".join([name, *(x[0] or x[1] or x[2] for x in NAMED.findall(m[3]))]) if m[3] else name)
        stack.append((name, above))
        opened[name] += 1
        opaque += name in OPAQUE
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = len(page) if end is None else end.start()
    text(page[at:])
    close()
    return out


RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}


def own_labels(found: list[tuple[Path, str, float]]) -> np.ndarray | None:
    """What a page says of its blocks; None if it names no main element."""
    if not any(path.inside for path, _, _ in found):
        return None
    return np.array([path.inside and not path.outside for path, _, _ in found], np.float32)


def _slot(word: str, size: int) -> tuple[int, float]:
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(word)
    return h % size, 1.0 if h >> 40 & 1 else -1.0


def _word_slot(word: str) -> int:
    """The slot of a word, in the second half if its sign is negative."""
    slot, sign = _slot(word, WORD_SIZE)
    return slot if sign > 0 else slot + WORD_SIZE


def _label_vector(label: str) -> np.ndarray:
    out = np.zeros(PATH_SIZE, np.float32)
    for word in {label.lower(), *re.split(r"[^a-z0-9]+", label.lower())}:
        if word:
            k, sign = _slot(word, PATH_SIZE)
            out[k] += sign
    return out


#: Weights of the innermost elements; all further ones have the last.
NEAR, FAR = (1.0, 0.85, 0.7, 0.55), 0.4


class Vectors:
    def __init__(self):
        self.labels = Memo(_label_vector, 20_000)
        self.slots = Memo(_word_slot, 100_000)

    def path(self, path: Path) -> np.ndarray:
        """The elements' vectors, weighted by their distance from the block. Sums over all elements above are kept, so each element is added once."""
        above = []
        while path.total is None and path.parent is not None:
            above.append(path)
            path = path.parent
        if path.total is None:
            path.own = path.total = np.zeros(PATH_SIZE, np.float32)
        for path in reversed(above):
            path.own = self.labels[path.label]
            path.total = path.parent.total + path.own
        out, at = FAR * path.total, path
        for weight in NEAR:
            out = out + (weight - FAR) * at.own
            at = at.parent or at
            if at.parent is None:
                break
        return out

    def of(self, found: list) -> np.ndarray:
        out = np.zeros((len(found), INPUT), np.float32)
        for k, (path, text, linked) in enumerate(found):
            out[k, :PATH_SIZE] = self.path(path if isinstance(path, Path) else Path.of(path))
            words = text.lower().split(" ")
            counts = np.bincount([self.slots[word] for word in words], minlength=2 * WORD_SIZE)
            out[k, PATH_SIZE : PATH_SIZE + WORD_SIZE] = (counts[:WORD_SIZE] - counts[WORD_SIZE:]) / len(words)
            n = len(text)
            out[k, PATH_SIZE + WORD_SIZE :] = (np.log1p(n) / 8, linked, min(1.0, sum(map(text.count, ".!?")) / 5), text[-1] in ".!?\"”»", "©" in text, k / len(found), n < 25, 1.0)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over sequences of block vectors, with its training."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"{side}{name}": value for side in "fb" for name, value in (("x", scale(INPUT, 4 * HIDDEN)), ("h", scale(HIDDEN, 4 * HIDDEN)), ("c", np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)))}
        self.p |= {"o": scale(2 * HIDDEN + INPUT, 1)[:, 0], "k": np.zeros(1, np.float32)}

    def _pass(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states (steps, batch, HIDDEN) of x (steps, batch, INPUT), and what their gradient needs if it is to be kept; a step whose mask is 0 leaves the state as it was."""
        steps, batch, _ = x.shape
        given = x @ self.p[side + "x"] + self.p[side + "c"]
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out, kept = np.zeros((steps, batch, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[side + "h"]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new, m = f * c + i * g, mask[t][:, None]
            tanh = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, tanh, m))
            c = np.where(m > 0, new, c)
            h = np.where(m > 0, o * tanh, h)
            out[t] = h
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        joined = np.concatenate([self._pass("f", x, mask, False)[0], self._pass("b", x, mask, False)[0], x], axis=2)
        return joined @ self.p["o"] + self.p["k"][0]

    def _back(self, side: str, x: np.ndarray, kept: list, d_out: np.ndarray, grad: dict) -> None:
        dh_next = dc_next = np.zeros(d_out.shape[1:], np.float32)
        dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        for t, h, c, i, f, o, g, tanh, m in reversed(kept):
            dh = d_out[t] + dh_next
            dc = dc_next + dh * m * o * (1 - tanh * tanh)
            step = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)], axis=1) * m
            dz[t] = step
            grad[side + "h"] += h.T @ step
            dh_next = step @ self.p[side + "h"].T + dh * (1 - m)
            dc_next = np.where(m > 0, dc * f, dc_next)
        grad[side + "x"] += np.einsum("tbi,tbj->ij", x, dz, optimize=True)
        grad[side + "c"] += dz.sum(axis=(0, 1))

    def gradient(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        forward, kept_f = self._pass("f", x, mask)
        backward, kept_b = self._pass("b", x, mask)
        joined = np.concatenate([forward, backward, x], axis=2)
        p = sigmoid(joined @ self.p["o"] + self.p["k"][0])
        total = mask.sum()
        loss = -float((mask * (labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7))).sum() / total)
        d = ((p - labels) * mask / total).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"], grad["k"] = np.einsum("tb,tbi->i", d, joined), np.array([d.sum()], np.float32)
        spread = d[:, :, None] * self.p["o"]
        self._back("f", x, kept_f, spread[:, :, :HIDDEN], grad)
        self._back("b", x, kept_b, spread[:, :, HIDDEN : 2 * HIDDEN], grad)
        return loss, grad

    def train(self, sequences: list[np.ndarray], labels: list[np.ndarray]) -> None:
        rng = np.random.default_rng(SEED)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(ROUNDS):
            order = rng.permutation(len(sequences))
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                x, mask = padded([sequences[i] for i in part])
                y, _ = padded([labels[i][:, None] for i in part])
                _, grad = self.gradient(x, mask, y[:, :, 0])
                step += 1
                for name, g in grad.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] = self.p[name] - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)

    def main_text(self, pages: list[list], vectors: Vectors) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out = [np.zeros(len(found), bool) for found in pages]
        order = sorted((k for k, found in enumerate(pages) if found), key=lambda k: len(pages[k]))
        while order:
            n = 1
            while n < min(len(order), PASS_PAGES) and (n + 1) * len(pages[order[n]]) <= PASS_CELLS:
                n += 1
            part, order = order[:n], order[n:]
            scores = self.scores(*padded([vectors.of(pages[k]) for k in part]))
            for b, k in enumerate(part):
                out[k][:] = scores[: len(pages[k]), b] >= 0
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, batch, ...) with zeros after the end of each sequence, and a mask of what is in them."""
    steps = max(map(len, sequences))
    x, mask = np.zeros((steps, len(sequences), sequences[0].shape[1]), np.float32), np.zeros((steps, len(sequences)), np.float32)
    for k, s in enumerate(sequences):
        x[: len(s), k], mask[: len(s), k] = s, 1
    return x, mask


#: Names that pages commonly give to what is and is not the main text (fixed values).
MAIN_NAMES = ["div content", "div main-content", "div post", "div entry-content", "section story", "div article-body", "main", "article", "div post-content", "div body-text"]
OTHER_NAMES = ["aside", "div sidebar", "div comments", "section comments", "div comment", "ul menu", "nav", "header", "div header", "footer", "div footer", "div cookie-notice", "div notice", "div ad", "div advert", "div banner", "form", "form newsletter", "div related", "div share", "div promo", "div widget", "div popup", "div breadcrumbs", "div reply", "div sponsored"]
MAIN = re.compile(r"^(article|main)\b")


def changed(found: list, labels: np.ndarray, rng: np.random.Generator) -> tuple[list, np.ndarray]:
    """A page's blocks with its main element renamed, path names left out, and other blocks put in."""
    name = MAIN_NAMES[rng.integers(len(MAIN_NAMES))]
    words = " ".join(text for _, text, _ in found).split()
    out, marks, root, renamed = [], [], Path(), {}

    def rename(path: Path) -> Path:
        above = []
        while path.parent is not None and path not in renamed:
            above.append(path)
            path = path.parent
        made = renamed.get(path, root)
        for path in reversed(above):
            main = MAIN.match(path.label)
            if main or rng.random() > 0.05:
                made = made.under(name if main else path.label)
            renamed[path] = made
        return made

    def other() -> None:
        start = int(rng.integers(len(words)))
        text = " ".join(words[start : start + int(rng.integers(1, 40))])
        around = root.under("html").under("body")
        around = around.under(name) if rng.random() < 0.4 else around
        kind = OTHER_NAMES[rng.integers(len(OTHER_NAMES))]
        inner = [(), ("p",), ("ul", "li"), ("div",), ("h3",), ("div", "p")][rng.integers(6)]
        for _ in range(int(rng.integers(1, 5))):
            path = around.under(kind)
            for label in inner:
                path = path.under(label)
            out.append((path, text, float(rng.random() < 0.3)))
            marks.append(0.0)

    for (path, text, linked), mark in zip(found, labels, strict=True):
        if rng.random() < 0.15:
            other()
        out.append((rename(path), text, linked))
        marks.append(mark)
    if rng.random() < 0.5:
        other()
    return out, np.array(marks, np.float32)


def train(pages: list[str]) -> Labeller | None:
    rng, vectors, sequences, labels = np.random.default_rng(SEED), Vectors(), [], []
    for page in pages:
        found = blocks(page)
        own = own_labels(found)
        if own is None:
            continue
        for form in [(found, own), changed(found, own, rng), changed(found, own, rng)]:
            made = vectors.of(form[0])
            for start in range(0, len(made), TRAIN_STEPS):
                sequences.append(made[start : start + TRAIN_STEPS])
                labels.append(form[1][start : start + TRAIN_STEPS])
    if not sequences:
        return None
    labeller = Labeller()
    labeller.train(sequences, labels)
    return labeller


def sampled(pages: DataFrame, id_column: str, html_column: str) -> list[str]:
    """The html of the `SAMPLE` different rows with the smallest hashes of id and html. Only rows in the lowest share of the hashes' range, in which about twice as many are awaited, are sent on by each task; where too few are there, the share grows."""
    known = pages.where(F.col(html_column).isNotNull()).select(F.shiftrightunsigned(F.xxhash64(id_column, F.lit("sample")), 1).alias("h"), F.xxhash64(html_column).alias("g"), F.col(html_column).alias("html"))
    share = 2 * SAMPLE / max(1, known.select("h").count())
    while True:
        low = known.where(F.col("h") < F.lit(min(share, 1.0)) * F.lit(2.0**63)) if share < 1 else known
        found = low.groupBy("h", "g").agg(F.count("*")).orderBy("h", "g").limit(SAMPLE).collect()
        if len(found) == SAMPLE or share >= 1:
            break
        share *= 4
    if not found:
        return []
    last = found[-1]
    rows = low.where((F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("g") <= last.g))).groupBy("h", "g").agg(F.first("html").alias("html")).collect()
    return [r.html for r in sorted(rows, key=lambda r: (r.h, r.g))]


def fit(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> Labeller | None:
    """A labeller trained on a bounded sample of pages."""
    return train(sampled(pages, id_column, html_column))


def extract(page: str, labeller: Labeller | None, vectors: Vectors) -> str:
    return extract_all([page], labeller, vectors)[0]


def extract_all(pages: list[str], labeller: Labeller | None, vectors: Vectors) -> list[str]:
    found = [blocks(page) for page in pages]
    kept = [np.array([not path.outside for path, _, _ in f], bool) for f in found] if labeller is None else labeller.main_text(found, vectors)
    return ["\n".join(text for (_, text, _), keep in zip(f, k, strict=True) if keep) for f, k in zip(found, kept, strict=True)]


def _extract(labeller: Labeller | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = extract_all([x or "" for x in part.column(2).to_pylist()], labeller, vectors)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return run


def extract_pages(pages: DataFrame, labeller: Labeller | None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars)."""
    source = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    ids = pages.schema[id_column].dataType.simpleString()
    return source.mapInArrow(_extract(labeller), f"id {ids}, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
