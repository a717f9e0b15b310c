"""HTML extraction: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, the runs of text between block-level tags. Each has features of its ancestor tags and classes and of its
text; a chain over the blocks of a page labels them content or not. Weights are trained by stochastic gradient on labelled pages, with
exact marginals from forward and backward passes; decoding is Viterbi's.

Pages are labelled by the documents table: where the url names a document, blocks whose words are in that document are content.
The training sample is bounded by TRAIN_PAGES.

Defined cases: a null page gives a null text; an empty page, or one without a block, gives an empty text; broken, unclosed or
endless markup is read to its end; without any labelled page all blocks are content; of equal scores "not content" is chosen; repeated rows
are extracted alike; an empty table gives an empty result; pages of any length and depth are read whole, in time in proportion to their
length; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

DIM = 1 << 13
#: Bound of the training sample: about so many labelled pages, chosen by a hash of page_id.
TRAIN_PAGES = 400
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea svg".split())
_TITLE_END = re.compile(r"</title|</head|<body", re.I | re.A)
#: Raw elements whose content is a program: unclosed, they take the rest of the page; the others end behind their opening tag.
_PROGRAM = frozenset("script style".split())
_IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"\w+")


@dataclass
class Block:
    path: tuple[frozenset[int], tuple[str, ...]]  # features of all ancestor tags, and the three innermost ones with their classes
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks in order. A tag ends at the next '>'; comments, scripts and the head are left out."""
    out: list[Block] = []
    stack: list[tuple[str, str, frozenset[int]]] = []  # tag, tag with classes, features of the tags down to it
    inside: Counter[str] = Counter()
    missing: set[str] = set()  # closing tags that don't follow any more
    parts: list[str] = []
    linked, links, pos, n = 0, 0, 0, len(page)
    head = skip = False

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block((stack[-1][2] if stack else frozenset(), tuple(x[1] for x in stack[-3:])), text, linked))
            parts, linked = [], 0

    def pop() -> str:
        name = stack.pop()[0]
        inside[name] -= 1
        return name

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos and not skip:
            parts.append(page[pos:at])
            if links:
                linked += at - pos
        if at == n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            if page.startswith(("!", "?"), at + 1) or closing:
                end = page.find(">", at)
                pos = n if end < 0 else end + 1
            else:  # a bare '<'
                if not skip:
                    parts.append("<")
                pos = at + 1
            continue
        end = page.find(">", m.end())
        if end < 0:
            break
        name, pos = m.group().lower(), end + 1
        if name not in ("head", "title"):  # the first tag that can't be in a head ends it
            skip = head = head and (name not in ("body", "html") if closing else name in _IN_HEAD)
        if name in _RAW and not closing:
            if page[end - 1] != "/":
                close = -1 if name in missing else _find_close(page, name, pos)
                if close < 0:
                    missing.add(name)
                if close < 0 and name in _PROGRAM:
                    break
                if close < 0:
                    continue
                end = page.find(">", close)
                pos = n if end < 0 else end + 1
            continue
        if name == "head":
            flush()
            head = skip = not closing
            continue
        if name == "title":
            flush()
            skip = head or not closing  # unclosed, it ends at the next tag
            m = None if closing or "title" in missing else _TITLE_END.search(page, pos)
            if not closing and not m:
                missing.add("title")
            if m and m.group().lower() == "</title":
                pos = m.start()
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in _INLINE:
            if name != "a" and not closing:
                continue
            continue
        flush()
        if name in _VOID:
            continue
        if closing:
            if inside[name]:
                while pop() != name:
                    pass
            links = 0
        else:
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                pop()
            found = _CLASS.findall(page, m.end(), end) if end - m.end() > 3 else ()
            above, own = stack[-1][2] if stack else frozenset(), _named("any", name)
            stack.append((name, name + "".join(" " + x.strip("\"'").lower() for x in found) if found else name, above if own in above else above | {own}))
            inside[name] += 1
    flush()
    return out


def _find_close(page: str, name: str, pos: int) -> int:
    """Where the next ``</name`` begins, whatever the case of its ASCII letters; -1 if there is none."""
    while (pos := page.find("</", pos)) >= 0 and page[pos + 2 : pos + 2 + len(name)].lower() != name:
        pos += 2
    return pos


def _id(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIM


@functools.lru_cache(50_000)
def path_features(path: tuple[frozenset[int], tuple[str, ...]]) -> tuple[int, ...]:
    """Ancestor tags, the two innermost ones, and the class words of the innermost three."""
    every, inner = path
    tags = [p.partition(" ")[0] for p in inner]
    out = every | {_id("in " + t) for t in tags[-1:]} | {_id("in2 " + "/".join(tags[-2:]))}
    for p in inner:
        out |= {_id("class " + w) for w in _WORDS.findall(p.partition(" ")[2])}
    return tuple(sorted(out))


@functools.lru_cache(50_000)
def _named(name: str, value: int | str) -> int:
    return _id(f"{name} {value}")


def text_features(b: Block, i: int, n: int) -> list[int]:
    t = b.text
    size = len(t)
    words = t.count(" ") + 1
    stops = t.count(".") + t.count(",") + t.count("!") + t.count("?")
    return [
        _named("size", size.bit_length()),
        _named("words", words.bit_length()),
        _named("link", min(4, 4 * b.linked // max(1, size))),
        _named("stops", min(8, 16 * stops // max(1, words))),
        _named("end", t[-1] in ".!?:;\"'"),
        _named("upper", t[0].isupper()),
        _named("mark", ("©" in t) * 4 + ("|" in t) * 2 + ("·" in t)),
        _named("place", 10 * i // n),
        _named("first", min(i, 3)),
        _named("last", min(n - 1 - i, 3)),
    ]


@dataclass
class Model:
    weights: np.ndarray  # DIM: of content against not content
    moves: np.ndarray  # 2 x 2
    start: np.ndarray  # 2

    def scores(self, found: list[Block]) -> list[float]:
        w, n = self.weights, len(found)
        return [float(sum(w[list(path_features(b.path))]) + sum(w[text_features(b, i, n)])) for i, b in enumerate(found)]


class Scorer:
    """Scores of blocks, the part of the ancestors kept by path."""

    def __init__(self, model: Model):
        self.w = model.weights.tolist()
        self.paths: dict[tuple[frozenset[int], tuple[str, ...]], float] = {}

    def __call__(self, found: list[Block]) -> list[float]:
        w, n, out = self.w, len(found), []
        for i, b in enumerate(found):
            s = self.paths.get(b.path)
            if s is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                s = self.paths[b.path] = sum([w[k] for k in path_features(b.path)])
            for k in text_features(b, i, n):
                s += w[k]
            out.append(s)
        return out


def viterbi(scores: list[float], moves: list[list[float]], start: list[float]) -> list[int]:
    """The labels (1: content) of greatest sum. A block's score counts where it is content; of equal sums 0 is chosen."""
    if not scores:
        return []
    (m00, m01), (m10, m11) = moves
    a, b = start[0], start[1] + scores[0]
    back: list[tuple[int, int]] = []
    for s in scores[1:]:
        x, y = a + m00, b + m10
        p, q = a + m01, b + m11
        back.append((int(y > x), int(q > p)))
        a, b = (y if y > x else x), (q if q > p else p) + s
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def marginals(node: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """By forward and backward passes: log of the sum over all labellings, probabilities of the labels (blocks x 2), and of the labels of neighbours (blocks - 1 x 2 x 2)."""
    n = len(node)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = start + node[0]
    for i in range(1, n):
        alpha[i] = np.logaddexp(alpha[i - 1, 0] + moves[0], alpha[i - 1, 1] + moves[1]) + node[i]
    for i in range(n - 2, -1, -1):
        step = moves + node[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(step[:, 0], step[:, 1])
    z = np.logaddexp(*alpha[-1])
    return float(z), np.exp(alpha + beta - z), np.exp(alpha[:-1, :, None] + moves + (node + beta)[1:, None, :] - z)


def fit(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4) -> Model:
    """AdaGrad on the log-likelihood; a page is the features and the labels of its blocks."""
    w, moves, start = np.zeros(DIM), np.zeros((2, 2)), np.zeros(2)
    gw, gm, gs = np.full(DIM, 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(pages)):
            found, labels = pages[k]
            if not found:
                continue
            n, y = len(found), np.array(labels)
            node = np.zeros((n, 2))
            node[:, 1] = [w[f].sum() for f in found]
            _, p, pair = marginals(node, moves, start)
            d = y - p[:, 1]
            rows = np.repeat(np.arange(n), [len(f) for f in found])
            flat = np.concatenate([np.asarray(f) for f in found])
            ids, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, weights=d[rows]) - l2 * w[ids]
            gw[ids] += g * g
            w[ids] += rate * g / np.sqrt(gw[ids])
            if n > 1:
                g = -pair.sum(0)
                np.add.at(g, (y[:-1], y[1:]), 1)
                gm += g * g
                moves = moves + rate * g / np.sqrt(gm)
            g = -p[0]
            g[y[0]] += 1
            gs += g * g
            start = start + rate * g / np.sqrt(gs)
    return Model(w, moves, start)


def label(found: list[Block], document: str, anchor: int = 5) -> list[int] | None:
    """1 for the blocks whose words are, in order, in the document. Blocks of fewer than ``anchor`` words, which may be there by chance,
    count only between longer ones that do. None if there is no longer one: such a page tells nothing."""
    words = " " + " ".join(_WORDS.findall(document)) + " "
    own = [_WORDS.findall(b.text) for b in found]
    there = [bool(w) and " " + " ".join(w) + " " in words for w in own]
    anchors = [i for i, (w, t) in enumerate(zip(own, there, strict=True)) if t and len(w) >= anchor]
    return [int(t and anchors[0] <= i <= anchors[-1]) for i, t in enumerate(there)] if anchors else None


def labelled_pages(pages: DataFrame, docs: DataFrame, rows: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, html, document) of about ``rows`` pages whose url ends in a language and a doc_id."""
    named = pages.where(F.col("html").isNotNull()).withColumn("named", F.regexp_extract("url", "/[a-z]{2}/([0-9]{1,18})(?![0-9])", 1)).where("named <> ''")
    n = named.count()
    sample = named.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(1, n))))
    sample = sample.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), F.col("named").cast("long").alias("named"))
    texts = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("named"), docs["text"].cast("string").alias("document"))
    texts = texts.join(F.broadcast(sample.select("named").distinct()), "named", "left_semi")  # about ``rows`` ids are sent around, no pages
    return texts.join(sample, "named").select("page_id", "html", "document")


def train(pages: DataFrame, docs: DataFrame, rows: int = TRAIN_PAGES) -> Model | None:
    got = []
    for r in sorted(labelled_pages(pages, docs, rows).collect(), key=lambda r: (r[0] if r[0] is not None else -1, r[2])):
        found = blocks(r[1])
        if labels := label(found, r[2]):
            got.append(([[*path_features(b.path), *text_features(b, i, len(found))] for i, b in enumerate(found)], labels))
    return fit(got) if got else None


def extract(pages: DataFrame, docs: DataFrame, rows: int = TRAIN_PAGES) -> DataFrame:
    """page_id, text of the content blocks (a line each), and how many blocks there are and are content; one narrow pass after training."""
    arrow_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(train(pages, docs, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        score = Scorer(m) if m else None
        moves, start = (m.moves.tolist(), m.start.tolist()) if m else ([], [])
        for batch in batches:
            text, total, content = [], [], []
            for page in batch.column(1).to_pylist():
                if page is None:
                    text.append(None)
                    total.append(None)
                    content.append(None)
                    continue
                found = blocks(page)
                keep = viterbi(score(found), moves, start) if score else [1] * len(found)
                text.append("\n".join(b.text for b, k in zip(found, keep, strict=True) if k))
                total.append(len(found))
                content.append(sum(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(total, pa.int64()), pa.array(content, pa.int64())], names=["page_id", "text", "n_blocks", "n_content"])

    return pages.select(pages["page_id"].cast("long"), pages["html"].cast("string")).mapInArrow(run, "page_id long, text string, n_blocks long, n_content long")
