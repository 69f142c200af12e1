"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks, the runs of text between tags that start or end a block. Each block has
features of its ancestors (tags, the words of their class, id and role) and of its text (length, links,
closing mark, copyright sign, place). The field scores each block as article or not and each step from
one block to the next; Viterbi finds the best labelling of the whole page. It is trained by the gradient
of the log-likelihood (forward-backward, AdaGrad) on a fixed number of labelled pages of ``html_pages``;
training never sees the table that is extracted, so every page is scored by the same model.

Scripts, styles, comments, the head and other raw elements never become text. Character references are
decoded, white space in a block becomes one space, blocks are joined by a line feed. Pages are processed
whole, in ``mapInArrow``, without a shuffle.

Defined cases: null or empty html, or no block kept -> empty text; unclosed and stray tags are tolerated
as browsers do (a block start ends an open paragraph, an end tag closes what is open inside it); a page of
plain text is one block; repeated rows are extracted alike; clashing column names are replaced.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import html_pages
from revlens.llm.common import by_size, map_batches

#: Bound of the fit: labelled pages, passes over them.
TRAIN_PAGES, PASSES = 1500, 6

RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|title|canvas|audio|video|xmp|noframes"
#: An svg or math element whose start tag closes itself holds nothing; the slash of other raw elements means nothing.
ALONE = r"""<(?P<alone>svg|math)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*/>"""
TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|{ALONE}|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>"']|"[^"]*"|'[^']*')*)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
BLOCKS = frozenset("""html head body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre article
section header footer nav aside main form fieldset legend label button select option optgroup figure figcaption address hr details summary
center ins menu dialog search hgroup""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a start tag ends if it is the innermost open block of that kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table body html article section div main aside nav".split())
TELLING = frozenset("article main nav header footer aside form section menu".split())
HEAD_ONLY = frozenset("html head meta link base".split())

Block = tuple[str, list[str]]


class Leaves:
    """Collects the leaf blocks of a page with their features."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.text: list[str] = []
        self.linked = self.all = 0
        self.links = 0
        self.out: list[tuple[str, list[str]]] = []
        self.path: set[str] = set()
        self.own = "none"

    def words(self, s: str) -> None:
        if not s:
            return
        solid = len(s) - s.count(" ")
        if solid and not self.all:
            self.path = {f for _, fs in self.stack for f in fs}
            # once more for the innermost element that says what it is
            inner = next((fs for _, fs in reversed(self.stack) if len(fs) > 1 or fs[0][4:] in TELLING), ())
            self.path.update("in:" + f for f in inner)
            self.own = self.stack[-1][0] if self.stack else "none"
        self.text.append(s)
        self.all += solid
        self.linked += solid if self.links else 0

    def flush(self) -> None:
        if self.text:
            text = " ".join(references.unescape("".join(self.text)).split())
            if text:
                self.out.append((text, [*self.path, "own:" + self.own, *shape(text, self.linked / max(1, self.all))]))
            self.text, self.all, self.linked = [], 0, 0

    def start(self, tag: str, attr: str) -> None:
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.text.append(" ")
        if tag not in BLOCKS:
            return
        self.flush()
        while self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in ENDS.get(tag, ()):
                del self.stack[k:]
                break
            if self.stack[k][0] in BARRIER:
                break
        self.links = 0
        if tag not in VOID:
            self.stack.append((tag, ("tag:" + tag, *names(attr))))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in BLOCKS:
            return
        self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break


@lru_cache(maxsize=50_000)
def names(attr: str) -> tuple[str, ...]:
    """Features of a tag's class, id, role and hiding attributes."""
    out = []
    for m in ATTRIBUTE.finditer(attr):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind in ("hidden", "aria-hidden"):
            out += ["name:hidden"] if value != "false" else []
        elif kind == "style":
            out += ["name:hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
        else:
            out += ["name:" + (w[:-1] if len(w) > 3 and w.endswith("s") else w) for w in NAME_WORD.findall(value)]
    return tuple(dict.fromkeys(out))


def shape(text: str, linked: float) -> list[str]:
    """Features of a block's text."""
    n = text.count(" ") + 1
    return [f"size:{min(6, int(math.log2(n)))}", f"link:{min(3, int(linked * 4))}", "stop" if text[-1] in ".!?…:;\"”)" else "open",
            *(["copyright"] if "©" in text or "(c)" in text.lower() else [])]


def leaf_blocks(page: str) -> list[Block]:
    """Text and features of every leaf block, in page order."""
    leaves, at, body = Leaves(), 0, "<body" not in page.lower() and "<head" not in page.lower()
    for m in TOKEN.finditer(page):
        if body and m.start() > at:
            leaves.words(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if body and (m["raw"] or m["alone"]):
                leaves.words(" ")
            continue
        ends = m["end"] or m["end2"]
        if not body and (tag == "body" or tag == "head" and ends or tag not in HEAD_ONLY):
            body = True
        if ends:
            leaves.end(tag)
        else:
            leaves.start(tag, m["attr"] or "")
    if body and at < len(page):
        leaves.words(page[at:])
    leaves.flush()
    n = len(leaves.out)
    return [(t, [*f, *(["first"] if k == 0 else []), *(["last"] if k == n - 1 else [])]) for k, (t, f) in enumerate(leaves.out)]


class Field:
    """Weights: score of 'article' for each feature, and of each step between labels."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {"": 0.0}
        self.step = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, blocks: list[Block]) -> list[float]:
        w = self.weight
        return [w[""] + sum(w.get(f, 0.0) for f in fs) for _, fs in blocks]

    def viterbi(self, scores: list[float]) -> list[int]:
        """Best labelling of the whole page; label 0 scores 0, label 1 the block's score."""
        t, (a, b), back = self.step, (0.0, 0.0), []
        for k, s in enumerate(scores):
            if k == 0:
                a, b = 0.0, s
                continue
            to0, to1 = (a + t[0][0], b + t[1][0]), (a + t[0][1], b + t[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] >= to1[0])))
            a, b = max(to0), max(to1) + s
        if not scores:
            return []
        out = [int(b > a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Probability of label 1 at each block, and expected number of each step."""
        t = [[math.exp(x) for x in row] for row in self.step]
        node = [(1.0, math.exp(max(-30.0, min(30.0, s)))) for s in scores]
        ahead: list[tuple[float, float]] = []
        for k, (u, v) in enumerate(node):
            a, b = (u, v) if k == 0 else ((ahead[-1][0] * t[0][0] + ahead[-1][1] * t[1][0]) * u, (ahead[-1][0] * t[0][1] + ahead[-1][1] * t[1][1]) * v)
            ahead.append((a / (a + b), b / (a + b)))
        after = [(1.0, 1.0)] * len(node)
        for k in range(len(node) - 2, -1, -1):
            x, y = node[k + 1][0] * after[k + 1][0], node[k + 1][1] * after[k + 1][1]
            a, b = t[0][0] * x + t[0][1] * y, t[1][0] * x + t[1][1] * y
            after[k] = (a / (a + b), b / (a + b))
        one, steps = [], [[0.0, 0.0], [0.0, 0.0]]
        for (a, b), (c, d) in zip(ahead, after, strict=True):
            one.append(b * d / (a * c + b * d))
        for k in range(len(node) - 1):
            p = [[ahead[k][i] * t[i][j] * node[k + 1][j] * after[k + 1][j] for j in (0, 1)] for i in (0, 1)]
            z = sum(map(sum, p))
            for i in (0, 1):
                for j in (0, 1):
                    steps[i][j] += p[i][j] / z
        return one, steps


def train_field(pages: list[tuple[list[Block], list[int]]], passes: int = PASSES, rate: float = 0.3, l2: float = 1e-4) -> Field:
    """Maximum likelihood by AdaGrad, a page at a time."""
    field, rng = Field(), random.Random(3)
    past: dict[str, float] = {}
    past_step = [[1e-6, 1e-6], [1e-6, 1e-6]]
    for _ in range(passes):
        rng.shuffle(pages)
        for blocks, labels in pages:
            if not blocks:
                continue
            one, steps = field.marginals(field.scores(blocks))
            gradient: dict[str, float] = {}
            for (_, fs), y, p in zip(blocks, labels, one, strict=True):
                for f in (*fs, ""):
                    gradient[f] = gradient.get(f, 0.0) + y - p
            for f, g in gradient.items():
                g -= l2 * field.weight.get(f, 0.0)
                past[f] = past.get(f, 1e-6) + g * g
                field.weight[f] = field.weight.get(f, 0.0) + rate * g / math.sqrt(past[f])
            for a, b in zip(labels, labels[1:], strict=False):
                steps[a][b] -= 1.0
            for i in (0, 1):
                for j in (0, 1):
                    past_step[i][j] += steps[i][j] ** 2
                    field.step[i][j] -= rate * steps[i][j] / math.sqrt(past_step[i][j])
    return field


def labelled_blocks(n: int, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Training pages as blocks with labels; words of the article carry a mark that is cut off again."""
    mark, out = "", []
    for page in html_pages.labelled(n, seed):
        blocks = leaf_blocks("".join(t if kind is None else mark + t if kind else t for t, kind in page))
        out.append(([(t.replace(mark, ""), f) for t, f in blocks], [int(mark in t) for t, _ in blocks]))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES) -> Field:
    return train_field(labelled_blocks(pages))


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    return "\n".join(t for (t, _), y in zip(blocks, field.viterbi(field.scores(blocks)), strict=True) if y)


def extract(df: DataFrame, html: str = "html", field: Field | None = None) -> DataFrame:
    """``df`` without its html, with ``text`` and ``n_chars`` (code points)."""
    field = field or trained()
    keep = [c for c in df.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            texts = [main_text(p, field) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*b.schema.names[:-1], "text", "n_chars"])

    return map_batches(source, run, source.drop("__html").schema.add("text", "string").add("n_chars", "long"))
