"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins (quantiles of the fit sample). Boosting goes round the
features in turn: each step fits a tree of at most three leaves to the current gradient, on that
feature's histogram alone, and adds a small multiple of it to the feature's lookup table. Then the
pairs whose 2-d histogram explains most of what is left are boosted in the same way, with trees of
one cut on either axis (four leaves). A text's log-odds is the sum of its table entries, so scoring
is one vectorised table read per feature and pair.

Fitting uses a bounded sample of labelled rows (``max_rows``, chosen by a hash of the id); scoring
reads every whole text once in ``mapInArrow``, without a shuffle.

Defined cases: null text counts as empty; an empty text has a score as any other (its bins are those
of zero features); no labelled row, or one class only -> the constant prior; several labels of a
document -> their mean; repeated rows are scored alike; clashing column names are replaced.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import by_size, code_points, map_batches

#: Bound of the fit: labelled rows used.
MAX_ROWS = 12_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, L2 = 32, 150, 80, 8, 0.1, 5.0

FEATURES = ("chars", "words", "word_len", "upper", "digit", "symbol", "punct", "bang", "unique_words",
            "top_word", "repeat_lines", "line_len", "short_words", "alpha_words", "longest_word",
            "unique_pairs", "non_ascii", "stops", "caps_words", "odd_ends")
SPACES, LOWER, UPPER, LETTER, DIGIT, PUNCT, SYMBOL = range(7)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Code point -> one of the character kinds above."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))
        if g[0] == "L":
            out[c] = LOWER if g == "Ll" else UPPER if g == "Lu" else LETTER
        elif g[0] == "N":
            out[c] = DIGIT
        elif g[0] == "Z" or 9 <= c <= 13:
            out[c] = SPACES
    for ch in ".,;:'\"()?-":
        out[ord(ch)] = PUNCT
    return out


def features(text: str | None) -> list[float]:
    text = text or ""
    cp = code_points(text)
    n = np.bincount(kinds()[cp], minlength=7) if len(cp) else np.zeros(7, int)
    solid = max(1, int(n.sum() - n[SPACES]))
    letters = max(1, int(n[LOWER] + n[UPPER] + n[LETTER]))
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), int, len(words)) if words else np.zeros(1, int)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct_pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(cp)), np.log1p(len(words)), float(lengths.mean()), n[UPPER] / letters, n[DIGIT] / solid,
        n[SYMBOL] / solid, n[PUNCT] / solid, text.count("!") / w, len(counts) / w,
        (max(counts.values()) if counts else 0) / w, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))), float((lengths <= 3).sum()) / w,
        sum(map(str.isalpha, words)) / w, np.log1p(float(lengths.max())),
        distinct_pairs / max(1, len(words) - 1), float((cp > 127).sum()) / solid,
        (text.count(". ") + text.count(".\n")) / w, sum(map(str.isupper, words)) / w,
        sum(1 for x in words if not (x[-1].isalnum() or x[-1] in ".,;:?")) / w,
    ]


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int, rate: float, l2: float) -> np.ndarray:
    """Values of a greedy tree over ordered bins: gradient sums ``g``, curvature sums ``h``."""
    cg, ch = np.concatenate(([0.0], g.cumsum())), np.concatenate(([0.0], h.cumsum()))
    edges = [0, len(g)]
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = (cg[cut] - cg[a]) ** 2 / (ch[cut] - ch[a] + l2) + (cg[b] - cg[cut]) ** 2 / (ch[b] - ch[cut] + l2) - gain_of(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(cut[k]))
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = rate * (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Best four-leaf table of one cut on each axis of a 2-d histogram, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a = cg[:-1, :-1], ch[:-1, :-1]
    b = cg[:-1, -1:] - a[0], ch[:-1, -1:] - a[1]
    c = cg[-1:, :-1] - a[0], ch[-1:, :-1] - a[1]
    d = tg - a[0] - b[0] - c[0], th - a[1] - b[1] - c[1]
    gain = sum(x * x / (y + l2) for x, y in (a, b, c, d)) - tg * tg / (th + l2)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for (rows, cols), (x, y) in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                     (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))),
                                    (a, b, c, d), strict=True):
        out[rows, cols] = x[i, j] / (y[i, j] + l2)
    return float(gain[i, j]), out


class Additive:
    """Bin edges, one table per feature and per chosen pair, and the intercept."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.base)
        for table, b in zip(self.tables, at, strict=True):
            out += table[b]
        for i, j, table in self.pairs:
            out += table[at[i], at[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of one-feature trees, then of the most useful pairs."""
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Additive([np.empty(0) for _ in FEATURES], base)
    cuts = np.arange(1, BINS) / BINS
    model = Additive([np.unique(np.quantile(x[:, k], cuts)) for k in range(x.shape[1])], base)
    at = model.bins(x)
    f = np.full(len(y), base)
    for _ in range(ROUNDS):
        for k, b in enumerate(at):
            p = 1 / (1 + np.exp(-f))
            m = len(model.tables[k])
            step = _leaves(np.bincount(b, y - p, m), np.bincount(b, p * (1 - p), m), 3, RATE, L2)
            model.tables[k] += step
            f += step[b]
    sizes = [len(t) for t in model.tables]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        flat, shape = at[i] * sizes[j] + at[j], (sizes[i], sizes[j])
        n = shape[0] * shape[1]
        return np.bincount(flat, y - p, n).reshape(shape), np.bincount(flat, p * (1 - p), n).reshape(shape)

    ranked = sorted(((_quarters(*grid(i, j), L2)[0], i, j) for i, j in combinations(range(len(sizes)), 2)), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            _, step = _quarters(*grid(i, j), L2)
            table += RATE * step
            f += RATE * step[at[i], at[j]]
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_size(batches):
        x = [features(t) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))],
                                         names=[*b.schema.names[:-1], "x"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_rows: int = MAX_ROWS) -> Additive:
    """Fit on at most ``max_rows`` labelled ids; only their rows leave the scan. An id that repeats counts as
    one document, that whose text has the smallest hash."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.avg(F.col(label).cast("double")).alias("y"))
    picked = known.orderBy(F.xxhash64("k"), "k").limit(max_rows).collect()
    if not picked:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    few = spark.createDataFrame([(int(r["k"]), float(r["y"])) for r in picked], "k long, y double")
    mine = (docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
            .join(F.broadcast(few), "k"))  # at most max_rows rows are broadcast
    one = mine.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("row")).select("k", "y", "row.t")
    rows = map_batches(one, _feature_batches, "k long, y double, x array<double>").collect()
    rows.sort(key=lambda r: r["k"])
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows]))


def score(df: DataFrame, model: Additive, text: str = "text", threshold: float = 0.3,
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``df`` with the score and the decision in ``names``, replacing columns of these names; no shuffle."""
    keep = [c for c in df.columns if c.lower() not in names]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bins x features and pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            x = np.array([features(t) for t in b.column(b.num_columns - 1).to_pylist()]).reshape(-1, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                names=[*b.schema.names[:-1], *names])

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = source.drop("__text").schema.add(names[0], "double").add(names[1], "integer")
    return map_batches(source, run, schema)
