"""Language ID by string kernels: blended-spectrum presence kernel, Nyström map, kernel ridge.

Two texts are compared by the n-grams (1 to 3 letters, every run of other characters read as one
space) that occur in both: ``k(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|)`` with S the *set* of
n-grams of the whole text. Up to three code points of 21 bits fit in 63 bits, so sets are exact
integers, no hashing. Landmark texts L give the Nyström map ``phi(x) = K(x, L) K(L, L)^-1/2``;
one ridge regression per language (target +1, all others -1) is solved on phi. At scoring time
both steps fold into one matrix A, and a batch of texts is scored by two matrix products:
(presence rows x landmark sets) x A.

Every label that occurs is learned, from a bounded sample (``per_language`` distinct texts a label, those of
smallest hash); copies of a text count once. Sample and landmarks are bounded in all too (``TEXTS``, ``MARKS``):
with more labels each has fewer, but one at least. Fitting costs the landmarks squared in driver memory and
cubed in time, which beyond ``MARKS`` labels are as many as the labels. Scoring reads every whole text in ``mapInArrow``, without a shuffle.

Defined cases: null text or no letter -> ``und`` with score 0; no labelled row at all -> every
text is ``und``; one language -> that language; equal scores -> the alphabetically first; rows
that repeat are scored alike; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import SPACE, by_size, code_points, letter_table, map_batches

UND = "und"
#: Bounds of the fit: labelled texts a language, landmarks among them. The number of languages has none.
PER_LANGUAGE, LANDMARKS = 250, 24
#: Bounds over all languages (one each at least): labelled texts, landmarks.
TEXTS, MARKS = 16_000, 1536
RIDGE = 1e-2
#: Texts a kernel block, and rows a block of the fit's sums.
BATCH, BLOCK = 64, 1024


def ngrams(text: str | None) -> np.ndarray:
    """The set of 1- to 3-grams of the whole text, as sorted integers; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    c = letter_table()[code_points(text)]
    if not (c != SPACE).any():
        return np.empty(0, np.int64)
    c = np.concatenate(([SPACE], c, [SPACE]))
    c = c[np.concatenate(([True], (c[1:] != SPACE) | (c[:-1] != SPACE)))]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.unique(np.concatenate((c, two, three)))


class LanguageModel:
    """Landmark n-grams, for each the landmarks that hold it, and the folded regression matrix.

    Landmarks ``holders[first[v]:first[v + 1]]`` hold n-gram ``vocab[v]``: the membership matrix without its
    zeros, as the whole one grows with the square of the languages."""

    def __init__(self, languages: list[str], marks: list[np.ndarray], weights: np.ndarray):
        self.languages, self.weights = languages, weights
        every = np.concatenate(marks) if marks else np.empty(0, np.int64)
        self.sizes = np.array([len(s) for s in marks], float)
        self.vocab, place = np.unique(every, return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.holders = np.repeat(np.arange(len(marks), dtype=np.int32), self.sizes.astype(np.int64))[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(self.vocab))))).astype(np.int64)

    def shared(self, s: np.ndarray) -> np.ndarray:
        """How many n-grams of a set each landmark holds."""
        at = np.searchsorted(self.vocab, s)
        at[at == len(self.vocab)] = 0
        at = at[self.vocab[at] == s]
        n = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.holders[places], minlength=len(self.sizes))

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Normalised presence kernel of each set with each landmark. It counts shared n-grams in whole
        numbers, so a text's row does not depend on its batch."""
        rows = np.zeros((len(sets), len(self.sizes)))
        sizes = np.ones(len(sets))
        for i, s in enumerate(sets):
            if len(s):
                rows[i] = self.shared(s)
                sizes[i] = len(s)
        return rows / np.sqrt(np.outer(sizes, self.sizes))

    def values(self, row: np.ndarray) -> np.ndarray:
        """Regression values of a kernel row, summed in one order; a block of languages at a time."""
        return np.concatenate([(row[:, None] * self.weights[:, k:k + BATCH]).sum(axis=0) for k in range(0, len(self.languages), BATCH)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), BATCH):
            sets = [ngrams(t) for t in texts[at:at + BATCH]]
            values = np.stack([self.values(row) for row in self.kernel(sets)]) if self.languages else np.zeros((len(sets), 1))
            best = values.argmax(axis=1)
            for i, s in enumerate(sets):
                known = len(s) > 0 and bool(self.languages)
                langs.append(self.languages[best[i]] if known else UND)
                if known:
                    scores[at + i] = min(1.0, max(0.0, (float(values[i, best[i]]) + 1) / 2))
        return langs, scores


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, marks_in_all: int = MARKS) -> LanguageModel:
    """Fit on (text, language) rows; the first ``landmarks`` of each language, or an even share of ``marks_in_all``
    if that is less, become landmarks."""
    pairs = [(s, lang) for text, lang in rows if len(s := ngrams(text))]
    by: dict[str, list[np.ndarray]] = {}
    for s, lang in pairs:
        by.setdefault(lang, []).append(s)
    languages = sorted(by)
    if not languages:
        return LanguageModel([], [], np.empty((0, 0)))
    share = min(landmarks, max(1, marks_in_all // len(languages)))
    marks = [s for lang in languages for s in by[lang][:share]]
    model = LanguageModel(languages, marks, np.empty((0, 0)))
    k_mm = model.kernel(marks)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    number = {lang: i for i, lang in enumerate(languages)}
    left, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages)))
    for i in range(0, len(pairs), BLOCK):
        part = pairs[i:i + BLOCK]
        phi = model.kernel([s for s, _ in part]) @ root
        y = np.full((len(part), len(languages)), -1.0)
        y[np.arange(len(part)), [number[lang] for _, lang in part]] = 1
        w = 1 / np.array([len(by[lang]) for _, lang in part], dtype=float)[:, None]  # each language weighs the same
        left += phi.T @ (phi * w)
        right += phi.T @ (y * w)
    model.weights = root @ np.linalg.solve(left + ridge / len(languages) * np.eye(len(left)) / len(languages), right)
    return model


def labelled_sample(df: DataFrame, text: str, label: str, per_language: int) -> list[tuple[str, str]]:
    """The ``per_language`` distinct texts of smallest hash of every label, in the order of hash and label.

    Only texts with a letter count. Labels and 128-bit hashes of the texts are made distinct and counted,
    a bound on the hash keeps about twice the sample of each label to be ranked, and the texts of the sample
    are then picked from the table: the sample depends on the set of (text, label) alone."""
    df = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("t"), F.col(label).alias("l")).where(F.col("t").rlike(r"\p{L}"))
    hashed = df.select("l", F.xxhash64("t", F.lit("sample")).alias("h"), F.xxhash64("t").alias("h2"), "t")
    known = hashed.select("l", "h", "h2").distinct()
    counts = known.groupBy(F.col("l").alias("cl")).agg(F.count(F.lit(1)).alias("n"))
    place = (F.col("h").cast("double") + 2.0 ** 63) / 2.0 ** 64  # even in 0 to 1
    few = known.join(F.broadcast(counts), F.col("l") == F.col("cl")).where(place * F.col("n") <= 2 * per_language + 100)
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "h2"))  # of about 2 * per_language rows
    picked = few.withColumn("i", first).where(F.col("i") <= per_language).select("l", "h", "h2")
    taken = hashed.join(F.broadcast(picked), ["l", "h", "h2"]).groupBy("l", "h", "h2").agg(F.min("t").alias("t")).collect()
    return [(r["t"], r["l"]) for r in sorted(taken, key=lambda r: (r["h"], r["l"], r["t"]))]


def identify(df: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with its language and the score in ``names``, replacing columns of these names; no shuffle."""
    keep = [c for c in df.columns if c.lower() not in names]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks x languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            langs, scores = shared.value.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*b.schema.names[:-1], *names])

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = source.drop("__text").schema.add(names[0], "string").add(names[1], "double")
    return map_batches(source, score, schema)


def train(df: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE,
          landmarks: int = LANDMARKS, texts_in_all: int = TEXTS, marks_in_all: int = MARKS) -> LanguageModel:
    """The model of ``df``'s labelled rows; labels are counted first, as an even share of ``texts_in_all`` bounds each."""
    labels = df.where(F.col(label).isNotNull()).select(F.col(label).alias("l")).distinct().count()
    share = min(per_language, max(1, texts_in_all // max(1, labels)))
    return fit(labelled_sample(df, text, label, share), landmarks, marks_in_all=marks_in_all)
