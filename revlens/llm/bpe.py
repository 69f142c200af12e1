"""BPE encoding of long text by tree concatenation, and decoding.

A text of more than ``LONG`` characters is cut in halves, at the word edge nearest behind the middle, down to
leaves of at most ``LONG``. A stretch without a word edge that is still longer (text without spaces) is
normalised and pre-split by the library, and its words of more than ``LEAF`` symbols are cut in halves
inside, down to ``LEAF``. Leaves are encoded alone: texts through the word table, symbols by the merge
table. Joins then go up the tree: the end of the left half and the beginning of the right one are encoded
again as one window, ``k`` words or tokens of each with ``k`` doubling, until the new window begins as the
left half's part of it begins and ends as the right half's ends. Beside a stretch cut inside, the word edge
itself is the end; there the halves are set side by side.

That agreement makes the result exact: a token sequence is the encoding of its text just if every two
neighbours in it are the encoding of theirs. Neighbours outside the window are, from the halves;
inside, from the new encoding; at its edges the agreeing token has its old neighbour.

A word edge is a single space that both vocabularies put in front of a word: any ASCII space where white
space is dropped, one between two characters that are white space in no engine where it is kept.

The leaves of a text are encoded in the task that reads it, those of a text of more than ``SPREAD``
characters as rows of their own in any task; the joins are the same.

Defined cases: null text counts as empty and has no token; a stretch without word edges over ``LONG`` that
holds a special token of the vocabulary is encoded whole by the library; repeated rows are encoded as often
as they occur; no rows -> no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import Scratch, map_batches, partitions
from revlens.llm.tokens import id_lists, slices
from revlens.llm.words import KEPT, WHITE, pieces, tokenizer

LONG, LEAF = 4096, 512  # characters of a leaf of text, symbols of a leaf inside a word
SPREAD = 1 << 16  # characters from which a text's leaves go to tasks of their own
TEXT, SYMBOLS, DONE = 0, 1, 2  # kinds of parts


class Merges:
    """The merge table of a vocabulary file, over ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[a], self.vocab[b]] = (k, self.vocab[a + b])

    def symbols(self, word: str) -> list[int]:
        """First ids of a pre-split word in the vocabulary's byte alphabet."""
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]] if word else []

    def merge(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Tokens and how many symbols each covers: lowest rank first, leftmost on ties."""
        ids, n = list(symbols), len(symbols)
        size = [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(*rank[ids[i], ids[i + 1]][:1], i, ids[i], ids[i + 1]) for i in range(n - 1) if (ids[i], ids[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i] = rank[a, b][1]
            size[i] += size[j]
            size[j] = 0
            ids[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (hit := rank.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (hit[0], i, ids[i], ids[after[i]]))
            p = before[i]
            if p >= 0 and (hit := rank.get((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (hit[0], p, ids[p], ids[i]))
        return [x for x, s in zip(ids, size, strict=True) if s], [s for s in size if s]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


Half = tuple[list[int], list[int], list[int]]  # tokens, symbols each covers, symbols


def join(table: Merges, left: Half, right: Half) -> Half:
    """Exact encoding of two neighbouring halves: windows at the seam grow until both sides agree."""
    (lt, ls, la), (rt, rs, ra) = left, right
    k = 1
    while True:
        i, j = min(k, len(lt)), min(k, len(rt))
        tokens, sizes = table.merge(la[len(la) - sum(ls[len(ls) - i:]):] + ra[:sum(rs[:j])])
        left_ok = i == len(lt) or (tokens[0], sizes[0]) == (lt[len(lt) - i], ls[len(ls) - i])
        right_ok = j == len(rt) or (tokens[-1], sizes[-1]) == (rt[j - 1], rs[j - 1])
        if left_ok and right_ok:
            return lt[:len(lt) - i] + tokens + rt[j:], ls[:len(ls) - i] + sizes + rs[j:], la + ra
        k *= 2


def leaves(symbols: list[int], leaf: int = LEAF) -> list[list[int]]:
    """Halves of halves, down to ``leaf`` symbols or fewer."""
    if len(symbols) <= leaf:
        return [symbols]
    half = len(symbols) // 2
    return leaves(symbols[:half], leaf) + leaves(symbols[half:], leaf)


def tree(table: Merges, halves: list[Half]) -> Half:
    """Join neighbours level by level up to one encoding."""
    while len(halves) > 1:
        pairs = [join(table, a, b) for a, b in zip(halves[::2], halves[1::2], strict=False)]
        halves = pairs + halves[len(pairs) * 2:]
    return halves[0]


@lru_cache(maxsize=2)
def edges(spaces: str) -> re.Pattern[str]:
    """Places in front of a space where a text may be cut."""
    return re.compile(f"(?<=[^\\s{WHITE}])(?= [^\\s{WHITE}])" if spaces == KEPT else "(?= )")


def text_leaves(text: str, long: int, edge: re.Pattern[str]) -> list[str]:
    """Halves of halves at word edges, down to ``long`` characters or to a stretch without an edge."""
    if len(text) <= long:
        return [text]
    mid = max(1, len(text) // 2)
    found = edge.search(text, mid)
    cut = found.start() if found else 0
    if not cut:
        cut = text.rfind(" ", 1, mid)
        while cut > 0 and not edge.match(text, cut):
            cut = text.rfind(" ", 1, cut)
    if cut <= 0:
        return [text]
    return text_leaves(text[:cut], long, edge) + text_leaves(text[cut:], long, edge)


def last_words(text: str, k: int, edge: re.Pattern[str]) -> str:
    at = len(text)
    while k and at > 0:
        at = text.rfind(" ", 0, at)
        k -= at > 0 and edge.match(text, at) is not None
    return text[max(at, 0):]


def first_words(text: str, k: int, edge: re.Pattern[str]) -> str:
    at = 0
    for _ in range(k):
        found = edge.search(text, at + 1)
        if found is None:
            return text
        at = found.start()
    return text[:at]


Stretch = tuple[np.ndarray, str, str, bool]  # ids; text up to the first, and after the last, stretch cut inside; none is


def join_texts(path: str, edge: re.Pattern[str], left: Stretch, right: Stretch) -> Stretch:
    """Exact encoding of two neighbouring texts: windows of words at the seam grow until both sides agree."""
    (li, lhead, ltail, lone), (ri, rhead, rtail, rone) = left, right
    k, ids = 1, None
    while ids is None and ltail and rhead:
        a, b = last_words(ltail, k, edge), first_words(rhead, k, edge)
        asked = [a, b, a + b, first_words(a, 1, edge), last_words(b, 1, edge)]
        na, nb, window, begin, end = [e.ids for e in tokenizer(path).encode_batch_fast(asked, add_special_tokens=False)]
        old_a, old_b = li[len(li) - len(na):].tolist(), ri[:len(nb)].tolist()
        whole_a, whole_b = len(a) == len(ltail), len(b) == len(rhead)
        left_ok = whole_a or (window[:len(begin)] == begin == old_a[:len(begin)])
        right_ok = whole_b or (window[len(window) - len(end):] == end == old_b[len(old_b) - len(end):])
        if left_ok and right_ok:
            ids = np.concatenate((li[:len(li) - len(na)], np.array(window, np.uint32), ri[len(nb):]))
        k *= 2
    if ids is None:
        ids = np.concatenate((li, ri))
    return ids, lhead + rhead if lone else lhead, ltail + rtail if rone else rtail, lone and rone


def whole_text(path: str, spaces: str, parts: list[tuple]) -> np.ndarray:
    """Ids of a text from its encoded parts in order: (kind, text, ids, sizes, symbols)."""
    table, edge = merges(path), edges(spaces)
    level: list[Stretch] = []
    inside: list[Half] = []
    run: list[int] | None = None

    def close() -> None:
        nonlocal run
        if run is not None:
            run += tree(table, inside)[0] if inside else []
            level.append((np.array(run, np.uint32), "", "", False))
            run = None
            inside.clear()

    for kind, text, ids, sizes, symbols in parts:
        if kind == TEXT:
            close()
            level.append((np.asarray(ids, np.uint32), text, text, True))
            continue
        run = [] if run is None else run
        if kind == SYMBOLS:
            inside.append((list(ids), list(sizes), list(symbols)))
        else:
            run += tree(table, inside)[0] if inside else []
            inside.clear()
            run += list(ids)
    close()
    while len(level) > 1:
        pairs = [join_texts(path, edge, a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2:]
    return level[0][0] if level else np.empty(0, np.uint32)


Finish = Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch]


def as_lists(keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, id_lists(ids)], names=["key", "ids"])


def _cut(text: str, path: str, spaces: str, long: int, leaf: int) -> Iterator[tuple[int, str, list[int]]]:
    """Parts of a text in order: (TEXT, text, -), (SYMBOLS, -, symbols) of a leaf inside a word, (DONE, -, ids).
    A done part stands between the leaves of any two words."""
    library, table = tokenizer(path), merges(path)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    for part in text_leaves(text, long, edges(spaces)):
        if len(part) <= long:
            yield TEXT, part, []
            continue
        if any(s in part for s in special):
            yield DONE, "", library.encode(part, add_special_tokens=False).ids
            continue
        run = library.normalizer.normalize_str(part) if library.normalizer else part
        for word, _ in library.pre_tokenizer.pre_tokenize_str(run):
            symbols = table.symbols(word)
            if len(symbols) <= leaf:
                yield DONE, "", table.merge(symbols)[0]
            else:
                for x in leaves(symbols, leaf):
                    yield SYMBOLS, "", x
                yield DONE, "", []


def _encode_parts(parts: list[tuple[int, str, list[int]]], path: str, spaces: str) -> list[tuple]:
    """Leaves encoded: (kind, text, ids, sizes, symbols) of each part."""
    known, table = pieces(path, spaces), merges(path)
    texts = iter(known.encode([t for kind, t, _ in parts if kind == TEXT]))
    out = []
    for kind, text, ids in parts:
        if kind == TEXT:
            out.append((kind, text, next(texts), [], []))
        elif kind == SYMBOLS:
            out.append((kind, "", *table.merge(ids), ids))
        else:
            out.append((kind, "", ids, [], []))
    return out


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, spaces: str, long: int, leaf: int, finish: Finish) -> Iterator[pa.RecordBatch]:
    known = pieces(path, spaces)
    for b in slices(batches):
        texts = b.column(1)
        is_long = pc.greater(pc.utf8_length(texts), long)
        short = iter(known.encode(texts.filter(pc.invert(is_long))))
        ids = []
        for k, more in enumerate(is_long.to_pylist()):
            parts = _encode_parts(list(_cut(texts[k].as_py(), path, spaces, long, leaf)), path, spaces) if more else []
            ids.append(whole_text(path, spaces, parts) if more else next(short))
        yield finish(b.column(0), ids)


def encode(df: DataFrame, path: str, spaces: str, key: str = "doc_id", text: str = "text", long: int = LONG, leaf: int = LEAF,
           finish: Finish = as_lists, columns: dict[str, T.DataType] | None = None, spread: int = SPREAD) -> DataFrame:
    """(key, ids) of every row: exactly the library's ids, without special tokens. ``finish`` may turn the
    ids into other ``columns`` in the same worker, so that they need not be handed on."""
    source = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = source.select("key").schema
    for name, kind in (columns or {"ids": T.ArrayType(T.IntegerType())}).items():
        schema = schema.add(name, kind)
    encode_rows = partial(_encode_batches, path=path, spaces=spaces, long=long, leaf=leaf, finish=finish)
    encoded = map_batches(source.where(F.length("text") <= spread), encode_rows, schema)
    scratch = Scratch(df.sparkSession, "bpe")
    wide = scratch.keep(source.where(F.length("text") > spread).withColumn("row", F.monotonically_increasing_id()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in zip(b.column(0), b.column(1), strict=True):
                parts = list(_cut(t.as_py(), path, spaces, long, leaf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([k for k, _, _ in parts], pa.int32()),
                     pa.array([t for _, t, _ in parts], pa.string()), pa.array([x for _, _, x in parts], pa.list_(pa.int32()))],
                    names=["row", "at", "kind", "text", "ids"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = _encode_parts(list(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)), path, spaces)
            lists = [pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *lists], names=["row", "at", "kind", "text", "ids", "sizes", "symbols"])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            parts = sorted(b.column(1)[0].as_py(), key=lambda p: p["at"])
            yield finish(b.column(0), [whole_text(path, spaces, [tuple(p[c] for c in ("kind", "text", "ids", "sizes", "symbols")) for p in parts])])

    if wide.isEmpty():
        return encoded.withColumnRenamed("key", key)
    parts = map_batches(wide.select("row", "text"), cut, "row long, at int, kind int, text string, ids array<int>")
    dealt = parts.repartition(partitions(df), "row", "at")  # leaves of one text go to many tasks
    merged = map_batches(dealt, merge, "row long, at int, kind int, text string, ids array<int>, sizes array<int>, symbols array<int>")
    # the parts of one text meet again: they are no larger than that one row
    whole = merged.groupBy("row").agg(F.collect_list(F.struct("at", "kind", "text", "ids", "sizes", "symbols")).alias("parts"))
    joined = map_batches(wide.select("row", "key").join(whole, "row").select("key", "parts"), up, schema)
    return encoded.unionByName(joined).withColumnRenamed("key", key)


@lru_cache(maxsize=4)
def token_texts(path: str) -> list[str]:
    """Token of each id, as the library writes it."""
    t = tokenizer(path)
    return [t.id_to_token(k) or "" for k in range(max(t.get_vocab(with_added_tokens=True).values()) + 1)]


@lru_cache(maxsize=1)
def numbers(n: int) -> list[str]:
    return [str(k) for k in range(n)]


def decode(ids: list[int], path: str) -> str:
    """The text of ids, special tokens kept. A vocabulary without a decoder reads as its tokens with
    spaces between them; the library decodes for the others."""
    t = tokenizer(path)
    if t.decoder is not None:
        return t.decode(ids, skip_special_tokens=False)
    return " ".join(map(token_texts(path).__getitem__, ids))


def digests(df: DataFrame, path: str, spaces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again, as digests."""
    def finish(keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        name = numbers(len(token_texts(path)))
        n, made, back = [], [], []
        for x in ids:
            row = x.tolist()
            n.append(len(row))
            made.append(hashlib.sha256(" ".join(map(name.__getitem__, row)).encode()).hexdigest())
            back.append(hashlib.sha256(decode(row, path).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())],
                                          names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return encode(df, path, spaces, key, text, finish=finish, columns=columns)
