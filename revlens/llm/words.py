"""Exact encoding with the tokenizers library, once per distinct piece of text instead of per use.

No token of the two vocabularies used here crosses from a character that is no white space to a
single space after it, so a text may be cut there and each piece encoded alone. ``Pieces`` keeps the
ids of the pieces seen lately (a bounded table in each Python worker) and asks the library only for
new ones. Texts with white space on which engines differ (and, where white space is kept, with other
runs than single spaces and line feeds) are handed to the library whole. Cutting and counting words is
Arrow's work, so Python sees each distinct word of a batch once. ``tests/llm`` compares the result with
the library on whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

#: How a vocabulary treats white space: dropped between words, or kept in front of the next word.
DROPPED, KEPT = "dropped", "kept"
SPACE_BYTE, WORD_END = "\u0120", "</w>"  # how the two vocabularies write them
REMEMBER = 500_000  # pieces, about 150 bytes each
#: White space and format characters beyond ASCII on which engines differ.
_WIDE = (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF)
#: Texts that must not be cut.
WHITE = "\x1c-\x1f" + "".join(map(chr, _WIDE))
_UNCUT = f"[{WHITE}]"
_UNCUT_KEPT = _UNCUT + "|  | \n|\n |[\t\x0b-\r]|^ | $"
#: Letters beyond U+00FF (lower case may differ between engines there), and texts with special tokens.
_NOT_LATIN = r"[^\x00-\x{ff}]|<\|"
#: A word of letters followed by marks, none of them an apostrophe.
_MARKED = re.compile(r"[a-z\xe0-\xf6\xf8-\xff]+[!-&(-/:-@\[-`{-~]+")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a file, with truncation and padding off."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _is_latin(text: str) -> bool:
    """All below U+0100, where lower case is one character for one and the same in every engine."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pieces:
    """Ids of texts, as uint32 arrays, through a bounded table of known pieces."""

    def __init__(self, path: str, spaces: str, remember: int = REMEMBER):
        self.path, self.kept, self.remember = path, spaces == KEPT, remember
        t = tokenizer(path)
        ids = t.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(ids.values()) + 1, bool)  # tokens that begin, or end, a word
        self.edge[[k for w, k in ids.items() if (w.startswith(SPACE_BYTE) if self.kept else w.endswith(WORD_END))]] = True
        self.lower = t.normalizer is not None and t.normalizer.normalize_str("A\xc9 |").startswith("a\xe9")
        self.uncut = _UNCUT_KEPT if self.kept else _UNCUT
        self.place, self.seen, self.ids, self.ends = {}, np.zeros(0, np.int64), np.empty(0, np.uint32), np.zeros(1, np.int64)
        self._forget()

    def split(self, text: str) -> list[str] | None:
        """The words of a text; None if it must not be cut. A vocabulary that keeps white space sees a
        space before every word but the first, which is marked by a space here."""
        if re.search(self.uncut, text):
            return None
        words = text.split(" ") if self.kept else text.split()
        if self.kept:
            words[0] = " " + words[0]
        return words

    def _forget(self) -> None:
        """Start anew, with the words that were seen more than once."""
        words, ids, ends = list(self.place), self.ids, self.ends
        often = (self.seen[:len(words)] > 1).nonzero()[0]
        often = often if 2 * len(often) < self.remember else often[:0]
        self.place = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.ends = np.zeros(1 << 16, np.int64)  # ends[k + 1]: where the ids of piece k end
        self.seen = np.zeros(0, np.int64)
        if len(often):
            size = ends[often + 1] - ends[often]
            total = np.cumsum(size)
            self._add([words[k] for k in often.tolist()], ids[np.arange(total[-1]) + np.repeat(ends[often] - total + size, size)], size)

    def _learn(self, words: list[str]) -> None:
        """Ask the library for new words, some thousands in one text. Where white space is kept, a word
        begins with its only token that begins with the space. Where it is dropped, letters end with their
        only token that ends a word, and so do the marks that may follow. Others are asked for singly."""
        joined, edges, single = [], [], []
        if self.kept:
            for w in words:
                (single if w[:1] == " " or "<|" in w else joined).append(w)
        else:
            for w in words:
                n = 1 if w.isalpha() and _is_latin(w) else 2 if _MARKED.fullmatch(w) else 0
                if n:
                    joined.append(w)
                    edges.append(n)
                else:
                    single.append(w)
        step = 4096
        texts = [" " * self.kept + " ".join(joined[i:i + step]) for i in range(0, len(joined), step)]
        for i, e in zip(range(0, len(joined), step), self._library(texts), strict=True):
            edge = self.edge[e].nonzero()[0]
            counts = np.diff(np.append(edge, len(e))) if self.kept else np.diff(np.append(-1, edge[np.cumsum(edges[i:i + step]) - 1]))
            self._add(joined[i:i + step], e, counts)
        if single:
            found = self._library([w[1:] if w[:1] == " " else " " + w for w in single] if self.kept else single)
            self._add(single, np.concatenate(found), np.array([len(x) for x in found]))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        k = len(self.place)
        while k + len(words) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[self.used:self.used + len(ids)] = ids
        self.ends[k + 1:k + 1 + len(words)] = self.used + np.cumsum(counts)
        self.place.update(zip(words, range(k, k + len(words)), strict=True))
        self.used += len(ids)

    def _places(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Where the ids of distinct words stand; ``times`` says how often each is used."""
        if len(self.place) > self.remember:
            self._forget()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        unknown = (at < 0).nonzero()[0]
        if len(unknown):
            asked = [words[k] for k in unknown.tolist()]
            self._learn(asked)
            at[unknown] = np.fromiter(map(self.place.__getitem__, asked), np.int64, len(asked))
        if len(self.seen) < len(self.place):
            self.seen = np.concatenate((self.seen, np.zeros(len(self.place), np.int64)))
        self.seen[at] += times
        return at

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, one after the other, and where each word's end."""
        start = self.ends[at]
        size = self.ends[at + 1] - start
        total = np.concatenate(([0], np.cumsum(size)))
        return self.ids[np.arange(total[-1]) + np.repeat(start - total[:-1], size)], total

    def words(self, words: list[str]) -> np.ndarray:
        """Ids of words of one text, as ``split`` gives them."""
        distinct = dict.fromkeys(words)
        place = dict(zip(distinct, self._places(list(distinct), np.ones(len(distinct), np.int64)).tolist(), strict=True))
        return self._gather(np.array([place[w] for w in words], np.int64))[0]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one text after the other, and where each text's ids end (from 0)."""
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False).nonzero()[0]
        cut = texts
        if len(whole):
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            cut = pc.if_else(pa.array(mask), "", texts)
        if self.kept:
            lists = pc.split_pattern(cut, " ")
        else:  # such vocabularies lower the case themselves; there are fewer words without it
            lists = pc.utf8_split_whitespace(pc.if_else(pc.match_substring_regex(cut, _NOT_LATIN), cut, pc.utf8_lower(cut)) if self.lower else cut)
        coded = lists.flatten().dictionary_encode()
        index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
        if self.kept:  # no space stands before the first word of a text: another word, marked by a space
            firsts = index[ends[:-1]].tolist()
            marked = dict.fromkeys(firsts)
            number = {k: len(distinct) + i for i, k in enumerate(marked)}
            index = index.astype(np.int64)
            index[ends[:-1]] = [number[k] for k in firsts]
            distinct = distinct + [" " + distinct[k] for k in marked]
        times = np.bincount(index, minlength=len(distinct))
        used = times.nonzero()[0]
        place = np.zeros(len(distinct), np.int64)
        place[used] = self._places([distinct[k] for k in used.tolist()], times[used]) if len(used) < len(distinct) else self._places(distinct, times)
        ids, total = self._gather(place[index])
        ends = total[ends]
        if len(whole):
            parts = [ids[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for k, found in zip(whole.tolist(), self._library([texts[k].as_py() for k in whole.tolist()]), strict=True):
                parts[k] = found
            ids, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, ends

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return [ids[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=4)
def pieces(path: str, spaces: str) -> Pieces:
    """The worker's table for a vocabulary; Python workers live through many tasks."""
    return Pieces(path, spaces)
