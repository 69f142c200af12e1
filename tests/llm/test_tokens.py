import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from revlens.llm import bpe, packing, tokens
from revlens.llm.common import Scratch
from revlens.llm.words import DROPPED, KEPT, Pieces, tokenizer
from tests.llm.util import AWKWARD, documents

P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def library(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,spaces", [(WORD, DROPPED), (BYTE, KEPT)])
@pytest.mark.parametrize("remember", [1_000_000, 50])
def test_pieces_equal_library(path, spaces, remember):
    rng = random.Random(4)
    odd = list("abXYZ09'’éÉßñ \n\t\r\x0b\x1c\x85\xa0 !?#|<>中😀İΣς") + ["<|endoftext|>", "  ", "don't", "'LL", "|"]
    plain = ["word", "Word", "thing,", "a", "b|c", "été", "ÉTÉ!", "x.y", "don't", "3rd", "!!", "|", "line\nbreak", "<|x", "中文", "'s"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [" ".join(rng.choice(plain) for _ in range(rng.randint(1, 12))) for _ in range(1500)] + [t for _, t in AWKWARD]
    table = Pieces(path, spaces, remember)
    for at in range(0, len(texts), 300):
        for t, got in zip(texts[at:at + 300], table.encode(texts[at:at + 300]), strict=True):
            assert got.tolist() == library(path, t), t


def test_files_round_trip(spark):
    out = f"{Scratch(spark, 'test').path}/ids"
    tokens.write_tokens(documents(spark), out, WORD, DROPPED, 2)
    rows = sorted(tokens.read_tokens(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    at, texts = 0, {}
    for i, t in AWKWARD:
        texts.setdefault(i, t)
    for r in rows:
        assert r.ids == library(WORD, texts[r.doc_id]) + [2] and (r.start, r.n_tokens) == (at, len(r.ids))
        at += len(r.ids)
    crc = {r.start: r.ids_crc32 for r in tokens.with_crc(tokens.read_tokens(spark, out)).collect()}
    assert crc == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}


def test_file_layout_and_empty_table(spark):
    out = f"{Scratch(spark, 'test').path}/ids"
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("the", "house", "of", "stone")) for _ in range(200))) for i in range(300)]
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), out, WORD, DROPPED, 2, row_group=1 << 16, page=4096, page_rows=20)
    import glob
    files = [pq.ParquetFile(f) for f in sorted(glob.glob(out.removeprefix("file:") + "/*.parquet"))]
    columns = [f.metadata.row_group(g).column(c) for f in files for g in range(f.num_row_groups) for c in range(f.metadata.num_columns)]
    ids = [c for c in columns if c.path_in_schema.startswith("ids")]
    assert all("RLE_DICTIONARY" in c.encodings for c in ids) and all(c.has_column_index and c.has_offset_index for c in columns)
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "local_start")
    plan = tokens.read_tokens(spark, out).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    none = f"{Scratch(spark, 'test').path}/ids"
    tokens.write_tokens(documents(spark).limit(0), none, WORD, DROPPED, 2)
    assert tokens.read_tokens(spark, none).count() == 0


def test_bpe_tree_equals_library(spark):
    rng = random.Random(1)
    for path in (WORD, BYTE):
        table = bpe.merges(path)
        for _ in range(120):
            letters = rng.choice(("ab", "a", "theinganre", "abcdefghijklmnopqrstuvwxyz", "é中ñx"))
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 500)))
            symbols = table.symbols(tokenizer(path).pre_tokenizer.pre_tokenize_str(word)[0][0])
            halves = [(*table.merge(x), x) for x in bpe.leaves(symbols, rng.choice((1, 2, 5, 40)))]
            assert bpe.tree(table, halves)[0] == library(path, word)


@pytest.mark.parametrize("path,spaces", [(WORD, DROPPED), (BYTE, KEPT)])
def test_bpe_awkward_rows(spark, path, spaces):
    rows = AWKWARD + [(20, "a b " + "thering" * 2000 + " tail, ok"), (21, "9" * 5000 + " é" * 3000), (22, "<|endoftext|>" + "q" * 5000)]
    for long, leaf in ((4096, 512), (3, 2)):
        got = bpe.encode(documents(spark, rows), path, spaces, long=long, leaf=leaf).collect()
        assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, library(path, t)) for i, t in rows)
    assert bpe.encode(documents(spark).limit(0), path, spaces).count() == 0
    for _, t in rows:
        ids = library(path, t)
        assert bpe.decode(ids, path) == tokenizer(path).decode(ids, skip_special_tokens=False)


def test_packing(spark):
    rng = random.Random(2)
    rows = [*AWKWARD, *[(100 + i, "word " * rng.randint(0, 3000)) for i in range(150)], (300, "word " * 1023), (301, "word " * 2047)]
    packed = packing.pack(documents(spark, rows), WORD, DROPPED, 2).collect()
    want = sorted((i or 0, [*library(WORD, t), 2]) for i, t in rows)
    by, sequences = {}, {}
    for r in packed:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.length == 1024 or r.piece == 0
        by.setdefault((r.doc_id, r.piece), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ids in want:
        parts = sorted((rs[0] for (d, _), rs in by.items() if (d or 0) == i), key=lambda r: r.piece)
        assert [x for p in parts for x in p.ids] == ids
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    total = sum(len(x) for _, x in want)
    assert len(sequences) <= 1.03 * total / 1024 + 1
    assert sum(len(r.ids) for r in packing.sequences(packing.pack(documents(spark, rows), WORD, DROPPED, 2)).collect()) == total
    assert packing.pack(documents(spark).limit(0), WORD, DROPPED, 2).count() == 0


def test_packer_minimises_squares():
    rng = random.Random(3)
    packer, gaps = packing.Packer(50), {}
    for _ in range(400):
        s = rng.randint(1, 49)
        before = dict(gaps)
        at, offset = packer.put(s)
        fits = {g for g in before.values() if g >= s}
        score = lambda left: sum(sum(1 for x in left.values() if x == g) ** 2 for g in range(1, 50))
        gaps[at] = 50 - offset - s
        if offset:
            options = [score({**before, next(k for k, v in before.items() if v == g): g - s}) for g in fits]
            assert score(gaps) == min(options)
        else:
            assert not fits


def test_digests_equal_the_library(spark):
    import hashlib

    from revlens.llm import bpe, queries
    from revlens.llm.words import DROPPED, tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    rows = [*AWKWARD, (20, "中文字。" * 3000), (21, "abc" * 4000 + "\u3000" + "x y" * 50), (22, "a\u00a0b " * 2000)]
    lib = tokenizer(path)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = bpe.digests(documents(spark, rows), path, DROPPED).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("path,spaces", [(WORD, DROPPED), (BYTE, KEPT)])
def test_every_long_text_goes_through_the_tree(spark, path, spaces):
    rng = random.Random(7)
    odd = list("abZ9'é \n\t\x1c\x85\xa0\u3000\u200b !?中Σς\u0301") + ["<|endoftext|>", "  ", "don't", "word ", "house, ", "中文字中文字"]
    rows = [(i, "".join(rng.choice(odd) for _ in range(rng.randint(30, 400)))) for i in range(60)]
    rows += [(100, "plain words, of a text " * 900), (101, "中文字。" * 2000 + "\u3000" + "字" * 3000), (102, " " * 9000 + "x"), (103, "a\u00a0b " * 3000)]
    want = sorted((i, library(path, t)) for i, t in rows)
    for long, leaf, spread in ((4096, 512, 1 << 16), (7, 3, 1 << 16), (7, 3, 50), (2, 1, 100)):
        some = [r for r in rows if long > 7 or r[0] < 60]
        got = bpe.encode(documents(spark, some), path, spaces, long=long, leaf=leaf, spread=spread).collect()
        assert sorted((r.doc_id, r.ids) for r in got) == [w for w in want if long > 7 or w[0] < 60]


def test_text_leaves_cover_the_text_and_are_short_at_word_edges():
    edge = bpe.edges(DROPPED)
    text = "some words of a text " * 500 + "q" * 9000 + " end" * 2000
    parts = bpe.text_leaves(text, 4096, edge)
    assert "".join(parts) == text and sum(len(p) > 4096 for p in parts) == 1
    assert [len(p) for p in bpe.text_leaves("q" * 9000, 4096, edge)] == [9000]


def test_windows_grow_until_both_sides_agree():
    """Halves that are not cut at an edge: the first windows disagree, and the join still gives the library's ids."""
    edge = bpe.edges(DROPPED)
    text = "the house of sto" + "ne by the river and the hill"
    left, right = ((np.array(library(WORD, t), np.uint32), t, t, True) for t in (text[:16], text[16:]))
    assert bpe.join_texts(WORD, edge, left, right)[0].tolist() == library(WORD, text)
