"""Small tables for the operators of revlens.llm, with the awkward rows every operator must bear."""

import random

EXTRA = "score double, k1 string, fp string, lang_pred string, ids string, part int, key string"
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and the dog sleeps."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "12 34 56 !!"),
    (6, "The quick brown fox jumps over the lazy dog and the dog sleeps."),
    (7, "Été à la plage, où l'été dure. 中文字 😀 İstanbul"),
    (8, "x" * 20000),
    (9, "word " * 5000),
    (None, "A row without an id, of some words."),
    (1, "The quick brown fox jumps over the lazy dog and the dog sleeps."),
    (10, "tab\tand  two spaces\r\n<|endoftext|> odd\x1cones\xa0here"),
]


def documents(spark, rows=AWKWARD):
    """doc_id and text, with columns whose names clash with the operators' own."""
    data = [(*r, 0.5, "a", "b", "c", "d", 1, "e") for r in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, {EXTRA}")


def corpus(spark, path, n=80, seed=3):
    """A folder of documents, labels and pages with copies, near copies and shared passages."""
    rng = random.Random(seed)
    sets = {"en": "the and of to in is that with for house tree river stone walking reading water".split(),
            "fr": "le la les des une dans pour avec maison arbre rivière pierre marchant lisant été".split()}
    word = lambda lang: rng.choice(sets[lang]) + rng.choice(("", "", rng.choice("abcdefgh") + rng.choice("aeiou")))
    prose = lambda lang, k: " ".join(word(lang) for _ in range(k))
    passage = prose("en", 90)
    rows = []
    for i in range(n):
        lang = rng.choice(("en", "fr"))
        bad = i % 6 == 5
        text = " ".join(w.upper() + "!!" for w in prose(lang, 60).split()) if bad else prose(lang, rng.choice((5, 60, 200, 600)))
        if i % 9 == 4:
            text = text + "\n" + passage + "\n" + prose(lang, 30)
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    rows += [(n + k, rows[k * 7 + 1][1], rows[k * 7 + 1][2], "copy", len(rows[k * 7 + 1][1])) for k in range(5)]
    big = max(rows, key=lambda r: len(r[1]))
    rows += [(n + 10, big[1] + " added", big[2], "near", len(big[1]) + 6), (n + 11, "", "en", "none", 0), (n + 12, None, None, None, None),
             (n + 13, "123 456", "fr", "none", 7), (n + 14, big[1], None, "x", len(big[1]))]
    labels = [(i, 0 if i % 6 == 5 else 1, 0) for i in range(n) if i % 10 != 7]
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>{}</h1><p>{}</article><footer>© me</footer></body></html>"
    pages = [(i, f"http://a/{i}", page.format(prose("en", 4), prose("en", 30))) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(i, prose("en", 30)) for i in range(5)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows
