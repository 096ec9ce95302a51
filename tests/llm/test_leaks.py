import numpy as np

from tilewright.llm import leaks


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, share string")
    return d, spark.createDataFrame([(i, t, "en") for i, t in items], "item_id long, item_text string, lang string")


def brute(docs, items, least=12):
    out = set()
    for i, it in items:
        w = leaks.words_of(it or "")
        m = min(least, len(w))
        win = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
        for d, t in docs:
            v = leaks.words_of(t or "")
            if win and any(tuple(v[k : k + m]) in win for k in range(len(v) - m + 1)):
                out.add((d, i))
    return out


def test_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = np.array([f"w{i}" for i in range(12)])
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(rng.integers(1, 40)))) for i in range(60)] + [(100, None), (101, " .. "), (102, "w0 " * 30)]
    docs = []
    for i in range(120):
        t = say(int(rng.integers(0, 60)))
        if i % 2:
            w = items[i % 60][1].split()
            k = int(rng.integers(0, len(w)))
            t += " " + ", ".join(w[k : k + int(rng.integers(5, 20))]).upper() + " " + say(5)
        docs.append((i, t))
    docs += [(500, None), (501, ""), (502, "w0 " * 200), (1, docs[1][1])]
    d, it = frames(spark, docs, items)
    want = brute(docs, items)
    assert {tuple(r) for r in leaks.p7_found(d, it).collect()} == want
    # many small blocks of items give the same
    assert {(r.doc_id, r.item_id) for r in leaks.tiled(d, it, block_chars=300).collect()} == want


def test_words_ignore_what_is_between():
    assert leaks.words_of("ﬁne_Ǆ  x²—½ 日本語，​A") == ["fine", "dž", "x2", "1", "2", "日本語", "a"]


def test_tiles_cover_reordered_passages(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(15)) for p in "abc")
    d, it = frames(spark, [(1, f"x {c} y {a} z {b}"), (2, f"{a} q"), (3, f"{a} {a}")], [(9, f"{a} {b} {c}")])
    got = {r.doc_id: r for r in leaks.p7_tiles(d, it).collect()}
    assert (got[1].tiles, got[1].words, got[1].share, got[1].longest) == (3, 45, 1.0, 15)
    assert (got[2].tiles, got[2].words) == (1, 15)
    # the item's words are marked once
    assert (got[3].tiles, got[3].words) == (1, 15)
    r = leaks.p7_report(d, it).collect()[0]
    assert (r.item_id, r.documents, r.mostly, r.most) == (9, 3, 1, 1.0)


def test_tiling_takes_the_longest_first():
    doc, item = np.array([0, 1, 2, 3, 9, 2, 3, 4, 5, 6]), np.array([0, 1, 2, 3, 4, 5, 6])
    at, place = zip(*[(i, j) for i in range(9) for j in range(6) if (doc[i : i + 2] == item[j : j + 2]).all()], strict=True)
    assert leaks.tiles(doc, item, np.array(at), np.array(place), 2) == [(5, 2, 5), (0, 0, 2)]
    # a seed of unequal words, as if by a false hash, makes no tile
    assert leaks.tiles(doc, item, np.array([3]), np.array([0]), 2) == []


def test_repetitive_texts_give_the_same_tiles():
    rng = np.random.default_rng(7)
    for trial in range(300):
        kinds, size = int(rng.integers(1, 4)), int(rng.integers(1, 5))
        item = rng.integers(0, kinds, int(rng.integers(size, 40)))
        doc = rng.integers(-1, kinds, int(rng.integers(1, 60)))
        ix = leaks.Index([(5, " ".join("abc"[x] for x in item))], size)
        item, doc = ix.words[0], ix.numbers({x: 0 for x in "abc"})[doc] if trial % 2 else np.where(doc < len(ix.vocab), doc, -1)
        seeds = [(i, j) for i in range(len(doc) - size + 1) for j in range(len(item) - size + 1) if (doc[i : i + size] >= 0).all() and (doc[i : i + size] == item[j : j + size]).all()]
        want = leaks.tiles(doc, item, *(np.array(x) for x in zip(*seeds, strict=True)), size) if seeds else []
        assert leaks.repeated_tiles(ix, doc, item, size) == want


def test_hashes_that_lie(monkeypatch):
    # windows alike by hash only make no tiles and hide none
    rng = np.random.default_rng(8)
    item, doc = rng.integers(0, 2, 60), rng.integers(0, 2, 90)
    ix = leaks.Index([(5, " ".join("ab"[x] for x in item))], 6)
    item = ix.words[0]
    want = leaks.repeated_tiles(ix, doc, item, 6)
    assert want
    monkeypatch.setattr(leaks.Index, "rolled", lambda self, w: lambda size: np.zeros(max(len(w) + 1 - size, 0), np.uint64))
    assert leaks.repeated_tiles(ix, doc, item, 6) == want


def test_one_word_over_and_over(spark):
    d, it = frames(spark, [(1, "so " * 100_000), (2, "so so " * 7 + "it goes " * 20_000)], [(5, "so " * 10_000), (6, "so it goes " * 400 + "it goes " * 300)])
    got = {(r.doc_id, r.item_id): (r.tiles, r.words, r.longest) for r in leaks.p7_tiles(d, it).collect()}
    assert got == {(1, 5): (1, 10_000, 10_000), (2, 5): (1, 14, 14), (2, 6): (1, 603, 603)}


def test_empty_and_long(spark):
    d, it = frames(spark, [], [])
    assert leaks.p7_found(d, it).collect() == []
    d, it = frames(spark, [(1, "x y " * 400_000 + " a b c")], [(5, "a b c"), (None, "x y"), (6, "A. b")])
    assert {tuple(r) for r in leaks.p7_found(d, it).collect()} == {(1, 5), (1, 6)}


def test_pieces_keep_words():
    for text in ("ab cd\nef " * 40, "x" * 90 + " y", "", "é́ " * 50):
        parts = list(leaks.pieces(text, 13))
        assert "".join(parts) == text and [w for p in parts for w in leaks.words_of(p)] == leaks.words_of(text)
