import random

import numpy as np
import pytest

from tilewright.llm import tokens as tk

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocab():
    return tk.vocabulary(tk.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tk.default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(0)
    out = ["", " ", "a", "a" * 5000, "<|endoftext|> x", "it's 'sword ''s x'll'd 're", "'", " '", "'s", "\n's  t", "end  ", "x \x1c\x1d y", "\x00\x7f", "aaaaaaa bbbb" * 300]
    out += ["‍́ x　y \n\n  z", "\U00010348" * 100, "日本語の文章です。中文句子。", "Ünïcödé ﬁ ½ ²", "0123456789" * 50, "\r\n \r\n\t\ta"]
    return out + ["".join(rng.choice("ab 'strevlmd12.\n\t \xa0é漢-") for _ in range(rng.randint(0, 40))) for _ in range(2000)]


def test_encode_matches_the_public_tokenizer(vocab, reference):
    some = texts()
    ids, n = vocab.encode(some)
    for text, got in zip(some, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == reference(text), text


def test_pair_test_matches_exact_merging(vocab):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, vocab.n, 4000), rng.integers(0, vocab.n, 4000)
    raw = {i: t for t, i in vocab.number.items()}
    want = [vocab.merge(raw[x] + raw[y]) == [vocab.ids[x], vocab.ids[y]] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert vocab.compatible(a, b).tolist() == want


def test_own_merging_matches(vocab, reference):
    for w in ("internationalization", "aaaaaaaaaaaa", "日本語", "zzqxj", "x" * 3000):
        assert vocab.merge(w.encode()) == reference(w)


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_with_one_hash(vocab, reference, n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    for _ in range(2):
        # in one batch, and against what earlier batches kept
        for batch in ([a, b], [b], [a], [f"{b} {a} x {b}"], ["x", b, a]):
            ids, size = vocab.encode(batch)
            assert [g.tolist() for g in np.split(ids, np.cumsum(size)[:-1])] == [reference(t) for t in batch]
        vocab._forget()


def test_any_shared_hash(vocab, reference, monkeypatch):
    # as if words shared their hashes by length: whatever the hash, ids are the word's own
    monkeypatch.setattr(vocab, "_hashes", lambda chars, start, stop: ((stop - start) // 3).astype(np.uint64))
    vocab._forget()
    some = texts()[:300]
    for part in (some, some[::-1]):
        ids, n = vocab.encode(part)
        assert [g.tolist() for g in np.split(ids, np.cumsum(n)[:-1])] == [reference(t) for t in part]
    vocab._forget()


def test_both_exact_mergers_agree(vocab):
    rng = random.Random(5)
    words = [thue_morse(512), "aaaa" * 300, "ÿ" * 200, *("".join(rng.choice("abcdexyz\xe9漢") for _ in range(rng.randint(1, 60))) for _ in range(1500))]
    for w in words:
        raw = w.encode()
        assert list(vocab.exact(raw)) == vocab.merge(raw), w


def test_safe_pieces_keep_words(vocab, reference):
    for text in ("word " * 300 + "12ab" * 50, "a" * 500, " \n" * 300, "it's  x1y2 " * 100):
        parts = list(tk.safe_pieces(text, 37))
        assert "".join(parts) == text
        assert vocab.encode(parts)[0].tolist() == reference(text)


def test_forgetting_changes_nothing(vocab, reference, monkeypatch):
    monkeypatch.setattr(tk, "KEPT_WORDS", 3)
    monkeypatch.setattr(tk, "KEPT_PAIRS", 3)
    for text in texts()[:60]:
        assert vocab.encode([text])[0].tolist() == reference(text)


def test_p6_ids(spark, reference, monkeypatch):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x"), (1, "Hello world"), (4, "long text " * 150_000), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(a, b, [1], "y") for a, b in rows], "doc_id long, text string, ids array<int>, _text string").coalesce(1)
    got = [(r.doc_id, r.ids) for r in tk.p6_ids(df).collect()]
    assert sorted(got, key=str) == sorted(((a, reference(b or "")) for a, b in rows), key=str)
    assert tk.p6_ids(df.limit(0)).collect() == []


def test_ids_are_the_text(spark):
    rows = [(1, "Ünï \U00010348 <|endoftext|>"), (2, None), (3, ""), (4, "x " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in tk.p6_texts(df).collect()} == {(a, b or "") for a, b in rows}
