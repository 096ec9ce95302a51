"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

Speculate and verify. Greedy longest match proposes the tokens of every new
word at once, walking the vocabulary's trie in numpy. A sequence of tokens is
what BPE would give exactly if every adjacent pair is: undoing the merges of two
neighbours from the latest back must never meet a moment at which BPE would
have merged across their border. That test runs in numpy over all new pairs and
its results are kept. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.skew import spread

#: Words with their ids, characters of these, and tested pairs kept in each Python worker, and characters of text encoded at a time.
KEPT_WORDS, KEPT_CHARS, KEPT_PAIRS, CHUNK_CHARS = 300_000, 10_000_000, 1_000_000, 1_000_000
_NEVER = np.int64(2**40)


def default_vocabulary() -> str:
    """byte_bpe_50k of the public_tokenizers package, wherever that is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``n`` numbers each, one range after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


class Vocabulary:
    """A byte-level BPE vocabulary; tokens are numbered by the order in which merges make them.

    Numbers 0..255 are bytes, 256 + i is the i-th merge; ``ids`` translates
    numbers into the file's ids.
    """

    def __init__(self, path: str) -> None:
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        letter = _letters()
        raw = lambda s: bytes(letter[c] for c in s)
        vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in letter for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.number = {bytes([b]): b for b in range(256)}
        n = 256 + len(merges)
        self.left, self.right = np.arange(n), np.arange(n)
        self.ids = np.zeros(n, np.int32)
        self.pair: dict[tuple[int, int], int] = {}
        for b in range(256):
            self.ids[b] = vocab[bytes([b])]
        for i, (x, y) in enumerate(merges):
            a, b = raw(x), raw(y)
            t = 256 + i
            self.left[t], self.right[t], self.ids[t] = self.number[a], self.number[b], vocab[a + b]
            self.pair[self.number[a], self.number[b]] = t
            self.number.setdefault(a + b, t)
        self.n = n
        keys = np.array([a * n + b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.fromiter(self.pair.values(), np.int64, len(keys))[order]
        self._trie()
        self.good: dict[int, bool] = {}
        self.power = self.unpower = np.zeros(0, np.uint64)
        self._forget()
        self.exact = self._exact_merger(path)

    def _trie(self) -> None:
        """next[row of a prefix, byte] -> prefix; prefixes that go on come first and have rows."""
        inner = {b""} | {t[:i] for t in self.number for i in range(1, len(t))}
        place = {p: i for i, p in enumerate(sorted(inner, key=len))}
        self.inner = len(place)
        for t in self.number:
            place.setdefault(t, len(place))
        self.next = np.full((self.inner, 256), -1, np.int32)
        self.token = np.full(len(place), -1, np.int32)
        for p, i in place.items():
            if p:
                self.next[place[p[:-1]], p[-1]] = i
                self.token[i] = self.number.get(p, -1)

    def _exact_merger(self, path: str):
        """Exact BPE of one word's bytes into file ids: tiktoken's where it and the same vocabulary as ranks are there, else ours."""
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        try:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
            probe = list(self.number)[256::997]
            if all(enc._encode_single_piece(t) == self.merge(t) for t in probe):
                return enc._encode_single_piece
        except (ImportError, OSError, AttributeError, ValueError):
            pass
        return self.merge

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the earliest merge first, leftmost first; a heap, so long words take n log n."""
        tok = list(word)
        nxt, prev = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap = [(t, i, tok[i], tok[i + 1]) for i in range(len(tok) - 1) if (t := self.pair.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            t, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j >= len(tok) or tok[i] != a or tok[j] != b:
                continue
            tok[i], tok[j] = t, -1
            nxt[i] = nxt[j]
            if nxt[j] < len(tok):
                prev[nxt[j]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q < len(tok) and (m := self.pair.get((tok[p], tok[q]))) is not None:
                    heapq.heappush(heap, (m, p, tok[p], tok[q]))
        return [int(self.ids[t]) for t in tok if t >= 0]

    def propose(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of the words buf[start:stop]: word numbers and tokens, in order."""
        owner, tokens, order = [], [], []
        at, word = start.astype(np.int64), np.arange(len(start))
        step = 0
        while len(at):
            # longest match from every word's place
            state = np.zeros(len(at), np.int32)
            best, size = np.full(len(at), -1, np.int32), np.zeros(len(at), np.int64)
            live, depth = np.arange(len(at)), 0
            while len(live):
                live = live[at[live] + depth < stop[word[live]]]
                s = self.next[state[live], buf[at[live] + depth]]
                live, s = live[s >= 0], s[s >= 0]
                depth += 1
                t = self.token[s]
                hit = t >= 0
                best[live[hit]], size[live[hit]] = t[hit], depth
                state[live] = s
                live = live[s < self.inner]
            owner.append(word)
            tokens.append(best)
            order.append(np.full(len(word), step))
            at = at + size
            on = at < stop[word]
            at, word, step = at[on], word[on], step + 1
        if not owner:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, tokens, order = map(np.concatenate, (owner, tokens, order))
        by = np.lexsort((order, owner))
        return owner[by], tokens[by].astype(np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the two tokens' bytes together gives just these two tokens."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        before = np.full(len(a), _NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y, m = a[live], b[live], before[live]
            key = x * self.n + y
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[i] == key, self.pair_to[i], _NEVER)
            crossed = across < m
            ok[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            # undo the later of the two merges; of equal ones the right, which came second
            left_last = x > y
            whole_x, whole_y = x < 256, y < 256
            go_left = np.where(left_last, ~whole_x, whole_y & ~whole_x)
            go_right = ~go_left & ~whole_y
            before[live] = np.where(go_left, x, y + 1)
            a[live] = np.where(go_left, self.right[x], x)
            b[live] = np.where(go_right, self.left[y], y)
            live = live[go_left | go_right]
        return ok

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words one after another, and the number of each."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[list[int] | None] = [None] * len(raw)
        rest = []
        for i, r in enumerate(raw):
            t = self.number.get(r)
            if t is None:
                rest.append(i)
            else:
                out[i] = [int(self.ids[t])]
        if rest:
            sizes = np.fromiter((len(raw[i]) for i in rest), np.int64, len(rest))
            stop = np.cumsum(sizes)
            owner, tokens = self.propose(np.frombuffer(b"".join(raw[i] for i in rest), np.uint8), stop - sizes, stop)
            pairs = np.flatnonzero(owner[1:] == owner[:-1])
            keys, inv = np.unique(tokens[pairs] * self.n + tokens[pairs + 1], return_inverse=True)
            known = np.fromiter((self.good.get(k, 2) for k in keys.tolist()), np.int8, len(keys))
            new = np.flatnonzero(known == 2)
            known[new] = self.compatible(keys[new] // self.n, keys[new] % self.n)
            if len(self.good) > KEPT_PAIRS:
                self.good.clear()
            self.good.update(zip(keys[new].tolist(), known[new].astype(bool).tolist(), strict=True))
            failing = np.zeros(len(rest), bool)
            failing[owner[pairs[known[inv] == 0]]] = True
            ids = self.ids[tokens].tolist()
            cut = np.searchsorted(owner, np.arange(len(rest) + 1)).tolist()
            for k, i in enumerate(rest):
                out[i] = self.exact(raw[i]) if failing[k] else ids[cut[k] : cut[k + 1]]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(itertools.chain.from_iterable(out), np.int32, int(sizes.sum())), sizes

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and the number of each.

        Words are found by a hash and then compared character by character with
        the kept word; one that only shares its hash is encoded by itself.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = "".join(pieces)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        start, stop = word_bounds(chars, ends)
        h = self._hashes(chars, start, stop)
        keys, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        miss = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(miss):
            if len(self.keys) > KEPT_WORDS or len(self.text) > KEPT_CHARS:
                self._forget()
                at, miss = np.zeros(len(keys), np.int64), np.arange(len(keys))
            f = first[miss]
            ids, n = self._learned(whole, start[f], stop[f])
            chars_of = stop[f] - start[f]
            self.keys = np.insert(self.keys, at[miss], keys[miss])
            self.at = np.insert(self.at, at[miss], len(self.flat) + np.cumsum(n) - n)
            self.len = np.insert(self.len, at[miss], n)
            self.word = np.insert(self.word, at[miss], len(self.text) + np.cumsum(chars_of) - chars_of)
            self.chars = np.insert(self.chars, at[miss], chars_of)
            self.flat = np.concatenate([self.flat, ids])
            self.text = np.concatenate([self.text, chars[_ranges(start[f], chars_of)]])
            at = np.searchsorted(self.keys, keys)
        flat, where, n = self.flat, self.at[at][inv], self.len[at][inv]
        other = self._unlike(chars, start, stop, self.word[at][inv], self.chars[at][inv])
        if len(other):
            ids, m = self._learned(whole, start[other], stop[other])
            where[other], n[other] = len(flat) + np.cumsum(m) - m, m
            flat = np.concatenate([flat, ids])
        upto = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, ends)]
        return flat[_ranges(where, n)], np.diff(upto, prepend=0)

    def _learned(self, whole: str, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.learn([whole[i:j] for i, j in zip(start.tolist(), stop.tolist(), strict=True)])

    def _unlike(self, chars: np.ndarray, start: np.ndarray, stop: np.ndarray, kept: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the words, which cover ``chars`` one after another, that aren't the kept word at ``kept``."""
        n = stop - start
        longer = n != size
        some = np.flatnonzero(longer)
        if len(some):
            # words of another length are unlike; any kept word's place will do for them
            kept = np.where(longer, 0, kept)
        at = np.arange(len(chars), dtype=np.int32) + np.repeat((kept - start).astype(np.int32), n)
        unlike = np.flatnonzero(self.text.take(at, mode="clip") != chars)
        return np.union1d(some, np.searchsorted(start, unlike, "right") - 1) if len(unlike) or len(some) else some

    def _forget(self) -> None:
        self.keys, self.flat, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.at = self.len = self.word = self.chars = np.zeros(0, np.int64)

    def _hashes(self, chars: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        n = len(chars) + 1
        if n > len(self.power):
            m, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
            self.power = np.cumprod(np.full(n, m)) * inverse
            self.unpower = np.cumprod(np.full(n, inverse)) * m
        upto = np.zeros(n, np.uint64)
        np.cumsum(_values()[chars] * self.power[: n - 1], out=upto[1:])
        return (upto[stop] - upto[start]) * self.unpower[start] + (stop - start).astype(np.uint64)


#: Odd number whose powers weigh the characters of a word, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Letter, number, white space or other of every code point."""
    import unicodedata

    got = np.full(0x110000, _OTHER, np.uint8)
    first = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)], np.uint8)
    got[first == ord("L")], got[first == ord("N")] = _LETTER, _NUMBER
    # the code points with Unicode's White_Space property
    got[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return got


@lru_cache(1)
def _values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 0x110000, np.uint64) * np.uint64(2) + np.uint64(1)


def word_bounds(chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that the vocabulary's pattern makes of texts that end at ``ends``.

    A word is a run of letters, of numbers or of other characters, with the one
    blank before it if there is one; white space before a word is a word without
    its last character, which is one too if it isn't a blank; white space at the
    end of a text is one word. An apostrophe that stands alone before s, t, m,
    d, re, ve or ll is a word with these.
    """
    kind = _kinds()[chars]
    n = len(kind)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[ends[ends < n]] = True
    run = np.flatnonzero(change)
    to = np.append(run[1:], n)
    k = kind[run]
    last = np.zeros(n + 1, bool)
    last[ends] = True
    final = last[to]
    space = k == _SPACE
    # the last character of white space before a word of the same text
    tail = np.flatnonzero(space & ~final)
    blank = chars[to[tail] - 1] == 0x20
    mark = np.zeros(n + 1, bool)
    mark[run] = True
    mark[to[tail] - 1] = True
    taken = to[tail[blank]]
    mark[taken] = False
    # contractions
    alone = (k == _OTHER) & (to - run == 1) & ~final
    alone[np.searchsorted(run, taken)] = False
    c = np.flatnonzero(alone)
    c = c[chars[run[c]] == 0x27]
    if len(c):
        c = c[k[c + 1] == _LETTER]
        at, size = run[c], to[c + 1] - to[c]
        a = chars[at + 1]
        b = np.where(size > 1, chars[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, w in ((one, 1), (two & ~one, 2)):
            mark[at[hit] + 1] = False
            on = hit & (size > w)
            mark[at[on] + 1 + w] = True
    start = np.flatnonzero(mark[:n])
    return start, np.append(start[1:], n)


def safe_pieces(text: str, most: int) -> Iterator[str]:
    """The text in pieces of about ``most`` characters whose words, one after another, are the text's."""
    at = 0
    while len(text) - at > most:
        part = text[at : at + most]
        kind = _kinds()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        # before white space, or between letters and numbers, a word always ends
        ok = np.flatnonzero((kind[1:] != kind[:-1]) & ((kind[1:] == _SPACE) | (kind[1:] + kind[:-1] == _LETTER + _NUMBER) & (kind[1:] <= 1) & (kind[:-1] <= 1)))
        if len(ok):
            yield part[: ok[-1] + 1]
            at += int(ok[-1]) + 1
        else:
            most *= 2
    yield text[at:]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One a Python worker."""
    return Vocabulary(path)


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row; repeated keys stay repeated, null keys stay null.

    Special tokens' strings are ordinary text; null and empty texts give empty
    lists. Texts are encoded whole, whatever their length. The vocabulary file
    must be readable at ``path`` on every executor.
    """
    path = path or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            keys, done = b.column(0), 0
            pieces, owners, chars = [], [], 0
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def flush(upto: int) -> pa.RecordBatch:
                ids = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int32)
                n = np.zeros(upto - done, np.int64)
                for _, size, owner in got:
                    np.add.at(n, owner - done, size)
                ends = np.concatenate(([0], np.cumsum(n)))
                return pa.RecordBatch.from_arrays([keys.slice(done, upto - done), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=[key, "ids"])

            for i, text in enumerate(b.column(1).to_pylist()):
                for piece in safe_pieces(text or "", CHUNK_CHARS):
                    pieces.append(piece)
                    owners.append(i)
                    chars += len(piece)
                    if chars >= CHUNK_CHARS:
                        got.append((*v.encode(pieces), np.array(owners)))
                        pieces, owners, chars = [], [], 0
                if not pieces:
                    yield flush(i + 1)
                    done, got = i + 1, []
            if done < b.num_rows:
                got.append((*v.encode(pieces), np.array(owners)))
                yield flush(b.num_rows)

    return spread(df.select(key, F.col(text).cast("string").alias("_text")), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and ``text`` of lists of ids; null and empty lists give empty texts, ids that the vocabulary lacks are an error."""
    path = path or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        token = {int(v.ids[t]): raw for raw, t in v.number.items()}
        for b in batches:
            texts = [b"".join(map(token.__getitem__, x or ())).decode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def p6_texts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: what the ids of each document stand for, which is its text."""
    return decoded(encoded(documents, path=path), path=path)


def p6_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: one row a document."""
    return encoded(documents, path=path)
