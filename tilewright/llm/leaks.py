"""Evaluation texts that leaked into a corpus (problem 7).

Greedy string tiling of every document with every item. The items' windows of
MIN_WORDS words (or the whole of a shorter item) are hashed once; a document's
windows roll over its words in numpy (Karp-Rabin) and meet them in a sorted
array. Such seeds on one diagonal join to maximal matches; the longest match
whose words are all free is marked, again and again, so that reordered passages
are covered as well. A document that repeats itself would have a seed for every
two equal windows; its tiles come from running Karp-Rabin instead, which looks
for the greatest window length with a match and then for shorter ones, in
memory in proportion to the texts. Both give the same tiles. Matches are
compared word by word, never by hash alone.
"""

from __future__ import annotations

import heapq
import pickle
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.skew import spread
from tilewright.plans.stage import materialize

#: A passage has at least so many words; a shorter item must be there whole.
MIN_WORDS = 12
#: Items are indexed in blocks of about so many characters, each by one task; a task has one block in memory at a time.
BLOCK_CHARS = 20_000_000
#: A document with more seeds than so many for each of its words, and SEEDS besides, is tiled without them.
SEEDS_A_WORD, SEEDS = 4, 1000
#: Words of documents that are hashed at a time.
CHUNK_WORDS = 500_000
_BASE = 0xD1342543DE82EF95
_words = re.compile(r"[^\W_]+").findall
_space = re.compile(r"\s")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits after NFKC, in lower case."""
    return _words(unicodedata.normalize("NFKC", text).lower())


def pieces(text: str, most: int = 1_000_000) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut behind white space: words lie in one piece."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if cut < at:
            cut = _space.search(text, at + most)
            if cut is None:
                break
            cut = cut.start()
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


class _Ids(dict):
    """Words numbered as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Index:
    """The windows of a block of items. Items without a word are left out."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.vocab: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for item, text in items:
            w = [x for p in pieces(text or "") for x in words_of(p)]
            if w:
                self.ids.append(item)
                self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64))
        self.values = np.random.default_rng(11).integers(1, 2**63, len(self.vocab) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            by.setdefault(min(least, len(w)), []).append(k)
        #: window length -> hashes in order, item, place in the item
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, which in by.items():
            h = [self.rolled(self.words[k])(size) for k in which]
            item = np.repeat(which, [len(x) for x in h])
            place = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            self.windows[size] = h[order], item[order], place[order]

    def numbers(self, words: dict[str, int]) -> np.ndarray:
        """The block's number of each of the words, -1 for those that no item has."""
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def rolled(self, w: np.ndarray) -> Callable[[int], np.ndarray]:
        """A function that gives the hash of the window of a size at each place."""
        power, unpower = _powers(len(w) + 1)
        upto = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(self.values[w] * power[:-1], out=upto[1:])
        return lambda size: (upto[size:] - upto[: max(len(w) + 1 - size, 0)]) * unpower[: max(len(w) + 1 - size, 0)]

    def shared(self, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Window length, and of each window that items have too the place in ``w`` and where in that length's windows it starts and ends. Words not of any item are -1."""
        strange = np.concatenate(([0], np.cumsum(w < 0)))
        hashes = self.rolled(w)
        for size, (h, _, _) in self.windows.items():
            if len(w) < size:
                continue
            at = np.flatnonzero(strange[size:] == strange[: len(strange) - size])
            if not len(at):
                continue
            own = hashes(size)[at]
            lo = np.searchsorted(h, own)
            hit = h[np.minimum(lo, len(h) - 1)] == own
            at, own, lo = at[hit], own[hit], lo[hit]
            if len(at):
                yield size, at, lo, np.searchsorted(h, own, "right")


_power = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if n > len(_power[0]):
        m, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
        _power[:] = np.cumprod(np.full(n, m)) * inverse, np.cumprod(np.full(n, inverse)) * m
    return _power[0][:n], _power[1][:n]


def tiles(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, words) of the tiles out of seeds of ``size`` words, the longest first."""
    order = np.lexsort((at, at - place))
    at, place = at[order], place[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(place) != 1))))
    heap = []
    for i, j in zip(new.tolist(), np.append(new[1:], len(at)).tolist(), strict=True):
        d, p, n = int(at[i]), int(place[i]), j - i + size - 1
        same = doc[d : d + n] == item[p : p + n]
        if same.all():
            heap.append((-n, d, p))
        else:
            # a hash lied: what is really equal
            heap += [(-k, d + o, p + o) for o, k in _runs(same) if k >= size]
    heapq.heapify(heap)
    free_d, free_i, out = np.ones(len(doc), bool), np.ones(len(item), bool), []
    while heap:
        n, d, p = heapq.heappop(heap)
        free = free_d[d : d - n] & free_i[p : p - n]
        if free.all():
            out.append((d, p, -n))
            free_d[d : d - n] = free_i[p : p - n] = False
        else:
            for o, k in _runs(free):
                if k >= size:
                    heapq.heappush(heap, (-k, d + o, p + o))
    return out


def _runs(yes: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], yes, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def _room(free: np.ndarray) -> np.ndarray:
    """At each place, how many free places follow without a gap, itself included."""
    n = len(free)
    at = np.arange(n)
    taken = np.where(free, n, at)
    return np.minimum.accumulate(taken[::-1])[::-1] - at


def repeated_tiles(ix: Index, doc: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """What :func:`tiles` gives, without seeds: the greatest length at which a free window of both is alike, its tiles from the left, then the next length."""
    of_doc, of_item = ix.rolled(doc), ix.rolled(item)
    free_d, free_i = doc >= 0, np.ones(len(item), bool)
    room_d, room_i = _room(free_d), _room(free_i)

    def meet(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, p = np.flatnonzero(room_d[: len(doc) + 1 - n] >= n), np.flatnonzero(room_i[: len(item) + 1 - n] >= n)
        hd, hp = of_doc(n)[d], of_item(n)[p]
        known = np.unique(hp)
        hit = known[np.minimum(np.searchsorted(known, hd), len(known) - 1)] == hd if len(known) else np.zeros(len(hd), bool)
        return d[hit], hd[hit], p, hp

    out = []
    top = int(min(room_d.max(initial=0), room_i.max(initial=0)))
    while top >= size:
        # if windows of a length are alike, so are shorter ones
        low, high = size - 1, top
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(meet(mid)[0]) else (low, mid - 1)
        n = low
        if n < size:
            break
        d, hd, p, hp = meet(n)
        keys, which = np.unique(hd, return_inverse=True)
        mine = np.isin(hp, keys)
        p, k = p[mine], np.searchsorted(keys, hp[mine])
        order = np.lexsort((p, k))
        p, edge = p[order], np.searchsorted(k[order], np.arange(len(keys) + 1)).tolist()
        p, at = p.tolist(), edge[:-1]
        after = 0
        for i, key in zip(d.tolist(), which.tolist(), strict=True):
            if i < after:
                continue
            # places that are taken stay so at this length
            while at[key] < edge[key + 1] and not free_i[p[at[key]] : p[at[key]] + n].all():
                at[key] += 1
            for j in range(at[key], edge[key + 1]):
                if free_i[p[j] : p[j] + n].all() and np.array_equal(doc[i : i + n], item[p[j] : p[j] + n]):
                    out.append((i, p[j], n))
                    free_d[i : i + n] = free_i[p[j] : p[j] + n] = False
                    after = i + n
                    break
        room_d, room_i = _room(free_d), _room(free_i)
        top = n - 1
    return out


def _blocks(items: DataFrame, least: int, block_chars: int) -> DataFrame:
    """A pickled index, and whether there is any item in it, of each block. Items are dealt out by their hash, each once."""
    some = items.where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select("item_id", F.col("item_text").cast("string").alias("item_text")).distinct()
    some = materialize(some, "p7-items")
    chars = some.agg(F.sum(F.length("item_text")).cast("double")).scalar()
    n = some.sparkSession.range(1).select(F.coalesce(F.ceil(chars / block_chars), F.lit(0)).cast("int")).first()[0]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        ix = Index(sorted(got), least)
        if ix.ids:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ix, protocol=5)], pa.large_binary())], names=["block"])

    return materialize(some.repartition(max(n, 1), F.xxhash64("item_id", "item_text")).mapInArrow(build, "block binary"), "p7-blocks")


def tiled(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, tiles, words, share, longest of each document and item that share a passage.

    ``words`` is how many of the item's words lie in tiles, ``share`` their
    part of the item, ``longest`` the longest tile. Null and empty texts share
    nothing; items without id are left out; repeated documents give repeated
    results, equal items count once. Blocks of items are indexed in tasks and
    pass through the driver one at a time; a document is split into words once
    for all blocks.
    """
    spark = documents.sparkSession
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((documents, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, tiles int, words int, share double, longest int"
    docs = spread(documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()), "doc_id")
    blocks = [spark.sparkContext.broadcast(bytes(r.block)) for r in _blocks(items, least, block_chars).toLocalIterator()]
    if not blocks:
        return spark.createDataFrame([], schema)
    ids = pa.from_numpy_dtype(np.dtype({"bigint": "i8", "int": "i4", "smallint": "i2", "tinyint": "i1"}[kinds[1]])) if kinds[1] != "string" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int, float, int]] = []
            words, some = _Ids(), []
            get = words.__getitem__
            first, n = 0, 0
            for i in range(b.num_rows):
                some.append(np.concatenate([np.fromiter(map(get, w), np.int64, len(w)) for w in map(words_of, pieces(b.column(1)[i].as_py()))]))
                n += len(some[-1])
                if n >= CHUNK_WORDS or i + 1 == b.num_rows:
                    for block in blocks:
                        ix = _opened(block)
                        number = ix.numbers(words)
                        out += _matches(ix, [number[w] for w in some], first)
                    words, some = _Ids(), []
                    get = words.__getitem__
                    first, n = i + 1, 0
            if out:
                cols = list(zip(*out, strict=True))
                kind = [ids, pa.int32(), pa.int32(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *(pa.array(c, k) for c, k in zip(cols[1:], kind, strict=True))], names=["doc_id", "item_id", "tiles", "words", "share", "longest"])

    return docs.mapInArrow(run, schema)


_last: list = [None, None]


def _opened(block: Broadcast) -> Index:
    """The index in a broadcast block. A worker keeps the last one only; others are read again from the executor's disk."""
    path = getattr(block, "_path", None)
    if path is None or _last[0] != path:
        _last[:] = path, pickle.loads(block.value if path is None else block.load_from_path(path))
    return _last[1]


def _matches(ix: Index, some: list[np.ndarray], first: int) -> list[tuple[int, int, int, int, float, int]]:
    """Rows of the documents ``first``, ``first`` + 1, ...; a strange word between documents keeps windows inside them."""
    sizes = np.array([len(w) + 1 for w in some])
    start = np.cumsum(sizes) - sizes
    gap = np.array([-1])
    whole = np.concatenate([x for w in some for x in (w, gap)])
    out = []

    def put(d: int, k: int, t: list[tuple[int, int, int]]) -> None:
        if t:
            n = sum(x[2] for x in t)
            out.append((first + d, ix.ids[k], len(t), n, n / len(ix.words[k]), max(x[2] for x in t)))

    for size, at, lo, hi in ix.shared(whole):
        _, item_of, place_of = ix.windows[size]
        doc = np.searchsorted(start, at, "right") - 1
        seeds = np.bincount(doc, hi - lo, len(some))
        many = seeds > SEEDS_A_WORD * sizes + SEEDS
        for d in np.flatnonzero(many).tolist():
            # the items of the document's different windows
            own = doc == d
            a, z = np.unique(lo[own]), np.unique(hi[own])
            for k in np.unique(np.concatenate([np.unique(item_of[x:y]) for x, y in zip(a.tolist(), z.tolist(), strict=True)])).tolist():
                put(d, k, repeated_tiles(ix, some[d], ix.words[k], size))
        few = ~many[doc]
        at, lo, n, doc = at[few], lo[few], (hi - lo)[few], doc[few]
        if not len(at):
            continue
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at, doc, item, place = np.repeat(at, n), np.repeat(doc, n), item_of[k], place_of[k]
        order = np.lexsort((item, doc))
        doc, item, at, place = doc[order], item[order], at[order], place[order]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0))))
        for i, j in zip(cut.tolist(), np.append(cut[1:], len(doc)).tolist(), strict=True):
            d, k = int(doc[i]), int(item[i])
            put(d, k, tiles(some[d], ix.words[k], at[i:j] - start[d], place[i:j], size))
    return out


def p7_tiles(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every leak with its tiles and the covered share of the item."""
    return tiled(documents, items)


def p7_report(documents: DataFrame, items: DataFrame, mostly: float = 0.8) -> DataFrame:
    """item_id, documents, mostly, most: leaks of each test item, those that cover at least the share ``mostly`` of it in any order, and the largest share."""
    return tiled(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("share") >= mostly).alias("mostly"), F.max("share").alias("most"))


def p7_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of the leaks, each once."""
    return tiled(documents, items).select("doc_id", "item_id").distinct()
