"""Languages of documents and of their paragraphs (problem 8).

Multinomial naive Bayes over hashed character n-grams. The model is fitted on a
bounded sample of labelled documents, whose labels may be wrong and whose
paragraphs may be in several languages: labels only start it, then paragraphs
take the language the model gives them and it is fitted again. Its matrix of
log probabilities, 2**BITS buckets by languages, is broadcast, a few MB whatever
the corpus; every whole paragraph of every document is scored with it in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.skew import spread

#: Paragraphs with fewer letters don't count.
MIN_LETTERS = 80
#: n-grams of these sizes are hashed into 2**BITS buckets.
SIZES, BITS = (1, 2, 3, 4), 16
#: The training sample: so many documents a label at most, the ones with the smallest hashes of doc_id, of each the first paragraphs up to so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 8_000
#: Different hashes of doc_id.
_HASHES = 1 << 30
#: Refits on the model's own labels of the sample's paragraphs, and the count added to every bucket.
ROUNDS, SMOOTHING = 4, 0.02
#: Characters scored at a time.
CHUNK_CHARS = 400_000
#: Names of the languages, each as two- and three-letter codes and in English.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "ru": ("ru", "rus", "russian"),
    "ja": ("ja", "jpn", "japanese"),
    "zh": ("zh", "zho", "chi", "chinese"),
    "ko": ("ko", "kor", "korean"),
}
_BREAK = re.compile(r"\r?\n(?:[^\S\n]*\r?\n)+")
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def named_language(lang: Column) -> Column:
    """Two-letter code of a label in any case, with or without a region; null if it names no known language."""
    known = F.create_map(*(F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)))
    return F.element_at(known, F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^[\s\p{Z}]*(\p{L}+)(?:[-_][\p{L}\d]+)*[\s\p{Z}]*$", 1)))


def paragraphs(text: str) -> list[str]:
    """Non-empty paragraphs: what empty or blank lines part, with LF or CRLF line ends."""
    return [p for p in _BREAK.split(text) if p.strip()]


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters as code points, everything else as 0, a 0 around each text; and where texts start."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low)) + 1
    return np.where(_letters()[raw], raw, np.uint32(0)), np.cumsum(size) - size + 1


def _grams(c: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that end at ``at``, for each size."""
    h = np.zeros(len(at), np.uint32)
    for n in range(max(SIZES)):
        # what is before a text's start is the 0 that ends another one, or nothing
        h = h + (c[np.maximum(at - n, 0)] + np.uint32(n)) * _MUL[n]
        h ^= h >> np.uint32(15)
        if n + 1 in SIZES:
            yield ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int32)


class Model:
    """Log probabilities of buckets by language."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        p = counts + SMOOTHING
        self.logp = np.ascontiguousarray(np.log(p / p.sum(0)), np.float32)

    def scores(self, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters and log likelihoods of each text in ``c``."""
        at = np.flatnonzero(c)
        cut = np.searchsorted(at, np.append(start, len(c)))
        letters = np.diff(cut)
        out = np.zeros((len(start), len(self.langs)))
        some = np.flatnonzero(letters >= MIN_LETTERS)
        if len(some):
            keep = np.repeat(letters >= MIN_LETTERS, letters)
            at = at[keep]
            edge = np.cumsum(letters[some]) - letters[some]
            for g in _grams(c, at):
                out[some] += np.add.reduceat(np.take(self.logp, g, axis=0), edge, axis=0)
        return letters, out

    def judge(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(letters, language number, confidence) of each text; a text below MIN_LETTERS has number -1.

        The confidence is the posterior after the n-grams of one average letter:
        that of all would be 1 nearly always, as neighbouring n-grams are far
        from independent.
        """
        letters, s = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        some, chars = [], 0
        for i, t in enumerate(texts):
            # a text beyond the chunk is scored in pieces
            for k in range(0, max(len(t), 1), CHUNK_CHARS):
                some.append((i, t[k : k + CHUNK_CHARS] if len(t) > CHUNK_CHARS else t))
                chars += min(len(t) - k, CHUNK_CHARS)
                if chars >= CHUNK_CHARS:
                    self._add(some, letters, s)
                    some, chars = [], 0
        self._add(some, letters, s)
        best = s.argmax(1) if len(texts) else np.zeros(0, np.int64)
        z = (s - s.max(1, keepdims=True)) / np.maximum(letters, 1)[:, None] if len(texts) else s
        conf = 1 / np.exp(z).sum(1) if len(texts) else np.zeros(0)
        best[letters < MIN_LETTERS] = -1
        return list(zip(letters.tolist(), best.tolist(), conf.tolist(), strict=True))

    def _add(self, some: list[tuple[int, str]], letters: np.ndarray, s: np.ndarray) -> None:
        if some:
            n, got = self.scores(*_codes([t for _, t in some]))
            who = np.array([i for i, _ in some])
            np.add.at(letters, who, n)
            np.add.at(s, who, got)


def fit(texts: list[str], labels: list[str]) -> Model:
    """A model of the labelled texts. Languages without a text of MIN_LETTERS are unknown to it."""
    parts = [(p, x) for t, x in zip(texts, labels, strict=True) for p in paragraphs(t)]
    langs = sorted({x for _, x in parts})
    got, mine = [], []
    for i in range(0, len(parts), 2000):
        c, start = _codes([p for p, _ in parts[i : i + 2000]])
        at = np.flatnonzero(c)
        cut = np.searchsorted(at, np.append(start, len(c)))
        g = [x.astype(np.uint16) for x in _grams(c, at)]
        for k in np.flatnonzero(np.diff(cut) >= MIN_LETTERS).tolist():
            got.append(np.concatenate([x[cut[k] : cut[k + 1]] for x in g]))
            mine.append(langs.index(parts[i + k][1]))
    who = np.array(mine, np.int64)
    langs_there = np.unique(who)
    names = [langs[i] for i in langs_there]
    who = np.searchsorted(langs_there, who)
    model = Model(names, np.zeros((2**BITS, len(names))))
    for _ in range(ROUNDS + 1):
        counts = np.zeros((2**BITS, len(names)))
        for k in range(len(names)):
            own = [got[i] for i in np.flatnonzero(who == k)]
            if own:
                counts[:, k] = np.bincount(np.concatenate(own), minlength=2**BITS)
        model = Model(names, counts)
        now = np.array([model.logp[g].sum(0).argmax() for g in got], np.int64)
        if np.array_equal(now, who):
            break
        who = now
    return model


def sample_text(text: str, chars: int) -> Column:
    """The text's whole paragraphs up to ``chars`` characters; the start of its first one if that is longer."""
    head = F.substring(F.regexp_replace(text, r"^\s+", ""), 1, chars + 1)
    whole = F.regexp_extract(head, r"(?s)^(.*)\r?\n[^\S\n]*\r?\n", 1)
    return F.when(F.length(text) <= chars, F.col(text)).when(F.length(whole) > 0, whole).otherwise(F.substring(head, 1, chars))


def fitted(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of at most ``docs`` documents of each language that documents.lang names, whole paragraphs of each up to ``chars`` characters."""
    hashed = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(_HASHES))
    some = documents.select("doc_id", F.col("text").cast("string").alias("text"), named_language(F.col("lang")).alias("_lang"), hashed.alias("_h")).where(F.col("_lang").isNotNull())
    # labels are counted without a look at texts; so few rows reach the ranking that it's small however many a label has
    n = {r._lang: r.n for r in some.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = {k: 3 * docs / v for k, v in n.items()}
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "doc_id"))
    rows: list = []
    while part:
        limit = F.element_at(F.create_map(*(F.lit(x) for k, v in part.items() for x in (k, int(min(1.0, v) * _HASHES)))), F.col("_lang"))
        # of long texts, whole paragraphs up to the budget, else the start of the first one
        few = some.where((F.col("_h") < limit) & (F.length("text") >= MIN_LETTERS)).withColumn("text", sample_text("text", chars))
        got = few.withColumn("_r", rank).where(F.col("_r") <= docs).select("doc_id", "_lang", "text").collect()
        have = Counter(r._lang for r in got)
        # labels whose texts are mostly too short are looked for among more rows
        part = {k: 20 * v for k, v in part.items() if v < 1 and have[k] < docs}
        rows += [r for r in got if r._lang not in part]
    rows.sort(key=lambda r: (r._lang, r.doc_id))
    return fit([r.text for r in rows], [r._lang for r in rows])


def identified(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, stated, lang, confidence, letters and the paragraphs in other languages of each document.

    ``stated`` is the language that documents.lang names, ``lang`` that of most
    paragraphs with MIN_LETTERS letters, on ties of the one with more letters,
    then of the first; null if there is no such paragraph or no language known.
    ``confidence`` is the mean of its paragraphs' by letters. ``other`` lists
    (para, lang, confidence), para from 1 among all non-empty paragraphs. Null
    and empty texts have no language; repeated rows stay.
    """
    model = model or fitted(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast((model.langs, model.logp))
    other = pa.list_(pa.struct([("para", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.langs, m.logp = shared.value
        for b in batches:
            first, some, owners, chars = 0, [], [], 0
            for i in range(b.num_rows):
                ps = paragraphs(b.column(2)[i].as_py() or "")
                some += ps
                owners.append(len(ps))
                chars += sum(map(len, ps))
                if chars >= CHUNK_CHARS or i + 1 == b.num_rows:
                    main, conf, letters, rest = _by_document(m, some, owners)
                    part = b.slice(first, len(owners))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main, pa.string()), pa.array(conf, pa.float64()), pa.array(letters, pa.int64()), pa.array(rest, other)], names=["doc_id", "stated", "lang", "confidence", "letters", "other"])
                    first, some, owners, chars = i + 1, [], [], 0

    d = documents.select("doc_id", named_language(F.col("lang")).alias("stated"), F.col("text").cast("string").alias("_text"))
    return spread(d, "doc_id").mapInArrow(run, f"doc_id {kind}, stated string, lang string, confidence double, letters bigint, other array<struct<para:int,lang:string,confidence:double>>")


def _by_document(m: Model, some: list[str], owners: list[int]):
    got = m.judge(some) if m.langs else [(0, -1, 0.0)] * len(some)
    main, conf, letters, rest = [], [], [], []
    at = 0
    for n in owners:
        own = [(k + 1, *got[at + k]) for k in range(n) if got[at + k][1] >= 0]
        at += n
        letters.append(sum(x[1] for x in own))
        if not own:
            main.append(None)
            conf.append(None)
            rest.append([])
            continue
        votes: dict[int, list[int]] = {}
        for k, size, lang, _ in own:
            v = votes.setdefault(lang, [0, 0, -k])
            v[0] += 1
            v[1] += size
        best = max(votes, key=votes.__getitem__)
        mine = [(size, c) for _, size, lang, c in own if lang == best]
        main.append(m.langs[best])
        conf.append(sum(s * c for s, c in mine) / sum(s for s, _ in mine))
        rest.append([{"para": k, "lang": m.langs[lang], "confidence": c} for k, _, lang, c in own if lang != best])
    return main, conf, letters, rest


def p8_languages(documents: DataFrame) -> DataFrame:
    """doc_id, stated, para, lang, confidence: para 0 for each document that has a language, and each paragraph in another one."""
    d = identified(documents).where(F.col("lang").isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("para"), "lang", "confidence"))
    return d.select("doc_id", "stated", F.explode(F.concat(whole, "other")).alias("p")).select("doc_id", "stated", "p.para", "p.lang", "p.confidence")


def p8_found(documents: DataFrame) -> DataFrame:
    """doc_id, para, lang: para 0 where documents.lang doesn't name the main language, and each counted paragraph in another one."""
    return p8_languages(documents).where((F.col("para") > 0) | ~F.col("lang").eqNullSafe(F.col("stated"))).select("doc_id", "para", "lang")
