"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased; what isn't a letter becomes a space and runs of spaces one.  A
text starts after three pad symbols.  A language's model of order 4 interpolates
absolutely discounted 4-gram counts with continuation counts of the lower orders
and, at the bottom, a uniform distribution.  For every n-gram the tables hold the
whole interpolated log probability of each language that has it; for other languages
the tables of the lower orders and of the contexts' back-off weights are used.  Each
distinct 4-gram of a slice of text is looked up once.  Tables are sorted arrays of
64-bit hashes with a directory over their leading bits.

The language with the lowest cross-entropy per character wins.  A text is
*rejected* if its cross-entropy lies above that language's median by more than
``SLACK`` nats and by more than the calibrated bound for its length.  Both are taken
over all labelled rows, by predicted language; a language that none of them is
predicted as has those of all rows.

Scale: counts are taken over all labelled rows: each task folds its texts to distinct
4-grams, the sums are added by key, and come to the driver in blocks of whole languages.  All
4-grams are kept, so the model grows with the distinct 4-grams of the languages, by
some 30 bytes each, and not with the text; the driver and each worker hold one.  There
is no limit on languages: texts are scored fewer at a time the more there are.
Scoring is one scan without a shuffle; for calibration the scores, some 20 bytes a
row, are kept in the shared folder and aggregated there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field as member
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import discard, documents, field, materialize, slices

ORDER = 4
#: 4-grams that come to the driver at a time.
FETCHED = 1 << 22
#: Log probabilities that one step of scoring works on.
CELLS = 1 << 23
#: Share of the labelled rows that the length-dependent bound leaves above it.
TAIL = 0.001
#: Nats per character above the median that are never a reason to reject.
SLACK = 0.75
UNDETERMINED = "und"

_PAD, _SPACE = 1, 32
_LONG = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its 16-bit symbol: itself or a folded one for letters, else a space."""
    table = np.full(0x110000, _SPACE, np.uint16)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            table[cp] = cp if cp < 0x10000 else 0xE000 | cp & 0x1FFF
    table[_PAD] = _PAD
    return table


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts, the start of each text's run among them, and its number of letters."""
    pad = chr(_PAD) * (ORDER - 1)
    low = [(t or "").lower() for t in texts]
    joined = "".join(pad + (t.replace(chr(_PAD), " ") if chr(_PAD) in t else t) for t in low)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letters()[cps]
    owner = np.repeat(np.arange(len(texts)), [len(t) + ORDER - 1 for t in low])
    before = np.concatenate([[_PAD], codes[:-1]])
    kept = (codes != _SPACE) | ((before != _SPACE) & (before != _PAD))
    codes, owner = codes[kept].astype(np.uint64), owner[kept]
    grams = codes.copy()
    for back in range(1, ORDER):
        grams[back:] |= codes[: len(codes) - back] << _LONG(16 * back)
    real = codes != _PAD
    letters = np.bincount(owner[real & (codes != _SPACE)], minlength=len(texts))
    grams, owner = grams[real], owner[real]
    return grams, np.searchsorted(owner, np.arange(len(texts))), letters


def _mix(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> _LONG(31))) * _LONG(0x9E3779B97F4A7C15)
    return keys ^ (keys >> _LONG(29))


class HashArray:
    """Rows of numbers by 64-bit key: sorted hashes, and where each prefix of bits starts."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        hashes = _mix(keys)
        order = np.argsort(hashes, kind="stable")
        self.rows = rows[order].astype(np.float32)
        self._index(hashes[order])

    def _index(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        bits = max(1, min(22, int(np.ceil(np.log2(len(hashes) + 1))) + 1))
        self.shift = _LONG(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(hashes, edges), len(hashes)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where the key is absent."""
        hashes = _mix(keys)
        slot = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(keys), -1, np.int64)
        live = np.flatnonzero(at < end)
        at, end, hashes = at[live], end[live], hashes[live]
        while len(live):
            same = self.hashes[at] == hashes
            out[live[same]] = at[same]
            at = at + 1
            more = ~same & (at < end)
            live, at, end, hashes = live[more], at[more], end[more], hashes[more]
        return out


class SparseArray(HashArray):
    """Numbers by 64-bit key and language, held only for the pairs that there are."""

    def __init__(self, keys: np.ndarray, languages: np.ndarray, values: np.ndarray) -> None:
        hashes = _mix(keys)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        self._index(hashes[starts])
        self.starts = np.append(starts, len(hashes))
        self.languages, self.values = languages[order].astype(np.uint32), values[order].astype(np.float32)

    def fill(self, keys: np.ndarray, out: np.ndarray) -> None:
        """Put the numbers held for ``keys`` into their rows of ``out``, a column for each language."""
        at = self.find(keys)
        rows = np.flatnonzero(at >= 0)
        starts = self.starts[at[rows]]
        sizes = self.starts[at[rows] + 1] - starts
        entries = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out[np.repeat(rows, sizes), self.languages[entries]] = self.values[entries]


class _Language:
    """Counts of one language by order, as sorted keys, for building the tables."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, vocabulary: int, most: int | None = None) -> None:
        self.vocabulary = vocabulary
        frequent = counts >= np.sort(counts)[-most] if most and len(counts) > most else None
        self.levels = {}
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        if frequent is not None:
            frequent = frequent[order]
        for n in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.5
            contexts, at = np.unique(keys >> _LONG(16), return_inverse=True)
            totals = np.bincount(at, weights=counts)
            weight = discount * np.bincount(at) / totals
            self.levels[n] = (keys, (counts - discount) / totals[at], contexts, weight)
            if n > 1:
                # a lower order counts the distinct contexts that an n-gram continues
                keys, tally = np.unique(keys & _LONG((1 << 16 * (n - 1)) - 1), return_counts=True)
                counts = tally.astype(np.float64)
        if frequent is not None:
            own, share, contexts, weight = self.levels[ORDER]
            self.levels[ORDER] = (own[frequent], share[frequent], contexts, weight)

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def weight(self, contexts: np.ndarray, n: int) -> np.ndarray:
        return self._get(self.levels[n][2], self.levels[n][3], contexts, 1.0)

    def probability(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(keys), 1.0 / self.vocabulary)
        own, share, _, _ = self.levels[n]
        lower = self.probability(keys & _LONG((1 << 16 * (n - 1)) - 1), n - 1)
        return self._get(own, share, keys, 0.0) + self.weight(keys >> _LONG(16), n) * lower


@dataclass
class Model:
    """Tables of all languages, and what rejection was calibrated to."""

    languages: list[str]
    grams: dict[int, SparseArray] = member(default_factory=dict)
    weights: dict[int, SparseArray] = member(default_factory=dict)
    floor: float = 0.0
    median: dict[str, float] = member(default_factory=dict)
    bound: dict[str, float] = member(default_factory=dict)

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], max_grams: int | None = None) -> Model:
        """From each language's 4-gram keys and counts.

        With ``max_grams`` only the most frequent 4-grams of each language are
        stored, those of equal count together; discounts, lower orders and back-off
        weights are those of all.
        """
        names = sorted(name for name, (keys, _) in counts.items() if len(keys))
        model = cls(names)
        if not names:
            return model
        vocabulary = len(np.unique(np.concatenate([counts[n][0] & _LONG(0xFFFF) for n in names]))) + 1
        parts = [_Language(*counts[n], vocabulary, max_grams) for n in names]
        model.floor = float(-np.log(vocabulary))
        for n in range(1, ORDER + 1):
            for table, keys, logs in (
                (model.grams, [p.levels[n][0] for p in parts], [np.log(p.probability(p.levels[n][0], n)) for p in parts]),
                (model.weights, [p.levels[n][2] for p in parts], [np.log(p.levels[n][3]) for p in parts]),
            ):
                table[n] = SparseArray(np.concatenate(keys), np.repeat(np.arange(len(parts)), [len(k) for k in keys]), np.concatenate(logs))
        return model

    def at_once(self) -> int:
        """Texts that may be scored at a time."""
        return max(1, CELLS // max(1, len(self.languages)))

    def _logs(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        out = self._logs(keys & _LONG((1 << 16 * (n - 1)) - 1), n - 1)
        back = np.zeros_like(out)
        self.weights[n].fill(keys >> _LONG(16), back)
        out += back
        self.grams[n].fill(keys, out)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character by text and language, characters, letters."""
        grams, starts, letters = symbols(texts)
        sizes = np.diff(np.append(starts, len(grams)))
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some) and self.languages:
            begins, step = starts[some], max(1, CELLS // len(self.languages))
            for a in range(0, len(grams), step):
                b = min(len(grams), a + step)
                keys, at = np.unique(grams[a:b], return_inverse=True)
                first, last = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b)
                edges = np.maximum(begins[first:last] - a, 0)
                out[some[first:last]] -= np.add.reduceat(self._logs(keys, ORDER)[at], edges, axis=0, dtype=np.float64)
            out[some] /= sizes[some, None]
        return out, sizes, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, list[bool]]:
        """Language, score, cross-entropy and rejection of each text."""
        h, sizes, letters = self.entropies(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), [True] * len(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        score = 1.0 / np.exp(-2.0 * np.sqrt(sizes)[:, None] * (h - low[:, None])).sum(axis=1)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), letters.tolist())]
        score[letters == 0] = 0.0
        rejected = [name == UNDETERMINED or float(x) - self.median.get(name, np.inf) > max(SLACK, self.bound.get(name, np.inf) / np.sqrt(max(1, n))) for name, x, n in zip(names, low, sizes)]
        return names, score, low, rejected


def held_out(doc_id: str | Column) -> Column:
    """Whether CRC-32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): 4-gram counts of each language over all rows of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in sorted(running.items()):
                for i in range(0, len(keys), 100_000):
                    part = keys[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(counts[i : i + 100_000])], ["lang", "gram", "n"])
            running.clear()

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for a, b in slices([len(t) for t in texts]):
                    keys, counts = np.unique(symbols(texts[a:b])[0], return_counts=True)
                    if lang in running:
                        old, tally = running[lang]
                        keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                        counts = np.bincount(at, weights=np.concatenate([tally, counts])).astype(np.int64)
                    running[lang] = (keys, counts)
            if sum(len(k) for k, _ in running.values()) > 4_000_000:
                yield from emit()
        yield from emit()

    return labelled.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_grams: int | None = None) -> Model:
    """Fit and calibrate a model on all rows whose text and language aren't null.

    All 4-grams are kept unless ``max_grams`` says how many of a language are, see
    ``Model.fit``; with none labelled the model has no language and decides nothing.
    """
    rows = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counted = materialize(_counts(rows), "kn-counts")
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for block in _blocks({r.lang: r["count"] for r in counted.groupBy("lang").count().collect()}):
        got = counted.where(F.col("lang").between(block[0], block[-1])).select("lang", "gram", "n").toArrow()
        codes = got.column("lang").combine_chunks().dictionary_encode()
        at, grams, n = codes.indices.to_numpy(), got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(len(codes.dictionary) + 1))
        for lang, a, b in zip(codes.dictionary.to_pylist(), edges, edges[1:]):
            counts[lang] = (grams[order[a:b]], n[order[a:b]])
    discard(counted)
    model = Model.fit(counts, max_grams)
    if model.languages:
        _calibrate(model, rows)
    return model


def _blocks(sizes: dict[str, int], most: int = FETCHED) -> Iterator[list[str]]:
    """Runs of languages in string order with about ``most`` 4-grams together; a larger one is alone."""
    block, total = [], 0
    for lang in sorted(sizes):
        if block and total + sizes[lang] > most:
            yield block
            block, total = [], 0
        block.append(lang)
        total += sizes[lang]
    if block:
        yield block


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Set each language's median cross-entropy and its bound on the excess times the root of the length, over all rows."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices([len(t) for t in texts], rows=sent.value.at_once()):
                h, sizes, letters = sent.value.entropies(texts[a:b])
                best = h.argmin(axis=1)
                kept = letters > 0
                yield pa.RecordBatch.from_arrays([pa.array([sent.value.languages[i] for i in best[kept]], pa.string()), pa.array(h[np.arange(len(h)), best][kept]), pa.array(np.sqrt(sizes[kept]))], ["lang", "h", "root"])

    scored = materialize(rows.select("text").mapInArrow(run, "lang string, h double, root double"), "kn-scores")
    # the row of null is that of all languages
    medians = {r.lang: r.m for r in scored.rollup("lang").agg(F.percentile_approx("h", 0.5, 10_000).alias("m")).collect() if r.m is not None}
    if medians:
        middle = spark.createDataFrame([(k, v) for k, v in medians.items() if k is not None], "lang string, middle double")
        # a row for each language, of which the driver and every worker hold far more
        excess = scored.join(F.broadcast(middle), "lang").select("lang", ((F.col("h") - F.col("middle")) * F.col("root")).alias("x"))
        bounds = {r.lang: max(0.0, r.b) for r in excess.rollup("lang").agg(F.percentile_approx("x", 1 - TAIL, 10_000).alias("b")).collect()}
        model.median = {name: medians.get(name, medians[None]) for name in model.languages}
        model.bound = {name: bounds.get(name, bounds[None]) for name in model.languages}
    discard(scored)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) for each row.

    ``und`` with score 0 if the text is null or has no letter, or the model no
    language; such rows are rejected.  Else a learned language, a score that tends
    to 1 as the others fall behind, and the cross-entropy in nats per character.
    Ties go to the first language in string order.  Repeated rows stay separate.
    """
    src = documents(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], rows=sent.value.at_once()):
                names, score, h, rejected = sent.value.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(h), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    long = T.StructType([field(src, "doc_id"), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return src.mapInArrow(run, long)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject.

    Null texts, texts without a letter and, if the model has no language, all rows are
    rejected.  Ties go to the first language in string order; repeated rows stay or go
    together.  An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices([len(t or "") for t in texts], rows=sent.value.at_once()):
                rejected = sent.value.predict(texts[a:b])[3]
                yield batch.slice(a, b - a).filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
