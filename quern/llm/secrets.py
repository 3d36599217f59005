"""Secret scan: fixed patterns, and a battery of randomness tests.

Base kinds, leftmost and non-overlapping within a kind:

* ``assign``: a cue such as ``password`` or ``api_key``, ``:`` or ``=``, and a value
  of 6 characters or more;
* ``access``: ``AKIA`` and capitals or digits, 20 characters or more;
* ``hex``: a run of ``[0-9a-f]``, 24 characters or more.

Added kind ``random``: a part of a run of ``[A-Za-z0-9+/_=-]`` with 20 characters or
more besides padding that looks drawn at random from the alphabet of its encoding
(hexadecimal, base 32, lower- or upper-case alphanumeric, base 62, base 64), be it the
value of an assignment, a base span or neither; spans of this kind may overlap those of
the base kinds, which stand as they are. A string without a digit is judged among the letters alone, over which a
random one is uniform too; there a fourth test tells long words from it, by how often
their letters occur in European languages. Runs are parted at an inner ``=``; a part
that no alphabet holds, as it has ``/`` or ``+`` besides ``-`` or ``_``, is parted both
at ``/`` and at ``-`` and ``_``, so spans of this kind may overlap there. Three tests
are made on its symbols' places in that alphabet: chi-squared uniformity with the
variance that it has at the string's length, runs about the alphabet's middle, and
serial correlation. Their p-values are combined by Fisher's method into one that is
uniform for random strings and near 0 for others.

What counts as a discovery is settled over the whole corpus, apart for each encoding and
range of lengths, since short strings leave the tests little power. Each distinct string
counts once, however often it occurs. Random strings spread evenly over p, so twice the
number above one half estimates how many there are; what lies above a threshold beyond
their share are false discoveries. The lowest threshold on a grid that keeps these
within ``FDR`` is taken, and none if no threshold does. Where fewer than ``SPARSE``
distinct strings have a p-value of ``LOWEST`` or more, there is nothing to estimate
from: each is tested by itself at ``LEVEL``, which loses that share of random strings
and doesn't bound the false ones.

Scale: one scan finds the spans; a table of them with a hash for each candidate, without
text, is kept in the shared folder. Hashes are made distinct by a shuffle, and only a
histogram of p-values of fixed size comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import byte_texts, documents, field, materialize

BASE = ("assign", "access", "hex")
ADDED = ("random",)
KINDS = BASE + ADDED
LEAST = 20
FDR = 0.05
BINS = 200
#: Thresholds that may be chosen, and the first length of each range.
LOWEST, HIGHEST = 0.01, 0.5
LENGTHS = (20, 32, 48, 80)
#: Distinct strings from ``LOWEST`` up that a stratum needs for an estimate, and the threshold of those with fewer.
SPARSE, LEVEL = 50, 0.05

_ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_CUES = (b"passw", b"secret", b"token", b"api")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPLIT = bytes(b if b in _TOKEN else 32 for b in range(256))
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: What lies between a run's ``=``, with the padding that ends the run.
_PART = re.compile(rb"[A-Za-z0-9+/_-]+(?:=+\Z)?")
_FINER = (re.compile(rb"[^/]+"), re.compile(rb"[^_-]+"))

_D, _U, _L = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Encodings from the narrowest alphabet to the widest; a string has the first that holds it.
ENCODINGS = (
    *(("hex", _D + b"abcdef"), ("HEX", _D + b"ABCDEF"), ("lower26", _L), ("upper26", _U), ("base32", _U + b"234567"), ("lower36", _D + _L), ("upper36", _D + _U)),
    *(("letters52", _U + _L), ("base62", _D + _U + _L), ("letters54", _U + _L + b"+/"), ("letters54url", _U + _L + b"-_"), ("base64", _D + _U + _L + b"+/"), ("base64url", _D + _U + _L + b"-_")),
)
#: How often a to z occur in a hundred letters of prose, about, over several European languages.
_PROSE = (7.5, 1.5, 3.2, 4.2, 14.7, 1.6, 1.8, 3.5, 7.4, 0.4, 0.7, 4.3, 2.6, 8.1, 5.5, 2.1, 0.6, 6.8, 7.0, 6.8, 4.6, 1.6, 1.0, 0.3, 0.8, 0.8)
_PLACES = [np.array([alphabet.find(bytes([b])) for b in range(256)]) for _, alphabet in ENCODINGS]



def _wordlike(alphabet: bytes) -> np.ndarray | None:
    """For letters without digits how much each place speaks for prose, with mean 0 and variance 1 over the alphabet."""
    if any(b in _D for b in alphabet):
        return None
    w = np.array([math.log(_PROSE[(b | 32) - 97]) if chr(b).isalpha() else math.log(100 / 26) for b in alphabet])
    return (w - w.mean()) / w.std()


_WORDLIKE = [_wordlike(alphabet) for _, alphabet in ENCODINGS]

Found = tuple[str, int, int, str | None, float | None, int | None]


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(places: np.ndarray, size: int, wordlike: np.ndarray | None = None) -> float:
    """Combined p-value of the tests for symbols' places in an alphabet of ``size``; the fourth is made with ``wordlike``."""
    n = len(places)
    chi = float(((np.bincount(places, minlength=size) - n / size) ** 2).sum()) * size / n
    # with few symbols a cell chi-squared keeps its mean, but its variance shrinks: scale to both
    mean, var = size - 1.0, 2.0 * (size - 1) * (n - 1) / n
    scale, df = var / (2 * mean), 2 * mean * mean / var
    # Wilson and Hilferty's cube root makes it nearly normal
    uniform = _upper(((chi / scale / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = places >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        turns = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 0.0
    else:
        turns = 0.0
    x = places - places.mean()
    power = float((x * x).sum())
    serial = math.erfc(abs((float((x[1:] * x[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) / math.sqrt(2)) if power else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, turns, serial))
    if wordlike is None:
        return math.exp(-half) * (1 + half + half * half / 2)
    half -= math.log(max(_upper(float(wordlike[places].sum()) / math.sqrt(n)), 1e-300))
    return math.exp(-half) * (1 + half + half * half / 2 + half**3 / 6)


def judge(token: bytes) -> tuple[str, float] | None:
    """Stratum and p-value of a token, or None if it isn't a candidate."""
    body = token.strip(b"=")
    if len(body) < LEAST:
        return None
    raw = np.frombuffer(body, np.uint8)
    for (name, alphabet), table, wordlike in zip(ENCODINGS, _PLACES, _WORDLIKE):
        places = table[raw]
        if (places >= 0).all():
            length = max(x for x in LENGTHS if x <= len(body))
            return f"{name}:{length}", battery(places, len(alphabet), wordlike)
    return None


def _hash(token: bytes) -> int:
    """A signed 64-bit hash of a token without its padding."""
    return int.from_bytes(hashlib.blake2b(token.strip(b"="), digest_size=8).digest(), "big", signed=True)


def _judged(run: bytes) -> Iterator[tuple[int, int, str, float, int]]:
    """Start, end, stratum, p-value and hash of each candidate in a run, by start."""
    for m in _PART.finditer(run):
        if m.end() - m.start() < LEAST:
            continue
        if seen := judge(m.group()):
            yield (*m.span(), *seen, _hash(m.group()))
            continue
        finer = {(m.start() + x.start(), m.start() + x.end()) for cut in _FINER for x in cut.finditer(m.group())}
        for a, b in sorted(finer):
            if b - a >= LEAST and (seen := judge(run[a:b])):
                yield (a, b, *seen, _hash(run[a:b]))


def find(data: bytes | None) -> list[Found]:
    """Base spans and candidates of a text: kind, start, end, and stratum, p and hash of candidates.

    Places are code points, ends exclusive; by start, then kind as listed.
    """
    if not data:
        return []
    out: list[Found] = []
    if b"=" in data or b":" in data:
        low = data.translate(_LOWER)
        if any(cue in low for cue in _CUES):
            out += [("assign", *m.span(), None, None, None) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        out += [("access", *m.span(), None, None, None) for m in _ACCESS.finditer(data)]
    words = data.translate(_SPLIT).split()
    if words and max(map(len, words)) >= LEAST:
        out += [("hex", *m.span(), None, None, None) for m in _HEX.finditer(data)]
        for m in _RUN.finditer(data):
            out += [("random", m.start() + a, m.start() + b, *seen) for a, b, *seen in _judged(m.group())]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out if not out or data.isascii() else _in_characters(data, out)


def _in_characters(data: bytes, spans: list[Found]) -> list[Found]:
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(kind, int(before[a]), int(before[b]), *rest) for kind, a, b, *rest in spans]


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("stratum", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("hash", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("p", pa.float64()), ("hash", pa.int64())]))
_KEYS = ("kind", "start", "end", "stratum", "p", "hash")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): base spans, and all candidates with stratum, p-value and hash.

    A null or empty text has none; repeated rows and null ids stay separate rows; an
    empty table gives an empty table.
    """
    src = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(_KEYS, s)) for s in find(t)] for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["doc_id", "spans"])

    return src.mapInArrow(run, T.StructType([field(src, "doc_id"), T.StructField("spans", _SPANS)]))


def choose(histogram: dict[str, list[int]], fdr: float = FDR) -> dict[str, float]:
    """Each stratum's threshold from its counts of distinct strings by bin of p; strata without one are left out."""
    out = {}
    for stratum, counts in histogram.items():
        above = np.cumsum(np.array(counts)[::-1])[::-1]
        bins = len(counts)
        if above[int(LOWEST * bins)] < SPARSE:
            out[stratum] = LEVEL
            continue
        random = 2 * int(above[bins // 2])
        for i in range(int(LOWEST * bins), int(HIGHEST * bins) + 1):
            if random and max(0.0, above[i] - random * (1 - i / bins)) <= fdr * above[i]:
                out[stratum] = i / bins
                break
    return out


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """Thresholds by stratum over the whole of ``candidates``' result, each distinct string once."""
    each = found.select(F.explode(F.filter("spans", lambda s: s["p"].isNotNull())).alias("s"))
    each = each.select("s.stratum", "s.p", "s.hash").distinct()
    bins = each.groupBy("stratum", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    histogram: dict[str, list[int]] = {}
    for r in bins.collect():
        histogram.setdefault(r.stratum, [0] * BINS)[r.bin] += r["count"]
    return choose(histogram, fdr)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, spans) for each row; spans are (kind, start, end, stratum, p, hash), the last three null for base kinds.

    A null or empty text has none.  Repeated rows stay separate; their strings count
    once in the false-discovery control.
    """
    found = materialize(candidates(docs, id_col, text_col), "secret-candidates")
    limits = thresholds(found, fdr)
    kept = F.col("spans")
    if limits:
        limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
        kept = F.filter("spans", lambda s: s["p"].isNull() | F.coalesce(s["p"] >= F.try_element_at(limit, s["stratum"]), F.lit(False)))
    else:
        kept = F.filter("spans", lambda s: s["p"].isNull())
    return found.select("doc_id", kept.alias("spans"))


def discovered(spans: list[Found], limits: dict[str, float]) -> list[Found]:
    return [s for s in spans if s[4] is None or s[4] >= limits.get(s[3], 2.0)]


def masked(text: str, spans: list[Found]) -> str:
    """The text with ``[SECRET]`` for each span; spans that overlap are masked as one."""
    out, last = [], 0
    end = -1
    for _, a, b, *_ in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[last:a], "[SECRET]"]
        end = max(end, b)
        last = end
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, fdr: float = FDR) -> DataFrame:
    """``docs`` with every secret masked; ``length_col``, if given, becomes the text's code points.

    Thresholds are taken over the whole input first; the second scan masks.  A null
    text and its length stay null, an empty one stays empty; repeated rows stay
    separate.  An empty table gives an empty table.
    """
    limits = thresholds(candidates(docs.withColumn("__none", F.lit(0)), "__none", text_col), fdr)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            found = [discovered(find(t), limits) for t in byte_texts(column)]
            hit = [i for i, spans in enumerate(found) if spans]
            if hit:
                texts = column.to_pylist()
                for i in hit:
                    texts[i] = masked(texts[i], found[i])
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
