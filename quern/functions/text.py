"""Text analysis and size measures as Catalyst expressions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words too common to search for, by length.
STOP_WORDS = tuple(sorted("which where with when what that from into why who was how for and are the to or on of it is in by be at as an a".split()))
_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"
_CAMEL = r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
#: Suffixes of which at most one is cut: the longest whose rest has four bytes or more.
SUFFIXES = ("ization", "ation", "ated", "ingly", "edly", "ing", "ed", "ies", "es", "s")
#: The least characters that make up four bytes in UTF-8.
_FOUR = r"(?:[\x{10000}-\x{10FFFF}]|[\x{800}-\x{10FFFF}].|.[\x{800}-\x{10FFFF}]|[^\x00-\x7F]{2}|[^\x00-\x7F]..|.[^\x00-\x7F].|..[^\x00-\x7F]|.{4})"
_STEM = f"^({_FOUR}.*?)(?:{'|'.join(SUFFIXES)})$"


def stem_or_empty(term: Column) -> Column:
    """The term without its suffix; empty if none can be cut.

    One expression, not a chain of cases: generated code must stay small enough for
    the JVM to compile it.
    """
    return F.when(F.right(term, F.lit(1)).isin("s", "d", "g", "y", "n"), F.regexp_extract(term, _STEM, 1)).otherwise("")


def stem(term: Column) -> Column:
    """The term without its suffix; null if none can be cut."""
    return F.nullif(stem_or_empty(term), F.lit(""))


def analyze(df: DataFrame, text: Column, *keep: Column | str) -> DataFrame:
    """The ``keep`` columns and one row (term) for each term occurrence of ``text``.

    A token is a run of letters and digits.  It gives its lower-case form, its
    camel-case parts that differ from that, and one stem of each; stop words give
    nothing.  ``explode_outer`` serves where the array is never empty, as it keeps
    the optimizer from evaluating the array a second time in a filter.
    """
    tokens = df.select(*keep, F.explode_outer(F.split(text, _SPLIT)).alias("__token"))
    kept = [c for c in tokens.columns if c != "__token"]
    tokens = tokens.where("__token <> ''")
    token, low = F.col("__token"), F.lower("__token")
    own = F.filter(F.transform(F.split(token, _CAMEL), F.lower), lambda p: p != F.lower("__token"))
    raw = F.when(token.rlike(_CAMEL), F.concat(F.array(low), own)).otherwise(F.array(low))
    words = tokens.select(*kept, F.explode_outer(raw).alias("__raw")).where(~F.col("__raw").isin(*STOP_WORDS))
    both = F.array(F.col("__raw"), stem_or_empty(F.col("__raw")))
    return words.select(*kept, F.explode_outer(both).alias("term")).where("term <> ''")


def terms_of(text: Column) -> Column:
    """An array of what ``analyze`` gives for one text, so that a document's terms stay in its row; null for null."""

    def raw(token: Column) -> Column:
        low = F.lower(token)
        parts = F.filter(F.transform(F.split(token, _CAMEL), F.lower), lambda p: p != low)
        return F.filter(F.when(token.rlike(_CAMEL), F.concat(F.array(low), parts)).otherwise(F.array(low)), lambda r: ~r.isin(*STOP_WORDS))

    words = F.flatten(F.transform(F.filter(F.split(text, _SPLIT), lambda t: t != ""), raw))
    return F.filter(F.flatten(F.transform(words, lambda r: F.array(r, stem_or_empty(r)))), lambda t: t != "")


#: What the patterns say of a character: part of a token, lower case or number, upper case, lower case.
WORD, AFTER, UPPER, LOWER = 1, 2, 4, 8
_tables: dict[str, tuple[bytes, dict[str, str]]] = {}


def alphabet(spark: SparkSession) -> tuple[bytes, dict[str, str]]:
    """The flags of each code point and the lower-case forms, as this JVM has them; asked for once in a session."""
    app = spark.sparkContext.applicationId
    if app not in _tables:
        n = F.col("id")
        # other planes have no letters
        chars = spark.range(0x40000).where((n < 0xD800) | (n > 0xDFFF)).select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
        kinds = ((_SPLIT[2:-2], WORD), (r"\p{IsLowercase}\p{N}", AFTER), (r"\p{IsUppercase}", UPPER), (r"\p{IsLowercase}", LOWER))
        flags = sum((F.when(F.col("c").rlike(f"^[{k}]$"), v).otherwise(0) for k, v in kinds), F.lit(0))
        held = chars.select("id", "c", flags.alias("flags"), F.lower("c").alias("low")).toArrow()
        table = np.zeros(0x110000, np.uint8)
        table[held.column("id").to_numpy()] = held.column("flags").to_numpy()
        low = {c: x for c, x in zip(held.column("c").to_pylist(), held.column("low").to_pylist()) if c != x}
        _tables[app] = table.tobytes(), low
    return _tables[app]


class Analyzer:
    """``terms_of`` a token at a time, for Python workers: by the JVM's own table of characters."""

    #: Characters of a token, and tokens, whose terms a caller may keep.
    LONGEST, KEPT = 64, 1 << 18

    def __init__(self, table: bytes, low: dict[str, str]) -> None:
        self.table, self.low = table, low

        def ranges_of(flag: int) -> list[tuple[int, int]]:
            edges = np.flatnonzero(np.diff((np.frombuffer(table, np.uint8) & flag) != 0, prepend=False, append=False)).tolist()
            return list(zip(edges[::2], edges[1::2]))

        ranges = ranges_of(WORD)
        own = "".join(f"\\U{a:08x}-\\U{min(b, 0x10000) - 1:08x}" for a, b in ranges if a < 0x10000)
        high = "".join(f"\\U{max(a, 0x10000):08x}-\\U{b - 1:08x}" for a, b in ranges if b > 0x10000)
        self._plain = re.compile(f"[{own}]+").findall
        self._any = re.compile(f"(?:[{own}]|[{high}])+").findall
        self._high = re.compile("[\U00010000-\U0010ffff]").search
        self._upper = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in ranges_of(UPPER)) + "]").search
        self._ascii = re.compile("[0-9A-Za-z]+").findall

    def tokens(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text) if self._high(text) else self._plain(text)

    def lower(self, token: str) -> str:
        # a final sigma depends on what is around it
        if token.isascii() or "\u03a3" in token:
            return token.lower()
        return "".join(self.low.get(c, c) for c in token)

    def parts(self, token: str) -> list[str]:
        kinds = [self.table[ord(c)] for c in token]
        # a look behind sees but the last half of a pair
        last = [0 if c > "\uffff" else k for c, k in zip(token, kinds)]
        cuts = [0]
        for i in range(1, len(kinds)):
            if kinds[i] & UPPER and (last[i - 1] & AFTER or (last[i - 1] & UPPER and i + 1 < len(kinds) and kinds[i + 1] & LOWER)):
                cuts.append(i)
        return [token[a:b] for a, b in zip(cuts, [*cuts[1:], len(token)])]

    def stem(self, term: str) -> str:
        if not term.endswith(_LAST):
            return ""
        for suffix in _BY_LENGTH:
            if term.endswith(suffix):
                if len(term) - len(suffix) >= 4 or len(term[: -len(suffix)].encode()) >= 4:
                    return term[: -len(suffix)]
        return ""

    def terms(self, token: str) -> tuple[str, ...]:
        low = self.lower(token)
        # parts begin with an upper-case letter
        if not self._upper(token, 1) or len(parts := self.parts(token)) == 1:
            stem = self.stem(low)
            return () if low in _STOPPED else (low, stem) if stem else (low,)
        raw = [low, *(p for p in map(self.lower, parts) if p != low)]
        return tuple(t for r in raw if r not in _STOPPED for t in (r, self.stem(r)) if t)


_STOPPED = frozenset(STOP_WORDS)
_BY_LENGTH, _LAST = sorted(SUFFIXES, key=len, reverse=True), tuple({s[-1] for s in SUFFIXES})
_analyzers: dict[int, Analyzer] = {}


def analyzer(table: bytes, low: dict[str, str]) -> Analyzer:
    """One for each worker and table."""
    key = hash(table)
    if key not in _analyzers:
        _analyzers.clear()
        _analyzers[key] = Analyzer(table, low)
    return _analyzers[key]


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def word_size(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def line_size(text: Column) -> Column:
    """Lines; a last one without line end counts, an empty text has none."""
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def snippet(text: Column, length: int = 120) -> Column:
    """White space collapsed, cut to ``length`` characters."""
    return F.left(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(length))
