"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits,
URL schemes and identifier cues.  Local parsers then expand each anchor to the
boundaries of what may stand there and validate it, so no pattern is tried at every
character of a text.

Base kinds, leftmost and non-overlapping within a kind, and dropped without another
try if validation fails:

* ``email``: local part, at-sign, a domain of two labels or more;
* ``ip``: four dotted numbers of at most 255;
* ``card``: 16 to 19 digits, single spaces or hyphens between them, Luhn;
* ``phone``: plus sign, 8 to 15 digits with spaces, brackets, dots, hyphens.

Spans that the method adds:

* ``userinfo``: the ``user:password`` of ``scheme://user:password@host``;
* ``iban``: after the cue IBAN, country code, check digits and account, of the country's
  length or, if that isn't listed, of the longest that fits, modulo 97;
* ``account``: after an account cue, 6 to 18 digits in groups;
* ``ssn``: after a social-security cue, 3-2-4 digits, no all-zero group.

Scale: one scan, no shuffle, nothing that grows with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import documents, field

BASE = ("email", "ip", "card", "phone")
ADDED = ("userinfo", "iban", "account", "ssn")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP_REST = re.compile(r"(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@[A-Za-z0-9])")
_IBAN = re.compile(r"[Ii][Bb][Aa][Nn][ :#.=-]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[Aa]ccount|[Aa]cct|ACCOUNT|ACCT|[Kk]onto|[Cc]ompte|[Cc]uenta)\.?(?: ?(?:[Nn]umber|NUMBER|[Nn]o|NO|[Nn]r|[Nn]ummer|#)\.?)? ?[:#=]? ?([0-9](?:[ -]?[0-9]){5,17})(?![0-9A-Za-z])")
_SSN = re.compile(r"(?:SSN|ssn|[Ss]ocial [Ss]ecurity(?: [Nn]umber| [Nn]o\.?)?) ?[:#=]? ?((?!000)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
_CUES = {"iban": ("IBAN", "iban", "Iban"), "account": ("Account", "account", "ACCOUNT", "Acct", "acct", "ACCT", "Konto", "konto", "Compte", "compte", "Cuenta", "cuenta"), "ssn": ("SSN", "ssn", "Social Security", "Social security", "social security")}
_PARSERS = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN}

#: Characters of an account number by country.
_IBAN_LENGTHS = {country: length for length, countries in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "AE BG BH CR DE GB GE IE ME RS", 23: "GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR QA UA", 30: "JO KW MU", 31: "MT"}.items() for country in countries.split()}

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Anchors with what they announce and their length."""
    found = ahocorasick.Automaton()
    for word, kind in [("@", "email"), ("+", "phone"), ("://", "userinfo"), *((d, "digit") for d in "0123456789"), *((cue, kind) for kind, cues in _CUES.items() for cue in cues)]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban(said: str) -> int:
    """Characters of ``said``, which may run on into words or numbers, that are an account number; 0 if none are."""
    want = _IBAN_LENGTHS.get(said[:2])
    for end in range(len(said), 14, -1):
        if end == len(said) or said[end] == " ":
            whole = said[:end].replace(" ", "")
            if (len(whole) == want if want else len(whole) >= 15) and _mod97(whole):
                return end
    return 0


def find(text: str | None) -> list[Span]:
    """All spans, base and added, by kind as listed and then by start; ends exclusive."""
    if not text:
        return []
    got: dict[str, list[Span]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    run = 0
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    got["card"].append(("card", at, m.end()))
            # a number that no dotted rest follows has none later in the same run either
            if at >= run and at >= done["ip"]:
                run = _DIGITS.match(text, at).end()
                if m := _IP_REST.match(text, run):
                    done["ip"] = m.end()
                    if all(int(p) <= 255 for p in (text[at:run], m.group(1)[1:], m.group(2)[1:], m.group(3)[1:])):
                        got["ip"].append(("ip", at, m.end()))
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                got["email"].append(("email", start, m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    got["phone"].append(("phone", at, m.end()))
        elif kind == "userinfo":
            if m := _USERINFO.match(text, last + 1):
                got["userinfo"].append(("userinfo", last + 1, m.end()))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := _PARSERS[kind].match(text, at)) and m.start(1) >= done[kind]:
            if length := _iban(m.group(1)) if kind == "iban" else m.end(1) - m.start(1):
                done[kind] = m.start(1) + length
                got[kind].append((kind, m.start(1), m.start(1) + length))
    return [s for k in KINDS for s in got[k]]


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row; spans are (kind, start, end) in code points, ends exclusive.

    A null or empty text has none.  Spans come by kind as in ``KINDS``, then by
    start; those of different kinds may overlap.  Repeated rows stay separate.
    """
    src = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["doc_id", "spans"])

    return src.mapInArrow(run, T.StructType([field(src, "doc_id"), T.StructField("spans", _SPANS)]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by ``[KIND]``; where spans overlap, the first and longest counts.

    Null and empty texts stay as they are, other columns too; repeated rows stay
    separate.  An empty table gives an empty table.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t and masked(t, find(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with the spans' kinds in their place."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def joined(spans: str = "spans"):
    """The spans as ``kind:start:end``, comma-joined, as a column."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
