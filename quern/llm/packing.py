"""Sequence packing: bounded-space online best fit.

Each partition reads its documents in order, cuts whole windows off a document as
long as one can be filled, and places what remains into the fullest of a fixed
number of open windows that still has room for it.  When none has, the fullest
window is topped up with the document's first ids and emitted, and the rest is
placed as before.  The windows that a partition still holds open at its end are
merged with those of its neighbours, ``GROUP`` partitions at a time.

Scale: text is read once and never shuffled.  What moves is the leftovers, at most
``windows`` windows a partition.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import documents, field, materialize

CAPACITY = 1024
WINDOWS = 32
#: Partitions whose leftover windows are merged by one task.
GROUP = 128
END = 0
TOKENIZERS = "/opt/tokenizers"

_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to the little-endian unsigned 32-bit ids of a byte-level BPE file.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, so a
    special token's string in a text becomes that token's id.  A ``tokenizers`` JSON
    file is read as it stands; its merge list is turned into the ranks of the same
    vocabulary, which another library applies several times faster with equal ids.
    A file of another form is given to ``tokenizers`` itself.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and model["type"] == "BPE"
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # added tokens must be cut out as they stand, before anything else
    plain = plain and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) and all(t["special"] for t in spec["added_tokens"])
    if plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # ids must grow along the merge list, so that they can serve as ranks
        order = [ranks[bytes(byte_of[c] for c in a + b)] for a, b in merges]
        if order == sorted(order):
            core = tiktoken.Encoding("bpe", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)._core_bpe
            allowed = set(special)
            return lambda text: memoryview(core.encode_to_tiktoken_buffer(text, allowed)).tobytes()
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level BPE files."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Packer:
    """Best fit into a fixed number of open windows.

    A piece is (document number, start, length, offset, ids).  ``add`` returns the
    windows that it closes, as lists of pieces; ``rest`` those still open.
    """

    def __init__(self, capacity: int, windows: int) -> None:
        self.capacity, self.limit = capacity, windows
        self.open: list[list] = []
        self.fill: list[int] = []

    def _put(self, slot: int, doc: int, start: int, ids: bytes) -> None:
        n = len(ids) // 4
        self.open[slot].append((doc, start, n, self.fill[slot], ids))
        self.fill[slot] += n

    def _close(self, slot: int) -> list:
        self.fill.pop(slot)
        return self.open.pop(slot)

    def add(self, doc: int, ids: bytes, start: int = 0) -> list[list]:
        done = []
        cap = self.capacity * 4
        at = 0
        while len(ids) - at >= cap:
            done.append([(doc, start + at // 4, self.capacity, 0, ids[at : at + cap])])
            at += cap
        ids, start = ids[at:], start + at // 4
        while ids:
            n = len(ids) // 4
            best, fill = -1, -1
            for i, f in enumerate(self.fill):
                if f > fill and f + n <= self.capacity:
                    best, fill = i, f
            if best < 0 and len(self.open) >= self.limit:
                fullest = max(range(len(self.fill)), key=self.fill.__getitem__)
                gap = (self.capacity - self.fill[fullest]) * 4
                self._put(fullest, doc, start, ids[:gap])
                done.append(self._close(fullest))
                ids, start = ids[gap:], start + gap // 4
                continue
            if best < 0:
                self.open.append([])
                self.fill.append(0)
                best = len(self.open) - 1
            self._put(best, doc, start, ids)
            if self.fill[best] == self.capacity:
                done.append(self._close(best))
            break
        return done

    def rest(self) -> list[list]:
        left, self.open, self.fill = self.open, [], []
        return left


def merge(leftovers: list[tuple[int, int, bytes]], capacity: int) -> list[list]:
    """Pack leftover pieces (row, start, ids), largest first, one window at a time.

    Each window takes pieces that fit and then a cut of the next one, so that all
    but the last are full.
    """
    packer = Packer(capacity, 1)
    done = []
    for row, start, ids in sorted(leftovers, key=lambda p: (-len(p[2]), p[0], p[1])):
        done += packer.add(row, ids, start)
    return done + packer.rest()


def _schema(src: DataFrame, *more: T.StructField) -> T.StructType:
    long, binary = T.LongType(), T.BinaryType()
    return T.StructType([field(src, "doc_id"), T.StructField("start", long), T.StructField("length", long), T.StructField("ids_crc32", long), T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long), T.StructField("ids", binary), *more])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), a row for each piece.

    ``tokenizer`` is the path of a byte-level BPE file on every worker.  Each row of
    ``docs`` is one document: the ids of its text (null: empty), then id 0, so even
    an empty text gives one piece.  Rows that repeat are packed as often as they
    occur.  ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers,
    unless ``keep_ids`` is false.  No piece is lost or held twice; offsets within a
    sequence are gapless.  An empty table gives an empty table.
    """
    src = documents(docs, id_col, text_col)
    schema = _schema(src, T.StructField("part", T.LongType()))
    names = schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(capacity, windows)
        known: dict[int, tuple] = {}
        end = END.to_bytes(4, "little")
        doc = sequence = 0
        rows: list[list] = [[] for _ in names]

        def emit(windows: list[list], left: bool = False) -> None:
            nonlocal sequence
            for window in windows:
                for number, start, n, offset, ids in window:
                    doc_id, tokens = known[number]
                    for column, value in zip(rows, (doc_id, start, n, zlib.crc32(ids), tokens, part << 40 | sequence, offset, ids if left or keep_ids else None, part if left else None)):
                        column.append(value)
                sequence += 1

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [kind, *[pa.int64()] * 6, pa.binary(), pa.int64()])], names)
            for c in rows:
                c.clear()
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                known[doc] = (doc_id, len(ids) // 4)
                emit(packer.add(doc, ids))
                doc += 1
            held = {p[0] for w in packer.open for p in w}
            known = {k: v for k, v in known.items() if k in held}
            if rows[0]:
                yield flush(kind)
        emit(packer.rest(), True)
        if rows[0]:
            yield flush(kind)

    placed = materialize(src.mapInArrow(place, schema), "packed")

    out = _schema(src)

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        group = table.column("part")[0].as_py() // GROUP
        pieces = list(zip(range(table.num_rows), table.column("start").to_pylist(), table.column("ids").to_pylist()))
        cut = [(row, start, n, zlib.crc32(ids), -1 - (group << 40 | nth), offset, ids if keep_ids else None) for nth, window in enumerate(merge(pieces, capacity)) for row, start, n, offset, ids in window]
        row, *columns = zip(*cut)
        start, length, crc, sequence, offset = (pa.array(c, pa.int64()) for c in columns[:5])
        own = table.take(pa.array(row))
        return pa.table([own.column("doc_id"), start, length, crc, own.column("doc_tokens"), sequence, offset, pa.array(columns[5], pa.binary())], out.names)

    left = placed.where("part IS NOT NULL").withColumn("__group", F.floor(F.col("part") / GROUP))
    left = left.groupBy("__group").applyInArrow(merged, out)
    return placed.where("part IS NULL").select(*out.names).unionByName(left)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the whole sequences of ``pack`` with their ids joined in order.

    ``pieces`` must have been packed with ``keep_ids``; without it, ids are null.
    No pieces give an empty table.  A sequence is bounded by the capacity.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def byte_bpe_path() -> str:
    """The public byte-level BPE file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
