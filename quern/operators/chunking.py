"""Documents into exact, source-backed chunks.

Chunk boundaries depend on all that came before them in a text, so chunkers run as
Arrow functions, a batch of texts at a time; texts are never shuffled.  Ranges are
byte offsets into UTF-8, half open; lines count from 1, columns in bytes from 0.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern import errors
from quern.operators import eligibility

WINDOW_BYTES, OVERLAP_BYTES = 6_000, 600
MAX_WORDS, MAX_CHUNK_BYTES, MAX_INPUT_BYTES = 1_500, 25_000, 5 << 20
MAX_DEPTH = 512

Sizer = Callable[[str], int]


def byte_sizer(text: str) -> int:
    return len(text.encode())


def word_sizer(text: str) -> int:
    return len(text.split())


def line_sizer(text: str) -> int:
    return text.count("\n") + (text != "" and not text.endswith("\n"))


SIZERS: dict[str, Sizer] = {"bytes": byte_sizer, "words": word_sizer, "lines": line_sizer}


class BpeSizer:
    """Tokens of a ``tokenizers`` file, read where it is first used; special strings of a text count as tokens.

    The file's path must hold on every worker.  Its hash is part of a chunker's profile.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            self.profile = f"bpe:{hashlib.sha256(f.read()).hexdigest()}"
        self._encoder = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoder": None}

    def __call__(self, text: str) -> int:
        if self._encoder is None:
            try:
                from tokenizers import Tokenizer
            except ImportError as missing:
                raise errors.SizerError("tokenizers isn't installed") from missing
            self._encoder = Tokenizer.from_file(self.path)
        return len(self._encoder.encode(text, add_special_tokens=False).ids)


class Lines:
    """Line and byte column of byte offsets."""

    def __init__(self, data: bytes) -> None:
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", data))]

    def point(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1]


def floor_boundary(data: bytes, at: int) -> int:
    """The last character boundary at or before a byte offset."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


# -- fixed windows


def fixed_windows(data: bytes, window: int = WINDOW_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple[int, int, int]]:
    """(start, core end, context end): cores cover the text, contexts are windows that overlap."""
    if not 0 <= overlap < window:
        raise errors.ChunkConfigError("the overlap must be smaller than the window")
    if not data:
        return []
    starts = [0]
    while starts[-1] + window < len(data):
        at = floor_boundary(data, min(starts[-1] + window - overlap, len(data)))
        if at <= starts[-1]:
            raise errors.ChunkInvariant("a window holds no whole character")
        starts.append(at)
    ends = [*starts[1:], len(data)]
    return [(s, e, floor_boundary(data, min(s + window, len(data)))) for s, e in zip(starts, ends)]


# -- lexical splits


@dataclass(frozen=True)
class Config:
    """How to split; ``policy`` is recover, require_ast or generic_fallback, ``strict`` whether leaves may be cut."""

    max_size: int = MAX_WORDS
    max_bytes: int | None = MAX_CHUNK_BYTES
    sizer: str | Sizer = "words"
    strict: bool = True
    policy: str = "generic_fallback"
    kinds: str = "top_level"
    overlap: int = 0
    max_input: int = MAX_INPUT_BYTES

    def __post_init__(self) -> None:
        if self.max_size < 1 or (self.max_bytes is not None and self.max_bytes < 1) or not (callable(self.sizer) or self.sizer in SIZERS):
            raise errors.ChunkConfigError("sizes must be positive and the sizer known")

    def measure(self) -> Sizer:
        """The sizer: one of ``SIZERS`` by name, or the function itself."""
        return self.sizer if callable(self.sizer) else SIZERS[self.sizer]

    def profile(self) -> str:
        """Everything that boundaries depend on, for an index manifest."""
        name = self.sizer if isinstance(self.sizer, str) else getattr(self.sizer, "profile", None) or f"{self.sizer.__module__}.{self.sizer.__qualname__}"
        return f"quern-chunk-1;sizer={name};max={self.max_size};bytes={self.max_bytes};strict={self.strict};policy={self.policy};kinds={self.kinds};adapters={ADAPTERS_ID};window={WINDOW_BYTES}/{OVERLAP_BYTES}"


@dataclass
class Piece:
    start: int
    end: int
    kinds: list[str] = field(default_factory=list)
    degraded: bool = False


#: Whether a byte of ASCII is white space to ``str.split``.
_BLANKS = np.array([b < 128 and chr(b).isspace() for b in range(256)])


def blanks(data: bytes) -> np.ndarray:
    """Whether each byte of a text belongs to white space."""
    raw = np.frombuffer(data, np.uint8)
    if data.isascii():
        return _BLANKS[raw]
    codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    spaces = [c for c in np.unique(codes).tolist() if chr(c).isspace()]
    firsts = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.repeat(np.isin(codes, spaces), np.diff(np.append(firsts, len(raw))))


class _Source:
    """A text with the sizes of its byte ranges: words are counted once for the whole text, other sizes memoized."""

    def __init__(self, data: bytes, sizer: Sizer) -> None:
        self.data, self.sizer = data, sizer
        self.seen: dict[tuple[int, int], int] = {}
        self.before: np.ndarray | None = None

    def _count(self) -> None:
        """Words that begin before each byte, and the bytes within a word."""
        full = np.concatenate([[False], ~blanks(self.data), [False]])
        self.inside = full[1:] & full[:-1]
        self.before = np.concatenate([[0], np.cumsum(full[1:-1] & ~full[:-2], dtype=np.int32)])

    def between(self, bounds: list[int]) -> Callable[[int, int], int]:
        """The size from the i-th to the j-th of some offsets."""
        if self.sizer is not word_sizer:
            return lambda i, j: self.size(bounds[i], bounds[j])
        if self.before is None:
            self._count()
        at = np.array(bounds)
        before, inside = self.before[at].tolist(), self.inside[at].tolist()
        return lambda i, j: before[j] - before[i] + inside[i] if bounds[i] < bounds[j] else 0

    def size(self, start: int, end: int) -> int:
        if self.sizer is word_sizer and self.before is not None:
            return int(self.before[end] - self.before[start] + self.inside[start]) if start < end else 0
        key = (start, end)
        if key not in self.seen:
            self.seen[key] = self.sizer(self.data[start:end].decode())
        return self.seen[key]


_LINE, _BLANK, _MARK = re.compile("(?s).*\n"), re.compile(r"(?s).*\s"), re.compile(r"(?s).*[!-/:-@\[-`{-~]")


def preferred_end(text: str) -> int:
    """Characters up to the last line end, else the last white space, else punctuation, else all."""
    for pattern in (_LINE, _BLANK, _MARK):
        if m := pattern.match(text):
            return m.end()
    return len(text)


def lexical_split(source: _Source, start: int, end: int, kinds: list[str], config: Config, degraded: bool) -> list[Piece]:
    """Cut a range greedily into the largest prefixes that fit, at good places.

    The range is decoded once; a prefix is sought from the last one's length up, so the
    work grows with the range and not with its square.
    """
    text = source.data[start:end].decode()
    # byte offset of each character, unless these are the same
    offsets = None
    if len(text) != end - start:
        raw = np.frombuffer(source.data, np.uint8, end - start, start)
        offsets = np.append(np.flatnonzero((raw & 0xC0) != 0x80), end - start)

    def byte(n: int) -> int:
        return n if offsets is None else int(offsets[n])

    out, at, last = [], 0, 64
    while at < len(text):
        hard = len(text)
        if config.max_bytes and byte(at) + config.max_bytes < end - start:
            reach = byte(at) + config.max_bytes
            hard = reach if offsets is None else int(np.searchsorted(offsets, reach, "right")) - 1

        def fits(n: int, at=at) -> bool:
            return source.sizer(text[at:n]) <= config.max_size

        # sizes grow with prefixes: double the reach until it is too large, then bisect
        low, high = at, hard
        step = last
        while low < high:
            probe = min(hard, at + step)
            if not fits(probe):
                high = probe - 1
                break
            low = probe
            step *= 2
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if fits(middle) else (low, middle - 1)
        if low == at:
            raise errors.UnsplittableUnit(f"one character exceeds the size {config.max_size}")
        n = at + preferred_end(text[at:low])
        if n < low and not fits(n):
            n = low
        out.append(Piece(start + byte(at), start + byte(n), list(kinds), degraded))
        last = max(1, n - at)
        at = n
    return out


# -- syntax trees


@dataclass
class Node:
    """A named node of a syntax tree over byte offsets."""

    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)


class Parts(Node):
    """A root whose children are kept as kinds and places; they are made when they are asked for."""

    def __init__(self, end: int, firsts: list[tuple[str, int, int]], read: Callable[[int], list[Node]]) -> None:
        self.kind, self.start, self.end, self.firsts, self._read = "Module", 0, end, firsts, read

    def child(self, nth: int) -> Node:
        return Node(*self.firsts[nth], self._read(nth))

    @property
    def children(self) -> list[Node]:
        return [self.child(i) for i in range(len(self.firsts))]


ADAPTERS_ID = "python-ast+brackets-1+keywords-1"
#: Parts of a broken module that are tried together.
RECOVERY_REACH = 16


def python_tree(data: bytes) -> Node | None:
    """The tree of a Python module by the standard parser; None if it doesn't parse."""
    if re.search(rb"\r(?!\n)", data):
        # the parser ends lines there, byte offsets here don't
        return None
    try:
        tree = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = Lines(data).starts

    def place(node: ast.AST) -> tuple[int, int]:
        first, column = node.lineno, node.col_offset
        for d in getattr(node, "decorator_list", ()):
            if (d.lineno, d.col_offset - 1) < (first, column):
                first, column = d.lineno, max(0, d.col_offset - 1)
        return starts[first - 1] + column, starts[node.end_lineno - 1] + node.end_col_offset

    def convert(node: ast.AST, start: int, end: int) -> Node:
        out = Node(type(node).__name__, start, end)
        todo = [(out, node)]
        while todo:
            parent, current = todo.pop()
            found = []
            for child in ast.iter_child_nodes(current):
                if hasattr(child, "lineno") and hasattr(child, "end_lineno"):
                    a, b = place(child)
                    found.append((a, b, child))
                else:
                    found += [(*place(c), c) for c in ast.iter_child_nodes(child) if hasattr(c, "lineno")]
            last = parent.start
            for a, b, child in sorted(found, key=lambda f: (f[0], -f[1])):
                # overlapping places, as in decorated or formatted strings, stay with the first
                if last <= a < b <= parent.end:
                    parent.children.append(Node(type(child).__name__, a, b))
                    todo.append((parent.children[-1], child))
                    last = b
        return out

    return convert(tree, 0, len(data))


#: What may give a part of a module another meaning alone than in the module.
_BOUND = re.compile(rb"coding[:=]|__future__|\xef\xbb\xbf|\r(?!\n)")
#: Bytes that don't begin a part at the start of a line.
_INNER = np.isin(np.arange(256), list(b" \t\n\r\f\v#"))
#: Bytes of a part, and parts, whose first level a worker keeps.
PART_BYTES, PARTS = 256, 1 << 17
_parts: dict[bytes, tuple[tuple[str, int, int], ...] | None] = {}
_levels: dict[tuple, tuple] = {}


def _first_level(part: bytes) -> tuple[tuple[str, int, int], ...] | None:
    """(kind, start, end) of a part's statements; None if it doesn't parse."""
    try:
        body = compile(part, "<part>", "exec", ast.PyCF_ONLY_AST).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        body = found = None
    if body is not None:
        starts = [0, *accumulate(len(line) + 1 for line in part.split(b"\n"))]
        found = []
        for node in body:
            first, column = node.lineno, node.col_offset
            for d in getattr(node, "decorator_list", ()):
                if (d.lineno, d.col_offset - 1) < (first, column):
                    first, column = d.lineno, max(0, d.col_offset - 1)
            found.append((type(node).__name__, starts[first - 1] + column, starts[node.end_lineno - 1] + node.end_col_offset))
        found = tuple(found)
    if len(part) <= PART_BYTES:
        if len(_parts) >= PARTS:
            _parts.clear()
            _levels.clear()
        # most parts share their places with others
        found = _levels.setdefault(found, found)
        _parts[part] = found
    return found


def python_parts(data: bytes) -> Node | None:
    """The tree of a module from its parts; None unless each parses by itself.

    A part begins at a line without indent.  Statements that parse alone are those of
    the module; what goes on in the next part, as a bracket, a string, a decorator or a
    branch does, doesn't parse alone.  Equal short parts are parsed once, and below
    the first level only what is entered.
    """
    if not data or _BOUND.search(data):
        return None
    raw = np.frombuffer(data, np.uint8)
    lines = np.flatnonzero(raw[:-1] == 10) + 1
    starts = [0, *lines[~_INNER[raw[lines]]].tolist()]
    parts = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
    firsts: list[tuple[str, int, int]] = []
    for start, part in zip(starts, parts):
        found = _parts.get(part)
        if found is None and (found := _first_level(part)) is None:
            return None
        for kind, a, b in found:
            firsts.append((kind, start + a, start + b))

    def read(nth: int) -> list[Node]:
        """What is below a statement, by parsing its part again."""
        at = bisect_right(starts, firsts[nth][1]) - 1
        found = next(c for c in python_tree(parts[at]).children if c.start == firsts[nth][1] - starts[at]).children
        todo = list(found)
        while todo:
            node = todo.pop()
            node.start, node.end = node.start + starts[at], node.end + starts[at]
            todo += node.children
        return found

    return Parts(len(data), firsts, read)


_SKIP = {
    "c": re.compile(rb"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{}();]|\n", re.S),
    "js": re.compile(rb"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{}();]|\n", re.S),
    "rust": re.compile(rb"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'|[{}();]|\n", re.S),
    "go": re.compile(rb"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'|[{}();]|\n", re.S),
    "php": re.compile(rb"//[^\n]*|#[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[{}();]|\n", re.S),
}
_FAMILY = {"c": "c", "cpp": "c", "csharp": "c", "java": "c", "javascript": "js", "typescript": "js", "tsx": "js", "rust": "rust", "go": "go", "php": "php"}


def recovered_python(data: bytes) -> tuple[Node, int]:
    """A module's parts from one line without indent to the next, each parsed by itself; and how many don't parse.

    What doesn't parse becomes an ``ERROR`` node; a part that continues the last one, as
    ``else`` or a closing bracket does, or that its decorator precedes, is taken with it
    if both parse together.
    """
    starts = [m.start() for m in re.finditer(rb"^(?=[^\s#])", data, re.M)]
    if not starts:
        starts = [0]
    starts[0] = 0
    root, bad, at = Node("Module", 0, len(data)), 0, 0
    ends = [*starts[1:], len(data)]
    while at < len(starts):
        found, upto = None, at
        for last in range(at, min(len(starts), at + RECOVERY_REACH)):
            if (found := python_tree(data[starts[at] : ends[last]])) is not None:
                upto = last
                # a compound statement may go on
                if last + 1 == len(starts) or not re.match(rb"(?:else|elif|except|finally)\b", data[starts[last + 1] :]):
                    break
        if found is None:
            bad += 1
            root.children.append(Node("ERROR", starts[at], ends[at]))
        else:
            todo = list(found.children)
            root.children += todo
            while todo:
                node = todo.pop()
                node.start, node.end = node.start + starts[at], node.end + starts[at]
                todo += node.children
        at = upto + 1
    return root, bad


def bracket_tree(data: bytes, language: str, broken: list[int] | None = None) -> Node | None:
    """Statements and blocks of a brace language; strings and comments hide their brackets.

    Of brackets that don't match there is no tree, unless ``broken`` (errors, missing
    ends) is given, where they are counted: then a stray end is passed over, and what is
    open at the end closes there.
    """
    root = Node("source", 0, len(data))
    stack, begins, parens = [root], [0], 0

    def close(end: int, kind: str) -> None:
        start = begins[-1]
        while start < end and data[start : start + 1].isspace():
            start += 1
        if start < end:
            last = stack[-1].children[-1] if stack[-1].children else None
            inner = [last] if last and last.kind == "block" and last.start >= start else []
            if inner:
                stack[-1].children.pop()
            stack[-1].children.append(Node(kind, start, end, inner[0].children if inner else []))
        begins[-1] = end

    for m in _SKIP[_FAMILY[language]].finditer(data):
        mark = m.group()
        if mark == b"(":
            parens += 1
        elif mark == b")":
            parens = max(0, parens - 1)
        elif mark == b"{":
            stack.append(Node("block", m.start(), m.end()))
            begins.append(m.end())
        elif mark == b"}":
            if len(stack) == 1:
                if broken is None:
                    return None
                broken[0] += 1
                continue
            close(m.start(), "statement")
            block = stack.pop()
            begins.pop()
            block.end = m.end()
            stack[-1].children.append(block)
            if not parens:
                close(m.end(), "item")
        elif mark == b";" and not parens:
            close(m.end(), "statement")
    if len(stack) > 1 and broken is None:
        return None
    while len(stack) > 1:
        broken[1] += 1
        close(len(data), "statement")
        block = stack.pop()
        begins.pop()
        block.end = len(data)
        stack[-1].children.append(block)
    close(len(data), "statement")
    return root


_OPENS = {"ruby": re.compile(rb"^[ \t]*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$"), "bash": re.compile(rb"^[ \t]*(?:if|for|while|until|case|select)\b|\{[ \t]*$")}
_ENDS = {"ruby": re.compile(rb"^[ \t]*end\b"), "bash": re.compile(rb"^[ \t]*(?:fi|done|esac|\})[ \t;]*")}


def keyword_tree(data: bytes, language: str, broken: list[int] | None = None) -> Node | None:
    """Blocks between opening and closing keywords, by lines; ``broken`` as in ``bracket_tree``."""
    root = Node("source", 0, len(data))
    stack = [root]
    for m in re.finditer(rb"[^\n]*(?:\n|\Z)", data):
        line = m.group()
        if not line.strip():
            continue
        if _ENDS[language].match(line):
            if len(stack) == 1:
                if broken is None:
                    return None
                broken[0] += 1
                stack[-1].children.append(Node("ERROR", m.start(), m.end()))
                continue
            stack.pop().end = m.end()
        elif _OPENS[language].search(line.rstrip(b"\n")):
            node = Node("block", m.start(), m.end())
            stack[-1].children.append(node)
            stack.append(node)
        else:
            stack[-1].children.append(Node("line", m.start(), m.end()))
    if len(stack) > 1 and broken is None:
        return None
    while len(stack) > 1:
        broken[1] += 1
        stack.pop().end = len(data)
    return root


def tree_of(data: bytes, language: str) -> Node | None:
    if language == "python":
        return python_parts(data) or python_tree(data)
    if language in _FAMILY:
        return bracket_tree(data, language)
    return keyword_tree(data, language) if language in _OPENS else None


def recovered_tree(data: bytes, language: str) -> tuple[Node | None, int, int]:
    """A tree of what can be read of a text that doesn't parse, with its errors and missing ends; None without an adapter."""
    if language == "python":
        return (*recovered_python(data), 0)
    broken = [0, 0]
    if language in _FAMILY:
        return (bracket_tree(data, language, broken), *broken)
    return (keyword_tree(data, language, broken) if language in _OPENS else None, *broken)


def _kinds(node: Node, mode: str) -> list[str]:
    if mode == "none":
        return []
    if mode == "top_level":
        return [node.kind]
    found, todo = set(), [node]
    while todo:
        n = todo.pop()
        found.add(n.kind)
        todo += n.children
    return sorted(found)


def split_tree(source: _Source, root: Node, config: Config, notes: list[str]) -> list[Piece]:
    """Structure-aware split: a node that fits is a chunk, neighbours are merged while they fit, others are entered."""
    out: list[Piece] = []

    def fits(start: int, end: int) -> bool:
        return (config.max_bytes is None or end - start <= config.max_bytes) and source.size(start, end) <= config.max_size

    def leaf(node: Node, start: int, end: int) -> None:
        over = config.max_bytes is not None and end - start > config.max_bytes
        if over or config.strict:
            notes.append("hard_chunk_byte_cap" if over else "degraded_split")
            out.extend(lexical_split(source, start, end, _kinds(node, config.kinds), config, True))
        else:
            notes.append("oversized_atomic_node")
            out.append(Piece(start, end, _kinds(node, config.kinds)))

    def enter(node: Node, start: int, end: int, depth: int) -> Iterator[tuple[Node, int, int, int]]:
        """Emit what fits; hand out the parts that must be entered, in order."""
        if fits(start, end):
            out.append(Piece(start, end, _kinds(node, config.kinds)))
            return
        if depth >= MAX_DEPTH:
            notes.append("maximum_tree_depth")
            out.extend(lexical_split(source, start, end, _kinds(node, config.kinds), config, True))
            return
        late = isinstance(node, Parts)
        firsts = node.firsts if late else [(c.kind, c.start, c.end) for c in node.children]
        which = [i for i, (_, a, b) in enumerate(firsts) if b > a]
        if not any(firsts[i][1] > start or firsts[i][2] < end for i in which):
            leaf(node, start, end)
            return

        def child(nth: int) -> Node:
            return node.child(which[nth]) if late else node.children[which[nth]]

        def kinds(nth: int) -> list[str]:
            return [firsts[which[nth]][0]] if config.kinds == "top_level" else _kinds(child(nth), config.kinds)

        # a part reaches from its child's start to the next one's; the first also takes what leads
        bounds = [start, *(firsts[i][1] for i in which[1:]), end]
        size, cap = source.between(bounds), config.max_bytes
        group: Piece | None = None
        first = 0
        for nth, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b <= a:
                continue
            if (cap is not None and b - a > cap) or size(nth, nth + 1) > config.max_size:
                if group:
                    out.append(group)
                    group = None
                yield child(nth), a, b, depth + 1
                continue
            if group and (cap is None or b - group.start <= cap) and size(first, nth + 1) <= config.max_size:
                group.end = b
                group.kinds += kinds(nth)
                continue
            if group:
                out.append(group)
            group, first = Piece(a, b, kinds(nth)), nth
        if group:
            out.append(group)

    stack = [enter(root, 0, len(source.data), 0)]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        else:
            stack.append(enter(*part))
    return out


@dataclass
class Output:
    pieces: list[Piece]
    strategy: str
    notes: list[str]
    sizes: list[int]


def split(text: str, language: str, config: Config = Config()) -> Output:
    """Chunks that cover the text exactly, in order, each within the limits unless leaves are preserved."""
    data = text.encode()
    if len(data) > config.max_input:
        raise errors.InputTooLarge(f"{len(data)} bytes")
    name = eligibility.canonical_language(language)
    if config.overlap and name in eligibility.GRAMMARS:
        raise errors.UnsupportedFeature("no overlap with syntax trees")
    source, notes = _Source(data, config.measure()), []
    strategy = "generic"
    if not data:
        pieces = []
    else:
        tree = tree_of(data, name) if name in eligibility.GRAMMARS else None
        if tree is None and name in eligibility.GRAMMARS and config.policy == "require_ast":
            raise errors.ParseHasErrors(name)
        if tree is None and name in eligibility.GRAMMARS and config.policy == "recover":
            tree, bad, missing = recovered_tree(data, name)
            if tree is None:
                raise errors.ParseFailed(name)
            notes.append(f"recovered_parse:errors={bad},missing={missing}")
        if tree is None and name != "generic" and name not in eligibility.GRAMMARS and config.policy != "generic_fallback":
            raise errors.UnsupportedLanguage(language)
        if tree is None:
            notes += ["generic_fallback"] * (name != "generic")
            pieces = lexical_split(source, 0, len(data), ["generic"], config, False)
        else:
            strategy = "ast" if name == "python" else "generic"
            pieces = split_tree(source, tree, config, notes)
    pieces.sort(key=lambda p: p.start)
    at = 0
    for p in pieces:
        p.kinds = sorted(set(p.kinds))
        if p.start != at or p.end <= p.start:
            raise errors.ChunkInvariant("chunks don't follow one another")
        at = p.end
    if at != len(data):
        raise errors.ChunkInvariant("chunks don't reach the end")
    return Output(pieces, strategy, notes, [source.size(p.start, p.end) for p in pieces])


# -- DataFrames

SCHEMA = (
    "document_id string, chunk_id string, ordinal int, text string, start_byte long, end_byte long, start_line long, start_column long, end_line long, end_column long, "
    "context_end_byte long, measured_size long, language string, strategy string, node_kinds array<string>, diagnostics array<string>"
)


NAMES = tuple(c.split()[0] for c in SCHEMA.split(", "))
#: Rows, and characters of the texts split, that one batch of results holds at most, unless a text has more.
BATCH_ROWS, BATCH_CHARACTERS = 20_000, 4 << 20
_TEXT, _PLACES = frozenset({"text"}), frozenset({"start_line", "start_column", "end_line", "end_column"})


def _rows(document_id: str, language: str, text: str, method: str, config: Config, window: int, overlap: int, wanted: frozenset[str] = frozenset(NAMES)) -> Iterator[tuple]:
    """Rows of ``SCHEMA``; texts and lines are null unless they are wanted."""
    data = text.encode()
    if method != "fixed" and not wanted & (_TEXT | _PLACES):
        out = split(text, "generic" if method == "lexical" else language, config)
        for i, (p, size) in enumerate(zip(out.pieces, out.sizes)):
            yield (document_id, f"{document_id}#{i}", i, None, p.start, p.end, None, None, None, None, p.end, size, language, out.strategy, p.kinds, out.notes)
        return
    lines = Lines(data)
    if method == "fixed":
        for i, (a, b, c) in enumerate(fixed_windows(data, window, overlap)):
            yield (document_id, f"{document_id}#{i}", i, data[a:c].decode(), a, b, *lines.point(a), *lines.point(b), c, c - a, language, "generic", [], [])
        return
    out = split(text, "generic" if method == "lexical" else language, config)
    for i, (p, size) in enumerate(zip(out.pieces, out.sizes)):
        yield (document_id, f"{document_id}#{i}", i, data[p.start : p.end].decode(), p.start, p.end, *lines.point(p.start), *lines.point(p.end), p.end, size, language, out.strategy, p.kinds, out.notes)


def chunk(docs: DataFrame, method: str = "auto", config: Config = Config(), window: int = WINDOW_BYTES, overlap: int = OVERLAP_BYTES, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """Chunks of (document_id, language, content), with the ``columns`` of ``SCHEMA`` that are named.

    ``auto`` takes syntax trees where there is an adapter and fixed windows otherwise;
    ``fixed``, ``lexical`` and ``tree`` force one way.  A null or empty text has no chunk.
    """
    if method not in ("auto", "fixed", "lexical", "tree"):
        raise errors.ChunkConfigError(f"unknown method {method}")

    wanted = frozenset(columns)
    kinds = dict(zip(NAMES, [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]))
    held = [(c, NAMES.index(c), kinds[c]) for c in columns]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for _, i, k in held], [c for c, _, _ in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for nth in range(batch.num_rows):
                document_id, language, text = (batch.column(i)[nth].as_py() for i in range(3))
                if not text:
                    continue
                way = method if method != "auto" else "tree" if eligibility.canonical_language(language or "") in eligibility.GRAMMARS else "fixed"
                rows += _rows(document_id, language or "generic", text, way, config, window, overlap, wanted)
                size += len(text)
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARACTERS:
                    yield packed(rows)
                    rows, size = [], 0
            yield packed(rows)
        # the worker may idle beside others
        pa.default_memory_pool().release_unused()

    schema = ", ".join(f"{c} {dict(x.split(' ', 1) for x in SCHEMA.split(', '))[c]}" for c in columns)
    return docs.select(F.col("document_id").cast("string"), F.col("language").cast("string"), F.col("content").cast("string")).mapInArrow(run, schema)


def coverage(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, chunks, covered): whether a document's cores follow one another from 0 to its last byte."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    linked = chunks.withColumn("__gap", F.col("start_byte") != F.coalesce(F.lag("end_byte").over(w), F.lit(0)))
    per = linked.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("__gap").alias("gap"), F.max("end_byte").alias("reach"))
    joined = docs.select(F.col("document_id").cast("string"), F.octet_length("content").cast("long").alias("size")).join(per, "document_id", "left")
    return joined.select("document_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.when(F.col("size") > 0, F.coalesce(~F.col("gap") & (F.col("reach") == F.col("size")), F.lit(False))).otherwise(F.col("chunks").isNull()).alias("covered"))
