"""Languages of paths, and which files are worth indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import errors
from quern.functions.identity import has_hidden_component

MAX_SOURCE, MAX_CONFIG, PROBE = 5 << 20, 50 << 10, 8 << 10
DATA_SIZE, DATA_LINE = 750 << 10, 100

#: Languages for which chunking has a tree adapter, with their file extensions.
_TREES = {"rust": "rs", "bash": "sh bash", "c": "c", "cpp": "cc cpp cxx hh hpp hxx", "csharp": "cs", "go": "go", "java": "java", "javascript": "cjs js jsx mjs", "php": "php phtml", "python": "py pyi pyw", "ruby": "gemspec rake rb", "typescript": "ts", "tsx": "tsx"}
GRAMMARS = frozenset(_TREES)
_ALIASES = {"rust": "rs", "bash": "shell sh", "cpp": "cxx cc c++", "csharp": "cs c#", "go": "golang", "javascript": "node jsx js", "python": "py", "ruby": "rb", "typescript": "ts", "generic": "txt text"}
_PRODUCT = _TREES | {
    "bash": "bash sh zsh", "c": "c h", "css": "css", "cue": "cue", "elixir": "ex exs", "elm": "elm", "groovy": "gradle groovy", "hcl": "hcl tf tfvars", "html": "htm html", "json": "json", "kotlin": "kt kts", "lua": "lua",
    "markdown": "markdown md", "ocaml": "ml mli", "protobuf": "proto", "scala": "sc scala", "sql": "sql", "svelte": "svelte", "swift": "swift", "toml": "toml", "yaml": "yaml yml",
}
_EVALUATION = {"c": "c h", "cpp": "cc cpp", "go": "go", "java": "java", "javascript": "js jsx", "php": "php", "python": "py", "ruby": "rb", "rust": "rs", "bash": "sh", "typescript": "ts tsx", "css": "css", "html": "html", "json": "json", "markdown": "md", "toml": "toml", "yaml": "yaml yml"}


def _by_extension(table: dict[str, str]) -> dict[str, str]:
    return {e: language for language, extensions in table.items() for e in extensions.split()}


TREE_EXTENSIONS, PRODUCT_EXTENSIONS, EVALUATION_EXTENSIONS = map(_by_extension, (_TREES, _PRODUCT, _EVALUATION))
ALIASES = _by_extension(_ALIASES)
CONFIG_EXTENSIONS = tuple("cfg conf env hcl ini json properties tf tfvars toml yaml yml".split())
EVALUATION_CONFIG = ("json", "toml", "yaml", "yml")
IGNORED_DIRECTORIES = (".git", "node_modules", "vendor", ".venv", "_output", "target")


def canonical_language(name: str) -> str:
    low = name.strip().lower()
    return ALIASES.get(low, low)


def resolve_language(path: str, explicit: str | None = None, fallback: bool = True) -> tuple[str, str]:
    """(language, method) for a tree: explicit, extension or generic_fallback; ``.h`` is ambiguous."""
    name = canonical_language(explicit) if explicit else None
    if name:
        if name in GRAMMARS or name == "generic":
            return name, "explicit"
        if not fallback:
            raise errors.UnsupportedLanguage(name)
        return "generic", "generic_fallback"
    base = path.replace("\\", "/").rsplit("/", 1)[-1]
    extension = base.rsplit(".", 1)[-1].lower() if "." in base.lstrip(".") else ""
    if extension == "h":
        raise errors.AmbiguousLanguage(f"{path} may be C or C++")
    if extension in TREE_EXTENSIONS:
        return TREE_EXTENSIONS[extension], "extension"
    if not fallback:
        raise errors.UnsupportedLanguage(path)
    return "generic", "generic_fallback"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null if that dot leads or there is none."""
    name = file_name(path)
    return F.nullif(F.regexp_extract(name, r"^.+\.([^.]*)$", 1), F.lit(""))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), F.coalesce(key, F.lit("")))


def product_language(path: Column) -> Column:
    """Language of a path for indexing; null if it isn't indexed."""
    return F.when(F.lower(file_name(path)) == "dockerfile", "dockerfile").otherwise(_lookup(PRODUCT_EXTENSIONS, F.lower(extension(path))))


def evaluation_language(path: Column) -> Column:
    """Language of a path for evaluation; ``text`` if there is no better."""
    return F.coalesce(_lookup(EVALUATION_EXTENSIONS, extension(path)), F.lit("text"))


def tree_language(path: Column) -> Column:
    """Language by the tree adapters' extensions; ``ambiguous`` for ``.h``, null if there is none."""
    low = F.lower(extension(path))
    return F.when(low == "h", "ambiguous").otherwise(_lookup(TREE_EXTENSIONS, low))


def _probe_lines(probe: Column) -> Column:
    """Line ends among bytes that need not be UTF-8, by their hexadecimal form."""
    return F.regexp_count(F.regexp_replace(F.hex(probe), "(..)", "$1 "), F.lit("0A "))


def average_line_length(probe: Column) -> Column:
    """Bytes of the probe over its line ends, of which at least one is counted."""
    return F.floor(F.octet_length(probe) / F.greatest(F.lit(1), _probe_lines(probe)))


def skip_reason(path: Column, size: Column, content: Column, kind: Column | None = None, previous_hash: Column | None = None) -> Column:
    """Why a file is left out, in order of precedence; ``reused`` if its hash is the previous one; null if it is taken.

    ``kind`` is file, symlink or other.  Everything that needs no content comes first,
    so a plan that filters on those reasons alone never reads it.
    """
    low = F.lower(extension(path))
    probe = F.substring(content, 1, PROBE)
    text = F.try_validate_utf8(content.cast("string"))
    kind = F.lit("file") if kind is None else kind
    out = F.when(has_hidden_component(path), "hidden").when(kind == "symlink", "symlink").when(kind != "file", "not_file")
    out = out.when(low.isin(*CONFIG_EXTENSIONS) & (size > MAX_CONFIG), "oversized_config").when(size > MAX_SOURCE, "oversized_source")
    out = out.when(product_language(path).isNull(), "unsupported_language")
    out = out.when(F.regexp_replace(F.hex(probe), "(..)", "$1 ").contains("00 "), "binary")
    out = out.when((size > DATA_SIZE) & (average_line_length(probe) > DATA_LINE), "data_like")
    if previous_hash is not None:
        out = out.when(F.sha2(content, 256) == previous_hash, "reused")
    out = out.when(text.isNull(), "invalid_utf8")
    return out.when(~text.rlike(r"(?U)\S"), "empty")


def evaluation_skip_reason(path: Column, size: Column, content: Column) -> Column:
    """The evaluator's rules: extensions and sizes, then binary, encoding and emptiness."""
    own = extension(path)
    probe = F.substring(content, 1, PROBE)
    text = F.try_validate_utf8(content.cast("string"))
    ignored = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))
    out = F.when(ignored, "ignored_directory").when(_lookup(EVALUATION_EXTENSIONS, own).isNull(), "unsupported_extension")
    out = out.when(size > MAX_SOURCE, "oversized_source").when(own.isin(*EVALUATION_CONFIG) & (size > MAX_CONFIG), "oversized_config")
    out = out.when(F.regexp_replace(F.hex(probe), "(..)", "$1 ").contains("00 "), "binary")
    return out.when(text.isNull(), "invalid_utf8").when(~text.rlike(r"(?U)\S"), "empty")


def skip_counts(files: DataFrame) -> DataFrame:
    """(skip_reason, files) over files that carry a reason; null counts those taken."""
    return files.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("files"))
