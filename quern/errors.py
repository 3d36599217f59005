"""Errors, a class for each kind that callers tell apart."""

from __future__ import annotations


class QuernError(Exception):
    """Base of all."""


class ContractError(QuernError):
    """A value breaks a contract."""


class EmptyValue(ContractError):
    """A required value is empty."""


class InvalidValue(ContractError):
    """A value has the wrong form."""


class DimensionMismatch(ContractError):
    """A vector hasn't the length that its index or query has."""


class NonFinite(ContractError):
    """A vector or score holds NaN or an infinity."""


class SearchError(QuernError):
    """Base of index and query errors."""


class InvalidConfig(SearchError):
    """Options or a manifest are inconsistent."""


class CorpusError(SearchError):
    """A corpus can't be read: blank, duplicate or missing documents."""


class EmptyCorpus(CorpusError):
    """A corpus has no document."""


class RetrieverError(SearchError):
    """A query or its candidates break a contract."""


class ReindexRequired(SearchError):
    """Index and runtime differ; ``mismatches`` lists (field, index value, runtime value)."""

    def __init__(self, mismatches: list[tuple[str, object, object]]) -> None:
        self.mismatches = mismatches
        super().__init__("; ".join(f"{f}: index {a!r}, runtime {b!r}" for f, a, b in mismatches))


class ChunkError(QuernError):
    """Base of chunking errors."""


class ChunkConfigError(ChunkError):
    """A chunk configuration is inconsistent."""


class InputTooLarge(ChunkError):
    """The source exceeds the input ceiling."""


class UnsupportedLanguage(ChunkError):
    """No grammar adapter, and no generic fallback allowed."""


class AmbiguousLanguage(ChunkError):
    """An extension stands for several languages."""


class ParseFailed(ChunkError):
    """The adapter produced no tree."""


class ParseHasErrors(ChunkError):
    """The tree has errors and the policy requires none."""


class ParseTimeout(ChunkError):
    """Parsing took longer than its deadline."""


class UnsplittableUnit(ChunkError):
    """Not even one character fits."""


class UnsupportedFeature(ChunkError):
    """A combination of options isn't available."""


class ChunkInvariant(ChunkError):
    """Chunks don't cover their source exactly."""


class SizerError(ChunkError):
    """A sizer failed."""


class IndexFailure(QuernError):
    """A store operation failed; ``retry`` is never, immediate or a delay in seconds."""

    def __init__(self, kind: str, code: str, message: str, retry: str | float = "never") -> None:
        self.kind, self.code, self.retry = kind, code, retry
        super().__init__(f"{kind}/{code}: {message}")


class Stalled(QuernError):
    """A long action made no progress, or was cancelled."""
