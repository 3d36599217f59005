"""What a caller may put in place of the parts here, and a retriever that checks its requests."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from quern.manifest import Manifest
from quern.operators.retrieval import MOST_CANDIDATES, MOST_TOP


@runtime_checkable
class Sizer(Protocol):
    """A size of a text that doesn't shrink as the text grows."""

    def __call__(self, text: str) -> int: ...


@runtime_checkable
class Chunker(Protocol):
    """Chunks of (document_id, language, content), and the profile that their boundaries depend on."""

    def profile(self) -> str: ...

    def chunk(self, docs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Corpus(Protocol):
    """Documents (document_id, path, language, content) of a source."""

    def documents(self) -> DataFrame: ...


@runtime_checkable
class Retriever(Protocol):
    """Ranked documents (query_id, rank, document_id, score, …) for queries (query_id, text)."""

    manifest: Manifest

    def search(self, queries: DataFrame, top: int = 10, candidates: int = 50, query_vectors: DataFrame | None = None) -> DataFrame: ...


@runtime_checkable
class IndexStore(Retriever, Protocol):
    """A retriever whose documents can be replaced, updated and deleted."""

    def replace(self, docs: DataFrame) -> str: ...

    def update(self, new: DataFrame, stale: DataFrame) -> str: ...

    def delete(self, ids: DataFrame) -> str: ...

    def document_count(self) -> int: ...


@runtime_checkable
class Observer(Protocol):
    """Told of progress: tasks done and known, and the stages that run."""

    def __call__(self, done: int, known: int, stages: list[str]) -> None: ...


class Cancellation:
    """A wish to stop, looked at between steps."""

    def __init__(self) -> None:
        self.wanted = False

    def cancel(self) -> None:
        self.wanted = True


class Checked:
    """A retriever behind its contract: the manifest must agree, requests lie within a service's bounds."""

    def __init__(self, inner: Retriever, expected: Manifest) -> None:
        inner.manifest.validate_runtime(expected)
        self.inner, self.manifest = inner, inner.manifest

    def search(self, queries: DataFrame, top: int = 10, candidates: int = 50, query_vectors: DataFrame | None = None) -> DataFrame:
        if not 1 <= top <= MOST_TOP or not top <= candidates <= MOST_CANDIDATES:
            raise ValueError(f"{top} of {candidates}: at most {MOST_TOP} of {MOST_CANDIDATES}")
        return self.inner.search(queries, top, candidates, query_vectors)


DocumentIds = Callable[[DataFrame], DataFrame]
