"""The exact contract that an index carries, and its comparison with the runtime's."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from quern.errors import InvalidConfig, ReindexRequired
from quern.operators.chunking import Config

QUANTIZATIONS = ("none", "int8_per_vector_scale_offset", "binary_backend")


@dataclass(frozen=True)
class Manifest:
    """Ten fields, all of which must agree before an index is read or written."""

    model_id: str = "none"
    model_revision: str = "bm25-text1-path3-id2"
    embedding_profile: str = "none"
    embed_dim: int = 1
    mrl_dim: int = 1
    quantization: str = "none"
    tokenizer_hash: str = hashlib.sha256(b"words").hexdigest()
    chunker_version: str = field(default_factory=lambda: Config().profile())
    fde_params: dict[str, Any] = field(default_factory=lambda: {"kind": "disabled"})
    schema_version: int = 1

    def validate(self) -> None:
        names = (self.model_id, self.model_revision, self.embedding_profile, self.chunker_version)
        if any(not n.strip() for n in names) or self.schema_version < 1:
            raise InvalidConfig("a manifest needs model, revision, profile, chunker and schema")
        if not 0 < self.mrl_dim <= self.embed_dim:
            raise InvalidConfig("a manifest needs 0 < mrl_dim <= embed_dim")
        if self.quantization not in QUANTIZATIONS:
            raise InvalidConfig(f"unknown quantization {self.quantization}")

    def validate_runtime(self, runtime: Manifest) -> None:
        """Raise with every field that differs, in order."""
        self.validate()
        runtime.validate()
        found = [(f.name, getattr(self, f.name), getattr(runtime, f.name)) for f in fields(self) if getattr(self, f.name) != getattr(runtime, f.name)]
        if found:
            raise ReindexRequired(found)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        return cls(**json.loads(text))

    def digest(self) -> str:
        """SHA-256 of the whole manifest."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def fingerprint(self) -> str:
        """SHA-256 of what document ids depend on: not of dimensions kept nor quantization."""
        kept = {k: v for k, v in asdict(self).items() if k not in ("mrl_dim", "quantization")}
        return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: Pairs of (exact store, approximate store) representations that one model may have, besides equal ones.
PARITY_PAIRS = (("mrl-768", 768, 256, 768), ("static-mrl-1024", 1_024, 256, 1_024), ("static-code-256", 256, 256, 256))


def validate_parity(exact: Manifest, approximate: Manifest) -> None:
    """Raise unless two backends hold the same corpus in representations that may be compared."""
    exact.validate()
    approximate.validate()
    for name in ("model_id", "model_revision", "embedding_profile", "embed_dim", "tokenizer_hash", "chunker_version", "fde_params", "schema_version"):
        if getattr(exact, name) != getattr(approximate, name):
            raise InvalidConfig(f"backends differ in {name}: {getattr(exact, name)!r}, {getattr(approximate, name)!r}")
    if exact.model_id == "none":
        if exact.mrl_dim != approximate.mrl_dim or {exact.quantization, approximate.quantization} != {"none"}:
            raise InvalidConfig("lexical backends store no vectors")
        return
    pair = (exact.quantization, approximate.quantization)
    if pair == ("none", "binary_backend") and exact.mrl_dim == approximate.mrl_dim:
        return
    if pair == ("int8_per_vector_scale_offset", "binary_backend") and any((exact.embed_dim, exact.mrl_dim, approximate.mrl_dim) == p[1:] and (p[1] == 768 or exact.embedding_profile == p[0]) for p in PARITY_PAIRS):
        return
    raise InvalidConfig(f"representations can't be compared: {pair}, {exact.mrl_dim} and {approximate.mrl_dim} dimensions")
