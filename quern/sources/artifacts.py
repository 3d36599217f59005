"""Model artifacts: verified bytes and the tables in safetensors files."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np

from quern.errors import InvalidValue

_TYPES = {"F16": np.float16, "F32": np.float32, "F64": np.float64, "I8": np.int8, "I32": np.int32, "I64": np.int64, "U8": np.uint8}


def verified(path: str, sha256: str | None = None, length: int | None = None) -> bytes:
    """A file's bytes, if they have the length and hash that are pinned."""
    data = Path(path).read_bytes()
    if (length is not None and len(data) != length) or (sha256 is not None and hashlib.sha256(data).hexdigest() != sha256):
        raise InvalidValue(f"{path} isn't the pinned artifact")
    return data


def tensors(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a safetensors file."""
    n = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + n])
    out = {}
    for name, spec in head.items():
        if name != "__metadata__":
            a, b = spec["data_offsets"]
            out[name] = np.frombuffer(data[8 + n + a : 8 + n + b], _TYPES[spec["dtype"]]).reshape(spec["shape"])
    return out
