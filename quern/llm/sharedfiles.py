"""Files in the shared folder that tasks write whole and map into memory."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays so that a file is either whole or absent; writing again replaces it."""
    at, head = 0, {}
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += a.nbytes + -a.nbytes % 8
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)
    parts = [len(raw).to_bytes(8, "little"), raw]
    for a in arrays.values():
        parts += [np.ascontiguousarray(a).tobytes(), b"\0" * (-a.nbytes % 8)]
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.writelines(parts)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(name) as f:
        for p in parts:
            f.write(p)


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file as memory maps; from a store without paths, of a copy that has no name and goes with the process."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(uri)
        with tempfile.NamedTemporaryFile(delete=False) as copy, store.open_input_stream(name) as f:
            while piece := f.read(1 << 24):
                copy.write(piece)
        path = copy.name
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    if _local(uri) is None:
        os.unlink(path)
    n = int(raw[:8].view("<u8")[0])
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {name: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, size, at) in head.items()}
