"""Numpy arrays in the folder that driver and executors share, memory-mapped by readers.

A file is written under a temporary name and renamed, so a retried or
speculative task leaves a whole file.  On a mounted folder readers map the file
itself.  From any other store they read it into memory and keep the arrays used last, up to
KEEP_BYTES; nothing is written to a machine's own folders.
"""

from __future__ import annotations

import io
import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np

KEEP_BYTES = 256 << 20
_open: dict[str, np.ndarray] = {}


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        draft = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            np.save(out, array)
        os.replace(draft, f"{path}/{name}.npy")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    data = io.BytesIO()
    np.save(data, array)
    with store.open_output_stream(draft) as out:
        out.write(data.getbuffer())
    store.move(draft, f"{root}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """The array, mapped; kept open in this process until another folder is read."""
    key = f"{folder}/{name}"
    if key not in _open:
        for old in [k for k in _open if not k.startswith(f"{folder}/")]:
            del _open[old]
        path = _local(folder)
        if path is not None:
            _open[key] = np.load(f"{path}/{name}.npy", mmap_mode="r")
        else:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(folder)
            with store.open_input_stream(f"{root}/{name}.npy") as data:
                _open[key] = np.load(io.BytesIO(data.read()))
            held = 0
            for old in reversed(list(_open)):
                held += _open[old].nbytes
                if held > KEEP_BYTES and old != key:
                    del _open[old]
    else:
        _open[key] = _open.pop(key)  # used last
    return _open[key]
