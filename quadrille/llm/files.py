"""Files in the shared folder, by any address that pyarrow's file systems take."""

from __future__ import annotations

import io

import numpy as np
from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def make_dir(uri: str) -> None:
    system, path = place(uri)
    system.create_dir(path, recursive=True)


def remove(uri: str) -> None:
    """The folder or file goes, if it is there."""
    system, path = place(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)


def write(uri: str, data: bytes) -> None:
    system, path = place(uri)
    with system.open_output_stream(path) as out:
        out.write(data)


def read(uri: str) -> bytes:
    system, path = place(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def save_arrays(uri: str, **arrays: np.ndarray) -> None:
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    write(uri, buf.getvalue())


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(read(uri))) as z:
        return {n: z[n] for n in z.files}
