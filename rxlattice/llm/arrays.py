"""Raw little-endian arrays in the shared folder, written whole and memory-mapped by workers."""

from __future__ import annotations

import mmap
import sys
import tempfile
import uuid

import numpy as np
import pyarrow.fs


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def save(uri: str, array: np.ndarray) -> None:
    """Write under a name of its own, then rename: readers see the whole array or none."""
    fs, path = _place(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    fs.move(part, path)


def load(uri: str, kind: str) -> np.ndarray:
    """The array, memory-mapped. From a store that can't be mapped it is first copied; the copy has no name."""
    fs, path = _place(uri)
    info = fs.get_file_info(path)
    if not info.size:
        return np.empty(0, kind)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return _mapped(path, kind)
    with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(path) as source:
        while block := source.read(1 << 24):
            copy.write(block)
        copy.flush()
        return _mapped(copy.name, kind)


def _mapped(path: str, kind: str) -> np.ndarray:
    """The file's array, memory-mapped. The mapping holds no file open, so there may be any number of shards."""
    with open(path, "rb") as f:
        options = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **options), kind)


def exists(uri: str) -> bool:
    fs, path = _place(uri)
    return fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound
