"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

#: Code points that separate words: space and \t \n \v \f \r.  ``bytes.split()``
#: splits on exactly this set, so words are taken from the UTF-8 bytes.
SPACES = b" \t\n\x0b\x0c\r"


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a string column of an Arrow batch; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def as_text(column) -> list[str]:
    """Strings of a column of an Arrow batch; null becomes empty."""
    return [s or "" for s in column.to_pylist()]


def fresh_name(prefix: str, suffix: str = "") -> str:
    """A file name that no other task attempt uses.  A file counts only once
    the row that names it is in a committed table, so the file of a failed or
    repeated attempt is never read."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path inside it."""
    if re.match(r"file:/", uri) or "://" not in uri:
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def write_bytes(folder: str, name: str, parts) -> tuple[str, int]:
    """Write ``parts`` (an iterable of bytes) as one file of the shared folder."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    n = 0
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        for p in parts:
            out.write(p)
            n += len(p)
    return f"{folder.rstrip('/')}/{name}", n


def open_bytes(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_stream(path, compression=None)


def word_hashes(words) -> np.ndarray:
    """A 64-bit hash of each word (bytes), equal in every process."""
    import xxhash
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit integers into well-mixed ones (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(a: np.ndarray) -> bytes:
    """An array as zstd-compressed bytes (type and shape are the caller's)."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)
