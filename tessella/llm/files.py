"""Binary files in the shared folder, written whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import NativeFile, fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI, the folder made if missing."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


@contextmanager
def whole_file(system: fs.FileSystem, path: str) -> Iterator[NativeFile]:
    """A stream under a name of its own that takes `path` at the end.

    A task that is lost leaves no file at `path`, and one that runs twice replaces it by the same bytes.
    """
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own, compression=None, buffer_size=1 << 20) as stream:
        yield stream
    system.move(own, path)


def read_exactly(stream: NativeFile, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"a file ends within a record: {len(data)} of {n} bytes")
    return data
