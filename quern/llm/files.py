"""Files that tasks write into the shared folder, on any file system that pyarrow knows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


@contextmanager
def whole_file(folder: str, name: str):
    """A binary stream whose content appears as ``folder``/``name`` only when it is complete.

    It is written under a hidden name first and moved into place, so that a task that fails, runs
    again or runs twice leaves one whole file: the last complete one.
    """
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}-{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(hidden) as stream:
            yield stream
    except BaseException:
        fs.delete_file(hidden)
        raise
    fs.move(hidden, f"{path}/{name}")
