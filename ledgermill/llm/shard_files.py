"""Whole files on the shared folder, by URI, from inside a task."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyarrow import fs


def split_uri(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def committed(uri: str, attempt: int) -> Iterator:
    """A stream to a file that appears under its name when it is complete.

    An attempt writes to a name of its own; a repeated task replaces the file by the same bytes.
    """
    files, path = split_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.attempt-{attempt}"
    with files.open_output_stream(part, compression=None) as out:
        yield out
    files.move(part, path)
