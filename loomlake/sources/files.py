"""Files opened by executors, through the file system that a path's scheme names."""

from __future__ import annotations

import re
from urllib.parse import quote


def located(path: str):
    """(pyarrow file system, name) of a path as Spark's listing gives it: its characters stand for themselves."""
    from pyarrow import fs as pafs

    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/*", path)
    if m is None:
        return pafs.LocalFileSystem(), path
    if m[1] == "file":
        return pafs.LocalFileSystem(), "/" + path[m.end() :]
    scheme, rest = m[1], path[len(m[1]) + 1 :]
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(rest, safe='/:@')}")


def opened(path: str):
    """The file for reading by ranges."""
    files, name = located(path)
    return files.open_input_file(name)
