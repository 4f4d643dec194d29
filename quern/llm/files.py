"""Files in the shared folder, opened by URI from Python workers."""

from __future__ import annotations


def open_shared(uri: str, write: bool = False):
    """A sequential stream of the file; parent folders are made when writing."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if write:
        where.create_dir(path.rpartition("/")[0], recursive=True)
        return where.open_output_stream(path, compression=None)
    return where.open_input_stream(path, compression=None)
