"""Binary files written and range-read by executors, through any file system that pyarrow opens by URI (file, hdfs, s3, gs).

A task writes under a name no other attempt uses and returns index rows; the index is written by Spark's own committer.
Files of failed or repeated attempts are never in the index, so losing an executor cannot mix attempts.
"""

from __future__ import annotations

import uuid


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def as_uri(path: str) -> str:
    """``file:/x`` and ``/x`` as ``file:///x``; other schemes unchanged."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"


class Writer:
    """One file of one task attempt."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{as_uri(folder)}/{uuid.uuid4().hex}{suffix}"
        fs, path = _fs(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self._out = fs.open_output_stream(path, compression=None)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which ``data`` begins."""
        begin = self.at
        self._out.write(data)
        self.at += len(data)
        return begin

    def close(self) -> None:
        self._out.close()


class Ranges:
    """Byte-range reads; the last file stays open."""

    def __init__(self):
        self._uri, self._in = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self._uri:
            self.close()
            fs, path = _fs(uri)
            self._uri, self._in = uri, fs.open_input_file(path)
        return self._in.read_at(length, offset)

    def close(self) -> None:
        if self._in is not None:
            self._in.close()
        self._uri, self._in = None, None


def coalesced(rows, gap: int, most: int):
    """Group (uri, offset, length, ...) rows, sorted by uri and offset, into ranges: neighbours at most ``gap`` bytes apart, up to
    ``most`` bytes a range (a longer single record is a range of its own). Yields (uri, begin, length, rows)."""
    held: list = []
    begin = end = 0
    for row in rows:
        if held and (row[0] != held[0][0] or row[1] - end > gap or max(end, row[1] + row[2]) - begin > most):
            yield held[0][0], begin, end - begin, held
            held = []
        if not held:
            begin, end = row[1], row[1] + row[2]
        held.append(row)
        end = max(end, row[1] + row[2])
    if held:
        yield held[0][0], begin, end - begin, held
