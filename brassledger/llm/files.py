"""Files in the shared folder, on any store that pyarrow opens, with a commit
that survives repeated and lost tasks: write under a temporary name of the
attempt, then rename to the final name, which depends on the content's place
only. A repeated attempt renames equal bytes over equal bytes. A file counts
only if the manifest, a table that Spark commits, names it.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Committed:
    """A file that appears under its final name when it is complete."""

    def __init__(self, uri: str, name: str):
        self.fs, base = store(uri)
        self.final, self.temp = f"{base}/{name}", f"{base}/_temporary-{name}-{uuid.uuid4().hex}"
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)
