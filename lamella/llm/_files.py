"""Files that executors write and read by URI, in the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str):
    """A seekable binary input stream."""
    f, path = fs.FileSystem.from_uri(uri)
    return f.open_input_file(path)


class Written:
    """A file that appears under its name only when complete, so a retried or doubled task leaves one whole file."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)
