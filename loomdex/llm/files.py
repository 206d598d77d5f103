"""Binary files that tasks write to, and read from, the shared folder.

Any file system that ``pyarrow.fs`` opens by URI will do. Every attempt of a task writes under
names of its own and only the rows of the attempt that Spark commits mention them, so a task that
is run again, or twice at once, can't mix two attempts.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


class Rolling:
    """Appends pieces to files of about ``limit`` bytes each; a piece is never split."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.suffix, self.limit = folder, suffix, limit
        self.out = self.name = None
        self.at = 0

    def put(self, piece: bytes) -> tuple[str, int]:
        """(file name, offset) of the piece."""
        if self.out is None or (self.at and self.at + len(piece) > self.limit):
            self.close()
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.store.create_dir(self.root, recursive=True)
            self.out, self.at = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None), 0
        self.out.write(piece)
        self.at += len(piece)
        return self.name, self.at - len(piece)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Opened:
    """Random access to files of one folder; keeps ``keep`` of them open."""

    def __init__(self, folder: str, keep: int = 16):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.keep, self.files = keep, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= self.keep:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.store.open_input_file(f"{self.root}/{name}")
        return self.files[name].read_at(length, offset)

    def whole(self, name: str) -> bytes:
        with self.store.open_input_file(f"{self.root}/{name}") as f:
            return f.read()
