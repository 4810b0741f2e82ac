"""Files that tasks write to and read from the shared folder, whatever store it lies in."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}") if not uri.startswith("file:/") or uri.startswith("file://") else fs.FileSystem.from_uri("file://" + uri[5:])


def make_folder(uri: str) -> None:
    """Makes a folder and those above it."""
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


class Written:
    """A file that appears under its name only when it is whole: written beside it, then moved, so a repeated task replaces it by the same bytes."""

    def __init__(self, uri: str):
        self.store, self.path = opened(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.store.open_output_stream(self.temporary, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.temporary, self.path)
