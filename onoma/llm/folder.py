"""A folder that driver and workers share, for files that Spark has no format for."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs


class Folder:
    """Local (mapped in place) or in any store that pyarrow knows."""

    def __init__(self, uri: str):
        self.uri = uri

    def _open(self) -> tuple[pafs.FileSystem, str]:
        if self.uri.startswith("file:") or "://" not in self.uri:
            return pafs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(self.uri)

    def put(self, name: str, parts: list) -> None:
        """All parts one after the other; a file appears whole or not at all, also if tasks repeat."""
        fs, base = self._open()
        fs.create_dir(base, recursive=True)
        part = f"{base}/_{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as f:
            for p in parts:
                f.write(p)
        fs.move(part, f"{base}/{name}")

    def get(self, name: str) -> bytes:
        fs, base = self._open()
        with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
            return f.read()

    def map(self, name: str, cache: dict) -> np.ndarray:
        """The file's bytes, mapped; a file of a remote store is first copied to this process's folder."""
        fs, base = self._open()
        path = f"{base}/{name}"
        if not isinstance(fs, pafs.LocalFileSystem):
            if "dir" not in cache:
                cache["dir"] = tempfile.TemporaryDirectory(prefix="onoma-model-")
            local = os.path.join(cache["dir"].name, name)
            if not os.path.exists(local):
                with fs.open_input_stream(path, compression=None) as f, open(local, "wb") as out:
                    while piece := f.read(1 << 22):
                        out.write(piece)
            path = local
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)

    def remove(self) -> None:
        fs, base = self._open()
        try:
            fs.delete_dir(base)
        except OSError:
            pass
