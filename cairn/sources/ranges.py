"""Byte ranges of local files and of HTTP resources, as files that can be read and searched."""

from __future__ import annotations

import io
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs

TRIES, PAUSE = 3, 0.5


class HttpRanges(io.RawIOBase):
    """A resource read by ranges; each request is tried TRIES times."""

    def __init__(self, url: str, timeout: float = 30.0):
        self.url, self.timeout, self.at, self.length = url, timeout, 0, None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        if whence == 2:
            self.length = self.length if self.length is not None else self._length()
        self.at = offset + (0, self.at, self.length or 0)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def _length(self) -> int:
        with urllib.request.urlopen(urllib.request.Request(self.url, method="HEAD"), timeout=self.timeout) as r:
            return int(r.headers["Content-Length"])

    def read(self, n: int = -1) -> bytes:
        if n == 0:
            return b""
        ask = f"bytes={self.at}-" + ("" if n < 0 else str(self.at + n - 1))
        for attempt in range(TRIES):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, headers={"Range": ask}), timeout=self.timeout) as r:
                    body = r.read()
                    if r.status == 200:  # the server sent everything
                        body = body[self.at : None if n < 0 else self.at + n]
                break
            except urllib.error.HTTPError as e:
                if e.code == 416:
                    return b""
                if e.code < 500 or attempt == TRIES - 1:
                    raise OSError(f"{self.url}: {e}") from e
            except OSError as e:
                if attempt == TRIES - 1:
                    raise OSError(f"{self.url}: {e}") from e
            time.sleep(PAUSE)
        self.at += len(body)
        return body


def is_url(path: str) -> bool:
    return path.lower().startswith(("http://", "https://"))


def checked(path: str) -> str:
    """The path, if it can be a file of this kind: plain LAS and LAZ files can't, nor can missing ones."""
    name = path.split("?")[0].lower()
    if name.endswith((".las", ".laz")) and not name.endswith((".copc.laz", ".copc.las")):
        raise ValueError(f"{path} is a standard LAS/LAZ file without an octree")
    if not is_url(path) and not exists(path):
        raise FileNotFoundError(f"{path} was not found")
    return path


def plain(path: str) -> str:
    """A local path as an absolute one without its scheme; others as they are."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" in path else os.path.abspath(path)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (a plain one or file:, or any that pyarrow knows by its scheme), and the path there."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), plain(path)


def exists(path: str) -> bool:
    store, there = _store(path)
    return store.get_file_info(there).type != fs.FileType.NotFound


def stamp(path: str) -> tuple:
    """When a file was changed and its size; nothing for a URL."""
    if is_url(path):
        return ()
    store, there = _store(path)
    about = store.get_file_info(there)
    return about.mtime_ns, about.size


def opened(path: str) -> BinaryIO:
    if is_url(path):
        return HttpRanges(path)
    store, there = _store(path)
    return store.open_input_file(there)


@contextmanager
def created(path: str, sequential: bool = False) -> Iterator[BinaryIO]:
    """A file that can be written and searched; it has its name once it is whole. On stores without search it is held until then,
    but if it is only written on and on."""
    store, there = _store(path)
    store.create_dir(os.path.dirname(there), recursive=True)
    own = f"{there}.{uuid.uuid4().hex}"
    if isinstance(store, fs.LocalFileSystem):
        with open(own, "w+b") as f:
            yield f
    elif sequential:
        with store.open_output_stream(own) as f:
            yield f
    else:
        f = io.BytesIO()
        yield f
        with store.open_output_stream(own) as out:
            out.write(f.getbuffer())
    store.move(own, there)


def listed(folder: str) -> list[str]:
    """Paths of the files in a folder, none if it isn't there."""
    store, there = _store(folder)
    found = store.get_file_info(fs.FileSelector(there, allow_not_found=True))
    return sorted(f"{folder.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File)


def removed(path: str) -> None:
    store, there = _store(path)
    store.delete_file(there)


def removed_folder(path: str) -> None:
    """With all that is in it."""
    store, there = _store(path)
    store.delete_dir(there)
