"""Files that tasks read themselves, by byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of an address; one without a scheme is a local path."""
    if m := re.match(r"(?:file:/*)?(/.*)$|file:/+(.*)$", uri):
        return fs.LocalFileSystem(), m[1] or f"/{m[2]}"
    return fs.FileSystem.from_uri(uri)


def listed(paths: Sequence[str], suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(address, size) of the files at the paths, folders' files in order of their names; hidden ones are left out."""
    out = []
    for uri in paths:
        files, path = place(uri)
        head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        found = files.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.base_name[:1] not in "._" and (not suffixes or f.base_name.endswith(suffixes)):
                out.append((head + f.path, f.size))
    return out


def lines(uri: str, begin: int, end: int | None, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(where it begins, line without its end) of the lines that begin in the bytes from ``begin`` to ``end``; gzipped files are read whole.

    Bytes behind ``end`` are read only to finish a line, and nothing more than a block ahead of the line that is asked for.
    """
    files, path = place(uri)
    packed = uri.endswith(".gz")
    with files.open_input_stream(path) if packed else files.open_input_file(path) as f:
        at = begin
        held = b""
        if begin and not packed:  # a line begins here only behind a line's end
            f.seek(begin - 1)
            at = begin - 1
            skip = True
        else:
            skip = False
        while True:
            cut = held.find(b"\n")
            if cut < 0:
                more = f.read(block)
                if not more:
                    if held and not skip and (end is None or at < end or packed):
                        yield at, held
                    return
                held += more
                continue
            line, held = held[:cut], held[cut + 1 :]
            if not packed and end is not None and at >= end:
                return
            if not skip:
                yield at, line
            skip = False
            at += cut + 1


def ranges(size: int, split: int) -> list[tuple[int, int]]:
    """Bytes 0 to ``size`` in ranges of about ``split``."""
    n = max(1, -(-size // split))
    return [(size * i // n, size * (i + 1) // n) for i in range(n)] if size else []
