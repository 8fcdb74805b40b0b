"""Byte access to local paths and to any store that pyarrow's file systems reach."""

from __future__ import annotations

import fnmatch
import os

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it, for a plain path or a URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def must_exist(path: str) -> None:
    system, at = locate(path)
    if system.get_file_info(at).type != fs.FileType.File:
        raise FileNotFoundError(f"File not found: {path}")


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, at = locate(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(size) if size is not None else f.read()


def file_size(path: str) -> int:
    system, at = locate(path)
    return system.get_file_info(at).size


WILD = "*?["


def is_one_file(path: str | list[str]) -> bool:
    """Whether a path names one file: not a list, a pattern or a folder. A path that is not there counts as a file."""
    if isinstance(path, list):
        return False
    system, at = locate(path)
    found = system.get_file_info(at).type
    return found == fs.FileType.File or (found == fs.FileType.NotFound and not any(c in path for c in WILD))


def list_files(path: str | list[str], extensions: tuple[str, ...]) -> list[tuple[str, int]]:
    """Names and sizes of the files that a folder (with all below it), a pattern or a list names, in order; no file is opened.

    From a folder come files of the given extensions, in any case, and none whose name or folder begins with a dot or an
    underscore. The stars of a pattern do not cross slashes.
    """
    if isinstance(path, list):
        return [pair for one in path for pair in ([(one, file_size(one))] if is_one_file(one) else list_files(one, extensions))]
    system, at = locate(path)
    start = path[: len(path) - len(at)] if path.endswith(at) else ""
    pattern = None
    if system.get_file_info(at).type != fs.FileType.Directory:
        pattern = at
        at = at[: min(at.index(c) for c in WILD if c in at)].rsplit("/", 1)[0]
    out = []
    for info in system.get_file_info(fs.FileSelector(at, recursive=True)):
        if info.type != fs.FileType.File:
            continue
        inner = info.path[len(at) :].lstrip("/")
        if pattern is not None:
            fits = _fits(info.path, pattern)
        else:
            fits = info.path.lower().endswith(extensions) and not any(name[:1] in "._" for name in inner.split("/"))
        if fits:
            out.append((start + info.path, info.size))
    if not out:
        raise FileNotFoundError(f"File not found: {path}")
    return sorted(out)


def _fits(name: str, pattern: str) -> bool:
    parts, wanted = name.split("/"), pattern.split("/")
    return len(parts) == len(wanted) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(parts, wanted, strict=True))
