"""Random access to files and folders by path or URI, and the commit protocol of the writers here.

A task writes one part under a name of its own that readers skip; the job's commit renames the parts of
the tasks that succeeded, and an abort deletes them. A task that is run again writes a new part, and
the part of the lost attempt is never named in a commit; `cleared` removes what such attempts left.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

PENDING = ".pending"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path in it of a URI, or of a plain local path."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def files_of(path: str, ends: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, or of the one file, whose names end so, by name."""
    store, at = opened(path)
    about = store.get_file_info(at)
    found = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(ends))


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


def new_job() -> str:
    """A name for a write, so that writes into one folder at the same time don't touch each other's parts."""
    return uuid.uuid4().hex


def pending(folder: str, job: str) -> tuple[fs.FileSystem, str]:
    """A new part's name, which readers skip until it is committed."""
    store, at = opened(folder)
    store.create_dir(at, recursive=True)
    return store, f"{at}/part-{job}-{uuid.uuid4().hex}{PENDING}"


def commit(folder: str, job: str, parts: list[Part | None], end: str) -> None:
    """Names the parts of the tasks that succeeded so that readers see them; parts without rows go."""
    store, _ = opened(folder)
    for part in parts:
        if part is not None and part.rows:
            store.move(part.name, part.name.removesuffix(PENDING) + end)
        elif part is not None:
            store.delete_file(part.name)
    cleared(folder, job)


def cleared(folder: str, job: str) -> None:
    """Removes the parts of a write that its commit hasn't named."""
    store, at = opened(folder)
    for about in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if about.base_name.startswith(f"part-{job}-") and about.path.endswith(PENDING):
            store.delete_file(about.path)
