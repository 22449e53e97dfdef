"""Files in the cluster's store, through pyarrow (file, hdfs, s3, gs URIs or plain paths)."""

from __future__ import annotations

import re


def filesystem(path: str):
    """(filesystem, path inside it)."""
    from pyarrow import fs

    if not re.match(r"^[a-z0-9+.-]+:", path):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def list_files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Sorted (path, bytes) of the data files under ``path``; names with _ or . first are hidden."""
    from pyarrow import fs

    f, root = filesystem(path)
    found = f.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    if not found and (one := f.get_file_info(root)).type == fs.FileType.File:
        found = [one]
    base = root.rstrip("/")
    hidden = re.compile(r"(^|/)[_.]")
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffixes) and not hidden.search(x.path[len(base) :]))


class Commit:
    """Attempt files under _tmp, moved into place by the driver once all tasks are done.

    A lost or repeated attempt leaves a file that no commit names; it goes with _tmp.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def attempt(self, suffix: str):
        import uuid

        f, root = filesystem(self.path)
        tmp = f"{root}/_tmp"
        f.create_dir(tmp, recursive=True)
        name = f"{tmp}/{uuid.uuid4().hex}{suffix}"
        return f, name

    def place(self, names: list[str], suffix: str) -> list[str]:
        """Move attempt files to part-00000… in the order given."""
        f, root = filesystem(self.path)
        f.create_dir(root, recursive=True)
        if self.overwrite:
            for old, _ in list_files(self.path, (suffix,)):
                f.delete_file(old)
        have = len(list_files(self.path, (suffix,)))
        out = []
        for i, n in enumerate(names):
            f.move(n, to := f"{root}/part-{have + i:05d}{suffix}")
            out.append(to)
        self.clear()
        return out

    def clear(self) -> None:
        from pyarrow import fs

        f, root = filesystem(self.path)
        if f.get_file_info(f"{root}/_tmp").type == fs.FileType.Directory:
            f.delete_dir(f"{root}/_tmp")
