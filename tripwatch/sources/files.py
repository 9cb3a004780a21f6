"""Small files in a folder that all machines see: a mounted path, or any store that Arrow can open."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs


class Folder:
    """Whole files by name. A file is there with all its bytes or not at all."""

    def __init__(self, path: str):
        self.store, self.top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        self.top = self.top.rstrip("/")
        self.store.create_dir(self.top, recursive=True)

    def write(self, name: str, parts: Iterator[bytes]) -> int:
        """Writes a file beside and moves it to its name; how many parts it has."""
        n, path = 0, f"{self.top}/{name}"
        with self.store.open_output_stream(path + ".part") as out:
            for n, part in enumerate(parts, 1):  # noqa: B007
                out.write(part)
        self.store.move(path + ".part", path)
        return n

    def names(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.top))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.endswith(".part"))

    def has(self, name: str) -> bool:
        return self.store.get_file_info(f"{self.top}/{name}").type == fs.FileType.File

    def read(self, name: str) -> bytes:
        with self.store.open_input_stream(f"{self.top}/{name}") as f:
            return f.read()

    def lines(self, name: str) -> Iterator[bytes]:
        """A file line by line, however long it is."""
        rest = b""
        with self.store.open_input_stream(f"{self.top}/{name}") as f:
            while piece := f.read(1 << 20):
                *whole, rest = (rest + piece).split(b"\n")
                yield from whole
        if rest:
            yield rest

    def clear(self, prefix: str) -> None:
        """Deletes the files whose names begin so, and unfinished ones."""
        for f in self.store.get_file_info(fs.FileSelector(self.top)):
            if f.base_name.startswith(prefix):
                self.store.delete_file(f.path)

    def remove(self, name: str) -> None:
        if self.has(name):
            self.store.delete_file(f"{self.top}/{name}")
