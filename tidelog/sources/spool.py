"""Small files in a shared folder that tasks write and list: through Arrow's file systems, so that any store they know will do."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's uri or local path, and the folder in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def names(store: fs.FileSystem, folder: str) -> list[str]:
    """The names of the files in a folder, sorted; none if there is no folder."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File)


def put(store: fs.FileSystem, path: str, body: bytes) -> None:
    """Write a file whole: under a hidden name first, then moved."""
    folder, _, name = path.rpartition("/")
    store.create_dir(folder)
    hidden = f"{folder}/.{name}.new"
    with store.open_output_stream(hidden) as out:
        out.write(body)
    store.move(hidden, path)


def get(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound
