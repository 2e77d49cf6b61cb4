"""Binary files in any store that pyarrow reaches (file, hdfs, s3, gs), opened by URI."""

from __future__ import annotations

import pyarrow.fs as pafs


def split_uri(uri: str):
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def make_dir(uri: str) -> None:
    fs, path = split_uri(uri)
    fs.create_dir(path, recursive=True)


def open_write(uri: str):
    fs, path = split_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_read(uri: str):
    fs, path = split_uri(uri)
    return fs.open_input_file(path)


def size_of(uri: str) -> int:
    fs, path = split_uri(uri)
    return fs.get_file_info(path).size
