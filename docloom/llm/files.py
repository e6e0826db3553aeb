"""Files in the shared folder, opened by any executor through pyarrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def opened(url: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URL as Spark writes them (file:/x, file:///x, hdfs://..., s3://...)."""
    if "://" not in url:
        return fs.LocalFileSystem(), url.removeprefix("file:")
    return fs.FileSystem.from_uri(url)
