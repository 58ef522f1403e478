"""Files of any store, for readers that run in Python."""

from __future__ import annotations


def storage(uri: str):
    """(file system, path); s3a and s3n are s3."""
    from pyarrow import fs

    for other in ("s3a://", "s3n://"):
        uri = uri.replace(other, "s3://", 1) if uri.startswith(other) else uri
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
