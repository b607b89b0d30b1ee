"""Formats by extension, and file digests."""

from __future__ import annotations

import hashlib
from pathlib import Path

from ..errors import UnsupportedFormatError

#: The formats of extensions.
FORMATS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "xlsx": "excel", "xls": "excel", "xlsm": "excel", "xlsb": "excel"}


def format_of(path: str | Path) -> str:
    """By the extension, in any case; that of a pattern too (visits/*.csv)."""
    suffix = Path(str(path)).suffix.lower()
    if suffix[1:] not in FORMATS:
        raise UnsupportedFormatError(f"Unsupported file extension: {suffix or '(none)'}")
    return FORMATS[suffix[1:]]


def sha256_of(path: str | Path, step: int = 1 << 20, spark=None) -> str | None:
    """Read in pieces: a local file here, another store's by Hadoop's client if a session is given. A folder or pattern has none."""
    local = str(path).removeprefix("file://")
    if spark is not None and not Path(local).is_file():
        jvm = spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(str(path))
        store = there.getFileSystem(spark._jsc.hadoopConfiguration())
        if any(c in str(path) for c in "*?[{") or not store.getFileStatus(there).isFile():
            return None
        stream = store.open(there)
        try:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()
    digest = hashlib.sha256()
    with open(local, "rb") as file:
        while piece := file.read(step):
            digest.update(piece)
    return digest.hexdigest()
