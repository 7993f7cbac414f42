"""Members of archives (S-17, S-18, S-61, F-12, P-02, P-16)."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile

from lakeloom.operators.codepages import member_name

MEMBERS = "name string, size bigint, packed bigint, ratio int, is_folder boolean, refused boolean"


def dangerous(name: str) -> bool:
    slashed = name.replace("\\", "/")
    return slashed.startswith("/") or name[1:2] == ":" or ".." in slashed.split("/")


def zip_members(data: bytes) -> list[tuple]:
    """Name, size, packed size, ratio in percent, whether a folder, whether its name is refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(member_name(i.filename, bool(i.flag_bits & 0x800)), i.file_size, i.compress_size, round(i.compress_size * 100 / i.file_size) if i.file_size else None, i.is_dir(), dangerous(i.filename)) for i in z.infolist()]


def tar_members(data: bytes) -> list[tuple]:
    """The same of a tar, however packed; the bytes decide, not the name. A lone packed stream is a folder of one."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return [(re.sub(r"^(?:\./)+", "", m.name).rstrip("/"), m.size, None, None, m.isdir(), dangerous(m.name)) for m in t.getmembers()]
    except tarfile.ReadError:
        for mark, opened in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
            if data.startswith(mark):
                return [("content", len(opened(data)), len(data), None, False, False)]
        raise


def members(data: bytes) -> list[tuple]:
    return zip_members(data) if data[:2] == b"PK" else tar_members(data)
