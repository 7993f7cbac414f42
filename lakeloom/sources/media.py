"""Facts of pictures and sounds from their bytes (S-33 to S-35, F-20, F-27, F-51, F-52, F-56, W-23)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

FACTS = "grp string, label string, value string"

#: Tags of picture files that are named.
EXIF = {0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "Changed", 0x829A: "Exposure", 0x829D: "Aperture", 0x8827: "ISO", 0x9003: "Taken", 0x9004: "Digitised", 0x920A: "Focal", 0x9286: "Comment", 0xA405: "Equivalent"}
#: Frames and fields of sound tags and the label that each goes by; the first value of a label wins.
TAGS = {
    "TIT2": "Title", "TT2": "Title", "TITLE": "Title", "TPE1": "Artist", "TP1": "Artist", "ARTIST": "Artist", "TALB": "Album", "TAL": "Album", "ALBUM": "Album",
    "TRCK": "Track", "TRK": "Track", "TRACKNUMBER": "Track", "TYER": "Year", "TDRC": "Year", "DATE": "Year", "TCON": "Genre", "GENRE": "Genre",
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}


def tiff_tags(data: bytes, at: int = 0) -> Iterator[tuple[int, object]]:
    """Tags of the first directory and of the exposure directory that it points to."""
    order = {b"II": "<", b"MM": ">"}[data[at : at + 2]]
    queue, seen = [struct.unpack_from(order + "I", data, at + 4)[0]], set()
    while queue:
        where = queue.pop()
        if where in seen:
            continue
        seen.add(where)
        (n,) = struct.unpack_from(order + "H", data, at + where)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + where + 2 + 12 * k)
            size = SIZES.get(kind, 1) * count
            start = at + where + 10 + 12 * k
            if size > 4:
                start = at + struct.unpack_from(order + "I", data, start)[0]
            raw = data[start : start + size]
            if kind == 2:
                value: object = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                value = [struct.unpack_from(order + ("ii" if kind == 10 else "II"), raw, 8 * i) for i in range(count)]
            elif kind in (3, 4, 8, 9):
                value = list(struct.unpack(order + {3: "H", 4: "I", 8: "h", 9: "i"}[kind] * count, raw))
            else:
                value = raw
            if tag in (0x8769, 0x8825):
                queue.append(value[0])
            else:
                yield tag, value


def as_text(value: object) -> str:
    if isinstance(value, bytes):
        return user_comment(value) if value[:8] in (b"ASCII\0\0\0", b"UNICODE\0") else value[:8].hex()
    if isinstance(value, list):
        return ", ".join(f"{v[0]}/{v[1]}" if isinstance(v, tuple) else str(v) for v in value[:8]) + ("…" if len(value) > 8 else "")
    return str(value)


def user_comment(raw: bytes) -> str:
    """A comment with its encoding in front; UTF-16 of either order, told by where its zero bytes are."""
    body = raw[8:]
    if raw[:8] == b"UNICODE\0":
        return body.decode("utf-16-be" if body[0::2].count(0) > body[1::2].count(0) else "utf-16-le", "replace").rstrip("\0")
    return body.decode("utf-8", "replace").rstrip("\0")


def png(data: bytes) -> Iterator[tuple]:
    at = 8
    while at + 8 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            yield "picture", "Size", "{}×{}".format(*struct.unpack(">II", body[:8]))
        elif kind == b"tEXt":
            key, _, value = body.partition(b"\0")
            yield "text", key.decode("latin-1"), value.decode("latin-1")
        elif kind == b"zTXt":
            key, _, value = body.partition(b"\0")
            yield "text", key.decode("latin-1"), zlib.decompress(value[1:]).decode("latin-1")
        elif kind == b"iTXt":
            key, _, rest = body.partition(b"\0")
            value = rest[2:].split(b"\0", 2)[2]
            yield "text", key.decode("latin-1"), (zlib.decompress(value) if rest[0] else value).decode("utf-8", "replace")
        elif kind == b"eXIf":
            yield from (("exif", EXIF[t], as_text(v)) for t, v in tiff_tags(body) if t in EXIF)
        at += 12 + n


def jpeg(data: bytes) -> Iterator[tuple]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        if mark == 0xE1 and body.startswith(b"Exif\0\0"):
            yield from (("exif", EXIF[t], as_text(v)) for t, v in tiff_tags(body, 6) if t in EXIF)
        elif mark == 0xFE:
            yield "text", "Comment", body.decode("utf-8", "replace")
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", body, 1)
            yield "picture", "Size", f"{width}×{height}"
        elif mark == 0xDA:
            return
        at += 2 + n


def synchsafe(raw: bytes) -> int:
    n = 0
    for b in raw:
        n = n << 7 | b & 127
    return n


def id3(data: bytes) -> Iterator[tuple]:
    version, size = data[3], synchsafe(data[6:10])
    at, end = 10, 10 + size
    while at + 10 <= end and data[at] > 32:
        if version == 2:
            name, n, at = data[at : at + 3].decode("latin-1"), int.from_bytes(data[at + 3 : at + 6]), at + 6
        else:
            name, n, at = data[at : at + 4].decode("latin-1"), synchsafe(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8]), at + 10
        body = data[at : at + n]
        if name in TAGS and body:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            yield "tags", TAGS[name], body[1:].decode(codec, "replace").strip("\0")
        at += n


def flac(data: bytes) -> Iterator[tuple]:
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, n = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4])
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            bits = int.from_bytes(body[10:18])
            rate, channels, samples = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
            yield "sound", "Channels", {1: "mono", 2: "stereo"}.get(channels, f"{channels} channels")
            if rate and samples:
                yield "sound", "Seconds", f"{samples / rate:.3f}"
        elif kind == 4:
            p = 4 + struct.unpack_from("<I", body)[0]
            (count,) = struct.unpack_from("<I", body, p)
            p += 4
            for _ in range(count):
                (n_field,) = struct.unpack_from("<I", body, p)
                key, _, value = body[p + 4 : p + 4 + n_field].decode("utf-8", "replace").partition("=")
                p += 4 + n_field
                if key.upper() in TAGS:
                    yield "tags", TAGS[key.upper()], value
        at += 4 + n


def wav(data: bytes) -> Iterator[tuple]:
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", data, at + 16)[0]
        elif kind == b"data" and rate:
            yield "sound", "Seconds", f"{n / rate:.3f}"
        at += 8 + n + n % 2


def facts(data: bytes) -> Iterator[tuple]:
    """Group, label and value of what a picture or sound says of itself; the first value of a label wins, blanks are left out."""
    readers = ((b"\x89PNG\r\n\x1a\n", png), (b"\xff\xd8", jpeg), (b"ID3", id3), (b"fLaC", flac), (b"RIFF", wav))
    reader = next((r for mark, r in readers if data.startswith(mark)), None)
    if reader is None and data[:2] in (b"II", b"MM"):
        reader = lambda d: (("exif", EXIF[t], as_text(v)) for t, v in tiff_tags(d) if t in EXIF)
    seen = set()
    for grp, label, value in reader(data) if reader else ():
        if value and (grp, label) not in seen:
            seen.add((grp, label))
            yield grp, label, value
