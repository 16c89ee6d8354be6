"""Zip directories and bounded members, and probes of paths.

The archive's directory is read, nothing is unpacked. Callers leave out paths
that are known to be online-only, which a read would download.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rollup import zip_rollup
from ..schema import IMAGE, MODEL, PREVIEW_HINT, ZIP_FILES_CAP

#: The most that is read of an image, and of a model, inside an archive.
IMAGE_CAP, MODEL_CAP = 40 << 20, 96 << 20
#: File attributes that mark an online-only file on Windows.
ONLINE_ONLY = 0x1000 | 0x00040000 | 0x00400000
#: How image files begin.
_IMAGE_STARTS = (b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"BM", b"RIFF", b"II*\0", b"MM\0*")
_HINT = re.compile(PREVIEW_HINT, re.I)
_MEMBERS = "path string, status string, detail string, members array<struct<base:string,size:long,seq:int>>, preview string"
_STEP = 1 << 20


def bounded(stream: BinaryIO, cap: int) -> bytes | None:
    """All of ``stream``, or null as soon as more than ``cap`` bytes have come: a
    header that understates a member's size costs no more memory than that."""
    parts, room = [], cap
    while part := stream.read(min(_STEP, room + 1)):
        room -= len(part)
        if room < 0:
            return None
        parts.append(part)
    return b"".join(parts)


def picture(archive: zipfile.ZipFile, entries: list[zipfile.ZipInfo], cap: int = IMAGE_CAP) -> tuple[str, bytes] | None:
    """Name and bytes of the preview among image ``entries``: hinted names alone
    if there are any, the largest first, stored order for ties; the first that is
    within ``cap`` and begins like an image."""
    hinted = [e for e in entries if _HINT.search(_base(e))]
    for entry in sorted(hinted or entries, key=lambda e: e.file_size, reverse=True):
        if entry.file_size <= cap:
            with archive.open(entry) as stream:
                data = bounded(stream, cap)
            if data and data.startswith(_IMAGE_STARTS):
                return _base(entry), data
    return None


def _base(entry: zipfile.ZipInfo) -> str:
    return entry.filename.replace("\\", "/").rpartition("/")[2]


def _kind(name: str) -> str:
    return os.path.splitext(name)[1].lower().lstrip(".")


def _directory(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The model and image entries, in stored order."""
    return [e for e in archive.infolist() if not e.is_dir() and "__MACOSX" not in e.filename and not _base(e).startswith("._") and _kind(_base(e)) in (*MODEL, *IMAGE)]


def _listed(path: str) -> tuple[str, str | None, list[dict] | None, str | None]:
    """Status, detail, members and preview; members are null where none could be read."""
    if _kind(path) != "zip":
        return "unsupported", f".{_kind(path)} is known by name only", None, None
    try:
        with zipfile.ZipFile(path) as archive:
            entries = _directory(archive)
            found = [{"base": _base(e), "size": e.file_size, "seq": k} for k, e in enumerate(entries)]
            models = [e.file_size for e in entries if _kind(_base(e)) in MODEL]
            shown = picture(archive, [e for e in entries if _kind(_base(e)) in IMAGE])
            if shown:
                return "reused", f"picture in the archive: {shown[0]}", found, shown[0]
            if not entries:
                return "packed", "neither picture nor model in the archive", [], None
            if models and max(models) > MODEL_CAP:
                return "packed", f"its largest model has {max(models) / 1e6:.0f} MB, more than is read from an archive", found, None
            return "packed", None, found, None
    except FileNotFoundError:
        return "missing", "archive gone from its path", None, None
    except RuntimeError as error:  # an encrypted picture
        return "packed", f"not readable: {error}"[:120], None, None
    except (zipfile.BadZipFile, OSError, NotImplementedError) as error:
        return "packed", f"not a readable zip ({type(error).__name__})", None, None


def preview_bytes(path: str) -> bytes | None:
    """The picture that ``members`` names, read again."""
    with zipfile.ZipFile(path) as archive:
        shown = picture(archive, [e for e in _directory(archive) if _kind(_base(e)) in IMAGE])
    return shown and shown[1]


def members(archives: DataFrame, path: str = "path") -> DataFrame:
    """path, status, detail, members (base, size, seq) and preview of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("base", pa.string()), ("size", pa.int64()), ("seq", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                paths = batch.column(0).slice(at, 64)
                status, detail, found, shown = zip(*[_listed(p.as_py()) for p in paths])
                yield pa.RecordBatch.from_arrays([paths, pa.array(status), pa.array(detail, pa.string()), pa.array(found, item), pa.array(shown, pa.string())], names=["path", "status", "detail", "members", "preview"])

    return archives.select(F.col(path).alias("path")).where("path is not null").mapInArrow(run, _MEMBERS)


def contents(archives: DataFrame, path: str = "path") -> DataFrame:
    """path, status, detail, preview, part_count, inner_bytes, model_files, formats of each archive."""
    listed = members(archives, path).withColumn("_key", F.struct("path", "status", "detail", "preview", F.col("members").isNotNull().alias("read")))
    learned = ("part_count", "inner_bytes", "model_files", "formats")
    found = zip_rollup(listed, "_key", ZIP_FILES_CAP).select("_key.*", *learned)
    return found.select("path", "status", "detail", "preview", *[F.when(F.col("read"), F.col(c)).alias(c) for c in learned])


def probe(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, hydrated: true on disk, false online-only, null absent; and is_dir."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, folder = [], []
            for p in batch.column(0):
                try:
                    s = os.stat(p.as_py())
                    state.append(not getattr(s, "st_file_attributes", 0) & ONLINE_ONLY)
                    folder.append(os.path.isdir(p.as_py()))
                except OSError:
                    state.append(None)
                    folder.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(state, pa.bool_()), pa.array(folder, pa.bool_())], names=["path", "hydrated", "is_dir"])

    return paths.select(F.col(path).alias("path")).where("path is not null").mapInArrow(run, "path string, hydrated boolean, is_dir boolean")

