"""The catalog's relations."""

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

FILES = T.StructType([
    T.StructField("root", _S), T.StructField("dir", _S), T.StructField("name", _S), T.StructField("size", _L),
    T.StructField("is_symlink", _B), T.StructField("unreadable", _B),
])
ITEM = T.StructType([
    T.StructField("id", _S), T.StructField("type", _S), T.StructField("name", _S), T.StructField("path", _S),
    T.StructField("source", _S), T.StructField("category", _S), T.StructField("faction", _S), T.StructField("packed", _B),
    T.StructField("part_count", _I), T.StructField("formats", T.ArrayType(_S)), T.StructField("size_bytes", _L),
    T.StructField("primary_file", _S), T.StructField("has_shipped_preview", _B), T.StructField("preview_file", _S),
    T.StructField("model_files", T.ArrayType(_S)), T.StructField("inner_bytes", _L), T.StructField("thumbnail", _S),
    T.StructField("thumb_status", _S), T.StructField("thumb_error", _S), T.StructField("tags", T.ArrayType(_S)), T.StructField("ord", _L),
])
#: Columns that a scan sets; the others of an item survive a rescan.
SCANNED = ["type", "name", "path", "source", "category", "faction", "packed", "part_count", "formats", "size_bytes",
           "primary_file", "has_shipped_preview", "preview_file", "model_files", "thumbnail", "thumb_status", "tags"]

#: File kinds by extension, and the outcomes of a thumbnail.
MODEL = ("stl", "obj", "3mf", "step", "stp", "ply")
IMAGE = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff")
ARCHIVE = ("zip", "rar", "7z")
OK_STATUS = ("reused", "shell", "mesh", "existing")
STATUS = (*OK_STATUS, "pending", "packed", "cloud_only", "missing", "no_model_file", "unsupported", "too_big", "timeout", "failed")
#: What a scan passes over.
IGNORED_DIRS = ("__macosx", ".git", ".svn", "$recycle.bin", "system volume information", ".trashes", "#recycle", ".dropbox.cache", ".tmp.driveupload")
IGNORED_PREFIXES = ("._",)
#: Names of preview pictures, and caps of the views.
PREVIEW_HINT = "render|preview|thumb|_prev|display|promo|cover|hero|showcase"
HAYSTACK_CAP, ZIP_FILES_CAP, ALL_FILES_CAP, PAGE = 4000, 200, 25, 120
#: Folder names that say nothing about what is inside, where no list is configured.
GENERIC = (
    "files", "file", "parts", "part", "stl", "stls", "meshes", "mesh", "obj", "output", "export", "supported", "presupported",
    "unsupported", "supports", "print", "prints", "split", "cut", "assembled", "whole", "body", "bodies", "misc", "new folder",
    "untitled", "resin", "fdm",
)
