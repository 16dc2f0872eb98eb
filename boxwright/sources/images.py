"""Files of a data set: listings, splits, label files beside images or predictions, and image sizes from file headers.

Listings never read contents. Sizes come from the few header bytes that tasks read of each file, not from its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import unpack
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem, suffix

IMAGE_SUFFIXES = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def list_files(spark: SparkSession, pattern: str, recursive: bool = True) -> DataFrame:
    """(path, length) of files; the contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(pattern).select("path", "length")


def is_hidden(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1).startswith(".")


def is_image(path: Column) -> Column:
    return ~is_hidden(path) & F.lower(F.substr(suffix(path), F.lit(2))).isin(*IMAGE_SUFFIXES)


def split_of(path: Column) -> Column:
    """The folders below the last ``images``, ``labels`` or ``annotations`` folder of a path, such as train; '' without any."""
    return F.regexp_extract(path, r"^.*/(?:images|labels|annotations)/(?:(.+)/)?[^/]*$", 1)


def split_key(path: Column) -> Column:
    """<split>/<stem>, or the stem alone: files of equal names in different splits stay apart."""
    return F.concat(F.regexp_replace(split_of(path), r"(?<=.)$", "/"), stem(path))


def located(files: DataFrame, roots: list[str]) -> DataFrame:
    """With ds, the place in ``roots`` of the first folder that holds the file (null if none does), and stem."""
    place = F.coalesce(*(F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.lit(i)) for i, root in enumerate(roots)))
    return files.withColumn("ds", place).withColumn("stem", stem(F.col("path")))


def paired_files(left: DataFrame, right: DataFrame, shared_sets: bool = False) -> DataFrame:
    """(ds, stem, path, partner): each file of ``left`` with the first of ``right`` in its data set that has its stem.

    Both sides are ``located``. A file without partner has null, or is left out with its whole data set where
    ``shared_sets`` asks for sets that both sides have.
    """
    first = right.where("ds IS NOT NULL").groupBy("ds", "stem").agg(F.min("path").alias("partner"))
    out = left.select("ds", "stem", "path").join(first, ["ds", "stem"], "left")
    return out.join(first.select("ds").distinct(), "ds", "left_semi") if shared_sets else out


def gathered(files: DataFrame) -> DataFrame:
    """(split, n, first, last) of the files of each split; the list itself stays a table."""
    return files.groupBy(split_of(F.col("path")).alias("split")).agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def header_size(file: BinaryIO) -> tuple[int, int] | None:
    """(width, height) of an image as it is shown, or None for what is no image."""
    head = file.read(32)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return unpack(">II", head[16:24])
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = unpack("<ii", head[18:26])
        return abs(width), abs(height)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        kind = head[12:16]
        if kind == b"VP8X":
            return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
        if kind == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        width, height = unpack("<HH", head[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if head[:4] in (b"II*\0", b"MM\0*"):
        file.seek(0)
        tags = _tiff_tags(file.read(1 << 20))
        return (tags[256], tags[257]) if {256, 257} <= tags.keys() else None
    if head[:2] == b"\xff\xd8":
        return _jpeg_size(file)
    return None


def _tiff_tags(data: bytes) -> dict[int, int]:
    """Whole-number tags of the first directory."""
    order = "<" if data[:2] == b"II" else ">"
    at = unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k :][:12]
        tag, kind = unpack(order + "HH", entry[:4])
        if kind in (3, 4):
            tags[tag] = unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return tags


def _jpeg_size(file: BinaryIO) -> tuple[int, int] | None:
    """From the frame header; an EXIF orientation over 4 swaps the sides."""
    file.seek(2)
    turned = False
    while len(mark := file.read(4)) == 4 and mark[0] == 0xFF:
        code, length = mark[1], unpack(">H", mark[2:])[0]
        if 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            height, width = unpack(">HH", file.read(5)[1:])
            return (height, width) if turned else (width, height)
        start = file.tell()
        if code == 0xE1 and file.read(6) == b"Exif\0\0":
            turned = _tiff_tags(file.read(length - 8)).get(274, 1) > 4
        file.seek(start + length - 2)
    return None


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from struct import error

    from pyarrow import fs

    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            try:
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_file(name) as file:
                    found.append(header_size(file) or (None, None))
            except (error, OSError):  # cut short, gone since it was listed, or not to be read
                found.append((None, None))
        sizes = [pa.array([pair[side] for pair in found], pa.int32()) for side in (0, 1)]
        yield pa.record_batch([batch.column("path"), *sizes], names=["path", "width", "height"])


def image_headers(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, width, height) of image files; null sizes where the header can't be read.

    A listing has few bytes a file, so its rows are dealt anew: the work is opening files.
    """
    images = files.where(is_image(F.col("path"))).select("path")
    dealt = images.repartition(tasks) if tasks else images.repartition("path")
    return dealt.mapInArrow(_headers, "path string, width int, height int")


def sizes_of(files: DataFrame, key=stem) -> DataFrame:
    """(image_id, width, height): of the first image of each key that has a size."""
    rows = image_headers(files).where("width > 0 AND height > 0")
    first = rows.groupBy(key(F.col("path")).alias("image_id")).agg(F.min(F.struct("path", "width", "height")).alias("s"))
    return first.select("image_id", "s.width", "s.height")
