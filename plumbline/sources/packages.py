"""Published package archives to files: the stage between a registry's archives and the scans.

Archives are read by Spark (``binaryFile`` or a table), so any store does. One pass over them: an archive of up to
MOST_ARCHIVE bytes is unpacked entry by entry as it is read, and its files go on in batches of a bounded size. Nothing is
dropped silently: what a cap cut, what had an unsafe path, and what could not be read has a row that says so.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Caps of an archive, of a file in it, and of the files taken.
MOST_ARCHIVE, MOST_FILE, MOST_ENTRIES = 128 << 20, 8 << 20, 20_000
PACKAGE = ["ecosystem", "name", "version"]
_ROWS = "ecosystem string, name string, version string, path string, kind string, size long, body binary"
_ERRORS = (tarfile.TarError, zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, OSError, zlib.error, NotImplementedError, RuntimeError, ValueError)
_BATCH = 16 << 20


def _unsafe(path: str) -> bool:
    return not path or path.startswith("/") or ".." in path.split("/")


def _relative(path: str, rule: str) -> str:
    """A path within the package: without ``package/``, without its first folder, or without the prefix given."""
    if rule == "first":
        return path.partition("/")[2]
    return path.removeprefix(rule)


def _tar(raw: bytes, mode: str) -> Iterator[tuple[str, int, object]]:
    with tarfile.open(fileobj=io.BytesIO(raw), mode=mode) as tar:
        for member in tar:
            if member.isfile():
                yield member.name, member.size, lambda m=member: tar.extractfile(m).read(MOST_FILE)


def _zip(raw: bytes) -> Iterator[tuple[str, int, object]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                def read(i=info):
                    with archive.open(i) as f:
                        return f.read(MOST_FILE)

                yield info.filename, info.file_size, read


def _members(ecosystem: str, name: str, version: str, filename: str, raw: bytes) -> tuple[str, Iterator]:
    """(what to take off a path, entries) of an archive of one ecosystem."""
    if ecosystem == "go":
        return f"{name}@{version}/", _zip(raw)
    if ecosystem == "pypi" and filename.endswith((".whl", ".zip")):
        return "", _zip(raw)
    if ecosystem == "rubygems":
        return "", _tar(_gem_data(raw), "r|gz")
    return "package/" if ecosystem == "npm" else "first", _tar(raw, "r|gz")


def _gem_data(raw: bytes) -> bytes:
    """The archive of files within a gem, which is a plain tar."""
    with tarfile.open(fileobj=io.BytesIO(raw), mode="r|") as tar:
        for member in tar:
            if member.name.replace("\\", "/") == "data.tar.gz":
                return tar.extractfile(member).read(MOST_ARCHIVE)
    raise tarfile.ReadError("no data.tar.gz")


def archive_files(ecosystem: str, name: str, version: str, filename: str, raw: bytes | None) -> Iterator[tuple[str, str, int, bytes]]:
    """(path, kind, size, body) of one archive. Kinds: file; ``truncated`` (a cap ended the file or the reading), ``unsafe``
    (an absolute path or one with ``..``), ``too-large``, ``broken`` (not readable on), ``empty`` (no file came out)."""
    if raw is None or len(raw) > MOST_ARCHIVE:
        yield "", "too-large" if raw else "broken", len(raw or b""), b""  # a null content cannot be read
        return
    taken = 0
    try:
        rule, members = _members(ecosystem, name, version, filename, raw)
        for path, size, read in members:
            if taken >= MOST_ENTRIES:
                yield "", "truncated", taken, b""
                return
            path = path.replace("\\", "/")
            path = path.removeprefix("./")
            if _unsafe(path):
                yield path, "unsafe", size, b""
                continue
            inner = _relative(path, rule)
            if not inner:
                continue
            body = read()
            taken += 1
            yield inner, "file", size, body
            if len(body) < size:
                yield inner, "truncated", len(body), b""
    except _ERRORS:
        yield "", "broken", taken, b""
        return
    if not taken:
        yield "", "empty", 0, b""


def pick_archives(archives: DataFrame) -> DataFrame:
    """One archive a package (package columns, filename, content; ``place``, its order in the listing).

    PyPI: the first source archive (``.tar.gz``), else the first wheel for any platform, else the first wheel; packages
    without either have no row. Elsewhere the first. Contents are joined after the choice is made.
    """
    name = F.col("filename")
    pure = F.contains(name, F.lit("-none-any"))
    rank = F.when(F.col("ecosystem") != "pypi", 0).when(name.endswith(".tar.gz"), 0).when(name.endswith(".whl") & pure, 1).when(name.endswith(".whl"), 2)
    best = archives.select(*PACKAGE, "place", "filename", rank.alias("rank")).where("rank is not null").groupBy(*PACKAGE).agg(F.min(F.struct("rank", "place", "filename")).alias("b"))
    chosen = best.select(*PACKAGE, F.col("b.place").alias("place"), F.col("b.filename").alias("filename"))
    return archives.join(chosen, [*PACKAGE, "place", "filename"], "left_semi")


def package_files(archives: DataFrame) -> DataFrame:
    """(package columns, path, kind, size, body): the files of archives (package columns, filename, content), see ``archive_files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _ROWS.split(", ")]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                *of, filename, content = (c[i].as_py() for c in batch.columns)
                for entry in archive_files(*(x or "" for x in of), filename or "", content):
                    rows.append((*of, *entry))
                    held += len(entry[-1])
                    if held > _BATCH or len(rows) >= 8192:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    return archives.select(*PACKAGE, "filename", "content").mapInArrow(run, _ROWS)


def fetched(packages: DataFrame, files: DataFrame) -> DataFrame:
    """``packages`` with ``fetched`` (a file of it is there) and ``failed`` (why not: its archive's kind, or ``missing``)."""
    state = files.groupBy(*PACKAGE).agg(F.max((F.col("kind") == "file").cast("int")).alias("has"), F.min(F.when(F.col("kind").isin("broken", "too-large", "empty"), F.col("kind"))).alias("why"))
    rows = packages.join(state, PACKAGE, "left")
    has = F.coalesce(F.col("has") == 1, F.lit(False))
    return rows.withColumns({"fetched": has, "failed": F.when(~has, F.coalesce("why", F.lit("missing")))}).drop("has", "why")
