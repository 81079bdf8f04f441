"""Image archives: layer tars to entry rows."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_FILE, MOST_LAYER, MOST_ENTRIES = 8 << 20, 512 << 20, 200_000
# rows and bytes of bodies from which on an Arrow batch is sent
SENT_ROWS, SENT_BYTES = 256, 16 << 20
ENTRY = "image string, layer int, path string, kind string, mode int, size long, body binary"
SCHEMA = pa.schema([("image", pa.string()), ("layer", pa.int32()), ("path", pa.string()), ("kind", pa.string()), ("mode", pa.int32()), ("size", pa.int64()), ("body", pa.binary())])


def _clean(path: str) -> str:
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def entries(raw: bytes) -> Iterator[tuple[str, str, int, int, bytes]]:
    """(path, kind, mode, size, body) of one layer, compressed or not, unpacked as it is read.

    Kinds: file, whiteout, opaque; ``truncated`` where a cap ended the reading (its size: the bytes read), or where a file's
    body holds less than its size; ``broken`` where the archive cannot be read on.
    """
    total = 0
    try:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r|*") as tar:
            for count, member in enumerate(tar):
                if count >= MOST_ENTRIES or total > MOST_LAYER:
                    yield "", "truncated", 0, total, b""
                    return
                path = _clean(member.name)
                folder, _, base = path.rpartition("/")
                if base == ".wh..wh..opq":
                    yield folder, "opaque", 0, 0, b""
                elif base.startswith(".wh."):
                    yield f"{folder}/{base[4:]}".lstrip("/"), "whiteout", 0, 0, b""
                elif member.isfile():
                    body = tar.extractfile(member).read(MOST_FILE)
                    total += len(body)
                    yield path, "file", member.mode, member.size, body
                    if len(body) < member.size:
                        yield path, "truncated", member.mode, len(body), b""
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        yield "", "broken", 0, total, b""


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, the last value of each a body, as batches that hold many small rows or few large ones."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= SENT_ROWS or size > SENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def image_files(images: DataFrame) -> DataFrame:
    """(image, path, content) of saved images (image, content: one plain tar each), to be given to ``image_layers``.

    Read entry by entry; entries beyond MOST_LAYER bytes, and what cannot be read on, are left out here and so are missing
    layers there. A saved image is one binary cell, so one above 2 GB has to be unpacked beforehand.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for image, content in zip(*(batch.column(k) for k in (0, 1)), strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content.as_py() or b""), mode="r|") as tar:
                        for member in tar:
                            path = _clean(member.name)
                            if member.isfile() and path and member.size <= MOST_LAYER:
                                yield image.as_py(), path, tar.extractfile(member).read()
                except (tarfile.TarError, EOFError, OSError):
                    continue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(members(batches), pa.schema([("image", pa.string()), ("path", pa.string()), ("content", pa.binary())]))

    return images.select("image", "content").mapInArrow(run, "image string, path string, content binary")


def image_layers(files: DataFrame) -> DataFrame:
    """(image, layer, content) from the files (image, path, content) of unpacked images: layers in order from 0.

    A ``manifest.json`` lists layers by path; without one, the first image manifest of a layout's ``index.json`` names them by
    digest. Layers are joined by image and path, so that only the JSON documents are parsed.
    """
    text = F.col("content").cast("string")
    digest = lambda c: F.concat(F.lit("blobs/"), F.replace(c, F.lit(":"), F.lit("/")))
    small = files.where(F.length("content") <= MOST_FILE).select("image", "path", text.alias("text"))
    saved = small.where("path = 'manifest.json'").select("image", F.posexplode(F.get(F.from_json("text", "array<struct<Layers:array<string>>>"), F.lit(0))["Layers"]).alias("layer", "path"))
    manifests = F.from_json("text", "manifests array<struct<digest:string,mediaType:string>>")["manifests"]
    first = F.get(F.filter(manifests, lambda m: (F.coalesce(m["mediaType"], F.lit("")) == "") | F.contains(m["mediaType"], F.lit("manifest"))), F.lit(0))["digest"]
    index = small.where("path = 'index.json'").select("image", digest(first).alias("path")).join(small.where("path = 'manifest.json'").select("image"), "image", "left_anti")
    named = index.join(small, ["image", "path"]).select("image", F.posexplode(F.from_json("text", "layers array<struct<digest:string>>")["layers"]).alias("layer", "l")).select("image", "layer", digest(F.col("l.digest")).alias("path"))
    return saved.unionByName(named).join(files, ["image", "path"]).select("image", "layer", "content")


def layer_entries(layers: DataFrame) -> DataFrame:
    """Entry rows of layers (image, layer, content): one row in, its entries out, nothing gathered."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for image, layer, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                for entry in entries(content.as_py() or b"") if content.is_valid and len(content.as_buffer()) else ():
                    yield image.as_py(), layer.as_py(), *entry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), SCHEMA)

    return layers.select("image", "layer", "content").mapInArrow(run, ENTRY)
