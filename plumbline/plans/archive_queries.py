"""Queries over archives that Spark packs from the tables: published packages of six kinds, and saved images."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import files as FI
from ..shared import drop_table, spread, write_table
from ..sources import archives as A
from ..sources import packages as PK
from . import derived as D

KINDS = ("npm", "pypi", "wheel", "crates", "rubygems", "go")


def _tar(members, packed: bool = False) -> bytes:
    """A tar; a packed one is the same whenever it is made."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return gzip.compress(out.getvalue(), mtime=0) if packed else out.getvalue()


def _zipped(members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def _packed(kind: int, doc: int, text: bytes) -> list[tuple[str, bytes]]:
    """(file name, archive) of one document as a package; what must not come out is in it as well."""
    name, members = f"p{doc}", [("src/text", text), ("../evil", b"x"), ("/abs", b"y"), ("meta", b"{}")]
    if doc % 23 == 0:
        return [("broken", b"no archive")]
    if kind == 0:
        return [("a.tgz", _tar([(n if n[0] in "./" else f"package/{n}", b) for n, b in members], True))]
    if kind == 1:
        return [("x-none-any.whl", _zipped([("wrong", b"")])), (f"{name}-1.tar.gz", _tar([(n if n[0] in "./" else f"{name}-1/{n}", b) for n, b in members], True))]
    if kind == 2:
        return [("x-cp313-linux.whl", _zipped([("wrong", b"")])), ("x-py3-none-any.whl", _zipped(members))]
    if kind == 3:
        return [("c.crate", _tar([(n if n[0] in "./" else f"{name}-1/{n}", b) for n, b in members], True))]
    if kind == 4:
        return [("g.gem", _tar([("metadata.gz", gzip.compress(b"x", mtime=0)), ("data.tar.gz", _tar(members, True))]))]
    return [("v1.zip", _zipped([(n if n[0] in "./" else f"{name}@1/{n}", b) for n, b in members]))]


def published(spark, d):
    """Archives (package columns, place, filename, content) of whole documents."""

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = doc % 6
                rows = [("pypi" if kind == 2 else KINDS[kind], f"p{doc}", "1", i, f, c) for i, (f, c) in enumerate(_packed(kind, doc, (text or "").encode()))]
                kinds = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["ecosystem", "name", "version", "place", "filename", "content"])

    docs = D.table(spark, d, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "ecosystem string, name string, version string, place int, filename string, content binary")


def package_files(spark, d):
    """Files of six kinds of archives: the right archive is taken, paths are cut as the ecosystem does, unsafe ones told."""
    files = PK.package_files(PK.pick_archives(published(spark, d)))
    return files.select("ecosystem", "name", "path", "kind", "size", F.md5("body").alias("digest"))


def fetched_packages(spark, d):
    """Which packages have files, and why others have none; every 29th document was never published."""
    archives = published(spark, d).where("cast(substring(name, 2) as bigint) % 29 <> 0")
    wanted = D.table(spark, d, "documents").select(F.expr("element_at(array('npm','pypi','pypi','crates','rubygems','go'), cast(doc_id % 6 + 1 as int))").alias("ecosystem"), F.concat(F.lit("p"), "doc_id").alias("name"), F.lit("1").alias("version"))
    return PK.fetched(wanted, PK.package_files(PK.pick_archives(archives))).select("ecosystem", "name", "fetched", "failed")


def _saved(doc: int, text: bytes) -> bytes:
    """A saved image of two layers, by a manifest with paths or by a layout with digests."""
    layers = [_tar([("app/text", text), ("app/gone", b"1"), ("tmp/run.sh", b"#!/bin/sh\n"), ("opt/x/old", b"2")]), _tar([("app/.wh.gone", b""), ("opt/x/.wh..wh..opq", b""), ("opt/x/new.js", b"eval(atob(x))")], True)]
    names = [hashlib.sha256(x).hexdigest() for x in layers]
    blobs = [(f"blobs/sha256/{n}", x) for n, x in zip(names, layers, strict=True)]
    if doc % 2:
        manifest = json.dumps({"layers": [{"digest": f"sha256:{n}"} for n in names]}).encode()
        at = hashlib.sha256(manifest).hexdigest()
        index = json.dumps({"manifests": [{"digest": "sha256:0", "mediaType": "x/other"}, {"digest": f"sha256:{at}", "mediaType": "application/vnd.oci.image.manifest.v1+json"}, {"digest": "sha256:1"}]}).encode()
        return _tar([("./index.json", index), (f"blobs/sha256/{at}", manifest), *blobs])
    return _tar([("manifest.json", json.dumps([{"Layers": [n for n, _ in blobs]}]).encode()), ("index.json", b"{}"), *blobs])


def _images(spark, d):
    """(entries, kept): the entries of all saved images, and which of their files the overlay leaves. Both are written: archives
    are packed and unpacked once, and what is joined afterwards reads the columns it needs."""

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([f"i{doc}"]), pa.array([_saved(doc, (text or "").encode())], pa.binary())], ["image", "content"])

    # packing is slow and a file of documents may have few row groups, so they are dealt out first
    images = spread(D.table(spark, d, "documents").select("doc_id", "text"), "doc_id").mapInArrow(run, "image string, content binary")
    unpacked, at = write_table(A.image_files(images), "image-files")  # manifests and layers are read apart
    entries, _ = write_table(A.layer_entries(A.image_layers(unpacked)), "image-entries")
    drop_table(spark, at)
    kept, _ = write_table(FI.overlay(entries), "image-kept")
    return entries, kept


def _kept(images, *columns):
    """The kept files (image, path, layer) with columns that are computed from their entries before the join."""
    entries, kept = images
    return kept.join(entries.where("kind = 'file'").select("image", "layer", "path", *columns), ["image", "layer", "path"])


def image_overlay(spark, d):
    """Saved images to the files that are left when all layers lie on each other."""
    return _kept(_images(spark, d), F.md5("body").alias("digest")).select("image", "path", F.col("layer").cast("long").alias("layer"), "digest")


def image_command(spark, d):
    """Saved images to findings: by place and kind of file, and by what texts hold and do (outside the documents' own text)."""
    images = _images(spark, d)
    shallow = FI.image_findings(_kept(images, F.substring("body", 1, FI.MAGIC_BYTES).alias("body"))).select("image", "path", F.col("reason").alias("finding"), F.lit("shallow").alias("depth"))
    deep = FI.image_deep_findings(_kept(images, "body").where("path <> 'app/text'")).select("image", "path", F.col("capability").alias("finding"), "depth")
    return shallow.unionByName(deep)


NAMES = [package_files, fetched_packages, image_overlay, image_command]
QUERIES = {f.__name__: f for f in NAMES}
_ECO = "['npm','pypi','pypi','crates','rubygems','go'][CAST(doc_id % 6 + 1 AS INT)]"
_TEXT = "coalesce(text, '')"
ORACLES = {
    "package_files": f"""WITH d AS (SELECT doc_id, {_ECO} AS ecosystem, 'p' || doc_id AS name, {_TEXT} AS t FROM documents)
SELECT ecosystem, name, 'src/text' AS path, 'file' AS kind, CAST(octet_length(encode(t)) AS BIGINT) AS size, md5(t) AS digest FROM d WHERE doc_id % 23 <> 0
UNION ALL SELECT ecosystem, name, 'meta', 'file', 2, md5('{{}}') FROM d WHERE doc_id % 23 <> 0 UNION ALL SELECT ecosystem, name, '../evil', 'unsafe', 1, md5('') FROM d WHERE doc_id % 23 <> 0
UNION ALL SELECT ecosystem, name, '/abs', 'unsafe', 1, md5('') FROM d WHERE doc_id % 23 <> 0 UNION ALL SELECT ecosystem, name, '', 'broken', 0, md5('') FROM d WHERE doc_id % 23 = 0 AND doc_id % 6 NOT IN (1, 2)""",
    "fetched_packages": f"""SELECT {_ECO} AS ecosystem, 'p' || doc_id AS name, doc_id % 29 <> 0 AND doc_id % 23 <> 0 AS fetched,
  CASE WHEN doc_id % 29 = 0 OR doc_id % 23 = 0 AND doc_id % 6 IN (1, 2) THEN 'missing' WHEN doc_id % 23 = 0 THEN 'broken' END AS failed FROM documents""",
    "image_overlay": f"""SELECT 'i' || doc_id AS image, path, CAST(layer AS BIGINT) AS layer, CASE WHEN path = 'app/text' THEN md5({_TEXT}) ELSE md5(body) END AS digest
FROM documents, (VALUES ('app/text', 0, ''), ('tmp/run.sh', 0, '#!/bin/sh' || chr(10)), ('opt/x/new.js', 1, 'eval(atob(x))')) t(path, layer, body)""",
    "image_command": """SELECT 'i' || doc_id AS image, path, finding, depth FROM documents, (VALUES ('tmp/run.sh', 'temp-script', 'shallow'), ('opt/x/new.js', 'dynamic-eval', 'code'), ('opt/x/new.js', 'base64-decode', 'code'),
  ('opt/x/new.js', 'obfuscated-payload', 'source')) t(path, finding, depth)""",
}
