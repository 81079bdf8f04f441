"""Package heuristics: each gives the rows (or keys) that raise a capability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import versions as V
from ..functions.names import dep_source

KEY = ["ecosystem", "name"]


def bare_name(name: Column) -> Column:
    """A name without its npm scope."""
    return F.when(name.startswith("@"), F.regexp_replace(name, r"\A@[^/]*/", "")).otherwise(name)


def byte_text(c: Column) -> Column:
    """Text with one character a UTF-8 byte, so that edit distances count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def read_top_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(ecosystem, name) of files ``<ecosystem>.txt``: a name a line, blank lines and those that begin with ``#`` left out."""
    rows = spark.read.text(f"{folder.rstrip('/')}/*.txt").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("ecosystem"), F.trim("value").alias("name"))
    return rows.where((F.col("name") != "") & ~F.col("name").startswith("#")).distinct()


def typosquat_index(top: DataFrame, most: int = 2) -> DataFrame:
    """(ecosystem, top, near, piece, at, len): each top name in ``most`` + 1 pieces, with their places and the name's length.

    Two strings within k edits share one of the k + 1 pieces of one of them, moved by at most k places. Pieces of names
    shorter than that are empty and are shared by all names of a like length, so short names are found as well.
    """
    tops = top.where("name <> ''").select("ecosystem", byte_text(F.col("name")).alias("top"), F.col("name").alias("near")).distinct()
    n = most + 1
    cut = lambda i: (F.floor(F.length("top") * i / n)).cast("int")
    pieces = F.array(*[F.struct(F.substring(F.col("top"), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"), cut(i).alias("at"), F.length("top").alias("len")) for i in range(n)])
    return tops.withColumn("p", F.explode(pieces)).select("ecosystem", "top", "near", "p.piece", "p.at", "p.len")


def write_index(top: DataFrame, path: str, most: int = 2) -> list[str]:
    """Store the index of top lists, a folder an ecosystem; only lists that differ from those stored are written again.

    Returns the ecosystems that were (a few names). Readers see each ecosystem's old or new list, never a mixture.
    """
    spark = top.sparkSession
    mark = lambda rows: {r["ecosystem"]: (r["n"], r["h"]) for r in rows.groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("near").cast("decimal(38,0)")).alias("h")).collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = mark(read_index(spark, path).select("ecosystem", "near").distinct()) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else {}
    now = mark(top.where("name <> ''").select("ecosystem", F.col("name").alias("near")).distinct())
    changed = sorted(e for e in now if now[e] != stored.get(e))
    if changed:
        rows = typosquat_index(top.where(F.col("ecosystem").isin(changed)), most)
        rows.repartition("ecosystem").write.partitionBy("ecosystem").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return changed


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("top string, near string, piece string, at int, len int, ecosystem string").parquet(path)


def near_names(packages: DataFrame, index: DataFrame, most: int = 2) -> DataFrame:
    """(ecosystem, name, near): names within ``most`` byte edits of an indexed top name, but no top name themselves.

    Candidates come from an equi-join by piece, not a theta join; the distance is then checked. Ecosystems without a list, and
    null and empty names, have no rows.
    """
    names = packages.where("name <> ''").select("ecosystem", "name").distinct().withColumn("bare", byte_text(bare_name(F.col("name"))))
    fresh = names.join(index.select("ecosystem", F.col("top").alias("bare")).distinct(), ["ecosystem", "bare"], "left_anti")
    # every piece length and place that may occur: three a length of a top name
    shapes = index.select("ecosystem", F.length("piece").alias("plen"), "at", "len").distinct()
    moved = shapes.withColumn("s", F.explode(F.sequence(F.greatest(F.col("at") - most, F.lit(0)), F.col("at") + most)))
    probe = fresh.join(F.broadcast(moved), "ecosystem").where((F.abs(F.length("bare") - F.col("len")) <= most) & (F.col("s") + F.col("plen") <= F.length("bare")))
    probe = probe.select("ecosystem", "name", "bare", "at", "len", F.substring(F.col("bare"), F.col("s") + 1, F.col("plen")).alias("piece")).distinct()
    found = probe.join(index.select("ecosystem", "top", "near", "piece", "at", "len"), ["ecosystem", "piece", "at", "len"])
    return found.where(F.levenshtein("bare", "top") <= most).select("ecosystem", "name", "near").distinct()


def typosquats(packages: DataFrame, top: DataFrame, most: int = 2) -> DataFrame:
    """``near_names`` with an index that is made for this once."""
    return near_names(packages, typosquat_index(top, most), most)


def maintainer_signals(releases: DataFrame) -> DataFrame:
    """Releases (ecosystem, name, version, published_at, publisher) with the previous release's time and publisher."""
    w = Window.partitionBy(*KEY).orderBy("published_at", "version")
    return releases.withColumns({"previous_published_at": F.lag("published_at").over(w), "previous_publisher": F.lag("publisher").over(w)})


def hijack_signals(signals: DataFrame, now: Column) -> DataFrame:
    """``hijack_points``: fresh (7 days at most), after a long gap (180 days at least), few downloads (0 < n < 1000); two make a risk."""
    day = 86400
    age = F.unix_timestamp(now) - F.unix_timestamp("published_at")
    gap = F.unix_timestamp("published_at") - F.unix_timestamp("previous_published_at")
    points = [(age >= 0) & (age <= 7 * day), gap >= 180 * day, (F.col("weekly_downloads") > 0) & (F.col("weekly_downloads") < 1000)]
    total = sum((F.coalesce(p, F.lit(False)).cast("int") for p in points), F.lit(0))
    total = F.when(F.col("published_at").isNull(), 0).otherwise(total)
    changed = (F.coalesce("publisher", F.lit("")) != "") & (F.coalesce("previous_publisher", F.lit("")) != "") & (F.col("publisher") != F.col("previous_publisher"))
    return signals.withColumns({"hijack_points": total, "hijack_risk": total >= 2, "maintainer_changed": changed})


def retracted(packages: DataFrame, retractions: DataFrame) -> DataFrame:
    """Go versions that are retracted: equal to a bound, or between both (semantic order)."""
    hit = packages.join(retractions, ["ecosystem", "name"])
    v, lo, hi = (V.parse_version(F.col(c)) for c in ("version", "low", "high"))
    return hit.where((F.col("version") == F.col("low")) | (F.col("version") == F.col("high")) | ((v >= lo) & (v <= hi))).select("ecosystem", "name", "version").distinct()


# Extensions of executables, and PyPI paths where they are usual.
BINARIES = ["exe", "msi", "bat", "cmd", "dll", "so", "dylib", "scpt", "applescript", "ps1"]
PYPI_USUAL = r"\.cpython-[^/]*\.so\z|\.abi3\.so\z|\.pyd\z|/\.libs/|/_vendor/"


def is_binary_dropper(path: Column, ecosystem: Column) -> Column:
    return R.extension(path).isin(*BINARIES) & ~((ecosystem == "pypi") & path.rlike(PYPI_USUAL))


def binary_droppers(files: DataFrame) -> DataFrame:
    """Files (ecosystem, path, ...) that are executables."""
    return files.where(is_binary_dropper(F.col("path"), F.col("ecosystem")))


# Folders of build output, and files that any package may have.
BUILD_DIRS = ["dist/", "lib/", "build/", "out/", "cjs/", "mjs/", "esm/", "umd/", "types/", "typings/", "dts/"]
METADATA_FILES = ["package.json", "readme.md", "readme", "license", "license.md", "license.txt", "changelog.md", "changelog", "notice", "authors", "contributors.md"]


def in_folder(low_path: Column, folders: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, folders)), lambda d: F.startswith(low_path, d))


def unlisted_large(files: DataFrame, listed: DataFrame, least: int = 512000) -> DataFrame:
    """Large script files (ecosystem, name, path, length) outside build folders that the package's ``files`` field does not list.

    ``listed`` (ecosystem, name, path): an entry stands for a path or base name, and without a dot or with a final slash
    for a folder. A package's entries are its manifest's, a bounded list, and joined as one array.
    """
    entry = F.trim(F.regexp_replace(F.regexp_replace(F.trim("path"), r"\A/+", ""), r"\A(?:\./)+", ""))
    entries = listed.select(*KEY, F.lower(entry).alias("entry")).where("entry <> ''").groupBy(*KEY).agg(F.collect_set("entry").alias("entries"))
    big = files.where((F.col("length") >= least) & (R.language(F.col("path")) == "js"))
    low = F.regexp_replace(F.lower("path"), r"\A(?:\./)+", "")
    names = F.coalesce("entries", F.array().cast("array<string>"))
    base = F.element_at(F.split(low, "/"), -1)
    known = F.array_contains(names, low) | F.array_contains(names, base) | low.isin(*METADATA_FILES) | base.isin(*METADATA_FILES) | in_folder(low, BUILD_DIRS)
    folder = F.exists(names, lambda e: (~F.contains(e, F.lit(".")) | e.endswith("/")) & F.startswith(low, F.concat(F.regexp_replace(e, r"/+\z", ""), F.lit("/"))))
    return big.join(entries, KEY, "left").where(~known & ~folder).drop("entries")


def dependency_sources(manifest: DataFrame) -> DataFrame:
    """Manifest rows (spec, dep_group) with ``dep_source``, ``vcs_dependency`` and ``git_dep_in_optional``."""
    vcs = F.col("dep_source") == "vcs"
    return manifest.withColumn("dep_source", dep_source(F.col("spec"))).withColumns({"vcs_dependency": vcs, "git_dep_in_optional": vcs & (F.col("dep_group") == "optional")})


def source_findings(files: DataFrame) -> DataFrame:
    """Files (path, body text) with ``capabilities``: malware names, decode-then-run code, suspicious URLs, piped downloads.

    Whole texts are looked at, as they are and with string literals joined.
    """
    both = files.withColumn("raw", F.col("body")).withColumn("language", R.language(F.col("path")))
    both = both.withColumn("joined", F.when(F.col("raw").rlike(R.SPLIT_LITERAL), R.join_literals(F.col("raw"))))  # null, and so cheap, where nothing is split
    either = lambda f: F.coalesce(f(F.col("raw")) | f(F.col("joined")), F.lit(False))
    coded = F.lit(False)
    for lang in R.OBFUSCATION:
        coded = F.when(F.col("language") == lang, either(lambda c, x=lang: R.obfuscated(c, x))).otherwise(coded)
    base = F.regexp_extract("path", r"([^/]+)\z", 1)
    known = F.col("language").isNotNull()
    caps = F.array_compact(F.array(
        F.when(base.isin(*R.MALWARE_FILES), "known-malware-ioc"), F.when(known & coded, "obfuscated-payload"),
        F.when(known & either(R.suspicious_url), "suspicious-url"), F.when(known & either(R.piped_download), "install-hook-suspicious"),
    ))
    return both.withColumn("capabilities", caps).drop("raw", "joined", "language")


# What makes an inline script of node dangerous at any length.
INLINE_DANGER = [
    "require(", "import(", "child_process", "execSync", "spawn", "exec(", "fetch(", "http.", "https.", "net.",
    "fs.write", "writeFileSync", "createWriteStream", "atob(", "Buffer.from", "base64", "eval(", "Function(",
]
INLINE_LONG = 120
_NODE = r"""\b(?:node)\s+(?:-e|--eval)\s+(.+)$"""
_BENIGN = r"""^[\s'"]*(?:if\s*\(?\s*)?process\.(?:env\.\w+|exit\s*\(\s*\d+\s*\)|argv|platform|version)"""


def inline_danger(script: Column) -> Column:
    """Whether an inline script of node is long, or holds a sign of danger and is no short look at the process."""
    bare = F.regexp_replace(F.regexp_replace(script, r"\A\s+|\s+\z", ""), r"[&|;]+\z", "")
    bare = F.regexp_replace(bare, r"\A\s+|\s+\z", "")
    bare = F.regexp_replace(bare, r"""(?s)\A(["'])(.*)\1\z""", "$2")
    signs = F.exists(F.array(*map(F.lit, INLINE_DANGER)), lambda d: F.contains(bare, d))
    return (bare != "") & ((F.octet_length(bare) > INLINE_LONG) | (~bare.rlike(_BENIGN) & signs))


def suspicious_hook(body: Column) -> Column:
    """Whether an install hook downloads and runs, hides, or sends out identities; also with string literals joined."""
    body = F.regexp_replace(body, r"\A\s+|\s+\z", "")
    one = lambda c: R.any_of(c, R.HOOKS) | inline_danger(F.regexp_extract(c, _NODE, 1))
    return one(body) | (body.rlike(R.SPLIT_LITERAL) & one(R.join_literals(body)))


def secrets(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``files`` with the kinds of secrets in their text, where there are any."""
    kinds = F.array_compact(F.array(*[F.when(F.col(text_col).rlike(p), F.lit(k)) for k, p in R.SECRETS]))
    return files.withColumn("secret_kinds", kinds).where(F.size("secret_kinds") > 0)


def hook_files(body: Column) -> Column:
    """Local script files that a hook names: words with a script extension that are no flags or URLs."""
    words = F.split(F.regexp_replace(body, r"""[;&|()"'`]""", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"(?i)\.(?:js|mjs|cjs|ts|sh|py|rb|pl|ps1)\z") & ~w.startswith("-") & ~F.contains(w, F.lit("://"))))


def hook_paths(body: Column) -> Column:
    """Lower-cased words of a hook that look like local files: with an extension, and no flag or URL."""
    words = F.transform(F.split(body, r"[ \t\n;|&()`]"), lambda w: F.regexp_replace(w, r"\A(?:\./)+", ""))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike(r"\.[^./]+\z") & ~w.startswith("-") & ~F.contains(w, F.lit("://"))), F.lower))


def maintainer_capabilities(signals: DataFrame) -> DataFrame:
    """Signals with the capabilities they raise: hijack risk, changed maintainer, unpublished version."""
    caps = F.array_compact(F.array(
        F.when(F.col("hijack_risk"), "maintainer-hijack-risk"), F.when(F.col("maintainer_changed"), "maintainer-changed"), F.when(F.coalesce("unpublished", F.lit(False)), "version-unpublished"),
    ))
    return signals.withColumn("capabilities", caps)
