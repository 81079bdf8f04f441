"""Names, paths and references as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ECOSYSTEMS


def url_component(c: Column) -> Column:
    """Percent-encoding that keeps A-Z a-z 0-9 - . _ ~ only."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """A package URL; the name's last ``/`` (Maven: ``:``) parts namespace and name."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for e in ECOSYSTEMS for x in (e[0], e[3])]), ecosystem), F.lit("generic"))
    full = F.when(ecosystem == "maven", F.replace(name, F.lit(":"), F.lit("/"))).otherwise(name)
    path = F.array_join(F.transform(F.split(full, "/"), url_component), "/")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), path, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), url_component(version))).otherwise(""))


def glob_regex(glob: Column) -> Column:
    """An anchored pattern for a glob in which ``*`` stays within a path segment and ``**`` is one ``*``."""
    quoted = F.regexp_replace(F.regexp_replace(glob, r"\*+", "*"), r"([.+?^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit(r"\A"), F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit(r"\z"))


def glob_match(path: Column, glob: Column) -> Column:
    return F.rlike(path, glob_regex(glob))


def clean_path(path: Column) -> Column:
    """``/`` for backslashes, no empty or ``.`` segments, ``..`` resolved within the root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def image_reference(c: Column) -> Column:
    """struct(registry, repository, tag) of an image reference; a digest is dropped."""
    text = F.split_part(c, F.lit("@"), F.lit(1))
    last = F.element_at(F.split(text, "/"), -1)
    tag = F.when(F.contains(last, F.lit(":")), F.split_part(last, F.lit(":"), F.lit(-1))).otherwise("latest")
    bare = F.when(F.contains(last, F.lit(":")), F.substring(text, F.lit(1), F.length(text) - F.length(tag) - 1)).otherwise(text)
    first = F.split_part(bare, F.lit("/"), F.lit(1))
    has = F.contains(bare, F.lit("/")) & (F.contains(first, F.lit(".")) | F.contains(first, F.lit(":")) | (first == "localhost"))
    rest = F.when(has, F.substring(bare, F.length(first) + 2, F.length(bare))).otherwise(bare)
    registry = F.when(has, first).otherwise("registry-1.docker.io")
    return F.struct(registry.alias("registry"), F.when(~has & ~F.contains(rest, F.lit("/")), F.concat(F.lit("library/"), rest)).otherwise(rest).alias("repository"), tag.alias("tag"))


def parse_repository(c: Column) -> Column:
    """``owner/repo`` of a GitHub repository field (shorthand, URL, git+ or scp form), or null."""
    pattern = r"\A(?:(?:git\+)?(?:https?|ssh|git)://(?:[^@/]+@)?github\.com/|git@github\.com:|github:)?([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?)(?:\.git)?/?(?:[#?].*)?\z"
    return F.nullif(F.regexp_extract(F.trim(c), pattern, 1), F.lit(""))


def npm_spec(c: Column) -> Column:
    """struct(name, request) of ``name@request``; the at sign of a scope is part of the name."""
    at = F.when(c.startswith("@"), F.locate("@", F.substring(c, F.lit(2), F.length(c))) + 1).otherwise(F.locate("@", c))
    has = F.when(c.startswith("@"), at > 1).otherwise(at > 0)
    return F.struct(F.when(has, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("name"), F.when(has, F.substring(c, at + 1, F.length(c))).otherwise("").alias("request"))


def pep508_spec(c: Column) -> Column:
    """struct(name, request) of a requirement; extras and markers are dropped."""
    head = F.trim(F.split_part(c, F.lit(";"), F.lit(1)))
    name = F.regexp_extract(head, r"\A([^=<>!~ (\[]+)", 1)
    rest = F.regexp_replace(F.regexp_replace(F.substring(head, F.length(name) + 1, F.length(head)), r"\[[^\]]*\]", ""), r"[() ]", "")
    return F.struct(name.alias("name"), rest.alias("request"))


# Beginnings of specifications that name a git repository, and those that name a local folder.
GIT_PREFIXES = ["github:", "gitlab:", "bitbucket:", "sourcehut:", "git+https://", "git+ssh://", "git+http://", "git://"]
LOCAL_PREFIXES = ["file:", "./", "../"]


def dep_source(spec: Column) -> Column:
    """vcs, local or registry, by a dependency's specification; a reference of 40 hex digits after ``#`` is a commit."""
    spec = F.trim(spec)
    begins = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.startswith(spec, w))
    commit = spec.rlike(r"\A[^#]*#[0-9a-fA-F]{40}\z")
    return F.when(begins(GIT_PREFIXES) | commit, "vcs").when(begins(LOCAL_PREFIXES), "local").otherwise("registry")


# Import names that differ from the names of their distributions.
PYPI_IMPORTS = {
    "pyyaml": "yaml", "beautifulsoup4": "bs4", "pillow": "PIL", "python-dateutil": "dateutil", "python-dotenv": "dotenv",
    "scikit-learn": "sklearn", "scikit-image": "skimage", "opencv-python": "cv2", "opencv-python-headless": "cv2",
    "msgpack-python": "msgpack", "attrs": "attr", "pymysql": "pymysql", "protobuf": "google", "google-cloud-storage": "google",
    "typing-extensions": "typing_extensions",
}


def pypi_import_candidates(name: Column) -> Column:
    """Names under which a distribution may be imported: its own, a known one, lower-cased, with underscores."""
    low = F.lower(name)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in PYPI_IMPORTS.items() for x in kv]), low)
    return F.array_distinct(F.filter(F.array(name, known, low, F.regexp_replace(low, r"[-.]", "_")), lambda x: x != ""))


def dep_key(language: Column, module: Column) -> Column:
    """The dependency an imported module belongs to; empty for standard libraries and relative imports."""
    first = F.split_part(module, F.lit("/"), F.lit(1))
    npm = F.when(module.startswith(".") | module.startswith("/") | module.startswith("node:"), "").when(
        module.startswith("@"), F.regexp_extract(module, r"\A(@[^/]+/[^/]+)", 1)
    ).otherwise(first)
    rust = F.regexp_extract(module, r"\A\s*(?:::)?\s*([^:{},\s]*)", 1)
    java = F.regexp_replace(F.regexp_replace(module, r"\.\*\z", ""), r"\.[A-Z][^.]*\z", "")
    return (
        F.when(language == "js", npm)
        .when(language == "py", F.when(module.startswith("."), "").otherwise(F.split_part(module, F.lit("."), F.lit(1))))
        .when(language == "go", F.when(F.contains(first, F.lit(".")), module).otherwise(""))
        .when(language == "php", "")
        .when(language == "ruby", F.when(module.startswith("."), "").otherwise(first))
        .when(language == "rust", F.when(rust.isin("std", "core", "alloc", "crate", "self", "super", ""), "").otherwise(rust))
        .when(language == "java", F.when(java.rlike(r"\Ajavax?(?:\.|\z)"), "").otherwise(java))
        .when(language == "c#", F.when(F.trim(module).isin("static", "global"), "").otherwise(F.trim(module)))
        .otherwise("")
    )


def domain_match(host: Column, listed: str) -> Column:
    """A dotted entry is the host or a parent domain of it; a bare one occurs in one of its labels."""
    return (host == listed) | host.endswith("." + listed) if "." in listed else F.exists(F.split(host, r"\."), lambda x: F.contains(x, F.lit(listed)))
