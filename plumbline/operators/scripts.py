"""Build files, install scripts, built packages, source lists, histories and workflows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.batches import small
from ..functions.names import domain_match

_FUNCTION = re.compile(r"\s*(prepare|build|package|pkgver|post_install|post_upgrade|pre_install|pre_upgrade)\s*\(")


_RUNNING = "array<struct<line:int,content:string,function:string>>"
_FIELD = re.compile(rf"(?:{'|'.join(R.METADATA_FIELDS)})\+?=")
_BLANK = " \t\n\x0b\f\r"


def _running(text: str) -> list[dict]:
    """The lines of one build file that run, with the function that was begun last."""
    out, inside, function = [], False, ""
    for number, raw in enumerate(text.removesuffix("\n").split("\n"), 1):
        line = raw.strip(_BLANK)
        if not line or line.startswith("#"):
            continue
        field = bool(_FIELD.match(line)) or (line.startswith("'") and ": " in line)
        if not inside and not field:
            begun = _FUNCTION.match(line)
            function = begun[1] if begun else function
            out.append({"line": number, "content": line, "function": function})
        if ")" in line:
            inside = False
        elif field and "(" in line:
            inside = True
    return out


def with_running_lines(files: DataFrame, text_col: str) -> DataFrame:
    """``files`` with ``running``: the lines of each build file that run: no comments, no fields that only describe.

    A field's list may go on over lines to its closing bracket. Whether a line is inside one, and which function was begun
    last, depends on the file's earlier lines alone, so the state stays within a row: nothing is shuffled, and files that
    share a key do not touch. Null and empty texts have no lines.
    """
    fields = [f for f in files.schema.fields if f.name != "running"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("content", pa.string()), ("function", pa.string())]))
        for batch in small(batches):
            found = [_running(x or "") for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "running"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return files.select(*[f.name for f in fields]).mapInArrow(run, f"{schema}, running {_RUNNING}")


def running_lines(files: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line, content, function): a row for each line that runs; see ``with_running_lines``."""
    return with_running_lines(files.select(key, text_col), text_col).select(key, F.inline("running"))


def _denied_dependencies(files: DataFrame, key: str, text_col: str) -> DataFrame:
    hit = F.filter(F.array(*map(F.lit, R.DENIED_DEPENDENCIES)), lambda d: F.contains(F.lower(text_col), d))
    return files.select(key, F.explode(hit).alias("dep")).select(key, F.lit("").alias("function"), F.lit(0).alias("line"), F.lit("ioc-dep").alias("rule"), F.lit(3).alias("severity"))


def _line_findings(rows: DataFrame, key: str, table: list) -> DataFrame:
    found = rows.withColumn("hit", F.explode(F.array_distinct(R.hits(F.col("content"), table))))
    split = (F.col("hit.rule") == "eval-obfuscation") & F.col("content").rlike(R.SPLIT_PACKAGE)
    return found.where(~split).select(key, "function", "line", "hit.rule", "hit.severity")


def build_file_findings(files: DataFrame, key: str = "package", text_col: str = "text") -> DataFrame:
    """(package, function, line, rule, severity 1 to 3) of build files; line 0 is the whole file."""
    return _line_findings(running_lines(files, key, text_col), key, R.BUILD_RULES).unionByName(_denied_dependencies(files, key, text_col))


def install_script_findings(files: DataFrame, key: str = "package", text_col: str = "text") -> DataFrame:
    """(package, function, line, rule, severity) of scripts that run as root: the rules of build files but for privileges,
    and those of install hooks, from which lines that only print are exempt."""
    rows = running_lines(files, key, text_col)
    build = _line_findings(rows, key, [r for r in R.BUILD_RULES if r[0] != "privilege-escalation-in-build"])
    prints = F.col("content").rlike(r"\A(?:echo[ \t]|printf |print )") & ~F.col("content").rlike(r"[>|`]|\$\(")
    found = rows.where(~prints).withColumn("hit", F.explode(R.hits(F.col("content"), R.INSTALL_RULES)))
    quiet = (F.col("hit.rule") == "install-hook-enables-unit") & (F.contains("content", F.lit("--global")) | F.contains("content", F.lit("--user")))
    folder = (F.col("hit.rule") == "install-hook-drops-executable") & F.array_contains(F.split("content", r"\s+"), "-d")
    hooks = found.where(~quiet & ~folder).select(key, "function", "line", "hit.rule", "hit.severity")
    return build.unionByName(hooks).unionByName(_denied_dependencies(files, key, text_col))


def denied_packages(packages: DataFrame, key: str = "package") -> DataFrame:
    """(package, rule, severity) of packages that are known malware by name."""
    return packages.where(F.trim(key).isin(*R.DENIED_PACKAGES)).select(key, F.lit("ioc-package").alias("rule"), F.lit(3).alias("severity"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"\A(?:git\+)?(?:https://|http://)?", ""), r"\A([^/:]*)", 1))


def source_findings(files: DataFrame, key: str = "package", text_col: str = "text", upstream_col: str | None = None) -> DataFrame:
    """(package, url, rule, severity) of the distinct URLs of build files that list sources, comments left out: bare
    addresses, untrusted hosts, and code hosts other than that of the package's own page (``upstream_col``, its URL)."""
    listing = with_running_lines(files, text_col).where(F.exists("running", lambda x: x["content"].rlike(R.SOURCE_LINE)))
    upstream = url_host(F.coalesce(F.col(upstream_col), F.lit(""))) if upstream_col else F.lit("")
    bare = F.array_join(F.filter(R.lines(F.col(text_col)), lambda x: ~x.rlike(r"\A\s*#")), "\n")
    urls = listing.select(key, upstream.alias("own"), F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"""(?i)\b(?:git\+)?https?://[^\s"')]+"""), F.lit(0)))).alias("url"))
    urls = urls.withColumn("host", url_host(F.col("url")))
    bad = F.lit(False)
    for h in R.UNTRUSTED_HOSTS:
        bad = bad | domain_match(F.col("host"), h)
    code = lambda c: F.exists(F.array(*map(F.lit, R.CODE_HOSTS)), lambda h: F.contains(c, h))
    drift = (F.col("own") != "") & (F.col("host") != "") & (F.col("host") != F.col("own")) & code(F.col("host")) & code(F.col("own"))
    address = F.col("url").rlike(r"https?://\d{1,3}(\.\d{1,3}){3}")
    hit = lambda cond, rule, severity: F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(hit(address, "source-bare-ip", 2), hit(~address & bad, "source-untrusted-host", 2), hit(~address & drift, "source-host-drift", 1)))
    return urls.select(key, "url", F.explode(found).alias("f")).select(key, "url", "f.rule", "f.severity")


def history_findings(commits: DataFrame, key: str = "package") -> DataFrame:
    """(package, rule, at): the newest place where a commit (newest first) is over a day older than the next."""
    w = Window.partitionBy(key).orderBy("position")
    older = commits.withColumn("next_date", F.lead("commit_date").over(w))
    return older.where(F.col("next_date") - F.col("commit_date") > 86400).groupBy(key).agg(F.min("position").alias("at")).select(key, F.lit("commit-date-nonmonotonic").alias("rule"), "at")


def entry_findings(entries: DataFrame, key: str = "package") -> DataFrame:
    """(package, path, rule, severity 1 medium to 3 critical) of a built package's entries (path, mode)."""
    path = F.regexp_replace("path", r"\A(?:\./)+/*|\A/+", "")
    rows = entries.select(key, path.alias("path"), "mode").where(~F.col("path").isin(".PKGINFO", ".BUILDINFO", ".MTREE", ".CHANGELOG"))
    p, folder = F.col("path"), F.col("path").endswith("/")
    body = p != ".INSTALL"
    home = p.startswith("home/") | p.startswith("root/")
    hit = lambda cond, rule, sev: F.when(cond, F.struct(F.lit(rule).alias("rule"), sev if isinstance(sev, Column) else F.lit(sev).alias("severity")))
    setuid = F.col("mode").bitwiseAND(0o4000) != 0
    found = F.array_compact(F.array(
        hit(~body, "install-script", 1), hit(p == "etc/ld.so.preload", "ld-preload", 3), hit(p.startswith("etc/sudoers.d/") & ~folder, "sudoers-drop-in", 3),
        hit(p.startswith("usr/share/libalpm/hooks/") & ~folder, "pacman-hook", 2), hit(p.startswith("usr/lib/security/") & p.endswith(".so"), "pam-module", 2),
        hit(p.startswith("etc/cron.") | p.startswith("var/spool/cron/"), "cron-drop-in", 2), hit(body & setuid, "setuid-binary", 2),
        hit(body & ~setuid & (F.col("mode").bitwiseAND(0o2000) != 0) & ~folder, "setgid-binary", 1),
        hit(body & ~folder & (p != "") & ~p.rlike(r"\A(?:usr|etc|opt|srv|var|boot)/"), "file-outside-prefix", F.when(home, 3).otherwise(2).alias("severity")),
    ))
    return rows.select(key, "path", F.explode(found).alias("f")).select(key, "path", "f.rule", "f.severity")


def verdicts(findings: DataFrame, key: str = "package") -> DataFrame:
    """(package, verdict): block on a critical finding, warn on a high one, else allow."""
    worst = findings.groupBy(key).agg(F.max("severity").alias("worst"))
    return worst.select(key, F.when(F.col("worst") >= 3, "block").when(F.col("worst") == 2, "warn").otherwise("allow").alias("verdict"))


_RUN = re.compile(r"^(\s*)-?\s*run:\s*(.*)$")


def workflow_parts(text: str) -> list[tuple[int, bool, str]]:
    """(line, whether a run body, text) of a workflow file: run bodies, and all lines that are in none.

    A body is the rest of its line, or of a block the lines that follow, blank or indented more than the key.
    """
    lines = text.removesuffix("\n").split("\n") if text else []
    out, at = [], 0
    while at < len(lines):
        line = lines[at].removesuffix("\r")
        out.append((at + 1, False, line))
        found, at = _RUN.match(line), at + 1
        if found:
            body, start = found[2], at
            if body.strip() in ("|", ">", ""):
                first = at
                while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > len(found[1])):
                    at += 1
                body = "".join(x.removesuffix("\r") + "\n" for x in lines[first:at])
            out.append((start, True, body))
    return out


def workflow_findings(files: DataFrame, key: str = "file", text_col: str = "text") -> DataFrame:
    """(file, line, rule, severity) of workflow files: permissions, actions not pinned to a commit, a cache that a fork can
    poison, and the first place of each rule in a run body. Only the split into bodies runs in Python."""
    kind = files.schema[key].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = workflow_parts(text or "")
                fork = "pull_request_target" in (text or "")
                keys += [i] * len(found)
                rows += [(*x, fork) for x in found]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())],
                [key, "line", "run", "content", "fork"],
            )

    rows = files.select(key, text_col).mapInArrow(parts, f"`{key}` {kind}, line int, run boolean, content string, fork boolean")
    content, ref = F.col("content"), F.regexp_extract("content", R.USES, 1)
    owner = F.split_part(F.split_part(ref, F.lit("@"), F.lit(1)), F.lit("/"), F.lit(1))
    loose = (ref != "") & ~ref.startswith(".") & ~ref.startswith("docker://") & F.contains(ref, F.lit("@")) & ~F.regexp_extract(ref, r"@(.*)$", 1).rlike(r"^[0-9a-f]{40}$")
    hit = lambda cond, rule, severity, line: F.when(cond, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), line.alias("line")))
    line = F.col("line")
    found = [
        hit(~F.col("run") & content.rlike(R.WRITE_ALL), "permissions-write-all", F.lit(2), line),
        hit(~F.col("run") & loose, "unpinned-action-ref", F.when(owner.isin("actions", "github"), 1).otherwise(2), line),
        hit(~F.col("run") & F.col("fork") & ref.startswith("actions/cache"), "cache-poisoning", F.lit(2), F.lit(1)),
    ]
    for rule, severity, pattern in R.WORKFLOW_RUN_RULES:
        before = F.substring(content, F.lit(1), F.regexp_instr(content, F.lit(pattern)) - 1)
        found.append(hit(F.col("run") & content.rlike(pattern), rule, F.lit(severity), line + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))))
    hits = rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.line", "f.rule", "f.severity")
    return hits.where("rule <> 'cache-poisoning'").unionByName(hits.where("rule = 'cache-poisoning'").distinct())


def bash_array(text: Column, name: str) -> Column:
    """Words of the first assignment ``name=( ... )`` of a bash array, comments and quotes off; null without one."""
    pattern = rf"(?:\A|\n)[^\S\n]*{name}=\(([^)]*)\)"
    body = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"#[^\n]*", "")
    words = F.regexp_extract_all(body, F.lit(r"""['"][^'"]+['"]|\S+"""), F.lit(0))
    return F.when(text.rlike(pattern), F.transform(words, lambda w: F.regexp_replace(w, r"""\A['"]([^'"]+)['"]\z""", "$1")))


def checksum_findings(files: DataFrame, key: str = "package", text_col: str = "text") -> DataFrame:
    """(package, rule, severity): build files in which a list of checksums has another length than the sources; sources with
    brace lists are left alone."""
    text = F.col(text_col)
    sources = bash_array(text, "source")
    wrong = F.lit(False)
    for name in ("sha256sums", "sha512sums", "b2sums", "sha1sums", "md5sums"):
        wrong = wrong | F.coalesce(F.size(bash_array(text, name)) != F.size(sources), F.lit(False))
    braces = F.exists(sources, lambda x: F.contains(x, F.lit("{")) & F.contains(x, F.lit(",")))
    return files.where((F.size(sources) > 0) & ~braces & wrong).select(key, F.lit("checksum-count-mismatch").alias("rule"), F.lit(2).alias("severity"))


# First bytes of executables (ELF, MZ, five Mach-O forms).
MAGIC = ("7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE")


def binary_findings(local_files: DataFrame, key: str = "package") -> DataFrame:
    """(package, path, rule, severity): executables among the files beside a build file (path, head binary, and whether the
    build file lists it as a source, and whether the last revision added it; both may hold)."""
    head = F.hex(F.substring("head", 1, 4))
    binary = head.isin(*MAGIC) | head.startswith("4D5A")
    hit = lambda c, rule, severity: F.when(F.col(c), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    listed = local_files if "listed" in local_files.columns else local_files.withColumn("listed", F.lit(True))
    found = F.array_compact(F.array(hit("listed", "binary-in-source", 3), hit("added", "local-binary-added", 2)))
    return listed.where(binary).select(key, "path", F.explode(found).alias("f")).select(key, "path", "f.rule", "f.severity")


def stale_history_findings(packages: DataFrame, key: str = "package") -> DataFrame:
    """(package, rule, severity): several roots; an oldest commit over 365 days after the package was first submitted that is
    itself under 730 days old (times in seconds)."""
    roots = packages.where("root_count > 1").select(key, F.lit("multiple-root-commits").alias("rule"), F.lit(1).alias("severity"))
    days = lambda a, b: F.expr(f"({a} - {b}) div 86400")
    wiped = packages.where((days("oldest_commit", "first_submitted") > 365) & (days("now", "oldest_commit") < 730))
    return roots.unionByName(wiped.select(key, F.lit("history-recently-wiped").alias("rule"), F.lit(2).alias("severity")))
