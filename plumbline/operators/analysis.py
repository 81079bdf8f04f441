"""Source analysis: files to fingerprints, imports, symbol uses and call graphs."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions.batches import small
from ..functions.lexer import masked, outer
from ..functions.second_pass import second_pass
from ..functions.uses import uses
from .heuristics import dependency_sources, is_binary_dropper, retracted, secrets, source_findings, suspicious_hook, typosquats, unlisted_large

PACKAGE = ["ecosystem", "name", "version"]


def lexed(files: DataFrame, text_col: str = "body", every: bool = False) -> DataFrame:
    """``files`` with ``language``, and of sources the masked texts ``code``, ``bare`` and (PHP) ``top``; see ``functions.code``.

    Other files are left out, or with ``every`` kept with nulls. One pass over the texts, nothing is shuffled. Null texts are
    empty sources.
    """
    names = [c for c in files.columns if c not in ("language", "code", "bare", "top")]
    lang = files.select(*names).withColumn("language", C.scanned_language(F.col("path")))
    lang = lang if every else lang.where("language is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            at = batch.schema.get_field_index(text_col)
            texts, languages = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            found = [masked(t or "", x) if x else (None, None) for t, x in zip(texts, languages, strict=True)]
            tops = [outer(bare) if x == "php" else None for (_, bare), x in zip(found, languages, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in ([f[0] for f in found], [f[1] for f in found], tops))], [*batch.schema.names, "code", "bare", "top"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lang.schema.fields)
    return lang.mapInArrow(run, f"{schema}, code string, bare string, top string")


def file_capabilities(files: DataFrame, text_col: str = "body") -> DataFrame:
    """files with ``language``, ``capabilities`` and ``env_reads`` of their code, JavaScript by two passes; other files are left out."""
    rows, code, bare, lang = lexed(files, text_col), F.col("code"), F.col("bare"), F.col("language")
    found = {"capabilities": F.array_union(C.capabilities(code, bare, lang), second_pass(code, lang)), "env_reads": C.env_reads(code, bare, lang)}
    return rows.withColumns(found).drop("code", "bare", "top")


def file_imports(files: DataFrame, text_col: str = "body", every: bool = False) -> DataFrame:
    """(file columns, language, module as written, key_of): one row an imported module; ``names.dep_key`` of key_of is its dependency.

    ``every`` (see ``lexed``) gives the same rows; no filter then goes down to ``files``, so a shuffle of them may be used again.
    """
    rows = lexed(files, text_col, every)
    kept = [c for c in rows.columns if c not in (text_col, "code", "bare", "top", "module", "key_of")]
    return rows.select(*kept, F.explode(C.imports(F.col("code"), F.col("bare"), F.col("top"), F.col("language"))).alias("i")).select(*kept, "i.module", F.col("i.key").alias("key_of"))


def heuristic_capabilities(files: DataFrame, listed: DataFrame, manifest: DataFrame, retractions: DataFrame, top: DataFrame) -> DataFrame:
    """(package columns, capability) of the detectors that look beyond one file: large files that ``listed`` (ecosystem, name,
    path) leaves out, secrets, dependencies from repositories (``manifest``: package columns, spec, dep_group), retracted
    versions, and names near those of ``top``."""
    packages = files.select(*PACKAGE).distinct()
    named = lambda f, c: f.select(*PACKAGE, F.lit(c).alias("capability")).distinct()
    large = unlisted_large(files.select(*PACKAGE, "path", F.octet_length("body").alias("length")), listed)
    sources = dependency_sources(manifest)
    near = packages.join(typosquats(packages, top).select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_semi")
    found = [
        (large, "unlisted-large-file"), (secrets(files, "body"), "hardcoded-secret"), (sources.where("vcs_dependency"), "vcs-dependency"), (sources.where("git_dep_in_optional"), "git-dep-in-optional"),
        (retracted(packages.where("ecosystem = 'go'"), retractions), "version-unpublished"), (near, "typosquat-risk"),
    ]
    out = named(*found[0])
    for frame, capability in found[1:]:
        out = out.unionByName(named(frame, capability))
    return out


def fingerprints(files: DataFrame, hooks: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Package fingerprints from files (package columns, path, body) and hooks (package columns, phase, body), and, if given,
    further capabilities (package columns, capability) such as those of ``heuristic_capabilities``.

    Capabilities are those of the code, of the heuristics over files, and of suspicious hooks, among them build commands of
    Lua plugins; a declared hook adds install-hook-exec. ``hooks`` maps a hook's phase to the SHA-256 of its body, which is
    what a difference of snapshots compares. Each file is read once: one projection to sets and sizes, and one aggregate by package, which keeps
    distinct sets (few, of capabilities) and combines before the shuffle. Environment names are as many as the code reads.
    """
    every = lexed(source_findings(files).withColumnRenamed("capabilities", "source_caps"), every=True)
    none, no_hook = F.array().cast("array<string>"), F.lit(None).cast("struct<phase:string,hash:string>")
    coded = F.col("language").isNotNull()
    masks = F.col("code"), F.col("bare"), F.col("language")
    lua = F.when(F.exists(C.build_scripts(F.col("code"), F.col("language")), suspicious_hook), F.array(F.lit("install-hook-suspicious"))).otherwise(none)
    code = F.when(coded, F.concat(C.capabilities(*masks), second_pass(F.col("code"), F.col("language")), lua))
    every = every.select(
        *PACKAGE, F.array_union(F.coalesce(code, none), F.coalesce("source_caps", none)).alias("caps"), F.when(is_binary_dropper(F.col("path"), F.col("ecosystem")), F.array(F.lit("binary-dropper"))).otherwise(none).alias("drops"),
        F.coalesce(F.when(coded, C.env_reads(*masks)), none).alias("reads"), F.when(coded, F.octet_length("body")).otherwise(0).alias("bytes"), F.lit(0).alias("hook"), F.lit(True).alias("file"), no_hook.alias("told"),
    )
    hook = hooks.select(
        *PACKAGE, F.array_compact(F.array(F.lit("install-hook-exec"), F.when(suspicious_hook(F.col("body")), "install-hook-suspicious"))).alias("caps"), none.alias("drops"), none.alias("reads"), F.lit(0).alias("bytes"), F.lit(1).alias("hook"), F.lit(False).alias("file"),
        F.struct(F.coalesce("phase", F.lit("")).alias("phase"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("hash")).alias("told"),
    )
    if more is not None:
        beyond = more.select(*PACKAGE, F.array("capability").alias("caps"), none.alias("drops"), none.alias("reads"), F.lit(0).alias("bytes"), F.lit(0).alias("hook"), F.lit(False).alias("file"), no_hook.alias("told"))
        hook = hook.unionByName(beyond)
    gathered = every.unionByName(hook).withColumn("caps", F.array_union("caps", "drops")).groupBy(*PACKAGE).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("caps")))).alias("capabilities"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reads")))).alias("env_reads"),
        F.sum("bytes").alias("source_size_bytes"), F.sum("hook").cast("int").alias("n_hooks"), F.max("file").alias("has_files"),
        F.sort_array(F.collect_set("told")).alias("told"),
    )
    first = F.filter("told", lambda x, i: (i == 0) | (F.get(F.col("told"), i - 1)["phase"] != x["phase"]))  # a phase once
    gathered = gathered.withColumn("hooks", F.map_from_entries(first)).drop("told")
    return gathered.where("has_files").drop("has_files").withColumn("analyzed", F.lit(True))


def _python(text: str):
    """(kind, function, module, symbol, line) of one Python source: imports, symbol uses, and calls by name."""
    tree = ast.parse(text)
    modules, members = {}, {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                modules[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                yield "import", "", a.name, "", node.lineno
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            yield "import", "", module, "", node.lineno
            for a in node.names:
                members[a.asname or a.name] = (module, a.name)

    def top(module):
        return module if module.startswith(".") else module.split(".")[0]

    def dotted(node):
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return (node.id, parts[::-1]) if isinstance(node, ast.Name) else (None, [])

    def visit(node, scope):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield from visit(child, child.name)
                continue
            if isinstance(child, ast.Attribute):
                root, parts = dotted(child)
                if root in modules:
                    yield "symbol", scope, top(modules[root]), parts[-1], child.lineno
                elif root in members:
                    yield "symbol", scope, top(members[root][0]), members[root][1], child.lineno
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load) and child.id in members:
                yield "symbol", scope, top(members[child.id][0]), members[child.id][1], child.lineno
            if isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    yield "call", scope, "", name, child.lineno
            yield from visit(child, scope)

    yield from visit(tree, "<module>")


def python_facts(files: DataFrame, text_col: str = "body") -> DataFrame:
    """(path, kind import|symbol|call, function, module, symbol, line) of Python files, by their syntax trees; files that do not parse give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += sorted({(path, *r) for r in _python(text or "")})
                except (SyntaxError, ValueError, RecursionError):
                    continue
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "kind", "function", "module", "symbol", "line"])

    mine = files.where(C.scanned_language(F.col("path")) == "py").select("path", text_col)
    return mine.mapInArrow(run, "path string, kind string, function string, module string, symbol string, line long")


def symbol_sites(facts: DataFrame) -> DataFrame:
    """(file, function, module, symbol, line) for ``reach.functions_reaching``."""
    return facts.where("kind = 'symbol'").select(F.col("path").alias("file"), "function", "module", "symbol", "line")


def call_edges(facts: DataFrame) -> DataFrame:
    """(file, caller, callee), distinct, for ``reach.callers_closure``."""
    return facts.where("kind = 'call'").select(F.col("path").alias("file"), F.col("function").alias("caller"), F.col("symbol").alias("callee")).distinct()


def code_facts(files: DataFrame, text_col: str = "body") -> DataFrame:
    """(path, language, kind symbol|call, function, module, symbol, line) of JavaScript, Go, PHP and Rust (symbols only) sources.

    Modules are in the form of their dependency where they have one, and as written where not; see ``functions.uses``. Masks are
    made and read in one pass, so they never leave their worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code, bare = masked(text or "", language)
                rows += [(path, language, *r) for r in uses(language, code, bare, outer(bare) if language == "php" else None)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string()] * 6 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "language", "kind", "function", "module", "symbol", "line"])

    mine = files.select("path", C.scanned_language(F.col("path")).alias("language"), text_col).where(F.col("language").isin("js", "go", "php", "rust"))
    return mine.mapInArrow(run, "path string, language string, kind string, function string, module string, symbol string, line long")


def source_facts(files: DataFrame, text_col: str = "body") -> DataFrame:
    """(path, kind, function, module, symbol, line) of Python, JavaScript, Go, PHP and Rust sources together."""
    columns = ("path", "kind", "function", "module", "symbol", "line")
    return python_facts(files, text_col).select(*columns).unionByName(code_facts(files, text_col).select(*columns))
