"""Reachability: imports against dependencies, and call graphs."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import dep_key, pypi_import_candidates
from ..shared import drop_buckets, drop_table, write_buckets, write_table


def import_keys(imports: DataFrame) -> DataFrame:
    """(language, dep_key) of import rows (language, module or, where given, key_of), empties left out."""
    of = F.col("key_of" if "key_of" in imports.columns else "module")
    return imports.select("language", dep_key(F.col("language"), of).alias("dep_key")).where("dep_key <> ''").distinct()


# The language whose imports tell about an ecosystem.
LANGUAGE_OF = {"npm": "js", "pypi": "py", "go": "go", "rubygems": "ruby", "nuget": "c#"}


def project_reachability(deps: DataFrame, imports: DataFrame) -> DataFrame:
    """deps with ``reachability``: unknown without any import of the language, used, or unused.

    Names match exactly; Go modules also as path prefixes, PyPI by candidate import names, NuGet by dotted prefixes both
    ways. Prefixes are joined by key, over all prefixes of a module.
    """
    keys = import_keys(imports)
    eco = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    names = deps.select("ecosystem", "name").distinct().withColumn("language", F.try_element_at(eco, F.col("ecosystem")))
    candidate = F.when(F.col("ecosystem") == "pypi", pypi_import_candidates(F.col("name"))).otherwise(F.array("name"))
    mine = names.withColumn("key", F.explode(candidate)).withColumn("key", F.when(F.col("language") == "py", F.lower("key")).otherwise(F.col("key")))
    cut = lambda c: F.split(c, F.when(F.col("language") == "go", "/").otherwise(r"\."))
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.size(cut(c))), lambda i: F.array_join(F.slice(cut(c), F.lit(1), i), "\x00"))
    prefixes = lambda c: F.when(F.col("language").isin("go", "c#"), runs(c)).otherwise(F.array(c))
    seen = keys.withColumn("key", F.explode(prefixes(F.col("dep_key")))).withColumn("key", F.when(F.col("language") == "py", F.lower("key")).otherwise(F.col("key"))).select("language", "key").distinct()
    join_key = F.when(F.col("language") == "go", F.regexp_replace("key", "/", "\x00")).when(F.col("language") == "c#", F.regexp_replace("key", r"\.", "\x00")).otherwise(F.col("key"))
    used = mine.withColumn("key", join_key).join(seen, ["language", "key"], "left_semi").select("ecosystem", "name").distinct()
    languages = keys.select("language").distinct().withColumn("scanned", F.lit(True))
    state = names.join(used.withColumn("used", F.lit(True)), ["ecosystem", "name"], "left").join(F.broadcast(languages), "language", "left")
    state = state.select("ecosystem", "name", F.when(F.col("scanned").isNull(), "unknown").when(F.col("used"), "used").otherwise("unused").alias("reachability"))
    return deps.join(state, ["ecosystem", "name"], "left")


def functions_reaching(sites: DataFrame, module: str, symbol: str) -> DataFrame:
    """(file, function, line): functions that use a symbol directly, with the first line."""
    hit = sites.where((F.col("module") == module) & (F.col("symbol") == symbol))
    return hit.groupBy("file", "function").agg(F.min("line").alias("line"))


def callers_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(function, depth): functions from which a start function is reached along caller to callee edges.

    A frontier loop until no new function is found: only new functions go on, so cycles end, and chains of any length are
    followed. Each round writes its frontier alone, beside the earlier ones, in the shared folder; edges are written once.
    """
    spark = edges.sparkSession
    edges, edges_path = write_table(edges.select("caller", "callee").distinct(), "edges")
    frontier, _ = write_table(start.select("function").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    for depth in count(1):
        new = edges.join(frontier.select(F.col("function").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("function")).distinct()
        frontier, path = write_table(new.join(seen.select("function"), "function", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            drop_table(spark, path)
            break
        seen = seen.unionByName(frontier)
        if depth % 32 == 0:  # a plan of few parts, whatever the depth
            seen, _ = write_table(seen, "reached")
    drop_table(spark, edges_path)
    return seen


def _unseen(named: DataFrame, frontier: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(module, symbol, function) that call the frontier and are in no round: new pairs are shuffled, written rounds are not."""
    pair = ["module", "symbol", "function"]
    new = named.join(frontier.withColumnRenamed("function", "callee"), "callee").select("module", "symbol", F.col("caller").alias("function")).distinct()
    for old in rounds:
        new = new.join(old, pair, "left_anti")
    return new


def functions_reaching_transitive(sites: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(module, symbol, file, function, line, direct): for many symbols at once, which functions reach them.

    ``sites`` (file, function, module, symbol, line) are direct uses: their functions are direct, with the first line there.
    All that call, through any chain, a function of a reached name have line 0; calls (``edges``: file, caller, callee) meet
    functions by name over all files. A symbol without a direct use has no rows. ``wanted`` (module, symbol) restricts the
    symbols; without it all that are used are followed together.

    Rounds of one join: only (symbol, function) pairs that are new go on, so cycles end, each pair is joined once, and
    chains of any length are followed. Rounds are written in buckets in the shared folder while this runs, and removed at its end but
    for the pairs found. Null names reach nothing; repeated rows count once.
    """
    spark = sites.sparkSession
    label = ["module", "symbol"]
    pair = [*label, "function"]
    direct = sites if wanted is None else sites.join(wanted.select(*label).distinct(), label, "left_semi")
    direct, _ = write_table(direct.groupBy(*label, "file", "function").agg(F.min("line").alias("line")), "direct-uses")
    calls, calls_path = write_table(edges.select("file", "caller", "callee").distinct(), "calls")
    named = write_buckets(calls.select("caller", "callee").distinct(), "named_calls", ["callee"])
    frontier = write_buckets(direct.select(*pair).distinct(), "reaching", pair)
    rounds = [frontier]
    for depth in count(1):
        frontier = write_buckets(_unseen(named, frontier, rounds), "reaching", pair)
        if frontier.isEmpty():
            drop_buckets(frontier)
            break
        rounds.append(frontier)
        if depth % 16 == 0:  # a plan of few parts, whatever the depth; the frontier stays a part
            merged = write_buckets(reduce(DataFrame.unionByName, rounds[:-1]), "reached", pair)
            for old in rounds[:-1]:
                drop_buckets(old)
            rounds = [merged, frontier]
    seen = reduce(DataFrame.unionByName, rounds)
    callers = calls.join(seen.withColumnRenamed("function", "callee"), "callee").select(*label, "file", F.col("caller").alias("function"), F.lit(None).cast("long").alias("line"))
    every = direct.unionByName(callers).groupBy(*label, "file", "function").agg(F.min("line").alias("line"))
    out, _ = write_table(every.select(*label, "file", "function", F.coalesce("line", F.lit(0)).alias("line"), F.col("line").isNotNull().alias("direct")), "reaching-functions")
    for old in (named, *rounds):
        drop_buckets(old)
    drop_table(spark, calls_path)
    return out
