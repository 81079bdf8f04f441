"""Package data derived from the generic tables, for queries that need it: the same rules stand in the SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ECO = "element_at(array('npm','pypi','crates','go','maven','rubygems'), cast({} % 6 + 1 as int))"


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned dependencies of projects (orders): one a line item."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as project", f"{_ECO.format('l_suppkey')} as ecosystem", "concat('pkg-', l_partkey) as name",
        "concat(l_partkey % 5, '.', l_linenumber, '.', l_suppkey % 10, if(l_suppkey % 7 = 0, concat('-rc.', l_linenumber), '')) as version",
        "l_linenumber = 1 as direct", "l_shipdate", "l_linenumber",
    )


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories on two thirds of the parts."""
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr(
        f"{_ECO.format('p_partkey')} as ecosystem", "concat('pkg-', p_partkey) as name", "concat('CVE-2024-', p_partkey) as id",
        "array(concat('GHSA-', p_partkey % 50)) as aliases", "element_at(array('info','low','moderate','high','critical'), cast(p_size % 5 + 1 as int)) as severity",
        "p_name as summary", "'osv' as source", "if(p_size % 7 = 0, '', concat(p_size % 6, '.', p_size % 4, '.', p_size % 3)) as fixed_in", "p_partkey",
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of each part's package found."""
    return table(spark, sf_dir, "part").selectExpr(
        f"{_ECO.format('p_partkey')} as ecosystem", "concat('pkg-', p_partkey) as name", "concat(p_size, '.0.0') as version", "p_partkey % 17 <> 0 as analyzed",
        "cast(if(p_partkey % 9 = 0, 1 + p_size % 2, 0) as int) as n_hooks", "array(if(p_partkey % 2 = 0, 'aws_secret', 'HOME'), 'PATH') as env_reads",
        "array_compact(array(if(p_size % 2 = 1, 'shell-spawn', null), if(p_size % 3 = 0, 'dynamic-eval', null), if(p_size % 5 = 0, 'net-egress', null), "
        "if(p_size % 11 = 0, 'install-hook-suspicious', null), if(p_size % 13 = 0, 'env-read', null), if(p_partkey % 4 = 0, 'install-hook-exec', null))) as capabilities",
    )


def allow_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "npm", "*", ">=10.0.0", "shell-spawn", "large ones spawn"), (2, "npm", "pkg-6", "", None, "known"), (3, "pypi", "*", "^5", "dynamic-eval", "templates"),
        (4, "go", "*", "~7 || 11.x", "net-egress", "clients"), (5, "npm", "*", "", "install-hook-exec", "native"), (6, "crates", "*", "> 1", "shell-spawn", "detached operator"),
        (7, "pypi", "pkg-7", "<=40.0.0", "shell-spawn", "seven"),
    ]
    return spark.createDataFrame(rows, "rule_ord int, ecosystem string, name string, version_range string, capability string, reason string")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release a customer's order: publisher by priority."""
    return table(spark, sf_dir, "orders").selectExpr(
        "'npm' as ecosystem", "concat('pkg-', o_custkey) as name", "concat('1.0.', o_orderkey) as version", "o_orderdate as published_at", "o_orderpriority as publisher",
        "cast(o_totalprice as bigint) % 2000 as weekly_downloads",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges with cycles."""
    return table(spark, sf_dir, "lineitem").selectExpr("concat('f', l_partkey % 300) as caller", "concat('f', (l_partkey * 7 + l_suppkey) % 600) as callee").distinct()
