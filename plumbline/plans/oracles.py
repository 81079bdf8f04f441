"""DuckDB SQL for the queries, with the derivations written out."""

ECO = "['npm','pypi','crates','go','maven','rubygems'][CAST({} % 6 + 1 AS INT)]"
DEPS = f"""deps AS (SELECT l_orderkey AS project, {ECO.format('l_suppkey')} AS ecosystem, 'pkg-' || l_partkey AS name,
 (l_partkey % 5) || '.' || l_linenumber || '.' || (l_suppkey % 10) || CASE WHEN l_suppkey % 7 = 0 THEN '-rc.' || l_linenumber ELSE '' END AS version,
 l_linenumber = 1 AS direct, l_shipdate, l_linenumber, l_partkey FROM lineitem)"""
ADVS = f"""advs AS (SELECT {ECO.format('p_partkey')} AS ecosystem, 'pkg-' || p_partkey AS name, 'CVE-2024-' || p_partkey AS id, p_size % 5 AS sev,
 ['info','low','moderate','high','critical'][CAST(p_size % 5 + 1 AS INT)] AS severity, p_name AS summary, p_partkey, p_size,
 CASE WHEN p_size % 7 = 0 THEN '' ELSE (p_size % 6) || '.' || (p_size % 4) || '.' || (p_size % 3) END AS fixed_in FROM part WHERE p_partkey % 3 <> 0)"""
FLAGS = f"""fps AS (SELECT {ECO.format('p_partkey')} AS ecosystem, 'pkg-' || p_partkey AS name, p_size || '.0.0' AS version, p_partkey, p_size,
 CASE WHEN p_partkey % 9 = 0 THEN 1 + p_size % 2 ELSE 0 END AS n_hooks FROM part),
flags AS (
 SELECT ecosystem, name, version, p_size, 'shell-spawn' AS code, 10 AS weight FROM fps WHERE p_size % 2 = 1
 UNION ALL SELECT ecosystem, name, version, p_size, 'dynamic-eval', 15 FROM fps WHERE p_size % 3 = 0
 UNION ALL SELECT ecosystem, name, version, p_size, 'net-egress', 8 FROM fps WHERE p_size % 5 = 0
 UNION ALL SELECT ecosystem, name, version, p_size, 'install-hook-suspicious', 70 FROM fps WHERE p_size % 11 = 0
 UNION ALL SELECT ecosystem, name, version, p_size, 'env-cred-read', 15 FROM fps WHERE p_size % 13 = 0 AND p_partkey % 2 = 0
 UNION ALL SELECT ecosystem, name, version, p_size, 'install-hook-exec', 20 FROM fps WHERE p_partkey % 4 = 0 AND n_hooks = 0
 UNION ALL SELECT ecosystem, name, version, p_size, 'install-hook', 30 FROM fps, range(1, 3) t(k) WHERE k <= n_hooks)"""
VERDICT = "CASE WHEN {0} >= 100 THEN 3 WHEN {0} >= 61 THEN 2 WHEN {0} >= 21 THEN 1 ELSE 0 END"
ADV_VERDICT = "CASE WHEN {0} >= 3 THEN 3 WHEN {0} = 2 THEN 2 WHEN {0} = 1 THEN 1 ELSE 0 END"


def vkey(v: str) -> str:
    """A list that orders the derived versions."""
    core = f"split_part({v}, '-', 1)"
    part = lambda i: f"CAST(split_part({core}, '.', {i}) AS BIGINT)"
    return f"[{part(1)}, {part(2)}, {part(3)}, CASE WHEN contains({v}, '-') THEN 0 ELSE 1 END, CASE WHEN contains({v}, '-') THEN CAST(split_part({v}, 'rc.', 2) AS BIGINT) ELSE 0 END]"


def vnum(v: str) -> str:
    """A number that orders release versions with parts under 1000."""
    core = f"split_part({v}, '-', 1)"
    return f"(CAST(split_part({core}, '.', 1) AS BIGINT) * 1000000 + CAST(split_part({core}, '.', 2) AS BIGINT) * 1000 + CAST(split_part({core}, '.', 3) AS BIGINT))"


REACH = "CASE WHEN ecosystem IN ('crates', 'maven') THEN 'unknown' WHEN l_partkey % 2 = 0 THEN 'used' ELSE 'unused' END"
VERDICTS = f"""{DEPS}, {ADVS}, {FLAGS},
d AS (SELECT DISTINCT project, ecosystem, name, version, direct, l_partkey, {REACH} AS reachability FROM deps),
s AS (SELECT ecosystem, name, CAST(sum(weight) AS BIGINT) AS score FROM flags GROUP BY 1, 2),
a AS (SELECT ecosystem, name, max(sev) AS sev FROM advs GROUP BY 1, 2),
v AS (SELECT project, d.ecosystem, d.name, version, direct, reachability, coalesce(score, 0) AS score, coalesce(sev, 0) AS sev,
  {VERDICT.format('coalesce(score, 0)')} AS cap_v, {ADV_VERDICT.format('coalesce(sev, 0)')} AS adv_v
  FROM d LEFT JOIN s ON d.ecosystem = s.ecosystem AND d.name = s.name LEFT JOIN a ON d.ecosystem = a.ecosystem AND d.name = a.name),
verdicts AS (SELECT *, greatest(cap_v, CASE WHEN reachability = 'unused' THEN greatest(adv_v - 1, 0) ELSE adv_v END) AS verdict FROM v)"""
NAMES = "['safe','review','prompt','block'][CAST(verdict + 1 AS INT)]"

ORACLES = {
    "dependency_verdicts": f"WITH {VERDICTS} SELECT project, ecosystem, name, version, direct, CAST(score AS BIGINT) AS score, CAST(sev AS BIGINT) AS severity, reachability, {NAMES} AS verdict FROM verdicts",
    "ci_gate": f"""WITH {VERDICTS} SELECT project, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE verdict = 0) AS BIGINT) AS safe, CAST(count(*) FILTER (WHERE verdict = 1) AS BIGINT) AS review,
 CAST(count(*) FILTER (WHERE verdict = 2) AS BIGINT) AS prompt, CAST(count(*) FILTER (WHERE verdict = 3) AS BIGINT) AS blocked, max(verdict) < 3 AS passed FROM verdicts GROUP BY project""",
    "ci_findings": f"WITH {VERDICTS} SELECT project, ecosystem, name, version, {NAMES} AS verdict FROM verdicts WHERE verdict >= 3",
    "verdict_cube": f"WITH {VERDICTS} SELECT ecosystem, name AS verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT ecosystem, {NAMES} AS name FROM verdicts) GROUP BY CUBE (ecosystem, name)",
    "max_severity": f"""WITH {DEPS}, {ADVS}, d AS (SELECT DISTINCT ecosystem, name, version FROM deps) SELECT d.ecosystem, d.name, d.version, CAST(coalesce(max(sev), 0) AS BIGINT) AS severity, CAST(count(id) AS BIGINT) AS n_advisories
 FROM d LEFT JOIN advs a ON d.ecosystem = a.ecosystem AND d.name = a.name GROUP BY 1, 2, 3""",
    "advisory_merge": f"""WITH {ADVS}, ghsa AS (SELECT ecosystem, name, CASE WHEN p_partkey % 2 = 0 THEN id ELSE 'GHSA-' || p_partkey END AS id, 'ghsa' AS source FROM advs WHERE p_partkey % 5 < 3)
 SELECT ecosystem, name, id, 'osv' AS source FROM advs UNION ALL SELECT ecosystem, name, id, source FROM ghsa WHERE id NOT LIKE 'CVE-%'""",
    "advisory_merge_alias": f"""WITH {ADVS}, r AS (SELECT ecosystem, 'group-' || (p_partkey % 100) AS name, p_partkey AS position, id, 'GHSA-' || (p_partkey % 50) AS alias FROM advs)
 SELECT ecosystem, name, id FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.ecosystem = r.ecosystem AND q.name = r.name AND q.alias = r.alias AND q.position < r.position)""",
    "epss_enrich": f"""WITH {ADVS}, flat AS (SELECT ecosystem, name, id, p_partkey AS position, 'CVE-2024-' || (p_partkey % 40) AS cve FROM advs),
 e AS (SELECT DISTINCT 'CVE-2024-' || (p_partkey % 40) AS cve, CAST((p_partkey % 40) / 100.0 AS DOUBLE) AS epss FROM part WHERE (p_partkey % 40) % 7 <> 0)
 SELECT ecosystem, name, id, CASE WHEN row_number() OVER (PARTITION BY flat.cve ORDER BY position) = 1 THEN coalesce(epss, 0.0) ELSE 0.0 END AS epss FROM flat LEFT JOIN e ON flat.cve = e.cve""",
    "kev_enrich": f"WITH {ADVS} SELECT ecosystem, name, id, (p_partkey % 11 = 0 OR (p_partkey % 50) = 8) AS in_kev FROM advs",
    "cvss_score": """WITH v AS (SELECT p_partkey, ['N','A','L','P'][CAST(p_size % 4 + 1 AS INT)] AS av, ['L','H'][CAST(p_size % 2 + 1 AS INT)] AS ac, ['N','L','H'][CAST(p_partkey % 3 + 1 AS INT)] AS pr, ['N','R'][CAST(p_partkey % 2 + 1 AS INT)] AS ui,
 ['U','C'][CAST((p_partkey // 3) % 2 + 1 AS INT)] AS s, ['H','L','N'][CAST(p_size % 3 + 1 AS INT)] AS c, ['H','L','N'][CAST((p_size // 2) % 3 + 1 AS INT)] AS i, ['H','L','N'][CAST((p_partkey // 5) % 3 + 1 AS INT)] AS a, p_partkey % 10 = 0 AS old FROM part),
 w AS (SELECT *, CASE av WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62::DOUBLE WHEN 'L' THEN 0.55::DOUBLE ELSE 0.2::DOUBLE END AS wav, CASE ac WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44::DOUBLE END AS wac, CASE ui WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62::DOUBLE END AS wui,
 CASE WHEN pr = 'N' THEN 0.85::DOUBLE WHEN pr = 'L' THEN (CASE WHEN s = 'C' THEN 0.68::DOUBLE ELSE 0.62::DOUBLE END) ELSE (CASE WHEN s = 'C' THEN 0.5::DOUBLE ELSE 0.27::DOUBLE END) END AS wpr,
 CASE c WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END AS wc, CASE i WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END AS wi, CASE a WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END AS wa FROM v),
 x AS (SELECT *, 1.0::DOUBLE - (1.0::DOUBLE - wc) * (1.0::DOUBLE - wi) * (1.0::DOUBLE - wa) AS base FROM w),
 y AS (SELECT *, CASE WHEN s = 'C' THEN 7.52::DOUBLE * (base - 0.029::DOUBLE) - 3.25::DOUBLE * pow(base - 0.02::DOUBLE, 15.0::DOUBLE) ELSE 6.42::DOUBLE * base END AS impact, 8.22::DOUBLE * wav * wac * wpr * wui AS exploit FROM x)
 SELECT p_partkey, CASE WHEN old THEN NULL WHEN impact <= 0 THEN 0.0::DOUBLE ELSE ceil((CASE WHEN s = 'C' THEN least(1.08::DOUBLE * (impact + exploit), 10.0::DOUBLE) ELSE least(impact + exploit, 10.0::DOUBLE) END) * 10.0::DOUBLE) / 10.0::DOUBLE END AS base_score FROM y""",
    "version_order": f"WITH {DEPS} SELECT ecosystem, name, max_by(version, {vkey('version')}) AS newest, min_by(version, {vkey('version')}) AS oldest, CAST(count(DISTINCT version) AS BIGINT) AS n_versions FROM deps GROUP BY 1, 2",
    "version_satisfies": f"""WITH {DEPS}, d AS (SELECT DISTINCT version FROM deps), k AS (SELECT version, {vkey('version')} AS k FROM d)
 SELECT version, r AS range, CASE r WHEN '^1.2.0' THEN k >= [1,2,0,1,0] AND k < [2,0,0,1,0] WHEN '~2.3' THEN k >= [2,3,0,1,0] AND k < [2,4,0,1,0] WHEN '>=1.0.0 <3.0.0 || 4.x' THEN (k >= [1,0,0,1,0] AND k < [3,0,0,1,0]) OR (k >= [4,0,0,1,0] AND k < [5,0,0,1,0])
 WHEN '!=3.1.4' THEN k <> [3,1,4,1,0] WHEN '> 1.0' THEN false WHEN '*' THEN true WHEN '2.1.3' THEN k = [2,1,3,1,0] WHEN '^0.3' THEN k >= [0,3,0,1,0] AND k < [0,4,0,1,0] END AS satisfies
 FROM k, (SELECT unnest(['^1.2.0','~2.3','>=1.0.0 <3.0.0 || 4.x','!=3.1.4','> 1.0','*','2.1.3','^0.3']) AS r)""",
    "max_satisfying": f"""WITH {DEPS}, d AS (SELECT DISTINCT ecosystem, name, version FROM deps), k AS (SELECT *, {vnum('version')} AS k FROM d WHERE NOT contains(version, '-'))
 SELECT ecosystem, name, max_by(version, k) AS best FROM k WHERE k >= 1002000 AND k < 4000000 GROUP BY 1, 2""",
    "fix_plan": f"""WITH {DEPS}, {ADVS}, d AS (SELECT DISTINCT ecosystem, name, version FROM deps), j AS (SELECT d.*, fixed_in, CASE WHEN fixed_in = '' THEN false ELSE {vkey('fixed_in')} > {vkey('version')} END AS fwd FROM d JOIN advs USING (ecosystem, name))
 SELECT ecosystem, name, version, max_by(CASE WHEN fwd THEN fixed_in END, CASE WHEN fwd THEN {vkey("CASE WHEN fixed_in = '' THEN '0.0.0' ELSE fixed_in END")} END) AS target_version, CAST(count(*) FILTER (WHERE fwd) AS BIGINT) AS n_resolved, CAST(count(*) FILTER (WHERE NOT fwd) AS BIGINT) AS n_unresolved FROM j GROUP BY 1, 2, 3""",
    "risk_scores": f"WITH {FLAGS} SELECT ecosystem, name, version, CAST(sum(weight) AS BIGINT) AS score FROM flags GROUP BY 1, 2, 3",
    "risk_flags": f"WITH {FLAGS} SELECT ecosystem, name, version, code, CAST(weight AS BIGINT) AS weight FROM flags",
    "allowlisted_scores": f"""WITH {FLAGS}, f AS (SELECT *, CASE WHEN ecosystem = 'npm' AND name = 'pkg-6' AND code NOT IN ('env-cred-read', 'install-hook') THEN true WHEN ecosystem = 'npm' AND code = 'shell-spawn' AND p_size >= 10 THEN true
 WHEN ecosystem = 'pypi' AND code = 'dynamic-eval' AND p_size = 5 THEN true WHEN ecosystem = 'go' AND code = 'net-egress' AND p_size IN (7, 11) THEN true WHEN ecosystem = 'npm' AND code = 'install-hook-exec' THEN true
 WHEN ecosystem = 'pypi' AND name = 'pkg-7' AND code = 'shell-spawn' AND p_size <= 40 THEN true ELSE false END AS off FROM flags)
 SELECT ecosystem, name, version, CAST(sum(CASE WHEN off THEN 0 ELSE weight END) AS BIGINT) AS score, CAST(count(*) FILTER (WHERE off) AS BIGINT) AS n_suppressed FROM f GROUP BY 1, 2, 3""",
    "drift_scores": f"""WITH p AS (SELECT p_partkey, p_size FROM part), x AS (SELECT p_partkey, (CASE WHEN p_size % 3 = 0 AND p_size % 2 <> 0 THEN 0 ELSE 0 END) + (CASE WHEN p_size % 2 = 1 AND p_size % 3 <> 0 THEN 15 ELSE 0 END) + (CASE WHEN p_size % 5 = 0 THEN 15 ELSE 0 END)
 + (CASE WHEN p_partkey % 4 = 0 THEN 30 WHEN p_partkey % 4 = 1 THEN 30 ELSE 0 END) + (CASE WHEN p_size % 7 <> 0 AND (p_partkey % 100 >= 2 * (p_size % 7) * 10 OR (p_partkey % 100) * 2 <= (p_size % 7) * 10) AND p_partkey % 100 <> 0 THEN 5 ELSE 0 END) AS score FROM p WHERE p_partkey % 13 <> 0)
 SELECT p_partkey, CAST(score AS BIGINT) AS score FROM x WHERE score > 0""",
    "gate_policy": f"""WITH {VERDICTS} SELECT ecosystem, action, CAST(count(*) AS BIGINT) AS n FROM (SELECT ecosystem, CASE WHEN direct AND verdict >= 2 THEN 'block' WHEN direct THEN 'proceed' WHEN contains(version, '-') THEN 'warn-unchecked' ELSE 'block-unchecked' END AS action FROM verdicts) GROUP BY 1, 2""",
    "snapshot_diff": f"""WITH {DEPS}, h AS (SELECT ecosystem, name, version, l_shipdate < TIMESTAMP '1995-06-17' AS old, project * 10 + l_linenumber AS o FROM deps),
 a AS (SELECT ecosystem, name, max_by(version, o) AS v FROM h WHERE old GROUP BY 1, 2), b AS (SELECT ecosystem, name, max_by(version, o) AS v FROM h WHERE NOT old GROUP BY 1, 2)
 SELECT coalesce(a.ecosystem, b.ecosystem) AS ecosystem, coalesce(a.name, b.name) AS name, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'upgraded' END AS kind, a.v AS old_version, b.v AS new_version
 FROM a FULL JOIN b ON a.ecosystem = b.ecosystem AND a.name = b.name WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v""",
    "snapshot_rescan": f"WITH {ADVS} SELECT ecosystem, name, id FROM advs WHERE p_partkey % 4 <> 1",
    "snapshot_show": f"WITH {DEPS}, d AS (SELECT *, max(CASE WHEN direct AND l_partkey % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY project) AS anyd FROM deps) SELECT project, CAST(count(*) AS BIGINT) AS shown FROM d WHERE (direct AND l_partkey % 2 = 0) OR anyd = 0 GROUP BY project",
    "typosquats": """WITH n AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) || (p_partkey % 7) AS name FROM part UNION SELECT unnest(['lodahs','reqests','expres','lodash','axois','raect'])),
 t AS (SELECT unnest(['lodash','express','axios','requests','react']) AS t UNION SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part WHERE p_partkey % 3 = 0)
 SELECT 'npm' AS ecosystem, name, t AS near FROM n, t WHERE levenshtein(name, t) <= 2 AND name NOT IN (SELECT t FROM t)""",
    "maintainer_signals": """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate AS pubat, o_orderpriority AS pub, CAST(floor(o_totalprice) AS BIGINT) % 2000 AS dl, lag(o_orderdate) OVER w AS pat, lag(o_orderpriority) OVER w AS ppub FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, '1.0.' || o_orderkey)),
 s AS (SELECT *, (CASE WHEN (epoch(TIMESTAMP '1998-08-02') - epoch(pubat)) BETWEEN 0 AND 604800 THEN 1 ELSE 0 END) + (CASE WHEN pat IS NOT NULL AND epoch(pubat) - epoch(pat) >= 180 * 86400 THEN 1 ELSE 0 END) + (CASE WHEN dl > 0 AND dl < 1000 THEN 1 ELSE 0 END) AS pts FROM r)
 SELECT 'pkg-' || o_custkey AS name, '1.0.' || o_orderkey AS version, CAST(pts AS BIGINT) AS hijack_points, pts >= 2 AS hijack_risk, (ppub IS NOT NULL AND ppub <> pub) AS maintainer_changed FROM s""",
    "binary_droppers": "SELECT p_partkey FROM part WHERE p_size % 8 IN (1, 2, 4) OR (p_size % 8 = 3 AND p_partkey % 2 = 1)",
    "source_patterns": """SELECT doc_id, cap AS capability FROM documents, (SELECT unnest(['obfuscated-payload','suspicious-url','install-hook-suspicious','known-malware-ioc']) AS cap)
 WHERE (cap = 'obfuscated-payload' AND doc_id % 10 = 1) OR (cap = 'suspicious-url' AND doc_id % 10 = 2) OR (cap = 'install-hook-suspicious' AND doc_id % 10 = 3) OR (cap = 'known-malware-ioc' AND doc_id % 10 = 4)""",
    "secrets": r"""SELECT doc_id, kind FROM (SELECT doc_id, text || CASE WHEN doc_id % 20 = 3 THEN ' AKIA' || 'ABCDEFGHIJKLMNOP' || ' ' WHEN doc_id % 20 = 5 THEN ' -----BEGIN RSA PRIVATE KEY-----' ELSE '' END AS t FROM documents) d,
 (SELECT unnest(['aws-access-key','private-key','assigned-token']) AS kind) k WHERE (kind = 'aws-access-key' AND regexp_matches(t, '\bAKIA[0-9A-Z]{16}\b')) OR (kind = 'private-key' AND regexp_matches(t, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'))
 OR (kind = 'assigned-token' AND regexp_matches(t, '(?i)\b(?:token|secret|api_key)\s*=\s*["''][0-9a-f]{40}["'']'))""",
    "license_lines": r"""SELECT source, license, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, CASE WHEN contains(text, 'MIT License') THEN 'mit' WHEN contains(text, 'Apache License') THEN 'apache-2.0' WHEN contains(text, 'GNU General Public License') THEN 'gpl-3.0' END AS license FROM documents) WHERE license IN ('mit', 'gpl-3.0') GROUP BY 1, 2""",
    "page_hosts": r"SELECT host, CAST(count(*) AS BIGINT) AS pages, CAST(sum(CASE WHEN html LIKE '%<script>%' THEN 1 ELSE 0 END) AS BIGINT) AS with_script FROM (SELECT lower(regexp_extract(url, '://([^/:]+)', 1)) AS host, html FROM pages) GROUP BY host",
    "glob_match": "SELECT p_partkey, p_size % 3 = 0 AS in_star, p_size % 3 IN (0, 1) AS in_deep FROM part",
    "layer_overlay": """WITH e AS (SELECT DISTINCT l_partkey AS image, CAST(l_suppkey % 4 AS INT) AS layer, 'd' || (l_linenumber % 3) || '/f' || (l_orderkey % 5) AS path, 'd' || (l_linenumber % 3) AS dir, CASE WHEN l_quantity < 5 THEN 'whiteout' WHEN l_quantity > 47 THEN 'opaque' ELSE 'file' END AS kind FROM lineitem),
 f AS (SELECT image, path, dir, max(layer) AS layer FROM e WHERE kind = 'file' GROUP BY 1, 2, 3), w AS (SELECT image, path, max(layer) AS l FROM e WHERE kind = 'whiteout' GROUP BY 1, 2), o AS (SELECT image, dir, max(layer) AS l FROM e WHERE kind = 'opaque' GROUP BY 1, 2)
 SELECT f.image, f.path, f.layer FROM f LEFT JOIN w ON f.image = w.image AND f.path = w.path LEFT JOIN o ON f.image = o.image AND f.dir = o.dir WHERE (w.l IS NULL OR w.l <= f.layer) AND (o.l IS NULL OR o.l <= f.layer)""",
    "dep_keys": "SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '@s/pkg' WHEN 1 THEN '' WHEN 2 THEN 'os' WHEN 3 THEN 'github.com/a/b' WHEN 4 THEN 'serde' WHEN 5 THEN '' ELSE 'rack' END AS dep_key FROM part",
    "project_reachability": f"""WITH {DEPS}, d AS (SELECT DISTINCT ecosystem, name, l_partkey FROM deps) SELECT ecosystem, name, CASE WHEN ecosystem IN ('crates', 'maven', 'rubygems') THEN 'unknown' WHEN ecosystem = 'npm' AND l_partkey % 2 = 0 THEN 'used'
 WHEN ecosystem = 'pypi' AND l_partkey % 3 = 0 THEN 'used' WHEN ecosystem = 'go' THEN 'unused' ELSE 'unused' END AS reachability FROM d""",
    "functions_reaching": "SELECT 'file' || (l_partkey % 50) AS file, 'f' || (l_suppkey % 20) AS function, CAST(min(l_orderkey) AS BIGINT) AS line FROM lineitem WHERE l_linenumber = 3 AND l_partkey % 4 = 1 GROUP BY 1, 2",
    "callers_closure": """WITH RECURSIVE e AS (SELECT DISTINCT 'f' || (l_partkey % 300) AS caller, 'f' || ((l_partkey * 7 + l_suppkey) % 600) AS callee FROM lineitem), r(function) AS (SELECT 'f599' UNION SELECT caller FROM e JOIN r ON e.callee = r.function) SELECT function FROM r""",
    "package_urls": f"""WITH {DEPS} SELECT DISTINCT ecosystem, name, version, 'pkg:' || CASE ecosystem WHEN 'crates' THEN 'cargo' WHEN 'go' THEN 'golang' WHEN 'rubygems' THEN 'gem' ELSE ecosystem END || '/' || name || '@' || version AS purl, CASE WHEN direct THEN 'required' ELSE 'optional' END AS scope FROM deps""",
    "sarif_results": f"""WITH {DEPS}, {ADVS} SELECT DISTINCT 'vulnerable-dependency' AS "ruleId", CASE WHEN sev >= 3 THEN 'error' WHEN sev = 2 THEN 'warning' ELSE 'note' END AS level, id || ': ' || summary || ' (' || ['info','low','medium','high','critical'][CAST(sev + 1 AS INT)] || ')' AS message, ecosystem || '/' || name || '@' || version AS location FROM deps JOIN advs USING (ecosystem, name)""",
    "history_inversions": """WITH c AS (SELECT o_custkey AS package, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, epoch(o_orderdate)::BIGINT AS t FROM orders), n AS (SELECT *, lead(t) OVER (PARTITION BY package ORDER BY position) AS nt FROM c)
 SELECT package, CAST(min(position) AS BIGINT) AS at FROM n WHERE nt - t > 86400 GROUP BY package""",
    "package_entries": "SELECT p_partkey AS package, CASE p_size % 5 WHEN 0 THEN 'install-script' WHEN 1 THEN 'ld-preload' WHEN 2 THEN 'setuid-binary' WHEN 3 THEN 'file-outside-prefix' ELSE 'cron-drop-in' END AS rule, CAST(CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 2 END AS BIGINT) AS severity FROM part",
    "package_verdicts": "SELECT p_partkey AS package, CASE p_size % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' WHEN 2 THEN 'warn' WHEN 3 THEN 'block' ELSE 'warn' END AS verdict FROM part",
    "requirements_lock": "SELECT 'p' || l_orderkey || '/requirements.txt' AS path, 'pkg-' || l_partkey AS name, '1.' || l_linenumber || '.' || l_suppkey AS version FROM lineitem WHERE l_linenumber <> 3",
    "go_sum_lock": "SELECT DISTINCT 'p' || l_orderkey || '/go.sum' AS path, 'example.com/m' || l_partkey AS name, 'v1.' || l_linenumber || '.0' AS version FROM lineitem",
    "gradle_lock": "SELECT 'p' || l_orderkey || '/gradle.lockfile' AS path, 'org.x:a' || l_partkey AS name, '2.' || l_linenumber AS version FROM lineitem",
    "cargo_lock": "SELECT 'p' || l_orderkey || '/Cargo.lock' AS path, 'c' || l_partkey AS name, '0.' || l_linenumber || '.1' AS version FROM lineitem",
    "npm_lock": "SELECT DISTINCT 'p' || l_orderkey || '/package-lock.json' AS path, 'n' || l_partkey AS name, '3.' || l_linenumber || '.0' AS version, (l_orderkey, l_partkey) IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_linenumber = 1) AS direct FROM lineitem",
    "gem_lock": "SELECT 'p' || l_orderkey || '/Gemfile.lock' AS path, 'g' || l_partkey AS name, '4.' || l_linenumber AS version, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_partkey) = 1 AS direct FROM lineitem",
    "audit_tail": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "audit_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2",
    "audit_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(count(*) AS BIGINT) AS n, min(ts) AS session_start FROM s GROUP BY user_id, k""",
    "fleet": f"""WITH c AS (SELECT l_orderkey AS task, l_linenumber % 4 AS k, l_quantity > 40 AS failed FROM lineitem) SELECT task, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS n_findings, max(CASE WHEN k <> 3 THEN failed ELSE false END) AS task_failed FROM c GROUP BY task""",
    "image_references": "SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN 'ghcr.io' WHEN 3 THEN 'localhost:5000' ELSE 'registry-1.docker.io' END AS registry, CASE p_size % 4 WHEN 0 THEN 'library/nginx' WHEN 1 THEN 'a/b' WHEN 2 THEN 'o/r' ELSE 'x' END AS repository, CASE p_size % 4 WHEN 0 THEN 'latest' WHEN 1 THEN '1.2' WHEN 2 THEN 'v3' ELSE 'latest' END AS tag FROM part",
    "capability_docs": "SELECT capability, CAST(weight AS BIGINT) AS weight FROM (VALUES ('shell-spawn',10),('dynamic-eval',15),('base64-decode',12),('net-egress',8),('env-read',15),('fs-write-outside-root',8),('raw-ip-literal',10),('install-hook-exec',20),('install-hook-suspicious',70),('obfuscated-payload',60),('suspicious-url',50),('binary-dropper',25),('typosquat-risk',45),('maintainer-hijack-risk',50),('patch-version-drift',35),('maintainer-changed',55),('tarball-source-drift',60),('git-dep-in-optional',65),('unlisted-large-file',55),('version-unpublished',75),('known-malware-ioc',100),('vcs-dependency',45),('hardcoded-secret',80)) t(capability, weight)",
    "code_capabilities": """SELECT doc_id, cap AS capability FROM documents, (VALUES (0, 'shell-spawn'), (0, 'dynamic-eval'), (0, 'env-read'), (1, 'shell-spawn'), (2, 'shell-spawn'), (3, 'fs-write-outside-root'), (3, 'raw-ip-literal'), (4, 'base64-decode')) t(k, cap) WHERE doc_id % 6 = k""",
    "code_imports": "SELECT doc_id, m AS module FROM documents, (VALUES (0, 'child_process'), (1, 'yaml'), (1, 'subprocess'), (1, 'os'), (2, 'os/exec'), (3, 'std::fs')) t(k, m) WHERE doc_id % 6 = k",
    "python_symbols": "SELECT 'd' || doc_id || '.py' AS file, f AS function, m AS module, s AS symbol, CAST(l AS BIGINT) AS line FROM documents, (VALUES ('f', 'subprocess', 'run', 4), ('f', 'yaml', 'load', 5), ('<module>', 'os', 'getenv', 7)) t(f, m, s, l) WHERE doc_id % 6 = 1",
    "package_analysis": "SELECT 'p' || doc_id AS name, CAST(s AS BIGINT) AS score, v AS verdict FROM (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 140 WHEN doc_id % 6 = 0 THEN 40 WHEN doc_id % 6 IN (1, 2) THEN 10 WHEN doc_id % 6 = 3 THEN 18 WHEN doc_id % 6 = 4 THEN 12 END AS s FROM documents) JOIN (VALUES (140, 'block'), (40, 'review'), (10, 'safe'), (18, 'safe'), (12, 'safe')) t(k, v) ON s = k",
    "osv_parse": f"WITH {ADVS} SELECT ecosystem, name, id, summary, fixed_in, CASE WHEN severity = 'moderate' THEN 'medium' ELSE severity END AS severity FROM advs",
    "allowlist_matches": f"""WITH {FLAGS}, r AS (SELECT ecosystem, name, version, p_size, unnest([1, 2, 3, 4, 5, 7]) AS rule_ord FROM fps),
 m AS (SELECT * FROM r WHERE (rule_ord = 1 AND ecosystem = 'npm' AND p_size >= 10) OR (rule_ord = 2 AND ecosystem = 'npm' AND name = 'pkg-6') OR (rule_ord = 3 AND ecosystem = 'pypi' AND p_size = 5) OR (rule_ord = 4 AND ecosystem = 'go' AND p_size IN (7, 11)) OR (rule_ord = 5 AND ecosystem = 'npm') OR (rule_ord = 7 AND ecosystem = 'pypi' AND name = 'pkg-7' AND p_size <= 40))
 SELECT ecosystem, name, version, CAST(rule_ord AS BIGINT) AS rule_ord, ['large ones spawn', 'known', 'templates', 'clients', 'native', '', 'seven'][rule_ord] AS reason, CAST(row_number() OVER (PARTITION BY ecosystem, name, version ORDER BY CASE WHEN rule_ord IN (2, 7) THEN 0 ELSE 1 END, rule_ord) AS BIGINT) AS match_rank FROM m""",
    "advisory_queries": f"""WITH {DEPS} SELECT DISTINCT ecosystem, name, version, CASE ecosystem WHEN 'npm' THEN 'npm' WHEN 'pypi' THEN 'PyPI' WHEN 'crates' THEN 'crates.io' WHEN 'go' THEN 'Go' WHEN 'maven' THEN 'Maven' ELSE 'RubyGems' END AS osv, name AS osv_name FROM deps
 UNION ALL SELECT 'swifturl', 'https://github.com/a/r' || p_partkey || '.git', '1.0.0', 'SwiftURL', 'github.com/a/r' || p_partkey FROM part""",
    "advisory_lookup": f"WITH {DEPS}, {ADVS}, d AS (SELECT DISTINCT ecosystem, name, version FROM deps) SELECT d.ecosystem, d.name, d.version, CAST(count(DISTINCT id) AS BIGINT) AS n FROM d LEFT JOIN advs a ON d.ecosystem = a.ecosystem AND d.name = a.name GROUP BY 1, 2, 3",
    "ghsa_parse": f"WITH {ADVS} SELECT ecosystem, name, 'GHSA-' || p_partkey AS id, id AS alias, severity, fixed_in FROM advs",
    "npm_licenses": "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'ISC' WHEN 2 THEN 'MIT OR GPL-3.0' END AS license FROM part",
    "npm_provenance": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'https://github.com/o/r' || p_partkey END AS source_uri, CASE WHEN p_partkey % 3 <> 0 THEN 'c' || p_size END AS commit FROM part",
    "packument_releases": "SELECT 'c' || o_custkey AS name, '1.0.' || o_orderkey AS version, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS publisher, o_orderkey % 5 = 0 AS unpublished FROM orders",
    "resolved_requests": f"""WITH {DEPS}, d AS (SELECT DISTINCT name, version FROM deps), n AS (SELECT DISTINCT name FROM d), k AS (SELECT *, {vnum('version')} AS k FROM d WHERE NOT contains(version, '-')),
 r AS (SELECT name, max_by(version, k) AS best FROM k WHERE k >= 1002000 AND k < 2000000 GROUP BY 1) SELECT n.name, '^1.2.0' AS request, best AS resolved FROM n LEFT JOIN r USING (name) UNION ALL SELECT name, '' AS request, min(version) FROM d GROUP BY name""",
    "pypi_requests": f"WITH {DEPS}, d AS (SELECT DISTINCT name, version FROM deps), k AS (SELECT *, {vnum('version')} AS k FROM d WHERE NOT contains(version, '-')) SELECT name, '~=1.2, !=1.5.0' AS request, max_by(version, k) AS resolved FROM k WHERE k >= 1002000 AND k < 2000000 AND k <> 1005000 GROUP BY name",
    "tag_candidates": """SELECT p_partkey, CAST(i - 1 AS BIGINT) AS place, t[i] AS tag FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['v1.2', '1.2', '@s/p' || p_partkey || '@1.2', '@s/p' || p_partkey || '-v1.2', '@s/p' || p_partkey || '-1.2', 'p' || p_partkey || '@1.2', 'p' || p_partkey || '-v1.2', 'p' || p_partkey || '-1.2']
 ELSE ['v1.2', '1.2', 'p' || p_partkey || '@1.2', 'p' || p_partkey || '-v1.2', 'p' || p_partkey || '-1.2'] END AS t FROM part), range(1, 9) r(i) WHERE i <= len(t)""",
    "patch_drift": "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0",
    "unused_dependencies": "SELECT DISTINCT l_orderkey AS project, 'd' || (l_partkey % 20) AS dep_name FROM lineitem l WHERE l_linenumber % 2 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem q WHERE q.l_orderkey = l.l_orderkey AND q.l_suppkey % 20 = l.l_partkey % 20)",
}

from . import archive_queries, code_queries, lock_queries, report_queries, rule_queries, state_queries  # noqa: E402

ORACLES |= rule_queries.oracles(DEPS, vnum) | lock_queries.ORACLES | report_queries.oracles(DEPS, ADVS) | code_queries.ORACLES | state_queries.ORACLES | archive_queries.ORACLES
