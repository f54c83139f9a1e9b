"""Queries of what is resolved over a whole repository: imports, calls, constants, configurations, clients, deliveries.

The rows are SQL over the supplied keys that both engines read; what must come of them is told by the keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.operators import linking

from .projections import table
from .snapshots import SYMBOLS

TARGETS = """SELECT module, CASE g % 6 WHEN 0 THEN '.sib' WHEN 1 THEN '.m' || (g % 40) WHEN 2 THEN 'os.path' WHEN 3 THEN 'Declared_Lib.sub'
  WHEN 4 THEN 'pkg' || ((g + 1) % 7) || '.m' || ((g + 1) % 40) || '.C1' ELSE 'nowhere' END AS target, g FROM {x} WHERE place = 9"""


def _x(spark, sf_dir):
    return spark.sql(SYMBOLS, part=table(spark, sf_dir, "part"))


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))


def resolved_imports(spark, sf_dir):
    x = _x(spark, sf_dir)
    declared = spark.createDataFrame([("declared-lib",)], "package string")
    return linking.classified_imports(spark.sql(TARGETS, x=x), x.select("module").distinct(), declared)


def resolved_calls(spark, sf_dir):
    """Calls by ``self``, by a name of the module, by a name that one symbol has, and by names that nothing or several have."""
    x = _x(spark, sf_dir)
    symbols = x.select(F.concat_ws(":", F.concat_ws("/", "repo", "module"), "qualname").alias("symbol"))
    name = F.when(F.col("g") % 4 == 0, "self.__init__").when(F.col("g") % 4 == 1, F.concat(F.lit("C"), "g")).when(F.col("g") % 4 == 2, F.concat(F.lit("C"), F.col("g") + 1)).otherwise("f7")
    calls = x.where("place = 2").select(F.concat_ws(":", F.concat_ws("/", "repo", "module"), "qualname").alias("caller"), name.alias("name"))
    return linking.resolved_calls(calls, symbols)


def typed_calls(spark, sf_dir):
    """A class under its imported name, by an alias of its module, in the caller's module, and one that a method lacks."""
    k = _keys(spark, sf_dir)
    mod = F.concat(F.lit("m"), "k")
    symbols = None
    for suffix, kind in ((":C", "class"), (":C.go", "method"), (":f", "function")):
        rows = k.select(F.concat(mod, F.lit(suffix)).alias("symbol"), F.lit(kind).alias("symbol_kind"))
        symbols = rows if symbols is None else symbols.union(rows)
    made = F.when(F.col("k") % 4 == 0, "D").when(F.col("k") % 4 == 1, "n.C").when(F.col("k") % 4 == 2, "C").otherwise("D")
    method = F.when(F.col("k") % 4 == 3, "missing").when(F.col("k") % 8 < 4, "go")
    calls = k.select(F.concat(mod, F.lit(":f")).alias("caller"), made.alias("made"), method.alias("method"), F.lit(1).alias("line"))
    other = F.concat(F.lit("m"), (F.col("k") + 1) % 10)
    imports = k.select(mod.alias("module"), other.alias("target"), F.lit("C").alias("name"), F.lit("D").alias("alias")).union(k.select(mod, other, F.lit(""), F.lit("n")))
    return linking.typed_calls(calls, imports, symbols).select("caller", "callee", "rule")


def resolved_constants(spark, sf_dir):
    """Chains of ten names, each the one before it and a piece; eight rounds leave the last one out."""
    parts = F.when(F.col("k") % 10 == 0, F.concat(F.lit('[["text","r'), "k", F.lit('"]]'))).otherwise(F.concat(F.lit('[["name","n'), F.col("k") - 1, F.lit('"],["text","-'), F.col("k") % 10, F.lit('"]]')))
    return linking.resolved_constants(_keys(spark, sf_dir).select(F.concat(F.lit("n"), "k").alias("name"), parts.alias("parts")))


def inherited_aliases(spark, sf_dir):
    k = F.col("k")
    rows = _keys(spark, sf_dir).select(
        F.concat(F.lit("c"), "k").alias("config"), F.when(k % 4 != 0, F.concat(F.lit("c"), k - 1)).alias("extends"), F.when(k % 4 == 1, F.concat(F.lit("src"), k)).alias("base_url"),
        F.when(k % 2 == 0, F.create_map(F.lit("@/*"), F.concat(F.lit("a"), k, F.lit("/*")))).alias("aliases"),
    )
    return linking.chained_aliases(rows)


def script_imports(spark, sf_dir):
    """Relative files, folders' indexes, aliases, builtins, resources, declared and unknown packages."""
    k = F.col("k")
    keys = _keys(spark, sf_dir)
    path = F.concat(F.lit("src/a"), k, F.lit("/main.ts"))
    pick = F.when(k % 7 == 0, "./util").when(k % 7 == 1, "../lib").when(k % 7 == 2, "@/shared").when(k % 7 == 3, "node:fs").when(k % 7 == 4, "./style.css").when(k % 7 == 5, "react").otherwise("nothing/at/all")
    files = keys.select(F.concat(F.lit("src/a"), k, F.lit("/util.tsx")).alias("path")).union(keys.select(F.lit("src/lib/index.ts"))).union(keys.select(F.lit("app/shared.js"))).distinct()
    aliases = spark.createDataFrame([("@/*", "app/*")], "pattern string, replacement string")
    return linking.resolved_script_imports(keys.select(path.alias("path"), pick.alias("target")), files, aliases, spark.createDataFrame([("react",)], "package string"))


def delivered_domains(spark, sf_dir):
    """Distributions with a literal alias and one by a variable; every third leads to no bucket."""
    keys, k = _keys(spark, sf_dir), F.col("k")
    name = F.concat(F.lit("d"), k, F.lit("|x"))
    rows = keys.select(name.alias("name"), F.lit("HAS_ALIAS").alias("relation"), F.concat(F.lit("a"), k, F.lit(".example")).alias("target"))
    rows = rows.union(keys.select(name, F.lit("HAS_ALIAS"), F.concat(F.lit("d"), k, F.lit("|var.h"))))
    rows = rows.union(keys.where("k % 2 = 0").select(F.concat(F.lit("d"), k, F.lit("|var.h")), F.lit("DEFAULTS_TO"), F.concat(F.lit("v"), k, F.lit(".example"))))
    rows = rows.union(keys.select(name, F.lit("HAS_ORIGIN"), F.when(k % 3 == 0, "backend.example").otherwise(F.concat(F.lit("d"), k, F.lit("|aws_s3_bucket.b")))))
    return linking.delivered(rows)


def client_calls(spark, sf_dir):
    """Calls by a file's own client, by an imported one, and by one that isn't known."""
    keys, k = _keys(spark, sf_dir), F.col("k")
    path = F.concat(F.lit("f"), k, F.lit(".ts"))
    client = F.when(k % 3 == 0, "own").when(k % 3 == 1, "api").otherwise("other")
    calls = keys.select(path.alias("path"), client.alias("client"), F.lit("GET").alias("method"), F.concat(F.lit("/x/"), k).alias("route"))
    clients = keys.select(path.alias("path"), F.lit("own").alias("client"), F.concat(F.lit("https://h"), k, F.lit(".example/")).alias("url"))
    imports = keys.select(path.alias("path"), F.concat(F.lit("f"), (k + 1) % 10, F.lit(".ts")).alias("resolved"), F.lit("own").alias("name"), F.lit("api").alias("alias"))
    return linking.client_calls(calls, clients, imports)


def named_models(spark, sf_dir):
    """Models by whole name, by their application's label, by a name that is theirs alone, and by one that is not."""
    keys, k = _keys(spark, sf_dir), F.col("k")
    symbols = keys.select(F.concat(F.lit("app"), k, F.lit(".models:Item"), k).alias("symbol")).union(keys.select(F.concat(F.lit("app"), k, F.lit(".models:Same"))))
    named = F.when(k % 4 == 0, F.concat(F.lit("app"), k, F.lit(".models.Item"), k)).when(k % 4 == 1, F.concat(F.lit("app"), k, F.lit(".Item"), k)).when(k % 4 == 2, F.concat(F.lit("Item"), k)).otherwise("Same")
    return linking.named_symbols(keys.select("k", named.alias("named")), symbols)


QUERIES = {
    f.__name__: f
    for f in (resolved_imports, resolved_calls, typed_calls, resolved_constants, inherited_aliases, script_imports, delivered_domains, client_calls, named_models)
}

_X = f"WITH x AS ({SYMBOLS.format(part='part')})"
_K = "(SELECT s_suppkey AS k FROM supplier)"
ORACLES = {
    "resolved_imports": f"""{_X}, t AS (SELECT DISTINCT module, target, g % 6 AS c FROM ({TARGETS.replace("{x}", "x")})), r AS (SELECT *, CASE c WHEN 1 THEN module WHEN 4 THEN regexp_replace(target, '[.]C1$', '') END AS want FROM t)
SELECT module, target, CASE WHEN want IN (SELECT module FROM x) THEN want END AS resolved, CASE WHEN c IN (0, 1) THEN CASE WHEN want IN (SELECT module FROM x) THEN 'relative_internal_module' ELSE 'unknown' END WHEN c = 2 THEN 'stdlib'
WHEN c = 3 THEN 'third_party' WHEN c = 4 AND want IN (SELECT module FROM x) THEN 'internal_module' ELSE 'unknown' END AS category FROM r""",
    "resolved_calls": f"""{_X}, s AS (SELECT DISTINCT repo || '/' || module || ':' || qualname AS symbol, qualname, repo || '/' || module AS m, regexp_extract(qualname, '([^.]+)$', 1) AS short FROM x),
c AS (SELECT DISTINCT repo || '/' || module AS m, repo || '/' || module || ':' || qualname AS caller, CASE g % 4 WHEN 0 THEN 'self.__init__' WHEN 1 THEN 'C' || g WHEN 2 THEN 'C' || (g + 1) ELSE 'f7' END AS name, 'C' || g || '.__init__' AS own FROM x WHERE place = 2),
u AS (SELECT short, min(symbol) AS lone FROM s GROUP BY 1 HAVING count(*) = 1),
j AS (SELECT c.*, (SELECT min(symbol) FROM s WHERE s.m = c.m AND s.qualname = CASE WHEN starts_with(name, 'self.') THEN own ELSE name END) AS there, lone FROM c LEFT JOIN u ON u.short = c.name)
SELECT caller, name, CASE WHEN starts_with(name, 'self.') THEN there ELSE coalesce(there, lone) END AS callee, CASE WHEN starts_with(name, 'self.') THEN CASE WHEN there IS NOT NULL THEN 'enclosing_class' END WHEN there IS NOT NULL THEN 'same_module' WHEN lone IS NOT NULL THEN 'unique_name' END AS rule FROM j""",
    "typed_calls": f"""SELECT 'm' || k || ':f' AS caller, CASE WHEN k % 4 = 2 THEN 'm' || k ELSE 'm' || ((k + 1) % 10) END || ':C' || CASE WHEN k % 8 < 4 THEN '.go' ELSE '' END AS callee,
CASE WHEN k % 8 < 4 THEN 'receiver' ELSE 'constructor' END AS rule FROM {_K} WHERE k % 4 <> 3""",
    "resolved_constants": f"SELECT 'n' || k AS name, 'r' || (k - k % 10) || array_to_string(list_transform(range(1, (k % 10 + 1)::BIGINT), lambda i: '-' || i), '') AS value FROM {_K} WHERE k % 10 <= 8",
    "inherited_aliases": f"""SELECT 'c' || k AS config, CASE WHEN k % 4 = 0 THEN NULL ELSE 'src' || (k - k % 4 + 1) END AS base_url, '@/*' AS pattern, 'a' || (k - k % 2) || '/*' AS replacement FROM {_K}""",
    "script_imports": f"""SELECT 'src/a' || k || '/main.ts' AS path, ['./util', '../lib', '@/shared', 'node:fs', './style.css', 'react', 'nothing/at/all'][k % 7 + 1] AS target,
CASE k % 7 WHEN 0 THEN 'src/a' || k || '/util.tsx' WHEN 1 THEN 'src/lib/index.ts' WHEN 2 THEN 'app/shared.js' END AS resolved,
['relative_internal_module', 'relative_internal_module', 'internal_module', 'node_builtin', 'relative_resource_module', 'third_party', 'unknown'][k % 7 + 1] AS category FROM {_K}""",
    "delivered_domains": f"""SELECT 'a' || k || '.example' AS domain, 'd' || k || '|aws_s3_bucket.b' AS target FROM {_K} WHERE k % 3 <> 0
UNION ALL SELECT 'v' || k || '.example', 'd' || k || '|aws_s3_bucket.b' FROM {_K} WHERE k % 3 <> 0 AND k % 2 = 0""",
    "client_calls": f"""SELECT 'f' || k || '.ts' AS path, 'GET https://h' || CASE WHEN k % 3 = 0 THEN k ELSE (k + 1) % 10 END || '.example/x/' || k AS endpoint FROM {_K} WHERE k % 3 < 2""",
    "named_models": f"""SELECT k, CASE k % 4 WHEN 0 THEN 'app' || k || '.models.Item' || k WHEN 1 THEN 'app' || k || '.Item' || k WHEN 2 THEN 'Item' || k ELSE 'Same' END AS named,
CASE WHEN k % 4 < 3 THEN 'app' || k || '.models:Item' || k WHEN (SELECT count(*) FROM supplier) = 1 THEN 'app' || k || '.models:Same' END AS symbol FROM {_K}""",
}
