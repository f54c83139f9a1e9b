"""Second phase of extraction: rows of single files resolved against the whole repository, and packages against repositories."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import columns as C

from .lineage import cut


def _ancestors(name: Column) -> Column:
    """``a.b.c`` as [a.b.c, a.b, a]."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def absolute(module: Column, target: Column) -> Column:
    """A relative import seen from its module: one dot is the module's package, each further one its parent."""
    dots = F.char_length(F.regexp_extract(target, r"^(\.*)", 1))
    parts = F.split(module, r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), ".")
    rest = F.regexp_replace(target, r"^\.+", "")
    return F.when(dots == 0, target).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))


def classified_imports(imports: DataFrame, modules: DataFrame, declared: DataFrame) -> DataFrame:
    """``imports`` (module, target) with ``resolved`` (the internal module, if any) and ``category``.

    ``modules`` (module) are the repository's; ``declared`` (package) its dependencies.  Relative imports are internal
    or unknown; others are internal by the longest known prefix, then stdlib, then third_party if declared.
    """
    stdlib = sorted(sys.stdlib_module_names)  # some three hundred names
    rows = imports.select("module", "target").distinct().withColumn("whole", absolute(F.col("module"), F.col("target")))
    rows = rows.withColumn("relative", F.startswith("target", F.lit("."))).withColumn("root", F.substring_index("whole", ".", 1))
    tries = rows.select("module", "target", F.explode(_ancestors(F.col("whole"))).alias("known"))
    found = tries.join(modules.select(F.col("module").alias("known")).distinct(), "known")
    found = found.groupBy("module", "target").agg(F.max_by("known", F.char_length("known")).alias("resolved"))
    names = declared.select(C.package_name("package").alias("package")).distinct().withColumn("is_declared", F.lit(True))
    out = rows.join(found, ["module", "target"], "left").withColumn("package", C.package_name("root")).join(names, "package", "left")
    inside = F.col("resolved").isNotNull()
    category = (
        F.when(F.col("relative"), F.when(inside, "relative_internal_module").otherwise("unknown"))
        .when(inside, "internal_module")
        .when(F.col("root").isin(*stdlib), "stdlib")
        .when(F.col("is_declared"), "third_party")
        .otherwise("unknown")
    )
    return out.select("module", "target", "resolved", category.alias("category"))


def resolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls`` (caller ``module:scope``, name) with ``callee`` and ``rule``; calls that nothing decides have neither.

    ``symbols`` (symbol ``module:qualname``).  ``self.m`` is a method of the class that encloses the caller, a plain
    name a symbol of the caller's module, and else a name that one symbol of the repository alone has.
    """
    module, scope = F.substring_index("caller", ":", 1), F.substring_index("caller", ":", -1)
    owner = F.regexp_replace(scope, r"\.?[^.]*$", "")
    rows = calls.select("caller", "name").distinct().withColumn("by_self", F.concat(module, F.lit(":"), owner, F.lit("."), F.regexp_extract("name", r"^self\.(\w+)$", 1)))
    rows = rows.withColumn("by_module", F.concat(module, F.lit(":"), "name")).withColumn("short", F.substring_index("name", ".", -1))
    known = symbols.select("symbol").distinct()
    for by in ("by_self", "by_module"):
        rows = rows.join(known.select(F.col("symbol").alias(by), F.lit(True).alias(f"has_{by}")), by, "left")
    short = known.groupBy(F.regexp_extract("symbol", r"([^.:]+)$", 1).alias("short")).agg(F.count("*").alias("n"), F.min("symbol").alias("only"))
    rows = rows.join(short.where("n = 1"), "short", "left")
    is_self = F.startswith("name", F.lit("self."))
    rule = (
        F.when(F.col("has_by_self") & is_self, "enclosing_class")
        .when(F.col("has_by_module") & ~is_self, "same_module")
        .when(F.col("only").isNotNull() & ~is_self & ~F.contains("name", F.lit(".")), "unique_name")
    )
    callee = F.when(rule == "enclosing_class", F.col("by_self")).when(rule == "same_module", F.col("by_module")).when(rule == "unique_name", F.col("only"))
    return rows.select("caller", "name", callee.alias("callee"), rule.alias("rule"))


def _qualified(symbol: Column) -> Column:
    """``module:qualname`` as one dotted name."""
    return F.replace(symbol, F.lit(":"), F.lit("."))


def typed_calls(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls on what a body constructs: (caller, line, callee, rule).

    ``calls`` (caller ``module:scope``, made, method or null, line): the class as it is written there; ``imports``
    (module, target, name or null, alias); ``symbols`` (symbol, symbol_kind).  A plain name is a class that is imported,
    else one of the module; a dotted one a class's whole name, else one below an imported module.  A method must be
    the class's own; a constructor's callee is the class.
    """
    classes = symbols.where("symbol_kind = 'class'").select(F.col("symbol").alias("class_"), _qualified(F.col("symbol")).alias("full")).distinct()
    modules = symbols.select(F.substring_index("symbol", ":", 1).alias("full")).distinct()
    rows = calls.select("caller", "made", "method", "line").distinct().withColumn("module", F.substring_index("caller", ":", 1))
    rows = rows.withColumn("head", F.substring_index("made", ".", 1)).withColumn("rest", F.when(F.contains("made", F.lit(".")), F.regexp_replace("made", r"^[^.]*\.", "")))
    bound = imports.select("module", F.col("alias").alias("head"), absolute(F.col("module"), F.col("target")).alias("from"), F.nullif("name", F.lit("")).alias("name")).distinct()
    bound = bound.withColumn("means", F.concat_ws(".", "from", "name"))
    is_module = bound.join(modules.withColumnRenamed("full", "means"), "means", "left_semi").union(bound.where("name IS NULL").select(*["means", *[c for c in bound.columns if c != "means"]])).distinct()
    plain, deep = rows.where("rest IS NULL"), rows.where("rest IS NOT NULL")
    key = ["caller", "made", "method", "line"]
    tries = [
        (0, plain.join(bound.where("name IS NOT NULL").select("module", "head", "means"), ["module", "head"]).select(*key, F.col("means").alias("full"))),
        (0, deep.select(*key, F.col("made").alias("full"))),
        (1, deep.join(is_module.select("module", "head", "means"), ["module", "head"]).select(*key, F.concat_ws(".", "means", "rest").alias("full"))),
    ]
    tried = reduce(DataFrame.union, [t.withColumn("place", F.lit(n)) for n, t in tries]).join(classes, "full").drop("full")
    own = classes.select(F.substring_index("class_", ":", 1).alias("module"), F.regexp_extract("class_", r"([^.:]+)$", 1).alias("head"), "class_")
    own = plain.join(own, ["module", "head"]).select(*key, F.lit(1).alias("place"), "class_")
    best = tried.select(*key, "place", "class_").union(own).groupBy(*key).agg(F.min(F.struct("place", "class_")).alias("best"))
    best = best.select(*key, F.col("best.class_").alias("class_"))
    constructed = best.where("method IS NULL").select("caller", "line", F.col("class_").alias("callee"), F.lit("constructor").alias("rule"))
    methods = symbols.where("symbol_kind = 'method'").select(F.col("symbol").alias("callee")).distinct()
    called = best.where("method IS NOT NULL").select("caller", "line", F.concat_ws(".", "class_", "method").alias("callee")).join(methods, "callee", "left_semi")
    return called.select("caller", "line", "callee", F.lit("receiver").alias("rule")).union(constructed).distinct()


def named_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``rows`` with ``symbol``: that which column ``named`` means, by its whole name, by ``app.Name``, or by a name that one symbol alone has."""
    known = symbols.select("symbol").distinct().withColumn("full", _qualified(F.col("symbol")))
    short = F.regexp_extract("full", r"([^.]+)$", 1)
    app = F.regexp_extract("full", r"([^.]+)\.models(?:\.[^.]+)*$", 1)
    by_short = known.groupBy(short.alias("named")).agg(F.count("*").alias("n"), F.min("symbol").alias("by_short")).where("n = 1").drop("n")
    by_label = known.where(app != "").groupBy(F.concat_ws(".", app, short).alias("named")).agg(F.count("*").alias("n"), F.min("symbol").alias("by_label")).where("n = 1").drop("n")
    out = rows.join(known.select(F.col("full").alias("named"), F.col("symbol").alias("by_full")), "named", "left").join(by_label, "named", "left").join(by_short, "named", "left")
    return out.withColumn("symbol", F.coalesce("by_full", "by_label", "by_short")).drop("by_full", "by_label", "by_short")


def resolved_constants(bound: DataFrame, depth: int = 8) -> DataFrame:
    """(name, value): the texts that names stand for, from (name, parts), a JSON array of ["text", x], ["name", y] and ["env", v, default].

    A name may be bound several times.  In a text of several pieces each name must have one value; a text that is one
    name has all of that name's.  Names that need each other are left out; a round needs one more name known.
    """
    kinds = "array<array<string>>"
    rows = bound.select("name", F.from_json("parts", kinds).alias("parts")).distinct().withColumn("id", F.xxhash64("name", F.to_json("parts")))
    pieces = rows.select("id", "name", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part"))
    kind = F.element_at("part", 1)
    pieces = cut(pieces.select("id", "name", "n", "at", F.when(kind == "name", F.element_at("part", 2)).alias("needs"), F.when(kind == "text", F.element_at("part", 2)).when(kind == "env", F.element_at("part", 3)).alias("text")))
    one = pieces.where("n = 1")
    known = cut(one.where("needs IS NULL").select("name", F.col("text").alias("value")).distinct())
    for _ in range(depth):
        by_name = one.where("needs IS NOT NULL").join(known.withColumnRenamed("name", "needs"), "needs").select("name", "value")
        single = known.groupBy(F.col("name").alias("needs")).agg(F.count("*").alias("values"), F.min("value").alias("value")).where("values = 1")
        long = pieces.where("n > 1").join(single.select("needs", "value"), "needs", "left").withColumn("said", F.coalesce("text", "value"))
        whole = long.groupBy("id", "name", "n").agg(F.count("said").alias("there"), F.array_sort(F.collect_list(F.struct("at", "said"))).alias("all")).where("there = n")
        joined = whole.select("name", F.array_join(F.transform("all", lambda x: x["said"]), "").alias("value"))
        fresh = cut(by_name.union(joined).distinct().join(known, ["name", "value"], "left_anti"))
        if fresh.isEmpty():
            break
        known = known.union(fresh)
    return known


def chained_aliases(configs: DataFrame, depth: int = 8) -> DataFrame:
    """(config, pattern, replacement, base_url): the aliases of script configurations (config, extends or null, base_url, aliases map), inherited.

    A configuration's own aliases replace all that it extends; so does its base.  A chain that comes back to itself ends.
    """
    rows = cut(configs.select("config", "extends", "base_url", "aliases"))
    walk = rows.select("config", F.col("config").alias("at"), F.lit(0).alias("step"), F.array("config").alias("seen"))
    found = [walk]
    for d in range(1, depth + 1):
        up = walk.join(rows.select(F.col("config").alias("at"), "extends"), "at").where("extends IS NOT NULL")
        walk = cut(up.where(~F.array_contains("seen", F.col("extends"))).select("config", F.col("extends").alias("at"), F.lit(d).alias("step"), F.array_append("seen", F.col("extends")).alias("seen")))
        if walk.isEmpty():
            break
        found.append(walk)
    chain = reduce(DataFrame.union, found).join(rows.select(F.col("config").alias("at"), "base_url", "aliases"), "at")
    first = lambda c: F.min_by(F.struct(F.col(c), F.col("at")), F.when(F.col(c).isNotNull(), F.col("step")))
    top = chain.groupBy("config").agg(first("aliases").alias("a"), first("base_url").alias("b"))
    return top.select("config", F.col("b.base_url").alias("base_url"), F.explode("a.aliases").alias("pattern", "replacement"))


def delivered(rows: DataFrame) -> DataFrame:
    """(domain, target): aliases of distributions, variables resolved in their folder, that lead to a bucket; from rows (name, relation, target)."""
    of = lambda r: rows.where(F.col("relation") == r).select("name", F.col("target").alias("to")).distinct()
    values = of("DEFAULTS_TO").select(F.col("name").alias("to"), F.col("to").alias("value"))
    alias = of("HAS_ALIAS").join(values, "to", "left").select("name", F.when(F.contains("to", F.lit("|")), F.col("value")).otherwise(F.col("to")).alias("domain")).where("domain IS NOT NULL")
    origin = of("HAS_ORIGIN").where(F.contains("to", F.lit("|aws_s3_bucket")) | F.contains("to", F.lit(".s3.")))
    return alias.join(origin, "name").select("domain", F.col("to").alias("target")).distinct()


def client_calls(calls: DataFrame, clients: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, endpoint): calls by a client's name as whole addresses: ``calls`` (path, client, method, route), ``clients`` (path, client, url), ``imports`` (path, resolved, name, alias).

    A client is the file's own, or one that it imports by name.
    """
    own = calls.join(clients, ["path", "client"]).select("path", "method", "route", "url")
    by = imports.join(clients.select(F.col("path").alias("resolved"), F.col("client").alias("name"), "url"), ["resolved", "name"]).select("path", F.col("alias").alias("client"), "url")
    both = own.union(calls.join(by, ["path", "client"]).select("path", "method", "route", "url")).distinct()
    return both.select("path", F.concat(F.col("method"), F.lit(" "), F.rtrim(F.col("url"), F.lit("/")), F.col("route")).alias("endpoint"))


def linked_packages(dependencies: DataFrame, providers: DataFrame) -> DataFrame:
    """(package, consumers, providers, provider, bucket): packages against repositories that provide them.

    ``dependencies`` (consumer, package, target_url or null); ``providers`` (repo host/owner/name, name).  A dependency's
    own git target counts before its name.  A package is linked if each of its consumers leads to the same one provider.
    """
    wanted = dependencies.select("consumer", C.package_name("package").alias("package"), C.git_identity("target_url").alias("target")).distinct()
    known = providers.select("repo", C.package_name("name").alias("package")).distinct()
    by_target = wanted.where("target IS NOT NULL").join(known.select(F.col("repo").alias("target")).distinct(), "target").select("consumer", "package", F.col("target").alias("repo"))
    rest = wanted.join(by_target, ["consumer", "package"], "left_anti")
    hits = by_target.union(rest.join(known, "package").select("consumer", "package", "repo"))
    per = wanted.join(hits, ["consumer", "package"], "left").groupBy("package").agg(
        F.count_distinct("consumer").alias("consumers"), F.count_distinct("repo").alias("providers"),
        F.count_distinct(F.when(F.col("repo").isNotNull(), F.col("consumer"))).alias("matched"), F.min("repo").alias("only"),
    )
    one = (F.col("providers") == 1) & (F.col("matched") == F.col("consumers"))
    bucket = F.when(one, "candidate_internal").when(F.col("providers") > 0, "candidate_internal_ambiguous").otherwise("consumer_manifest_external")
    return per.select("package", "consumers", "providers", F.when(one, F.col("only")).alias("provider"), bucket.alias("bucket"))


# The endings that a module name may leave out, in the order in which they are tried, and what Node brings along.
ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".json", "/index.ts", "/index.tsx", "/index.js")
RESOURCES = ("css", "scss", "less", "svg", "png", "jpg", "gif", "woff", "woff2", "html", "md")
NODE_BUILTINS = (
    "assert", "buffer", "child_process", "cluster", "crypto", "dns", "events", "fs", "http", "http2", "https", "net", "os", "path", "perf_hooks",
    "process", "querystring", "readline", "stream", "string_decoder", "timers", "tls", "url", "util", "v8", "vm", "worker_threads", "zlib",
)


def joined_path(folder: Column, target: Column) -> Column:
    """``target`` seen from ``folder``, without ``.`` and ``..``; steps above the root are left out."""
    parts = F.filter(F.split(F.concat_ws("/", folder, target), "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(parts, none, step), "/")


def resolved_script_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame, declared: DataFrame, base_url: str = "") -> DataFrame:
    """``imports`` (path, target) with ``resolved`` (a path of ``files``) and ``category``.

    ``aliases`` (pattern, replacement), with one ``*`` at most, are the configuration's; the longest prefix wins.  Then
    targets are tried from ``base_url``; each with ENDINGS in order.  ``declared`` (package) are the dependencies.
    """
    rows = imports.select("path", "target").distinct()
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    relative = F.startswith("target", F.lit("."))
    prefix = F.substring_index("pattern", "*", 1)
    starred = F.contains("pattern", F.lit("*"))
    fits = F.when(starred, F.startswith("target", prefix)).otherwise(F.col("target") == F.col("pattern"))
    rest = F.when(starred, F.substr("target", F.char_length(prefix) + 1)).otherwise("")
    by_alias = rows.where(~relative).join(aliases, fits).select(  # a configuration holds few patterns
        "path", "target", F.struct(F.lit(1).alias("rule"), (-F.char_length(prefix)).alias("spec")).alias("order"),
        joined_path(F.lit(base_url), F.replace(F.col("replacement"), F.lit("*"), rest)).alias("base"),
    )
    plain = lambda test, rule, from_: rows.where(test).select("path", "target", F.struct(F.lit(rule).alias("rule"), F.lit(0).alias("spec")).alias("order"), joined_path(from_, F.col("target")).alias("base"))
    tries = plain(relative, 0, folder).union(by_alias).union(plain(~relative, 2, F.lit(base_url)))
    tries = tries.select("path", "target", "order", "base", F.posexplode(F.array(*[F.lit(e) for e in ENDINGS])).alias("ending", "text"))
    tries = tries.withColumn("file", F.concat("base", "text"))
    found = tries.join(files.select(F.col("path").alias("file")).distinct(), "file")
    best = found.groupBy("path", "target").agg(F.min_by("file", F.struct("order", "ending")).alias("resolved"))
    package = F.regexp_extract("target", r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    names = declared.select(F.col("package")).distinct().withColumn("is_declared", F.lit(True))
    out = rows.join(best, ["path", "target"], "left").withColumn("package", package).join(names, "package", "left")
    resource = F.regexp_extract("target", r"\.([a-z0-9]+)$", 1).isin(*RESOURCES)
    category = (
        F.when(relative & resource, "relative_resource_module").when(relative, F.when(F.col("resolved").isNotNull(), "relative_internal_module").otherwise("unknown"))
        .when(F.regexp_replace("package", "^node:", "").isin(*NODE_BUILTINS), "node_builtin")
        .when(F.col("resolved").isNotNull(), F.when(resource, "resource_module").otherwise("internal_module"))
        .when(F.col("is_declared"), "third_party").otherwise("unknown")
    )
    return out.select("path", "target", "resolved", category.alias("category"))
