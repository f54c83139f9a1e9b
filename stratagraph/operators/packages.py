"""Packages against the repositories of a fleet: links, their evidence, buckets and coverage.

``packages`` (entity_id, consumer, names array, category, distribution), a row for each repository that imports one;
``dependencies`` (consumer, declared_name, spec_form, target_url, manifest_path, line_number); ``providers`` (repo,
package_name, aliases array, roots array, service).  Repositories are host/owner/name.  Everything is joined by the
linker's form of a name; a name that many repositories hold is counted before it is joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import columns as C

#: Categories of what a language brings along, and forms of dependencies that point inside a fleet.
BUILTIN = ("stdlib", "node_builtin")
INTERNAL_FORMS = ("workspace", "file_path", "git_url")
RULES = ("manifest_target_repo_match", "unique_normalized_package_name_match")


def _names(packages: DataFrame) -> DataFrame:
    """(entity_id, consumer, key): the names that each package may be provided under."""
    names = F.filter(F.transform("names", C.package_name), lambda n: n.isNotNull() & (n != ""))
    return packages.select("entity_id", "consumer", F.explode(F.array_distinct(names)).alias("key")).distinct()


def _matching(packages: DataFrame, dependencies: DataFrame, providers: DataFrame) -> DataFrame:
    """Declared dependencies of each package and consumer: equal targets once, with ``target``, the provider its git address names."""
    url = F.nullif(F.trim("target_url"), F.lit(""))
    rows = dependencies.withColumns({"key": C.package_name("declared_name"), "url": url})
    rows = rows.withColumn("address", F.when(F.col("spec_form") == "git_url", C.git_identity("url")))
    known = providers.groupBy(F.col("repo").alias("address")).agg(F.count("*").alias("at_address"))
    rows = rows.join(known, "address", "left")
    rows = _names(packages).join(rows, ["consumer", "key"])
    place = F.struct("manifest_path", "line_number", "declared_name", "spec_form", "url", "address", "at_address")
    target = F.when(F.col("at_address").isNotNull(), F.struct(F.lit(True).alias("repo"), F.col("address").alias("to"))).otherwise(F.struct(F.lit(False).alias("repo"), F.col("url").alias("to")))
    return rows.groupBy("entity_id", "consumer", "key", "spec_form", target.alias("target")).agg(F.min(place).alias("d"))


def matches(packages: DataFrame, dependencies: DataFrame, providers: DataFrame) -> DataFrame:
    """(entity_id, consumer, providers, provider, by_target, dependency): where each consumer of a package leads.

    One dependency whose address is another repository of the fleet decides; else the providers of any of the names,
    and without any those whose import roots have it, if that is one.
    """
    own = F.col("repo") != F.col("consumer")
    by_target = _matching(packages, dependencies, providers).where("d.at_address = 1 AND d.address <> consumer")
    by_target = by_target.groupBy("entity_id", "consumer").agg(F.count("*").alias("n"), F.min("d").alias("dependency")).where("n = 1")
    by_target = by_target.select("entity_id", "consumer", F.lit(1).alias("providers"), F.col("dependency.address").alias("provider"), F.lit(True).alias("by_target"), "dependency")
    rest = _names(packages).join(by_target, ["entity_id", "consumer"], "left_anti")

    def named(column: Column, left: DataFrame) -> DataFrame:
        keys = providers.select("repo", F.explode(F.transform(column, C.package_name)).alias("key")).distinct()
        hits = left.join(keys, "key").where(own).groupBy("entity_id", "consumer")
        return hits.agg(F.count_distinct("repo").cast("int").alias("providers"), F.min("repo").alias("provider"))

    by_name = named(F.col("aliases"), rest)
    by_root = named(F.col("roots"), rest.join(by_name, ["entity_id", "consumer"], "left_anti")).where("providers = 1")
    none = F.lit(None).cast(by_target.schema["dependency"].dataType)
    plain = by_name.unionByName(by_root).select("entity_id", "consumer", "providers", "provider", F.lit(False).alias("by_target"), none.alias("dependency"))
    return by_target.unionByName(plain)


def links(packages: DataFrame, dependencies: DataFrame, providers: DataFrame) -> DataFrame:
    """(entity_id, state, provider, rule, consumers, dependency): state is linked, ambiguous or none.

    A package is linked if every consumer of it leads to the same one provider; one consumer with several makes it
    ambiguous.  Packages that a language brings along have no row.
    """
    builtin = packages.groupBy("entity_id").agg(F.max(F.coalesce(F.col("category").isin(*BUILTIN), F.lit(False))).alias("builtin")).where("NOT builtin")
    who = packages.select("entity_id", "consumer").distinct().join(builtin, "entity_id", "left_semi")
    per = who.join(matches(packages, dependencies, providers), ["entity_id", "consumer"], "left").groupBy("entity_id").agg(
        F.count("*").alias("consumers"), F.max("providers").alias("most"), F.count_if(F.col("providers") == 1).alias("led"),
        F.count_distinct(F.when(F.col("providers") == 1, F.col("provider"))).alias("ends"), F.min("provider").alias("provider"),
        F.count_if(F.coalesce("by_target", F.lit(False))).alias("targets"), F.min("dependency").alias("dependency"),
    )
    state = (
        F.when(F.col("most") > 1, "ambiguous").when((F.col("led") == 0) | (F.col("led") != F.col("consumers")) | F.col("led").isNull(), "none")
        .when(F.col("ends") > 1, "ambiguous").otherwise("linked")
    )
    linked = state == "linked"
    rule = F.when(F.col("targets") == F.col("consumers"), RULES[0]).otherwise(RULES[1])
    one = linked & (F.col("consumers") == 1) & (F.col("targets") == 1)
    return per.select(
        "entity_id", state.alias("state"), F.when(linked, F.col("provider")).alias("provider"), F.when(linked, rule).alias("rule"), "consumers",
        F.when(one, F.col("dependency")).alias("dependency"),
    )


def link_facts(linked: DataFrame, providers: DataFrame) -> DataFrame:
    """(predicate, entity_id, target, rule): an edge to the repository, and to its service unless an address decided."""
    rows = linked.where("state = 'linked'").join(providers.select(F.col("repo").alias("provider"), "service").distinct(), "provider")
    repo = rows.select(F.lit("RESOLVES_TO_REPO").alias("predicate"), "entity_id", F.col("provider").alias("target"), "rule")
    service = rows.where(F.col("service").isNotNull() & (F.col("rule") != RULES[0]))
    return repo.unionByName(service.select(F.lit("RESOLVES_TO_SERVICE").alias("predicate"), "entity_id", F.col("service").alias("target"), "rule"))


def link_evidence(linked: DataFrame, found: DataFrame, providers: DataFrame) -> DataFrame:
    """(entity_id, consumer, path, line): where each link is written.

    A link of several consumers by their addresses has a row for each, at its dependency; every other has one row, at
    the dependency that decided or else at the provider's manifest.
    """
    rows = linked.where("state = 'linked'")
    several = rows.where((F.col("rule") == RULES[0]) & (F.col("consumers") > 1)).select("entity_id")
    each = found.join(several, "entity_id", "left_semi").select("entity_id", "consumer", F.col("dependency.manifest_path").alias("path"), F.col("dependency.line_number").alias("line"))
    manifest = providers.groupBy(F.col("repo").alias("provider")).agg(F.min("manifest_path").alias("own"))
    single = rows.join(several, "entity_id", "left_anti").join(manifest, "provider", "left")
    single = single.select("entity_id", F.lit(None).cast("string").alias("consumer"), F.coalesce("dependency.manifest_path", "own").alias("path"), F.coalesce("dependency.line_number", F.lit(1)).alias("line"))
    return each.unionByName(single)


def classified(packages: DataFrame, dependencies: DataFrame, providers: DataFrame) -> DataFrame:
    """(entity_id, consumer, bucket, reason, spec_form, manifest_path, line_number): what each package is to each consumer."""
    both = F.array_union("aliases", F.array("package_name"))
    keys = providers.select("repo", F.explode(F.transform(both, C.package_name)).alias("key")).distinct()
    direct = _names(packages).join(keys, "key").where("repo <> consumer").select("entity_id", "consumer", "repo").distinct()
    declared = _matching(packages, dependencies, providers)
    one = declared.groupBy("entity_id", "consumer").agg(F.count("*").alias("declarations"), F.min("d").alias("d"))
    by_declared = one.where("declarations = 1").select("entity_id", "consumer", C.package_name("d.declared_name").alias("key")).join(keys, "key").where("repo <> consumer")
    to = one.where("declarations = 1 AND d.at_address = 1 AND d.address <> consumer").select("entity_id", "consumer", F.col("d.address").alias("repo"))
    hits = direct.unionByName(by_declared.select("entity_id", "consumer", "repo")).unionByName(to).distinct()
    hits = hits.groupBy("entity_id", "consumer").agg(F.count("*").alias("hits"))
    known = direct.select("entity_id", "consumer").distinct().withColumn("direct", F.lit(True))
    rows = packages.groupBy("entity_id", "consumer").agg(F.max("category").alias("category"), F.max("distribution").alias("distribution"))
    rows = rows.join(one, ["entity_id", "consumer"], "left").join(hits, ["entity_id", "consumer"], "left").join(known, ["entity_id", "consumer"], "left")
    form, n = F.col("d.spec_form"), F.coalesce("hits", F.lit(0))
    inferred = (F.col("category") == "third_party") & F.col("distribution").isNotNull() & F.col("direct").isNull()
    cases = (
        (F.col("category").isin(*BUILTIN), "builtin_or_stdlib", "extractor classified package as builtin or stdlib"),
        (F.col("declarations") > 1, "unknown", "multiple consumer manifest dependencies match the imported package"),
        ((F.col("declarations") == 1) & (n == 1) & F.col("d.at_address").isNotNull(), "candidate_internal", "consumer manifest dependency target matches exactly one fleet repo"),
        ((F.col("declarations") == 1) & (n == 1), "candidate_internal", "consumer manifest dependency matches exactly one fleet provider"),
        ((F.col("declarations") == 1) & (n > 1), "candidate_internal_ambiguous", "consumer manifest dependency matches multiple fleet providers"),
        ((F.col("declarations") == 1) & form.isin(*INTERNAL_FORMS), "consumer_manifest_external", "path, workspace, or git dependency has no matching fleet provider; treating as out-of-fleet"),
        ((F.col("declarations") == 1) & (form == "registry"), "consumer_manifest_external", "registry dependency has no matching fleet provider"),
        (F.col("declarations") == 1, "unknown", "consumer manifest dependency has unknown spec form"),
        (inferred, "code_inferred_external", "import normalizer classified package as third-party without a consumer manifest dependency"),
    )
    bucket, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, b, r in cases:
        bucket, reason = bucket.when(test, b), reason.when(test, r)
    single = lambda c: F.when((F.col("declarations") == 1) & ~F.coalesce(F.col("category").isin(*BUILTIN), F.lit(False)), F.col(f"d.{c}"))
    return rows.select(
        "entity_id", "consumer", bucket.otherwise("unknown").alias("bucket"), reason.otherwise("code import has no matching consumer manifest dependency").alias("reason"),
        single("spec_form").alias("spec_form"), single("manifest_path").alias("manifest_path"), single("line_number").alias("line_number"),
    )


def linkage_coverage(rows: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(consumer, entity_id, state, reason): where linking stopped short, from ``classified`` rows and unreadable manifests (consumer, manifest_path, reason)."""
    reason = (
        F.when(F.col("bucket") == "candidate_internal_ambiguous", "cross_repo_dependency_ambiguous_provider")
        .when(F.col("bucket") == "unknown", "cross_repo_dependency_unknown_category")
        .when((F.col("bucket") == "consumer_manifest_external") & F.col("spec_form").isin(*INTERNAL_FORMS), "cross_repo_dependency_no_provider")
    )
    out = rows.select("consumer", "entity_id", reason.alias("reason")).where("reason IS NOT NULL")
    if issues is not None:
        out = out.unionByName(issues.select("consumer", F.lit("-").alias("entity_id"), "reason"))
    return out.select("consumer", "entity_id", F.lit("partially_instrumented").alias("state"), "reason").distinct()


def runtime_links(targets: DataFrame, modules: DataFrame, existing: DataFrame) -> DataFrame:
    """(target, service, state): services whose module's path is the longest that ends a target's path; deploys that exist already are left out.

    ``targets`` (target, path), ``modules`` (service, path); ``existing`` (service, target).  One service is linked,
    several at the same length are candidates each.
    """
    ends = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.array_join(F.slice("steps", k, F.size("steps")), "/"))
    tries = targets.select("target", F.split(C.posix_path("path"), "/").alias("steps")).select("target", F.explode(ends).alias("path"))
    known = modules.select("service", C.posix_path("path").alias("path")).distinct()
    met = tries.join(known, "path").withColumn("length", F.char_length("path"))
    best = met.groupBy("target").agg(F.max("length").alias("length"))
    top = met.join(best, ["target", "length"]).select("target", "service").distinct()
    n = top.groupBy("target").agg(F.count("*").alias("n"))
    out = top.join(n, "target").join(existing.select("service", "target").distinct(), ["service", "target"], "left_anti")
    return out.select("target", "service", F.when(F.col("n") == 1, "canonical").otherwise("candidate").alias("state"))
