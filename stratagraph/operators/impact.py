"""What a change touches: models of a framework, guarded endpoints, an application's surfaces, and leads in other repositories.

``rows`` are facts with their ends flattened: predicate, subject_id, subject_repo, subject_module, subject_qualname,
object_id, object_repo, object_module, object_qualname, access_level.  ``entities`` have entity_id, kind, label, repo,
module, qualname, symbol_kind, path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import columns as C

#: Predicates of a framework's models and of authorisation, and the words that give a module its role.
MODEL_USES = ("SERIALIZES_MODEL", "HANDLES_MODEL", "TASK_USES_MODEL")
MODEL_ENDS = ("RELATES_TO_MODEL", *MODEL_USES)
FRAMEWORK = ("DECLARES_FIELD", *MODEL_ENDS)
AUTHZ = ("DEFINES_AUTHZ_POLICY", "APPLIES_AUTHZ_POLICY", "USES_AUTHZ_CHECK", "HANDLES_ENDPOINT")
ROLES = {
    "api": "api apis view views route routes url urls controller controllers", "serializer": "serializer serializers schema schemas",
    "worker": "task tasks worker workers job jobs consumer consumers processor processors", "model": "model models entity entities",
}
ROLE_ORDER = ("api", "serializer", "worker", "scheduled_job", "model")


def _inside(module: Column, qualname: Column, changed: DataFrame) -> Column:
    """Whether a changed symbol (repo, module, qualname) lies below the one of that module and name."""
    return (module == changed["changed_module"]) & F.startswith(changed["changed_qualname"], F.concat(qualname, F.lit(".")))


def impacted_models(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """(model): models that ``changed`` symbols (symbol_id, repo, module, qualname) are, declare a field of, lie in, or use.

    A changed symbol below a model, serializer, view or task counts as that; names meet by an equi join on the repository
    and module.
    """
    ids = changed.select(F.col("symbol_id").alias("id")).distinct()
    fields = rows.where("predicate = 'DECLARES_FIELD'")
    ends = rows.where(F.col("predicate").isin(*MODEL_ENDS))
    models = fields.select(F.col("subject_id").alias("id")).union(ends.select(F.col("object_id").alias("id"))).distinct()
    direct = models.join(ids, "id", "left_semi")
    by_field = fields.join(ids, fields["object_id"] == ids["id"], "left_semi").select(F.col("subject_id").alias("id"))
    uses = rows.where(F.col("predicate").isin(*MODEL_USES))
    by_use = uses.join(ids, uses["subject_id"] == ids["id"], "left_semi").select(F.col("object_id").alias("id"))
    said = changed.select(F.lower("repo").alias("changed_repo"), F.col("module").alias("changed_module"), F.col("qualname").alias("changed_qualname")).distinct()

    def below(df: DataFrame, side: str) -> DataFrame:
        at = [F.lower(F.col(f"{side}_repo")) == said["changed_repo"], _inside(F.col(f"{side}_module"), F.col(f"{side}_qualname"), said)]
        return df.join(said, at, "left_semi").select(F.col("object_id").alias("id"))

    parts = (direct, by_field, by_use, below(ends, "object"), below(uses, "subject"))
    return reduce(DataFrame.union, parts).distinct().withColumnRenamed("id", "model")


def framework_sections(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` with ``section``, of what concerns the impacted ``models``: fields, relations, serializers, views, tasks."""
    names = {"DECLARES_FIELD": "model_fields", "RELATES_TO_MODEL": "model_relations", "SERIALIZES_MODEL": "serializers", "HANDLES_MODEL": "views", "TASK_USES_MODEL": "tasks"}
    fields = rows.where("predicate = 'DECLARES_FIELD'").join(models, rows["subject_id"] == models["model"], "left_semi")
    to = rows.where(F.col("predicate").isin(*MODEL_ENDS)).join(models, rows["object_id"] == models["model"], "left_semi")
    own = fields.select(F.col("object_id").alias("field")).distinct()
    from_ = rows.where("predicate = 'RELATES_TO_MODEL'").join(own, rows["subject_id"] == own["field"], "left_semi")
    out = fields.unionByName(to).unionByName(from_).distinct()
    section = reduce(lambda acc, kv: acc.when(F.col("predicate") == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    return out.withColumn("section", section)


def model_paths(rows: DataFrame, models: DataFrame, depth: int = 2) -> DataFrame:
    """(path, field): relations that lead from an impacted model to another in ``depth`` steps at most, no model entered twice from one step on."""
    fields = rows.where("predicate = 'DECLARES_FIELD'").select(F.col("subject_id").alias("from"), F.col("object_id").alias("field")).distinct()
    targets = rows.where("predicate = 'RELATES_TO_MODEL'").groupBy(F.col("subject_id").alias("field")).agg(F.max("object_id").alias("to"))
    edges = fields.join(targets, "field")
    seen = models.select(F.col("model").alias("node"))
    front = models.select(F.array("model").alias("path"), F.col("model").alias("node"))
    found = []
    for _ in range(depth):
        step = front.join(edges, front["node"] == edges["from"]).select(F.array_append("path", F.col("to")).alias("path"), "field", F.col("to").alias("node"))
        found.append(step.select("path", "field"))
        fresh = step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        seen = seen.union(fresh.select("node"))
        front = fresh.select("path", "node")
    return reduce(DataFrame.union, found)


def endpoint_authorization(rows: DataFrame) -> DataFrame:
    """(endpoint, handler, status, public, policies, checks): what guards each handler, on itself or on a method one step below it.

    Status is declared_public if all that is said is public, authz_evidence_found if anything is said, else
    missing_declared_policy, which is a lead and no proof of open access.
    """
    handlers = rows.where("predicate = 'HANDLES_ENDPOINT'").select(F.col("object_id").alias("endpoint"), F.col("subject_id").alias("handler"), F.col("subject_module").alias("module"), F.col("subject_qualname").alias("qualname")).distinct()
    said = rows.where(F.col("predicate").isin("APPLIES_AUTHZ_POLICY", "USES_AUTHZ_CHECK"))
    said = said.select("predicate", "subject_id", "object_id", F.col("subject_module").alias("module"), F.col("subject_qualname").alias("qualname"), "access_level").distinct()
    own = handlers.join(said.drop("module", "qualname"), handlers["handler"] == said["subject_id"])
    above = said.where(F.contains("qualname", F.lit("."))).withColumn("qualname", F.regexp_replace("qualname", r"\.[^.]*$", ""))
    below = handlers.join(above, ["module", "qualname"])
    columns = ["endpoint", "handler", "predicate", "subject_id", "object_id", "access_level"]
    both = own.select(*columns).union(below.select(*columns)).distinct()
    per = both.groupBy("endpoint", "handler").agg(
        F.count_if(F.col("predicate") == "APPLIES_AUTHZ_POLICY").alias("policies"), F.count_if(F.col("predicate") == "USES_AUTHZ_CHECK").alias("checks"),
        F.collect_set("access_level").alias("levels"),
    )
    out = handlers.select("endpoint", "handler").distinct().join(per, ["endpoint", "handler"], "left").na.fill(0, ["policies", "checks"])
    levels = F.coalesce("levels", F.array().cast("array<string>"))
    public = F.array_contains(levels, "public")
    status = F.when((F.size(levels) == 1) & public, "declared_public").when(F.col("policies") + F.col("checks") > 0, "authz_evidence_found").otherwise("missing_declared_policy")
    return out.select("endpoint", "handler", status.alias("status"), public.alias("public"), "policies", "checks")


#: What makes a guarded endpoint worth a look, and how much.
LEADS = (("declared_public", 100), ("missing_declared_policy", 80), ("public_policy_present", 75))


def authz_leads(authorization: DataFrame) -> DataFrame:
    """(endpoint, handler, lead, priority): endpoints that are public, partly public or unguarded as far as is known."""
    lead = (
        F.when(F.col("status") == "declared_public", "declared_public").when(F.col("public"), "public_policy_present").when(F.col("status") == "missing_declared_policy", "missing_declared_policy")
    )
    priority = reduce(lambda acc, kv: acc.when(F.col("lead") == kv[0], kv[1]), LEADS, F.when(F.lit(False), 0))
    return authorization.select("endpoint", "handler", lead.alias("lead")).where("lead IS NOT NULL").withColumn("priority", priority)


def role(module: Column, path: Column, symbol_kind: Column) -> Column:
    """The first role that the parts of a module or path give: ROLE_ORDER; null for none."""
    parts = lambda x, by: F.transform(F.split(F.coalesce(x, F.lit("")), by), C.normal_token)
    words = F.array_union(parts(module, r"\."), parts(path, "/"))
    commands = F.array(F.lit("management"), F.lit("commands"))
    out = None
    for name in ROLE_ORDER:
        if name == "scheduled_job":
            hit = C.has_run(parts(module, r"\."), commands) | C.has_run(parts(path, "/"), commands)
        else:
            hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ROLES[name].split()]))
        if name == "model":
            hit = hit & (F.coalesce(symbol_kind, F.lit("")) != "django_field")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def lead_terms(root: str) -> list[str]:
    """A namespace's name, and its singular."""
    plain = "".join(c for c in root.lower() if c.isalnum())
    if not plain:
        return []
    one = plain[:-3] + "y" if plain.endswith("ies") and len(plain) > 3 else plain[:-1] if plain.endswith("s") and len(plain) > 3 else plain
    return sorted({plain, one})


def _under(module: Column, path: Column, roots: list[str]) -> Column:
    test = F.lit(False)
    for r in roots:
        bare = F.regexp_replace(F.coalesce(path, F.lit("")), r"^/+|/+$", "")
        test = test | (module == r) | F.startswith(module, F.lit(f"{r}.")) | (bare == r) | F.startswith(bare, F.lit(f"{r}/"))
    return F.coalesce(test, F.lit(False))


def application_surfaces(entities: DataFrame, repo: str, roots: list[str]) -> DataFrame:
    """``entities`` of the repository below one of the namespaces, with their ``role``."""
    rows = entities.where((F.lower("repo") == repo.lower()) & _under(F.col("module"), F.col("path"), roots))
    return rows.withColumn("role", role(F.col("module"), F.col("path"), F.col("symbol_kind")))


def cross_repo_leads(entities: DataFrame, repo: str, roots: list[str], limit: int) -> DataFrame:
    """(repo, entity_id, label, terms, basis, round): entities of other repositories that are named like the namespaces, a repository after the other.

    Tests are left out.  A service, or what has a role, also counts if only its repository is named so.
    """
    terms = F.array(*[F.lit(t) for t in sorted({t for r in roots for t in lead_terms(r)})]).cast("array<string>")
    rows = entities.where((F.lower("repo") != repo.lower()) & F.col("kind").isin("CodeModule", "CodeSymbol", "Service"))
    rows = rows.where(~F.coalesce(C.is_test_path("path"), F.lit(False)))
    bare = F.when(C.normal_token(F.substring_index("module", ".", 1)) == C.normal_token("repo"), F.regexp_replace("module", r"^[^.]*\.?", "")).otherwise(F.col("module"))
    none = F.array().cast("array<string>")
    said = reduce(F.array_union, [F.coalesce(C.tokens(x), none) for x in (bare, F.col("path"), F.col("qualname"))])
    direct, by_repo = F.array_intersect(terms, said), F.array_intersect(terms, C.tokens("repo"))
    known = (F.col("kind") == "Service") | role(F.col("module"), F.col("path"), F.col("symbol_kind")).isNotNull()
    rows = rows.withColumn("terms", F.when(F.size(direct) > 0, direct).when(known, by_repo)).withColumn(
        "basis", F.when(F.size(direct) > 0, "name_derived_unlinked_lead").otherwise("repo_name_derived_unlinked_lead")
    )
    rows = rows.where(F.size("terms") > 0).select("repo", "entity_id", "label", F.array_join(F.array_sort("terms"), ",").alias("terms"), "basis").distinct()
    place = F.row_number().over(Window.partitionBy(F.lower("repo")).orderBy("label", "entity_id"))
    return rows.withColumn("round", place).where(F.col("round") <= limit).orderBy("round", F.lower("repo")).limit(limit)
