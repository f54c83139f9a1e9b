"""Questions put to a snapshot: each verb is a plan over its tables and an answer for the caller.

An answer is a dict with ``status`` (ok, ambiguous, not_found) and rows.  Only
limited rows and small counts reach the driver.  An ambiguous name gives its
candidates and no result; ``not_found`` doesn't prove absence.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.functions import columns as C
from stratagraph.operators import aggregate, joins, traversal
from stratagraph.operators.lineage import cut
from stratagraph.sources.snapshot import read_snapshot

MAX_LIMIT, MAX_DEPTH = 500, 6
CALLABLE = ("function", "method", "class")
TIERS = ("exact_qualified", "exact_name", "fuzzy")
PATH_PREDICATES = ("CALLS", "IMPORTS", "DEFINED_IN", "RESOLVES_TO_REPO", "RESOLVES_TO_SERVICE")
DIRECTED = ("PRODUCES_EVENT", "CONSUMES_EVENT")
GAPS = ("uninstrumented", "partially_instrumented", "stale")


def clamp(n: int, most: int = MAX_LIMIT) -> int:
    return max(1, min(int(n), most))


def listed(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _label() -> Column:
    """What an entity is called, by kind."""
    i = lambda k: F.col("identity")[k]
    return (
        F.when(F.col("kind").isin("CodeSymbol"), F.concat_ws(".", i("module"), i("qualname")))
        .when(F.col("kind") == "ExternalSymbol", F.concat_ws(".", i("module"), i("name")))
        .when(F.col("kind") == "CodeModule", i("module"))
        .when(F.col("kind") == "Service", i("slug"))
        .when(F.col("kind") == "Endpoint", F.concat_ws(" ", F.nullif(i("host"), F.lit("_")), i("method"), i("path")))
        .when(F.col("kind") == "EventChannel", F.concat_ws(":", i("broker_kind"), i("channel_address")))
        .when(F.col("kind") == "DeployTarget", F.concat_ws(":", i("type"), i("target")))
        .otherwise(i("name"))
    )


def aggregation_label() -> Column:
    """What the aggregations call an entity: as above but for endpoints, deploy targets and variables, which go by name, slug or the whole identity."""
    i = F.col("identity")
    plain = F.coalesce(F.nullif(i["name"], F.lit("")), F.nullif(i["slug"], F.lit("")), C.canonical_json("identity"))
    return F.when(F.col("kind").isin("CodeSymbol", "CodeModule", "ExternalSymbol", "EventChannel"), _label()).otherwise(plain)


class Graph:
    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.facts, self.evidence, self.coverage = tables["facts"], tables["evidence"], tables["coverage"]

    @classmethod
    def load(cls, spark: SparkSession, root: str, form: str = "parquet") -> Graph:
        return cls(read_snapshot(spark, root, form))

    @cached_property
    def entities(self) -> DataFrame:
        return self.tables["entities"].withColumn("label", _label())

    @cached_property
    def joined(self) -> DataFrame:
        """Facts with the kind, label, identity and status of both ends; a fact without an end is left out."""
        return self._with_ends(self.facts)

    def _with_ends(self, facts: DataFrame) -> DataFrame:
        def end(side: str) -> DataFrame:
            names = {"entity_id": f"{side}_id", "kind": f"{side}_kind", "label": f"{side}_label", "identity": f"{side}_identity", "canonical_status": f"{side}_status"}
            return self.entities.select(*[F.col(a).alias(b) for a, b in names.items()])

        return facts.join(end("subject"), "subject_id").join(end("object"), "object_id")

    def _facts(self, *predicates: str) -> DataFrame:
        return self.joined.where(F.col("predicate").isin(*predicates))

    def _canonical(self, df: DataFrame) -> DataFrame:
        return df.where(" AND ".join(f"{c} = 'canonical'" for c in ("canonical_status", "subject_status", "object_status")))

    def _edges(self) -> DataFrame:
        return self.facts.where("predicate = 'CALLS'").select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "ordinal", "fact_id")

    @staticmethod
    def _in_order(df: DataFrame, limit: int, *columns: str) -> list[dict]:
        return listed(df.orderBy("ordinal", "fact_id").limit(clamp(limit)).select("fact_id", "predicate", "subject_label", "object_label", *columns))

    # symbols

    def _symbols(self) -> DataFrame:
        rows = self.entities.where(F.col("kind").isin("CodeSymbol", "ExternalSymbol"))
        name = F.when(F.col("kind") == "CodeSymbol", F.substring_index(F.col("identity")["qualname"], ".", -1)).otherwise(F.col("identity")["name"])
        where = self.evidence.where("target_type = 'entity' AND bytes_ref IS NOT NULL")
        where = aggregate.first_wins(where.select("target_id", "ordinal", "bytes_ref"), ["target_id"], F.col("ordinal"))
        where = where.select(F.col("target_id").alias("entity_id"), C.normal_path("bytes_ref.path").alias("path"), "bytes_ref.line_start", "bytes_ref.line_end")
        return rows.withColumn("name", name).join(where, "entity_id", "left")

    def _matching(self, symbol: str, path: str | None, line: int | None, fuzzy: bool) -> DataFrame:
        """Every symbol that matches, with its tier."""
        tier = F.when(F.col("label") == symbol, 0).when(F.col("name") == symbol, 1)
        if fuzzy:
            tier = tier.when(F.contains(F.lower("label"), F.lit(symbol.lower())), 2)
        found = self._symbols().withColumn("tier", tier).where("tier IS NOT NULL")
        if path is not None:
            found = found.where(F.col("path") == C.normal_path(F.lit(path)))
        if line is not None:
            found = found.where(F.lit(line).between(F.col("line_start"), F.col("line_end")))
        return found

    def _resolve(self, symbol: str, path: str | None, line: int | None, limit: int, fuzzy: bool) -> tuple[str, str, list[dict], int]:
        """(status, tier, candidates, how many): the best tier's matches."""
        found = self._matching(symbol, path, line, fuzzy)
        best = found.agg(F.min("tier").alias("t"), F.count("*").alias("n")).first()  # one row
        if best["t"] is None:
            return "not_found", "", [], 0
        rows = found.where(F.col("tier") == best["t"])
        n = rows.count()
        rows = rows.orderBy("path", "line_start", "label", "ordinal", "entity_id").limit(clamp(limit))  # the limit cuts ties in the snapshot's order
        shown = listed(rows.select("entity_id", "kind", "label", "path", "line_start", "line_end"))
        return ("ok" if n == 1 else "ambiguous"), TIERS[best["t"]], shown, n

    def lookup_symbol(self, symbol: str, path: str | None = None, line: int | None = None, limit: int = 25) -> dict:
        status, tier, rows, n = self._resolve(symbol, path, line, limit, True)
        return {"status": status, "tier": tier, "match_count": n, "matches": rows}

    def symbols_in_file(self, path: str, limit: int = 100) -> dict:
        rows = self._symbols().where(F.col("path") == C.normal_path(F.lit(path))).orderBy("line_start", "label").limit(clamp(limit))
        rows = listed(rows.select("entity_id", "label", "line_start", "line_end"))
        return {"status": "ok" if rows else "not_found", "symbols": rows}

    def _targets(self, symbol: str, path: str | None, line: int | None, include_all: bool, limit: int, every: bool = False) -> tuple[dict, DataFrame | None]:
        status, tier, rows, n = self._resolve(symbol, path, line, limit, False)
        answer = {"status": status, "tier": tier, "match_count": n}
        if every and n > len(rows):  # those that the limit leaves out of the list too
            nodes = self._matching(symbol, path, line, False).where(F.col("tier") == TIERS.index(tier)).select(F.col("entity_id").alias("node"))
            return answer | {"status": "ok"}, nodes
        if status == "ok" or (status == "ambiguous" and (include_all or every)):  # all: those listed, so a small limit narrows them
            nodes = self.facts.sparkSession.createDataFrame([(r["entity_id"],) for r in rows], "node string")
            return answer | {"status": "ok"}, nodes
        return answer | {"candidates": rows}, None

    def _neighbours(self, side: str, symbol: str, path, line, include_all, limit, every: bool = False) -> dict:
        answer, nodes = self._targets(symbol, path, line, include_all, limit, every)
        if nodes is None:
            return answer
        nodes = nodes if every else F.broadcast(nodes)  # at most MAX_LIMIT nodes unless every match is one
        rows = self._in_order(self._facts("CALLS").join(nodes, F.col(side) == F.col("node"), "left_semi"), limit)
        return answer | {"count": len(rows), "rows": rows}

    def find_callers(self, symbol: str, path: str | None = None, line: int | None = None, include_all: bool = False, limit: int = 25, every: bool = False) -> dict:
        """The first calls of a symbol; with include_all of the matches that the limit lists, with every of all matches."""
        return self._neighbours("object_id", symbol, path, line, include_all, limit, every)

    def find_callees(self, symbol: str, path: str | None = None, line: int | None = None, include_all: bool = False, limit: int = 25) -> dict:
        return self._neighbours("subject_id", symbol, path, line, include_all, limit)

    def blast_radius(self, symbol: str, path=None, line=None, include_all: bool = False, depth: int = 2, limit: int = 25) -> dict:
        answer, nodes = self._targets(symbol, path, line, include_all, limit)
        if nodes is None:
            return answer
        edges = traversal.walked_edges(self._edges(), nodes, clamp(depth, MAX_DEPTH)).select("fact_id", "depth")
        rows = self.joined.join(edges, "fact_id").orderBy("depth", "ordinal").limit(clamp(limit))
        rows = listed(rows.select("depth", "fact_id", "subject_label", "object_label"))
        return answer | {"edge_count": len(rows), "edges": rows}

    def _bridged(self) -> DataFrame:
        """Backward call edges; who calls a class is a caller of its constructor too."""
        back = traversal.backward(self._edges()).select("src", "dst", "ordinal")
        keys = ["tenant", "repo", "module"]
        code = self.entities.where("kind = 'CodeSymbol'").select("entity_id", *[F.col("identity")[k].alias(k) for k in (*keys, "qualname")])
        init = code.where("qualname LIKE '%.\\\\_\\\\_init\\\\_\\\\_'").withColumn("qualname", F.regexp_replace("qualname", r"\.__init__$", ""))
        pairs = init.withColumnRenamed("entity_id", "ctor").join(code.withColumnRenamed("entity_id", "cls"), [*keys, "qualname"])
        both = pairs.select(F.col("ctor").alias("a"), F.col("cls").alias("b")).union(pairs.select("cls", "ctor"))
        more = back.join(both, back["src"] == both["b"]).select(F.col("a").alias("src"), "dst", "ordinal")
        return back.union(more).distinct()

    def reverse_impact(self, symbol: str, path=None, line=None, include_all: bool = False, depth: int = 3, limit: int = 25) -> dict:
        answer, nodes = self._targets(symbol, path, line, include_all, limit)
        if nodes is None:
            return answer
        back = self._bridged()
        found = traversal.reach(back, nodes, clamp(depth, MAX_DEPTH)).where("depth > 0")
        kind = F.col("identity")["symbol_kind"]
        rows = found.join(self.entities.select(F.col("entity_id").alias("node"), "label", kind.alias("symbol_kind")), "node")
        called = back.select(F.col("src").alias("node")).distinct().withColumn("called", F.lit(True))
        rows = rows.join(called, "node", "left")
        terminal = F.when(F.col("called").isNull(), "no_incoming").when(F.col("depth") == clamp(depth, MAX_DEPTH), "max_depth")
        rows = rows.withColumn("terminal", terminal).withColumn("affected", F.coalesce(F.col("symbol_kind").isin(*CALLABLE), F.lit(False)))
        tiers = listed(rows.where("affected").groupBy("depth").agg(F.count("*").alias("n")).orderBy("depth"))
        shown = listed(rows.orderBy("depth", "label").limit(clamp(limit)).select("depth", "label", "affected", "terminal"))
        return answer | {"tiers": tiers, "rows": shown}

    def evidence_for_call(self, caller: str, callee: str, path=None, line=None, limit: int = 25) -> dict:
        a, first = self._targets(caller, None, None, False, limit)
        b, second = self._targets(callee, None, None, False, limit)
        if first is None or second is None:
            return {"status": a["status"] if first is None else b["status"], "caller": a, "callee": b}
        calls = self.facts.where("predicate = 'CALLS'").join(F.broadcast(first), F.col("subject_id") == F.col("node"), "left_semi")
        calls = calls.join(F.broadcast(second), F.col("object_id") == F.col("node"), "left_semi")
        seen = self.evidence.where("target_type = 'fact'").join(calls.select(F.col("fact_id").alias("target_id")), "target_id", "left_semi")
        if path is not None:
            seen = seen.where(C.normal_path("bytes_ref.path") == C.normal_path(F.lit(path)))
        if line is not None:
            seen = seen.where(F.lit(line).between(F.col("bytes_ref.line_start"), F.col("bytes_ref.line_end")))
        rows = listed(seen.orderBy("ordinal").limit(clamp(limit)).select("evidence_id", "target_id", "derivation_class", "source_system", "bytes_ref"))
        return {"status": "ok" if rows else "not_found", "evidence": rows}

    def evidence_for_any_call(self, caller: str, limit: int = 25) -> list[dict]:
        """Evidence of each call that one symbol makes, in order."""
        _, nodes = self._targets(caller, None, None, False, limit)
        if nodes is None:
            return []
        calls = self.facts.where("predicate = 'CALLS'").join(F.broadcast(nodes), F.col("subject_id") == F.col("node"), "left_semi")  # one node
        seen = self.evidence.where("target_type = 'fact'").join(calls.select(F.col("fact_id").alias("target_id")), "target_id", "left_semi")
        return listed(seen.orderBy("ordinal").limit(clamp(limit)).select("evidence_id", "target_id", "derivation_class", "source_system", "bytes_ref"))

    def module_samples(self, prefix: str, most: int = 5) -> DataFrame:
        """(module, label): of each module that begins so, the first labels in order."""
        rows = self.entities.where("kind = 'CodeSymbol'").select(F.col("identity")["module"].alias("module"), "label").distinct()
        place = F.row_number().over(Window.partitionBy("module").orderBy("label"))
        return rows.where(F.startswith("module", F.lit(prefix))).withColumn("place", place).where(F.col("place") <= most).drop("place")

    # imports

    def _imports(self) -> DataFrame:
        q = F.col("qualifier")
        names = F.array("object_label", q["import_root"], q["distribution_name"], q["module_name"], q["raw_import"])
        return self._facts("IMPORTS").withColumns({"category": F.coalesce(q["category"], F.lit("unknown")), "names": F.transform(names, F.lower)})

    def _importing(self, target: str) -> DataFrame:
        return self._imports().where(F.array_contains("names", F.lit(target.lower())))

    def modules_importing(self, package: str, limit: int = 25) -> dict:
        rows = self._in_order(self._importing(package), limit, "category")
        return {"status": "ok" if rows else "not_found", "modules": rows}

    def who_imports(self, target: str, group_prefix_depth: int = 2, grouping: bool = True, limit: int = 25) -> dict:
        rows = self._importing(target).select("subject_label", "ordinal").orderBy("subject_label", "ordinal").limit(clamp(limit))  # limited, then grouped
        if grouping:
            rows = rows.groupBy(F.substring_index("subject_label", ".", group_prefix_depth).alias("prefix")).agg(F.count("*").alias("n")).orderBy("prefix")
        out = listed(rows)
        return {"status": "ok" if out else "not_found", "rows": out}

    def dependency_info(self, package: str) -> dict:
        rows = self._importing(package)
        top = aggregate.last_wins(rows.withColumn("name", F.col("object_label")), ["name"], F.col("ordinal"), "category", "fact_id").orderBy("name")
        out = listed(top.limit(MAX_LIMIT))
        return {"status": "ok" if out else "not_found", "packages": out}

    def top_dependencies(self, limit: int = 25, include_stdlib: bool = False, include_unknown: bool = False) -> dict:
        skip = [c for c, on in (("stdlib", include_stdlib), ("node_builtin", include_stdlib), ("unknown", include_unknown)) if not on]
        rows = self._canonical(self._imports()).where(~F.col("category").isin(*skip, "")) if skip else self._canonical(self._imports())
        return {"status": "ok", "dependencies": listed(aggregate.top_counts(rows, "object_label", clamp(limit)))}

    def top_internal_dependencies(self, relative_only: bool = False, limit: int = 25) -> dict:
        kinds = ("relative_internal_module",) if relative_only else ("internal_module", "relative_internal_module")
        rows = self._canonical(self._imports()).where(F.col("category").isin(*kinds))
        return {"status": "ok", "dependencies": listed(aggregate.top_counts(rows, "object_label", clamp(limit), "subject_label", "importers"))}

    def top_fan_in_symbols(self, include_external: bool = False, limit: int = 25) -> dict:
        kinds = ("CodeSymbol", "ExternalSymbol") if include_external else ("CodeSymbol",)
        rows = self._canonical(self._facts("CALLS")).where(F.col("object_kind").isin(*kinds))
        return {"status": "ok", "symbols": listed(aggregate.top_counts(rows, "object_label", clamp(limit), "subject_label", "callers"))}

    def modules_importing_both(self, left: str, right: str, category: str | None = None, limit: int = 25) -> dict:
        rows = self._imports() if category is None else self._imports().where(F.col("category").isin(*category.split(",")))
        has = lambda t: F.array_contains("names", F.lit(t.lower()))
        each = rows.groupBy("subject_label").agg(F.count_if(has(left)).alias("first_facts"), F.count_if(has(right)).alias("second_facts"))  # a row may be of both
        out = listed(each.where("first_facts > 0 AND second_facts > 0").orderBy("subject_label").limit(clamp(limit)))
        return {"status": "ok" if out else "not_found", "modules": out}

    def dependency_path(self, source: str, target: str, max_depth: int = 4, limit: int = 5) -> dict:
        ends = []
        for name in (source, target):
            found = self.entities.where((F.col("label") == name) | (F.col("entity_id") == name)).select(F.col("entity_id").alias("node"))
            n = found.limit(2).count()
            if n != 1:
                return {"status": "not_found" if n == 0 else "ambiguous", "name": name}
            ends.append(found)
        edges = self._canonical(self._facts(*PATH_PREDICATES)).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")).distinct()
        paths = traversal.simple_paths(edges, ends[0], ends[1], clamp(max_depth, MAX_DEPTH), clamp(limit, 25))
        named = paths.orderBy("steps", "path").limit(clamp(limit, 25)).withColumn("id", F.monotonically_increasing_id())
        labels = self.entities.select(F.col("entity_id").alias("node"), "label")
        rows = named.select("id", "steps", F.posexplode("path").alias("at", "node")).join(labels, "node")
        rows = rows.groupBy("id", "steps").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("path"))
        out = listed(rows.orderBy("steps", "path").select("steps", "path"))
        return {"status": "ok" if out else "not_found", "paths": out}

    # links, domains, endpoints, events, deploys

    def cross_repo_links(self, limit: int = 25) -> dict:
        rows = self._facts("RESOLVES_TO_REPO", "RESOLVES_TO_SERVICE").orderBy("subject_label", "object_label", "predicate")
        return {"status": "ok", "link_count": rows.count(), "links": listed(rows.limit(clamp(limit)).select("fact_id", "predicate", "subject_label", "object_label"))}

    def repo_dependencies(self, repo: str, limit: int = 25) -> dict:
        rows = self._facts("RESOLVES_TO_REPO", "RESOLVES_TO_SERVICE")
        rows = rows.where(C.repo_matches(F.coalesce(F.col("qualifier")["consumer_repo"], F.col("subject_identity")["repo"]), F.lit(repo)))
        out = self._in_order(rows, limit)
        return {"status": "ok" if out else "not_found", "links": out}

    def domain_references(self, domain: str, limit: int = 25) -> dict:
        hit = F.contains(F.lower("label"), F.lit(domain.lower()))
        nodes = self.entities.where((F.col("kind") == "Domain") & hit).select(F.col("entity_id").alias("node"))
        ends = self.facts.select("fact_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("node"))
        near = ends.join(nodes, "node", "left_semi").select("fact_id").distinct()
        kinds = self.entities.where("kind = 'EnvVar'").select(F.col("entity_id").alias("node"))
        env = ends.join(near, "fact_id", "left_semi").join(kinds, "node", "left_semi").select("node").distinct()
        wanted = cut(ends.join(nodes.union(env).distinct(), "node", "left_semi").select("fact_id").distinct())
        rows = self._with_ends(self.facts.join(wanted, "fact_id", "left_semi"))
        return {"status": "ok", "reference_count": rows.count(), "references": self._in_order(rows, limit)}

    def _endpoints(self) -> DataFrame:
        rows = self._facts("EXPOSES_ENDPOINT", "CALLS_ENDPOINT", "DOCUMENTS_ENDPOINT").where("object_kind = 'Endpoint'")
        i = F.col("object_identity")
        return rows.withColumns({"method": i["method"], "route": i["path"], "shape": C.path_shape(i["path"]), "repo": i["repo"]})

    def endpoints(self, path: str | None = None, limit: int = 25) -> dict:
        rows = self._endpoints() if path is None else self._endpoints().where(F.contains("route", F.lit(path)))
        out = listed(rows.orderBy("route", "method", "predicate", "ordinal").limit(clamp(limit)).select("predicate", "method", "route", "subject_label"))
        return {"status": "ok", "endpoint_fact_count": rows.count(), "endpoints": out}

    def event_channels(self, channel: str | None = None, limit: int = 25) -> dict:
        rows = self.joined.where("object_kind = 'EventChannel'")
        if channel is not None:
            rows = rows.where(F.contains(F.lower("object_label"), F.lit(channel.lower())))
        known = F.col("predicate").isin(*DIRECTED) & (F.col("canonical_status") == "canonical") & (F.col("object_status") == "canonical")
        rows = rows.withColumn("linkage", F.when(known, "known_linked").otherwise("candidate"))
        out = listed(rows.orderBy(F.desc("linkage"), "object_label", "predicate", "ordinal").limit(clamp(limit)).select("linkage", "predicate", "subject_label", "object_label"))
        return {"status": "ok", "channels": out}

    def deploy_mappings(self, target: str | None = None, limit: int = 25) -> dict:
        rows = self._facts("DEPLOYS_VIA_CONFIG", "ROUTES_DOMAIN_TO_DEPLOY")
        if target is not None:
            rows = rows.where(F.contains(F.lower("object_label"), F.lit(target.lower())))
        known = (F.col("predicate") == "DEPLOYS_VIA_CONFIG") & (F.col("canonical_status") == "canonical")
        rows = rows.withColumn("linkage", F.when(known, "known_linked").otherwise("unlinked"))
        out = listed(rows.orderBy("object_label", "predicate", "ordinal").limit(clamp(limit)).select("linkage", "predicate", "subject_label", "object_label"))
        return {"status": "ok", "mappings": out}

    def _contract_side(self, key: str, predicates: list[str], repos: list[str] | None, prefix: str | None) -> DataFrame:
        rows = self._facts(*predicates)
        i = F.col("object_identity")
        made = {"endpoint_path": C.path_shape(i["path"]), "event_channel": i["channel_address"], "display_name": F.col("object_label")}[key]
        rows = rows.withColumn("key", made).where("key IS NOT NULL")
        if repos:
            test = F.lit(False)
            for r in repos:
                test = test | C.repo_matches(F.coalesce(i["repo"], F.col("subject_identity")["repo"]), F.lit(r))
            rows = rows.where(test)
        return rows if prefix is None else rows.where(C.has_path_prefix("key", C.path_shape(F.lit(prefix))))

    def reconcile_contract(self, name: str, identity_key: str, left_predicate: list[str], right_predicate: list[str], left_name: str = "left", right_name: str = "right",
                           left_repo=None, right_repo=None, left_path_prefix=None, right_path_prefix=None, limit: int = 100) -> dict:
        left = self._contract_side(identity_key, left_predicate, left_repo, left_path_prefix)
        right = self._contract_side(identity_key, right_predicate, right_repo, right_path_prefix)
        both = joins.reconciled(left, right, "key")
        counts = {r["side"]: r["n"] for r in both.groupBy("side").agg(F.count("*").alias("n")).collect()}
        only = {s: both.where(F.col("side") == f"{s}_only").select("key") for s in ("left", "right")}
        fuzzy = joins.possible_matches(only["left"], only["right"], "key")
        warnings = [f"{label} has no rows" for label, s in ((left_name, "left"), (right_name, "right")) if not (counts.get("matched", 0) + counts.get(f"{s}_only", 0))]
        sample = lambda side: [r["key"] for r in both.where(F.col("side") == side).orderBy("key").limit(clamp(limit)).collect()]
        return {
            "status": "ok", "name": name, "counts": counts, "warnings": warnings, "matched": sample("matched"), f"{left_name}_only": sample("left_only"),
            f"{right_name}_only": sample("right_only"), "possible_matches": listed(fuzzy.orderBy("left_key").limit(clamp(limit))),
        }

    def reconcile_endpoints(self, docs_repo=None, backend_repo=None, client_repo=None, path_prefix=None) -> dict:
        args = {"identity_key": "endpoint_path", "left_predicate": ["DOCUMENTS_ENDPOINT"], "left_name": "docs", "left_repo": docs_repo, "left_path_prefix": path_prefix, "right_path_prefix": path_prefix}
        backend = self.reconcile_contract("docs_backend", right_predicate=["EXPOSES_ENDPOINT"], right_name="backend", right_repo=backend_repo, **args)
        clients = self.reconcile_contract("docs_clients", right_predicate=["CALLS_ENDPOINT"], right_name="clients", right_repo=client_repo, **args)
        return {"status": "ok", "docs_backend": backend, "docs_clients": clients}

    # whole snapshot

    def summary(self) -> dict:
        kinds = {r[0]: r[1] for r in self.entities.groupBy("kind").count().collect()}
        predicates = {r[0]: r[1] for r in self.facts.groupBy("predicate").count().collect()}
        states = {r[0]: r[1] for r in self.coverage.groupBy("state").count().collect()}
        return {"status": "ok", "entities": kinds, "facts": predicates, "coverage": states, "gaps": self.coverage_gaps()["gaps"]}

    def coverage_gaps(self, limit: int = 100) -> dict:
        rows = self.coverage.where(F.col("state").isin(*GAPS)).orderBy("predicate", "state", "coverage_id").limit(clamp(limit))
        return {"status": "ok", "gaps": listed(rows.select("coverage_id", "predicate", "state", "scope_ref"))}

    # packets

    def service_brief(self, service: str, limit: int = 10) -> dict:
        """What a service exposes, calls, produces, consumes, refers to and runs on; several matching services are reported instead."""
        found = self.entities.where((F.col("kind") == "Service") & F.contains(F.lower("label"), F.lit(service.lower())))
        rows = listed(found.orderBy("label").limit(clamp(limit)).select("entity_id", "label"))
        if len(rows) != 1:
            return {"status": "ambiguous" if rows else "not_found", "services": rows}
        mine = self.joined.where(F.col("subject_id") == rows[0]["entity_id"])
        place = F.row_number().over(Window.partitionBy("predicate").orderBy("ordinal"))
        top = listed(mine.withColumn("place", place).where(F.col("place") <= clamp(limit)).orderBy("predicate", "place").select("predicate", "object_label", "canonical_status"))
        counts = {r[0]: r[1] for r in mine.groupBy("predicate").count().collect()}
        sections: dict[str, list] = {}
        for r in top:
            sections.setdefault(r.pop("predicate"), []).append(r)
        return {"status": "ok", "service": rows[0]["label"], "counts": counts, "sections": sections}

    def planning_context(self, term: str, limit: int = 5) -> dict:
        """What a term names, over all kinds in one scan, and the facts around it if that is one entity alone."""
        last = F.substring_index(F.substring_index(F.lower("label"), "/", -1), ".", -1)
        rows = self.entities.where((F.lower("label") == term.lower()) | (last == term.lower()))
        place = F.row_number().over(Window.partitionBy("kind").orderBy("label", "entity_id"))
        n = F.count("*").over(Window.partitionBy("kind"))
        shown = listed(rows.withColumns({"place": place, "n": n}).where(F.col("place") <= clamp(limit)).select("kind", "n", "entity_id", "label").orderBy("kind", "label"))
        if not shown:
            return {"status": "not_found", "matches": []}
        if len(shown) > 1 or shown[0]["n"] > 1:
            return {"status": "ambiguous", "matches": shown}
        at = shown[0]["entity_id"]
        near = self.joined.where((F.col("subject_id") == at) | (F.col("object_id") == at))
        near = near.withColumn("direction", F.when(F.col("subject_id") == at, "out").otherwise("in"))
        counts = listed(near.groupBy("predicate", "direction").agg(F.count("*").alias("n")).orderBy("predicate", "direction"))
        place = F.row_number().over(Window.partitionBy("predicate", "direction").orderBy("ordinal"))
        top = near.withColumn("place", place).where(F.col("place") <= clamp(limit)).orderBy("predicate", "direction", "place")
        return {"status": "ok", "matches": shown, "counts": counts, "facts": listed(top.select("predicate", "direction", "subject_label", "object_label", "canonical_status"))}

    def runtime_map(self, limit: int = 50) -> dict:
        """By service, what it exposes, produces, consumes and runs on; and the domains that lead to a deploy without a service."""
        names = {"EXPOSES_ENDPOINT": "endpoints", "PRODUCES_EVENT": "produced", "CONSUMES_EVENT": "consumed", "DEPLOYS_VIA_CONFIG": "deploys"}
        rows = self._facts(*names).where("subject_kind = 'Service'")
        services = rows.groupBy(F.col("subject_label").alias("service")).agg(*[F.count_if(F.col("predicate") == p).alias(n) for p, n in names.items()])
        routes = self._facts("ROUTES_DOMAIN_TO_DEPLOY").select(F.col("subject_label").alias("domain"), "object_id", F.col("object_label").alias("target"))
        linked = self.facts.where("predicate = 'DEPLOYS_VIA_CONFIG'").select("object_id").distinct()
        loose = routes.join(linked, "object_id", "left_anti").select("domain", "target").distinct()
        return {"status": "ok", "services": listed(services.orderBy("service").limit(clamp(limit))), "unlinked_routes": listed(loose.orderBy("domain", "target").limit(clamp(limit)))}

    def review(self, ranges: list[tuple[str, int, int]], depth: int = 2, limit: int = 25) -> dict:
        """From changed ranges (path, first line, last line) to the most specific symbols and who calls them."""
        spark = self.facts.sparkSession
        if not ranges:
            return {"status": "not_found", "symbols": [], "callers": []}
        changed = spark.createDataFrame(ranges, "path string, `from` int, `to` int").withColumn("path", C.normal_path("path"))
        spans = self._symbols().where("kind = 'CodeSymbol' AND line_start IS NOT NULL").select("path", "entity_id", "label", F.col("line_start").alias("start"), F.col("line_end").alias("stop"))
        met = joins.most_specific(joins.overlapping(spans, changed, "path", 64), ["path", "from", "to"])
        symbols = met.select("entity_id", "label", "path", "enclosing").distinct()
        callers = traversal.reach(traversal.backward(self._edges()), symbols.select(F.col("entity_id").alias("node")), clamp(depth, MAX_DEPTH)).where("depth > 0")
        named = callers.join(self.entities.select(F.col("entity_id").alias("node"), "label"), "node").orderBy("depth", "label").limit(clamp(limit))
        out = listed(symbols.orderBy("path", "label").limit(clamp(limit)))
        return {"status": "ok" if out else "not_found", "symbols": out, "callers": listed(named.select("depth", "label"))}


def within(packet: dict, most: int = 40_000) -> dict:
    """``packet`` with its longest lists halved, ends first, until it has ``most`` characters as JSON; says what it cut."""
    packet = json.loads(json.dumps(packet, default=str))
    cut: dict[str, int] = {}
    size = lambda p: len(json.dumps(p, sort_keys=True, separators=(",", ":")))
    while size(packet) > most:
        lists = {k: v for k, v in packet.items() if isinstance(v, list) and len(v) > 1}
        if not lists:
            break
        k = max(lists, key=lambda x: size(lists[x]))
        cut[k] = cut.get(k, 0) + len(lists[k]) - len(lists[k]) // 2
        packet[k] = lists[k][: len(lists[k]) // 2]
    return packet | ({"truncated": cut} if cut else {})
