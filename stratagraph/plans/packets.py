"""Packets: several questions to a snapshot put together, with what is proven, what is a lead, and what is missing.

Rows are limited by Spark before they reach the driver; what is here works on those few rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import columns as C
from stratagraph.operators import impact, joins, traversal

from .graph import GAPS, Graph, clamp, listed

#: Most characters of a packet by its kind, room kept for what the cap adds, and the sections' limits, tightening.
CAPS = {"fleet": 40_000, "anchored": 60_000, "review": 40_000, "impact": 40_000, "brief": 45_000}
RESERVE = 4_000
ROW_LIMITS = (8, 4, 2, 1)
SECTION = 10
DETAIL = 25
SURFACES = ("scheduled_jobs", "delivery_workers", "sqs_consumers", "api_surfaces", "ui_screens", "models", "serializers", "tracking_paths")
KEPT = ("output_budget", "packet_contract", "claim_contract", "scope_contract", "answerability", "next_actions")
KEPT_AT_TOP = ("proven_facts", "candidate_leads", "coverage_gaps", "inspection_areas")
PROVEN = ("rows", "edges", "references", "endpoints", "mappings", "links", "dependencies", "changed_symbols", "direct_callers", "direct_callees", "facts", "matches", "symbols")
LEADS = {"candidates": "ambiguous_candidate", "import_leads": "import_only_source_lead", "unlinked_routes": "unlinked_source_lead", "possible_matches": "inference_or_guidance", "cross_repo_leads": "unlinked_source_lead"}
WEAK = ("import_only_source_lead", "unlinked_source_lead", "inference_or_guidance", "truncated_source_inspection_lead")
#: Kinds of anchors, the verb that looks each up, and the argument that it goes to.
ANCHORS = {
    "DeployTarget": ("deploy_mappings", "target"), "Domain": ("domain_references", "domain"), "Endpoint": ("endpoints", "path"), "EventChannel": ("event_channels", "channel"),
    "Package": ("modules_importing", "package"), "Repo": ("repo_dependencies", "repo"), "Symbol": ("lookup_symbol", "symbol"),
}
MAX_ANCHORS = 8


def canonical(packet: object) -> str:
    return json.dumps(packet, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(packet: dict, fields: tuple[str, ...] = ("scenario_id", "user_query", "expected_answer_shape", "retrieval_steps", "evidence_items", "unknowns")) -> str:
    """A hash of what an answer was made from: it tells stale answers."""
    return hashlib.sha256(canonical({f: packet.get(f) for f in fields}).encode()).hexdigest()


def _unique(rows: list) -> list:
    return list({canonical(r): r for r in rows}.values())


def contract(packet: dict, tool: str) -> dict:
    """``packet`` with what every tool's has: proven facts, leads, gaps, areas to inspect, next actions, and whether it answers."""
    out = {"coverage_warnings": [], "unsupported_scopes": [], "next_actions": [], **packet}
    proven = [{"field": f, "count": len(out[f])} for f in PROVEN if isinstance(out.get(f), list) and out[f]]
    leads = [{"field": f, "count": len(out[f]), "lead_kind": k} for f, k in LEADS.items() if isinstance(out.get(f), list) and out[f]]
    status, weak = out.get("status", "unknown"), any(x["lead_kind"] in WEAK for x in leads)
    if "answerability" not in out:
        missing = {"ambiguous": ["ambiguous_anchor"], "not_found": ["requested_fact"], "unsupported_by_current_kg": ["unsupported_contract"]}.get(status, [])
        if status in ("ok", "found") or (status == "unknown" and proven):
            said = "partial" if weak else "answerable"
        elif missing or (status == "unknown" and not (leads or out["coverage_warnings"] or out["unsupported_scopes"])):
            said = "not_answerable"
        else:
            said = "partial"
        out["answerability"] = {"status": said, "missing_fact_families": missing, "recommended_source_checks": []}
    state = lambda found: "found" if found else "empty"
    out.setdefault("proven_facts", {"status": state(proven), "sources": proven})
    out.setdefault("candidate_leads", {"status": state(leads), "sources": leads})
    gaps = [{"trigger": "coverage_warning", "detail": w} for w in out["coverage_warnings"]]
    gaps += [{"trigger": "unsupported_scope", "detail": s} for s in out["unsupported_scopes"]]
    gaps += [{"trigger": "missing_fact_family", "fact_family": f} for f in out["answerability"].get("missing_fact_families", [])]
    if status in ("not_found", "ambiguous", "unsupported_by_current_kg"):
        gaps.append({"trigger": status, "detail": "the packet doesn't answer in full"})
    out.setdefault("coverage_gaps", _unique(gaps))
    areas = [a for k in ("inspection_areas", "source_inspection_areas") for a in out.get(k, [])]
    areas += [{"area": c, "trigger": "recommended_source_check"} for c in out["answerability"].get("recommended_source_checks", [])]
    areas += [{"area": a, "trigger": "next_action"} for a in out["next_actions"]]
    if leads:
        areas.append({"area": "candidate_leads", "trigger": "candidate_leads_present"})
    out["inspection_areas"] = _unique(areas)
    actions = list(out["next_actions"])
    if "ambiguous_anchor" in out["answerability"].get("missing_fact_families", []):
        actions.append("Ask again with one of the candidates' path or qualified name.")
    elif out["answerability"]["status"] != "answerable":
        actions.append("Take this as a head start: read the sources before saying that something is unknown.")
    if leads:
        actions.append("Check leads in the sources before reporting them as facts.")
    out["next_actions"] = list(dict.fromkeys(a for a in actions if str(a).strip()))
    out.setdefault("packet_contract", {"tool": tool, "proven": "facts with evidence", "leads": "not proof of execution, ownership, deploy order or impact"})
    return out


def _row_lists(node: object, label: str = "") -> list[tuple[int, str, list]]:
    """(size, where, list) of each list of rows in a packet that may shrink."""
    out: list[tuple[int, str, list]] = []
    for k, v in node.items() if isinstance(node, dict) else ():
        if k in KEPT or (not label and k in KEPT_AT_TOP):
            continue
        at = f"{label}.{k}" if label else k
        if isinstance(v, list) and any(isinstance(x, dict) for x in v):
            out.append((len(canonical(v)), at, v))
            for i, x in enumerate(v):
                out += _row_lists(x, f"{at}[{i}]")
        else:
            out += _row_lists(v, at)
    return out


def budgeted(packet: dict, kind: str = "review", most: int | None = None) -> dict:
    """``packet`` within its cap, by steps: as it is; with every list of rows cut to ROW_LIMITS in turn; then the heaviest list halved until it fits.

    What was cut is named, and where a text alone is too long the packet says so.
    """
    most = most or CAPS[kind]
    out = json.loads(json.dumps(packet, default=str))
    measured = len(canonical(out))
    if measured <= most:
        return out
    cut: set[str] = set()
    for limit in ROW_LIMITS:
        trial = json.loads(json.dumps(out))
        cut = set()
        for _, at, rows in _row_lists(trial):
            if len(rows) > limit:
                cut.add(at)
                del rows[limit:]
        if len(canonical(trial)) <= most - RESERVE:
            out = trial
            break
        if limit == ROW_LIMITS[-1]:
            out = trial
    dropped = 0
    while len(canonical(out)) > max(1, most - RESERVE):
        lists = _row_lists(out)
        if not lists:
            break
        _, at, rows = max(lists, key=lambda x: x[0])
        keep = len(rows) // 2
        dropped += len(rows) - keep
        cut.add(at)
        del rows[keep:]
    if dropped:
        out["inspection_areas"] = [*out.get("inspection_areas", []), {"area": "output_budget_overflow", "reason": "rows over the cap", "omitted_count": dropped}]
    out["output_budget"] = {"measured_chars": measured, "max_chars": most, "truncated": True, "truncated_sections": sorted(cut)}
    if dropped:
        out["output_budget"]["hard_capped"] = True
    if len(canonical(out)) > most:
        out["output_budget"]["exceeded_after_minimization"] = True
    return out


# plans of questions


def retrieval_steps(anchors: list[dict], limit: int = 25) -> list[dict]:
    """A step for each different anchor (kind, value): its name, verb, arguments and purpose."""
    out, seen = [], set()
    for a in anchors:
        kind, value = a.get("kind") if isinstance(a, dict) else None, a.get("value") if isinstance(a, dict) else None
        if not isinstance(kind, str) or kind.strip() not in ANCHORS:
            raise ValueError(f"unsupported kind of anchor: {kind}")
        if not isinstance(value, str) or not value.strip():
            raise ValueError("an anchor needs a non-empty text value")
        kind, value = kind.strip(), value.strip()
        if (kind, value) not in seen:
            seen.add((kind, value))
            verb, argument = ANCHORS[kind]
            name = "_".join(p for p in "".join(c.lower() if c.isalnum() else "_" for c in f"{kind}_{value}").split("_") if p)
            out.append({"step": name, "command": verb, "args": {argument: value, "limit": clamp(limit)}, "purpose": f"{kind} {value}"})
    return out


def checked_plan(plan: dict, limit: int = 25) -> dict:
    """A plan with its steps; at most MAX_ANCHORS anchors, and without any a clarification or a refusal."""
    if not isinstance(plan, dict):
        raise ValueError("a plan must be a JSON object")
    anchors = plan.get("anchors") or []
    if not isinstance(anchors, list) or len(anchors) > MAX_ANCHORS:
        raise ValueError(f"a plan's anchors must be a list of {MAX_ANCHORS} at most")
    if not anchors and not plan.get("clarification") and not plan.get("refusal_reason"):
        raise ValueError("a plan must have anchors, a clarification or a refusal")
    return {**plan, "anchors": anchors, "retrieval_steps": retrieval_steps(anchors, limit)}


ITEM_FIELDS = ("references", "endpoints", "channels", "mappings", "links", "modules", "matches")


def evidence_packet(scenario: str, query: str, shape: str, results: list[dict]) -> dict:
    """Step results (step, command, args, purpose, result) as evidence items, each once, and what gave nothing."""
    items, unknowns = [], []
    for r in results:
        rows = [x for f in ITEM_FIELDS for x in r["result"].get(f) or []]
        if r["result"].get("status") in ("not_found", "empty") or not rows:
            unknowns.append({"step": r["step"], "command": r["command"], "reason": f"no facts for {r['purpose']}"})
        items += [{"step": r["step"], "claim": _claim(x), "row": x} for x in rows]
    steps = [{k: r[k] for k in ("step", "command", "args", "purpose")} | {"status": r["result"].get("status")} for r in results]
    return {"scenario_id": scenario, "user_query": query, "expected_answer_shape": shape, "retrieval_steps": steps, "evidence_items": _unique(items), "unknowns": unknowns}


def _claim(row: dict) -> str:
    if "predicate" in row:
        return f"{row.get('subject_label')} {row['predicate']} {row.get('object_label') or row.get('route')}"
    return str(row.get("label") or row.get("subject_label") or row)


def answered(g: Graph, query: str, plan: dict, limit: int = 25) -> dict:
    """A plan carried out: its steps' results as an evidence packet."""
    plan = checked_plan(plan, limit)
    results = [s | {"result": getattr(g, s["command"])(**s["args"])} for s in plan["retrieval_steps"]]
    return {"plan": plan, "packet": evidence_packet("interactive", query, plan.get("answer_intent") or "an answer", results)}


# scopes and counts


def repos(g: Graph) -> DataFrame:
    """(repo): the repositories that entities and links name."""
    own = g.entities.select(F.lower(F.trim(F.col("identity")["repo"])).alias("repo"))
    linked = g.facts.select(F.lower(F.trim(F.col("qualifier")["consumer_repo"])).alias("repo"))
    return own.union(linked).where("repo IS NOT NULL AND repo <> ''").distinct()


def repo_scope(g: Graph, requested: str, changed_files: list[str]) -> dict:
    """Which repository of the snapshot a request means: the one of that name, or the only one if it has a changed file."""
    known = [r["repo"] for r in repos(g).orderBy("repo").limit(SECTION + 1).collect()]
    base = {"requested_repo": requested, "effective_repo": requested, "basis": "unchanged", "candidate_repos": known[:SECTION]}
    if not repos(g).where(F.col("repo") == requested.strip().lower()).isEmpty():
        return {"status": "matched", "requested_repo": requested, "effective_repo": requested.strip().lower(), "basis": "direct_repo_match"}
    if "/" not in requested:
        return base | {"status": "unresolved", "reason": "requested_repo_not_owner_qualified"}
    if len(known) != 1:
        return base | {"status": "ambiguous" if known else "unresolved", "reason": "multiple_snapshot_repos" if known else "no_snapshot_repo_identity"}
    paths = [p for p in changed_files if p]
    there = g.evidence.where(C.normal_path("bytes_ref.path").isin(*[_normal(p) for p in paths])) if paths else None
    if there is None or there.isEmpty():
        return base | {"status": "unresolved", "reason": "no_changed_file_overlap"}
    return {"status": "resolved", "requested_repo": requested, "effective_repo": known[0], "basis": "single_repo_snapshot_changed_file_overlap"}


def _normal(path: str) -> str:
    return path.replace("\\", "/").lstrip("./")


def scope_counts(g: Graph, repo: str | None = None) -> DataFrame:
    """(table, n): entities, facts with an end there, evidence and coverage of a repository or of all."""
    here = lambda c: C.repo_matches(c, F.lit(repo)) if repo else F.lit(True)
    mine = g.entities.where(F.coalesce(here(F.col("identity")["repo"]), F.lit(False)))
    facts = g.facts
    if repo:
        ids = mine.select(F.col("entity_id").alias("id"))
        touched = facts.select("fact_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("id")).join(ids, "id", "left_semi")
        facts = facts.join(touched.select("fact_id").distinct(), "fact_id", "left_semi")
    evidence = g.evidence.where(F.coalesce(here(F.col("bytes_ref.repo")), F.lit(not repo)))
    coverage = g.coverage.where(F.coalesce(here(F.col("scope_ref")["repo"]), F.lit(not repo)))
    out = None
    for name, rows in (("entities", mine), ("facts", facts), ("evidence", evidence), ("coverage", coverage)):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.union(one)
    return out


def inventory(g: Graph, repo: str | None = None, limit: int = SECTION) -> dict:
    """Counts of a repository or of the fleet, its top dependencies, and the states, predicates and reasons of its coverage."""
    coverage = g.coverage if repo is None else g.coverage.where(C.repo_matches(F.col("scope_ref")["repo"], F.lit(repo)))
    by = lambda c: {r["k"]: r["n"] for r in coverage.where(c.isNotNull()).groupBy(c.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10).collect()}
    rows = g._imports().where("object_kind = 'ExternalPackage'").where(~F.col("category").isin("stdlib", "node_builtin", "unknown"))
    if repo is not None:
        rows = rows.where(C.repo_matches(F.col("subject_identity")["repo"], F.lit(repo)))
    top = rows.groupBy(F.col("object_label").alias("name")).agg(F.count("*").alias("importers")).orderBy(F.desc("importers"), "name").limit(clamp(limit))
    return {
        "status": "ok", "scope": {"kind": "repo", "repo": repo} if repo else {"kind": "fleet"}, "summary": {r["table"]: r["n"] for r in scope_counts(g, repo).collect()}, "dependencies": listed(top),
        "coverage": {"states": by(F.col("state")), "predicates": by(F.col("predicate")), "reasons": by(F.col("scope_ref")["reason"])},
        "gaps": listed(coverage.where(F.col("state").isin(*GAPS)).orderBy("coverage_id").limit(clamp(limit)).select("coverage_id", "predicate", "state")),
    }


def support_rows(g: Graph, repo: str | None = None) -> DataFrame:
    """The snapshot's support facts as ``impact`` takes them; of a repository those that touch it."""
    def end(side: str) -> DataFrame:
        i = F.col("identity")
        return g.entities.select(F.col("entity_id").alias(f"{side}_id"), *[i[k].alias(f"{side}_{k}") for k in ("repo", "module", "qualname")])

    facts = g.tables["support_facts"].select("fact_id", "predicate", "subject_id", "object_id", F.col("qualifier")["access_level"].alias("access_level"))
    rows = facts.join(end("subject"), "subject_id").join(end("object"), "object_id")
    if repo is not None:
        rows = rows.where((F.lower("subject_repo") == repo.lower()) | (F.lower("object_repo") == repo.lower()))
    return rows


def flat_entities(g: Graph) -> DataFrame:
    """Entities as ``impact`` takes them."""
    i = F.col("identity")
    where = g._symbols().select("entity_id", "path").distinct()
    rows = g.entities.select("entity_id", "kind", "label", *[i[k].alias(k) for k in ("repo", "module", "qualname", "symbol_kind")])
    return rows.join(where, "entity_id", "left")


def authz_surface(g: Graph, repo: str | None = None, limit: int = DETAIL) -> dict:
    rows = support_rows(g, repo).where(F.col("predicate").isin(*impact.AUTHZ))
    found = impact.endpoint_authorization(rows)
    leads = impact.authz_leads(found).orderBy(F.desc("priority"), "endpoint", "handler").limit(clamp(limit))
    counts = {r["status"]: r["n"] for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()}
    out = listed(found.orderBy("endpoint", "handler").limit(clamp(limit)))
    missing = [f for f, on in (("endpoint_authz_policy", counts.get("missing_declared_policy")),) if on]
    answer = {"status": "partial" if missing else "answerable" if out else "empty", "missing_fact_families": missing if out else ["authz_surface"], "recommended_source_checks": []}
    return {"status": "found" if out else "empty", "summary": counts, "endpoint_authorization": out, "review_leads": listed(leads), "answerability": answer}


def framework_impact(g: Graph, repo: str, changed: DataFrame, limit: int = DETAIL) -> dict:
    rows = support_rows(g, repo).where(F.col("predicate").isin(*impact.FRAMEWORK))
    models = impact.impacted_models(rows, changed)
    sections = impact.framework_sections(rows, models)
    counts = {r["section"]: r["n"] for r in sections.groupBy("section").agg(F.count("*").alias("n")).collect()}
    shown = listed(sections.select("section", "subject_id", "object_id").distinct().orderBy("section", "subject_id", "object_id").limit(clamp(limit)))
    paths = listed(impact.model_paths(rows, models).distinct().orderBy(F.size("path"), "path", "field").limit(clamp(limit)))
    found = listed(models.orderBy("model").limit(clamp(limit)))
    return {"status": "found" if found else "empty", "changed_models": found, "summary": counts, "sections": shown, "relationship_paths": paths}


RUNTIME = ("EXPOSES_ENDPOINT", "CALLS_ENDPOINT", "PRODUCES_EVENT", "CONSUMES_EVENT", "DEPLOYS_VIA_CONFIG", "ROUTES_DOMAIN_TO_DEPLOY", "REFERENCES_DOMAIN")


def namespaces(changed_files: list[str], modules: list[str]) -> list[str]:
    """The first parts of changed modules and files, tests left out."""
    words = lambda p: {"".join(c for c in x.lower() if c.isalnum()) for x in p}
    out = {m.split(".")[0] for m in modules if m and not words(m.split(".")) & {"test", "tests"}}
    for path in changed_files:
        parts = [p for p in path.split("/") if p not in ("", ".")]
        if parts and not words(parts) & {"test", "tests"} and not parts[-1].startswith("test_"):
            out.add(parts[1] if parts[0] == "src" and len(parts) > 1 else parts[0])
    return sorted(out)


def application_impact(g: Graph, repo: str, roots: list[str], limit: int = DETAIL) -> dict:
    limit = min(clamp(limit), 20)
    if not roots:
        return {"status": "missing_anchor", "surfaces": {}, "cross_repo_leads": [], "runtime_facts": []}
    entities = flat_entities(g)
    surfaces = impact.application_surfaces(entities, repo, roots)
    counts = {r["role"]: r["n"] for r in surfaces.where("role IS NOT NULL").groupBy("role").agg(F.count("*").alias("n")).collect()}
    shown = listed(surfaces.where("role IS NOT NULL").orderBy("role", "label", "entity_id").limit(limit * 5).select("role", "entity_id", "label", "path"))
    ids = surfaces.select(F.col("entity_id").alias("id")).distinct()
    near = g._facts(*RUNTIME)
    touched = near.select("fact_id", F.explode(F.array("subject_id", "object_id")).alias("id")).join(ids, "id", "left_semi").select("fact_id").distinct()
    runtime = listed(near.join(touched, "fact_id", "left_semi").orderBy("predicate", "ordinal").limit(limit).select("fact_id", "predicate", "subject_label", "object_label"))
    by = {}
    for r in shown:
        by.setdefault(r.pop("role"), []).append(r)
    leads = listed(impact.cross_repo_leads(entities, repo, roots, limit))
    return {"status": "found" if counts or runtime or leads else "empty", "anchors": roots, "counts": counts, "surfaces": {k: v[:limit] for k, v in by.items()}, "cross_repo_leads": leads, "runtime_facts": runtime}


def review_context(g: Graph, repo: str, changed_files: list[str], changed_ranges: list[tuple[str, int, int]] | None = None, limit: int = DETAIL, include_deploy_blockers: bool = False, surfaces: tuple[str, ...] = SURFACES) -> dict:
    """From changed files and ranges to symbols, callers, callees, transitive callers, impacts and surfaces, within the review's cap.

    Without ranges nothing is said of changed symbols or their callers: the files' symbols are an inventory.
    """
    scope = repo_scope(g, repo, changed_files)
    repo, limit, spark = scope["effective_repo"], min(clamp(limit), DETAIL), g.facts.sparkSession
    files = spark.createDataFrame([(_normal(p),) for p in changed_files] or [("",)], "path string")
    symbols = g._symbols().where("kind = 'CodeSymbol'").withColumn("repo", F.col("identity")["repo"])
    symbols = symbols.where(C.repo_matches("repo", F.lit(repo))).join(F.broadcast(files), "path")  # a change's files
    inventory_ = symbols.select("entity_id", "label", "path", "line_start", "line_end").distinct()
    ranges = [(_normal(p), int(a), int(b)) for p, a, b in changed_ranges or [] if a <= b]
    changed = inventory_.limit(0)
    anchors = []
    if ranges:
        asked = spark.createDataFrame(ranges, "path string, `from` int, `to` int")
        spans = symbols.where("line_start IS NOT NULL").select("path", "entity_id", "label", F.col("line_start").alias("start"), F.col("line_end").alias("stop"))
        met = joins.most_specific(joins.overlapping(spans, asked, "path", 64), ["path", "from", "to"])
        changed = met.select("entity_id", "label", "path", F.col("start").alias("line_start"), F.col("stop").alias("line_end")).distinct()
        hits = {(r["path"], r["from"], r["to"]): r["n"] for r in met.groupBy("path", "from", "to").agg(F.count_distinct("entity_id").alias("n")).collect()}  # a change's ranges
        for p, a, b in ranges:
            n = hits.get((p, a, b), 0)
            anchors.append({"path": p, "range": [a, b], "anchor_type": "symbol" if n else "file", "match_kind": "changed_range" if n else "range_without_symbol", "symbol_count": n})
    with_range = {p for p, _, _ in ranges}
    for p in changed_files:
        if _normal(p) not in with_range:
            anchors.append({"path": _normal(p), "anchor_type": "file", "match_kind": "changed_file_without_range" if ranges else "changed_file_inventory"})
    top = changed.orderBy("path", "line_start", "label").limit(limit).select(F.col("entity_id").alias("node"))
    edges = g._edges()
    calls = g._facts("CALLS")
    callers = listed(calls.join(top, calls["object_id"] == top["node"], "left_semi").orderBy("ordinal").limit(limit).select("fact_id", "subject_label", "object_label"))
    callees = listed(calls.join(top, calls["subject_id"] == top["node"], "left_semi").orderBy("ordinal").limit(limit).select("fact_id", "subject_label", "object_label"))
    far = traversal.reach(traversal.backward(edges), top, 3).where("depth > 1").join(g.entities.select(F.col("entity_id").alias("node"), "label"), "node") if ranges else None
    transitive = listed(far.orderBy("depth", "label").limit(limit).select("depth", "label")) if far is not None else []
    dependencies = g.repo_dependencies(repo, limit).get("links", [])
    of = changed if ranges else inventory_
    named = of.join(g.entities.select("entity_id", "identity"), "entity_id").select(
        F.col("entity_id").alias("symbol_id"), F.col("identity")["repo"].alias("repo"), F.col("identity")["module"].alias("module"), F.col("identity")["qualname"].alias("qualname")
    )
    framework = framework_impact(g, repo, named, limit)
    modules = [r["module"] for r in named.select("module").distinct().orderBy("module").limit(limit).collect()]
    application = application_impact(g, repo, namespaces(changed_files, modules), limit)
    shown, files_symbols = listed(changed.orderBy("path", "line_start", "label").limit(limit)), listed(inventory_.orderBy("path", "line_start", "label").limit(limit))
    useful = bool(shown or callers or callees or transitive or any(a["anchor_type"] == "symbol" for a in anchors))
    roles = {"scheduled_jobs": "scheduled_job", "delivery_workers": "worker", "api_surfaces": "api", "models": "model", "serializers": "serializer"}

    def surface(name: str) -> dict:
        leads = [x for x in application["cross_repo_leads"] if name == "ui_screens" and any(w in x["label"].lower() for w in ("view", "screen", "ui"))]
        rows = application["surfaces"].get(roles.get(name, ""), [])
        return {"surface": name, "status": "inventory_context" if rows else "unlinked_lead" if leads else "missing", "known_count": 0, "context_count": len(rows), "unlinked_count": len(leads)}

    missing = [] if shown else ["changed_symbols"]
    out = {
        "status": "found" if shown or files_symbols or dependencies else "not_found", "repo": repo, "repo_resolution": scope, "diff_anchors": anchors, "changed_symbols": shown, "changed_file_symbols": files_symbols,
        "direct_callers": callers if ranges else [], "direct_callees": callees if ranges else [], "transitive_callers": transitive, "repo_dependencies": dependencies,
        "framework_impact": framework, "application_impact": application, "surface_status": [surface(s) for s in surfaces],
        "review_lead_status": {"coverage_status": "useful" if useful else "low_coverage", "recommended_action": "use_packet" if useful else "fall_back_to_plain_review"},
        "scope_contract": {"changed_symbols": "symbols that a changed range meets" if ranges else "unknown without ranges"},
        "answerability": {"status": "answerable" if not missing else "partial", "missing_fact_families": missing, "recommended_source_checks": []},
        "unsupported_scopes": [{"kind": "deploy_blockers", "scope": repo, "reason": "no relation says what blocks a deploy"}] if include_deploy_blockers else [],
    }
    return budgeted(contract(out, "review_context"), "review")


def deploy_blockers_for(g: Graph, scope: str) -> dict:
    """Always refused: no fact says what blocks a deploy."""
    return contract({"status": "unsupported_by_current_kg", "scope": scope, "unsupported_scopes": [{"kind": "deploy_blockers", "scope": scope, "reason": "no relation says what blocks a deploy"}]}, "deploy_blockers_for")


def planning_context(g: Graph, anchors: dict[str, str] | None = None, limit: int = SECTION) -> dict:
    """What the given anchors (repo, service, symbol, path, package, endpoint, event_channel, domain, query) lead to; without any, the fleet.

    An anchor that names several things ends the packet as ambiguous, with them as candidates.
    """
    anchors = {k: v for k, v in (anchors or {}).items() if v}
    if not anchors:
        return budgeted(contract({"status": "ok", "runtime_map": g.runtime_map(clamp(limit)), "inventory": inventory(g, limit=limit)}, "planning_context"), "fleet")
    out: dict = {"status": "not_found", "anchors": anchors}
    look: dict[str, Callable[[str], dict]] = {
        "service": lambda v: g.service_brief(v, limit), "symbol": lambda v: g.lookup_symbol(v, anchors.get("path"), None, limit), "path": lambda v: g.symbols_in_file(v, limit),
        "package": lambda v: g.modules_importing(v, limit), "endpoint": lambda v: g.endpoints(v, limit), "event_channel": lambda v: g.event_channels(v, limit), "domain": lambda v: g.domain_references(v, limit),
        "repo": lambda v: inventory(g, v, limit) | {"links": g.repo_dependencies(v, limit).get("links", []), "authz": authz_surface(g, v, limit)}, "query": lambda v: g.planning_context(v, limit),
    }
    for kind, value in anchors.items():
        if kind not in look:
            raise ValueError(f"unknown anchor: {kind}")
        if kind == "path" and "symbol" in anchors:
            continue
        found = look[kind](value)
        if found["status"] == "ambiguous":
            rows = found.get("services") or found.get("matches") or found.get("candidates") or []
            return contract(out | {"status": "ambiguous", "anchor": kind, "candidates": rows[: clamp(limit)]}, "planning_context")
        if any(isinstance(x, list) and x for x in found.values()) or found.get("sections"):
            out["status"] = "ok"
        out[kind] = found
    return budgeted(contract(out, "planning_context"), "anchored")
