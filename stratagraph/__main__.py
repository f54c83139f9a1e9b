"""``python -m stratagraph --snapshot DIR VERB [--name value ...]``: one question, answered as JSON."""

from __future__ import annotations

import argparse
import inspect
import json

from pyspark.sql import SparkSession

from stratagraph.plans.graph import Graph

VERBS = (
    "summary", "find_callers", "reverse_impact", "find_callees", "blast_radius", "modules_importing", "top_dependencies", "dependency_info", "who_imports",
    "top_internal_dependencies", "top_fan_in_symbols", "modules_importing_both", "dependency_path", "cross_repo_links", "repo_dependencies", "domain_references",
    "endpoints", "reconcile_endpoints", "event_channels", "deploy_mappings", "reconcile_contract", "lookup_symbol", "symbols_in_file", "evidence_for_call",
    "coverage_gaps", "service_brief", "planning_context", "runtime_map",
)
LISTS = ("left_predicate", "right_predicate", "left_repo", "right_repo", "docs_repo", "backend_repo", "client_repo")
NUMBERS = ("line", "limit", "depth", "max_depth", "group_prefix_depth")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratagraph", description=__doc__)
    out.add_argument("--snapshot", required=True)
    out.add_argument("--format", choices=("parquet", "json"), default="parquet")
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb in VERBS:
        sub = verbs.add_parser(verb.replace("_", "-"))
        for name, p in list(inspect.signature(getattr(Graph, verb)).parameters.items())[1:]:
            if p.default is inspect.Parameter.empty and name not in LISTS:
                sub.add_argument(name)
            elif isinstance(p.default, bool):
                sub.add_argument(f"--{'no-' if p.default else ''}{name.replace('_', '-')}", dest=name, action="store_false" if p.default else "store_true")
            elif name in LISTS:
                sub.add_argument(f"--{name.replace('_', '-')}", action="append", required=p.default is inspect.Parameter.empty)
            else:
                sub.add_argument(f"--{name.replace('_', '-')}", type=int if name in NUMBERS else str, default=p.default)
    return out


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    root, form, verb = args.pop("snapshot"), args.pop("format"), args.pop("verb").replace("-", "_")
    spark = SparkSession.builder.appName("stratagraph").getOrCreate()
    print(json.dumps(getattr(Graph.load(spark, root, form), verb)(**args), sort_keys=True, default=str))


if __name__ == "__main__":
    main()
