"""Queries of the scalar functions: values made from the supplied keys, and in SQL what must come of them.

Each case is (table, key, the value in SQL that both engines read, the function, the expected value in DuckDB's SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import columns as C

from .projections import table

Case = tuple[str, str, str, Callable[[str], Column], str]


def _joined(f: Callable[[str], Column]) -> Callable[[str], Column]:
    return lambda x: F.array_join(f(x), ",")


def _among(*values: str, of: str = "k") -> str:
    """One of some SQL values, by the key."""
    return f"CASE {of} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _channel(x: str) -> Column:
    return F.concat_ws("/", C.channel(x)["broker_kind"], C.channel(x)["channel_address"])


def _scope(x: str) -> Column:
    return F.concat_ws("|", *[C.scope_parts(x)[p] for p in ("repo", "commit_sha", "path")])


PART, SUPPLIER, CUSTOMER, ORDERS = ("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")

CASES: dict[str, Case] = {
    "fn_git_identity": (
        *SUPPLIER,
        _among(
            "'https://www.Forge.example/Org' || k || '/Repo.git'", "'git@forge.example:org' || k || '/repo.git'", "'ssh://git@forge.example:22/a/b' || k || '/repo'",
            "'git+https://forge.example/org/repo' || k || '.git?x=1#egg'", "'github:org' || k || '/repo'", "'forge.example/o/n'", "''", "' https://forge.example/only '",
            "'https://forge.example/o%20p/n+' || k || '/'",
        ),
        C.git_identity,
        _among(
            "'forge.example/Org' || k || '/Repo'", "'forge.example/org' || k || '/repo'", "'forge.example/a/b' || k || '/repo'", "'forge.example/org/repo' || k",
            "'github.com/org' || k || '/repo'", "NULL", "NULL", "NULL", "'forge.example/o p/n+' || k",
        ),
    ),
    "fn_channel": (
        *SUPPLIER,
        _among(
            "'arn:aws:sqs:eu-west-1:123:jobs-' || k", "' arn:aws:sns:eu-west-1:123:topic_' || k", "'arn:aws:kinesis:eu:1:stream/s' || k", "'arn:aws:dynamodb:eu:1:table/t' || k || '/stream/2020'",
            "'arn:aws:events:eu:1:event-bus/bus' || k", "'https://sqs.eu-west-1.amazonaws.com/123/jobs-' || k", "'arn:aws:sqs:eu:acc:jobs'", "'arn:aws-cn:sqs:eu:1:jobs'", "'jobs-' || k",
            "'arn:aws:sns:eu:1:a.b'", "'https://sqs.eu.amazonaws.com/1/x/jobs'", "'arn:aws:dynamodb:eu:1:table/t' || k",
        ),
        _channel,
        _among(
            "'sqs/jobs-' || k", "'sns/topic_' || k", "'kinesis/s' || k", "'dynamodb_stream/t' || k", "'eventbridge/bus' || k", "'sqs/jobs-' || k", "''", "''", "''", "''", "''", "''"
        ),
    ),
    "fn_queue_name": (
        *PART, _among("repeat('q', cast(k % 90 as int))", "repeat('q', cast(k % 90 as int)) || '.fifo'", "'a b'", "'a_b-' || k", "'x.fifo.fifo'"), C.is_queue_name,
        _among("k % 90 BETWEEN 1 AND 80", "k % 90 BETWEEN 1 AND 75", "false", "true", "false"),
    ),
    "fn_package_name": (*PART, "' ' || p_brand || '__.' || p_type || ' '", C.package_name, r"regexp_replace(lower(trim(x)), '[-_.]+', '-', 'g')"),
    "fn_dimension_package_name": (*PART, "' ' || p_brand || '__.' || p_type || ' '", C.dimension_package_name, "replace(lower(trim(x)), '_', '-')"),
    "fn_identifier_tokens": (
        *PART, _among("'getHTTPServer_name' || k", "'a-b.cD/eF' || k", "'__' || k || '__'", "'XMLParser'"), _joined(C.tokens),
        _among("'get,httpserver,name' || k", "'a,b,c,d,e,f' || k", "'' || k", "'xmlparser'"),
    ),
    "fn_slug": (*PART, _among("' ' || p_name || '! '", "p_brand || '/' || p_type", "' -- '"), C.slug,
                "CASE WHEN trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'anchor' ELSE trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_') END"),
    "fn_route": (
        *SUPPLIER, _among("'api/v1/|users/' || k", "'/|/'", "'|x'", "'/a/|'"), lambda x: C.joined_route(F.split_part(x, F.lit("|"), F.lit(1)), F.split_part(x, F.lit("|"), F.lit(2))),
        _among("'/api/v1/users/' || k", "'/'", "'/x'", "'/a'"),
    ),
    "fn_controller_route": (
        *SUPPLIER, _among("'Shop.Cart' || k || 'Controller'", "'Health'", "'Controllers.ControllerController'"), lambda x: C.controller_route(F.lit("api/[controller]/x"), x),
        _among("'api/cart' || k || '/x'", "'api/health/x'", "'api/controller/x'"),
    ),
    "fn_key_segments": (*SUPPLIER, "'/v' || k || '/order_items/a-b/v/order/' || k", _joined(C.key_segments), "'order,items,a,b,v' || ',' || k"),
    "fn_common_prefix": (
        *SUPPLIER, "'same' || k || '|same' || (k % 7)", lambda x: C.common_prefix_length(F.split_part(x, F.lit("|"), F.lit(1)), F.split_part(x, F.lit("|"), F.lit(2))).cast("long"),
        "CASE WHEN starts_with(k::VARCHAR, (k % 7)::VARCHAR) THEN 5 ELSE 4 END::BIGINT",
    ),
    "fn_posix_path": (*SUPPLIER, _among("' ./a//b' || k || '/./c '", "'x\\y' || k", "'/'", "''"), C.posix_path, _among("'a/b' || k || '/c'", "'x/y' || k", "NULL", "NULL")),
    "fn_path_suffix": (
        *SUPPLIER, _among("'a/b/c' || k", "'xb/c' || k", "'b/c' || k"), lambda x: C.has_path_suffix(x, F.concat(F.lit("b/c"), F.regexp_extract(x, r"(\d+)$", 1))), _among("true", "false", "true")
    ),
    "fn_common_folder": (
        *SUPPLIER, _among("'a/b/x,a/b/c/y,a/b' || k || '/z'", "'src/x' || k || '/a,src/x' || k || '/b/c'", "'top,a/b'", "'x,y'"), lambda x: C.common_folder(F.split(x, ",")),
        _among("'a'", "'src/x' || k", "'.'", "'.'"),
    ),
    "fn_scope_key": (*SUPPLIER, _among("'host/o/r' || k || '@c0ffee:src/a:b.py'", "'r@:x'", "'r@c:'", "'plain'"), _scope, _among("'host/o/r' || k || '|c0ffee|src/a:b.py'", "''", "''", "''")),
    "fn_instant": (
        *ORDERS, _among("'2024-01-0' || (k % 9 + 1) || 'T10:00:00Z'", "'2024-01-05T12:30:00+02:30'", "'2024-01-05 09:00:00'", "'2024-01-05'", "'soon'", "''"),
        lambda x: F.unix_seconds(C.instant(x)).cast("string"),
        "(" + _among("epoch(TIMESTAMP '2024-01-01 10:00:00')::BIGINT + 86400 * (k % 9)", "epoch(TIMESTAMP '2024-01-05 10:00:00')::BIGINT", "epoch(TIMESTAMP '2024-01-05 09:00:00')::BIGINT",
               "epoch(TIMESTAMP '2024-01-05 00:00:00')::BIGINT", "NULL", "NULL") + ")::VARCHAR",
    ),
    "fn_first_unique": (*SUPPLIER, "'b, a ,b,,c' || k || ',a,d'", lambda x: F.array_join(C.first_unique(F.split(x, ","), 3), ","), "'b,a,c' || k"),
    "fn_has_run": (*SUPPLIER, _among("'a,b,c,' || k", "'b,a,c'", "'b,c'", "'c'", "'x,b,c'"), lambda x: C.has_run(F.split(x, ","), F.array(F.lit("b"), F.lit("c"))), _among("true", "false", "true", "false", "true")),
    "fn_selector": (
        *SUPPLIER, _among("'app:web,tier:' || k", "'app:web'", "'app:api,tier:1'", "''"),
        lambda x: C.contains_map(F.str_to_map(x, F.lit(","), F.lit(":")), F.create_map(F.lit("app"), F.lit("web"))), _among("true", "true", "false", "false"),
    ),
    "fn_top_counts": (
        *SUPPLIER, "'a:' || k || ',b:3,c:3,d:1'",
        lambda x: F.array_join(F.transform(C.top_counts(F.transform_values(F.str_to_map(x, F.lit(","), F.lit(":")), lambda _, v: v.cast("long")), 2), lambda r: r["key"]), ","),
        "CASE WHEN k > 2 THEN 'a,b' ELSE 'b,c' END",
    ),
    "fn_ip_address": (
        *SUPPLIER, _among("'10.0.0.' || (k % 300)", "'2001:db8::' || (k % 10)", "'::'", "'::ffff:10.0.0.1'", "'1:2:3:4:5:6:7:8:9'", "'1::2::3'", "'a.b.c.d'", "'01.2.3.4'", "'fe80::1%eth0'"),
        C.is_ip_address, _among("k % 300 < 256", "true", "true", "true", "false", "false", "false", "false", "true"),
    ),
    "fn_deploy_kind": (
        *SUPPLIER, _among("'wsgi||'", "'|kubernetes_deployment|'", "'||zappa_domain'", "'lambda||apache_vhost'", "'||'", "'ecs|x|y'"),
        lambda x: C.deploy_kind(*[F.split_part(x, F.lit("|"), F.lit(n)) for n in (1, 2, 3)]),
        _among("'apache_wsgi'", "'kubernetes_deployment'", "'zappa_lambda'", "'apache_wsgi'", "NULL", "'ecs'"),
    ),
    "fn_reference_kind": (
        *SUPPLIER, _among("'Zappa_Domain|x'", "'terraform_literal|x'", "'domain_env|x'", "'source_domain_literal|10.0.0.1'", "'|x.execute-api.eu.amazonaws.com'", "'|10.0.0.' || (k % 200)", "'|shop.example'"),
        lambda x: C.reference_kind(*[F.split_part(x, F.lit("|"), F.lit(n)) for n in (1, 2)]),
        _among("'zappa_domain_reference'", "'terraform_domain_reference'", "'env_domain_reference'", "NULL", "'api_gateway_domain_reference'", "'internal_address_reference'", "NULL"),
    ),
    "fn_dotenv_value": (
        *SUPPLIER, _among("' v' || k || ' # note'", "'\"a # ' || k || '\" x'", "'''q'''", "'a\\#b'", "''", "'\"open'", "'end\\'"), C.dotenv_value,
        _among("'v' || k", "'a # ' || k", "'q'", "'a#b'", "''", "'open'", "'end\\'"),
    ),
    "fn_environment": (
        *SUPPLIER, _among("'Prod-' || k || '.shop.example'", "'api-qa.shop.example'", "'a_local.x'", "'production-shop.x'", "'prodx.shop.example'", "NULL"), lambda x: C.domain_environment_rank(x).cast("long"),
        _among("0", "2", "3", "0", "1", "4") + "::BIGINT",
    ),
    "fn_path_environment": (
        *SUPPLIER, _among("'deploy/Prod/' || k || '.yaml'", "'x/eu_prod/a'", "'stage.tf'", "'env/my-dev/x'", "'a/product/b'", "NULL"), lambda x: C.path_environment_rank(x).cast("long"),
        _among("0", "0", "2", "3", "1", "4") + "::BIGINT",
    ),
    "fn_test_path": (
        *SUPPLIER, _among("'src/Tests/x' || k || '.py'", "'a/b.spec.ts'", "'contest/a.py'", "'a/test_b.py'", "'__tests__/x'", "'a/b_test.go'", "'latest.py'"), C.is_test_path,
        _among("true", "true", "false", "true", "true", "true", "false"),
    ),
    "fn_repo_match": (
        *SUPPLIER, _among("'Own/Name|name'", "'own/name|other/name'", "'a' || k || '|A' || k", "'o/n|O/N'", "'x|y'"),
        lambda x: C.repo_matches(F.split_part(x, F.lit("|"), F.lit(1)), F.split_part(x, F.lit("|"), F.lit(2))), _among("true", "false", "true", "true", "false"),
    ),
    "fn_normal_path": (*SUPPLIER, _among("'.\\src\\' || k || '.py'", "'.env'", "'../a/b'", "'/x'", "'a/./b'"), C.normal_path, _among("'src/' || k || '.py'", "'env'", "'a/b'", "'x'", "'a/./b'")),
    "fn_path_prefix": (
        *SUPPLIER, _among("'/a/b/' || k", "'/ab'", "'/a'", "'/b/a'"), lambda x: C.has_path_prefix(C.path_shape(x), F.lit("/a")), _among("true", "false", "true", "false")
    ),
    "fn_canonical_json": (
        *SUPPLIER, "'b:' || k || ',a:é \"q\",c:x'", lambda x: C.canonical_json(F.str_to_map(x, F.lit(","), F.lit(":"))), r"""'{"a":"\u00e9 \"q\"","b":"' || k || '","c":"x"}'"""
    ),
    "fn_json_object": (
        *SUPPLIER, _among("'{\"b\": ' || k || ', \"a\": [1]}'", "'So: ```json {\"x\": {\"y\": 1}} ``` ok'", "'a {bad} then {\"k\": ' || k || '} {}'", "'[1]'", "'none'"), C.json_object,
        _among("'{\"a\":[1],\"b\":' || k || '}'", "'{\"x\":{\"y\":1}}'", "'{\"k\":' || k || '}'", "NULL", "NULL"),
    ),
    "fn_nested": (*SUPPLIER, _among("'{\"a\": {\"b\": \"v' || k || '\"}}'", "'{\"a\": 1}'", "'{}'"), lambda x: C.nested(x, "a", "b"), _among("'v' || k", "NULL", "NULL")),
    "fn_urn": (
        *SUPPLIER, _among("'tenant_id:t,repo:o/r' || k || ',name:a b'", "'tenant_id:t,repo:r'"), lambda x: C.urn("graph", F.lit("Domain"), F.str_to_map(x, F.lit(","), F.lit(":"))),
        _among("'graph://domain/t/o%2Fr' || k || '/a%20b'", "'graph://domain/' || left(sha256('{\"repo\":\"r\",\"tenant_id\":\"t\"}'), 24)"),
    ),
    "fn_endpoint_urn": (
        *SUPPLIER, _among("'tenant_id:t,repo:r,protocol:http,method:GET,path:/x/' || k", "'tenant_id:t,repo:r,protocol:http,method:GET,path:/,host:h.example'"),
        lambda x: C.urn("graph", F.lit("Endpoint"), F.str_to_map(x, F.lit(","), F.lit(":"))), _among("'graph://endpoint/t/r/http/GET/_/%2Fx%2F' || k", "'graph://endpoint/t/r/http/GET/h.example/%2F'"),
    ),
    "fn_call_site": (
        *SUPPLIER, _among("'source_line:f(' || k || ')'", "'source_line: ,source_excerpt:x'", "'other:1'"),
        lambda x: F.concat_ws("|", *[F.coalesce(C.call_site(F.str_to_map(x, F.lit(","), F.lit(":")))[n], F.lit("-")) for n in ("source_line", "source_excerpt")]),
        _among("'f(' || k || ')|-'", "'-|x'", "'-|-'"),
    ),
    "fn_masked": (*CUSTOMER, "c_name", lambda x: C.masked(x, 2), "left(x, 2) || repeat('*', least(8, greatest(length(x) - 2, 0))::INT)"),
    "fn_stable_hash": (*CUSTOMER, "c_name", lambda x: C.stable_hash("ent_", F.lit("Customer"), x), "'ent_' || left(sha256('Customer|' || x), 24)"),
}


def _query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    name, key, value, f, _ = case

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name).withColumn("k", F.col(key)).select("k", F.expr(value.replace("\\", "\\\\")).alias("x"))
        return rows.select("k", "x", f("x").alias("y"))

    return run


def build_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By nation, the hash of its suppliers' names and states in order: unchanged ones need no rebuild."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.struct(F.col("s_acctbal").cast("long").cast("string").alias("commit_sha"), F.col("s_name").alias("full_name")).alias("repo"))
    each = F.sort_array(F.collect_list(F.struct("repo.full_name", "repo.commit_sha")))
    listed = F.transform(each, lambda r: F.struct(r["commit_sha"].alias("commit_sha"), r["full_name"].alias("full_name")))
    return rows.groupBy("s_nationkey").agg(F.sha2(F.to_json(listed), 256).alias("fingerprint"))


QUERIES = {name: _query(case) for name, case in CASES.items()} | {"build_fingerprint": build_fingerprint}
ORACLES = {
    name: f"SELECT k, x, {want} AS y FROM (SELECT k, {value} AS x FROM (SELECT *, {key} AS k FROM {t}))" for name, (t, key, value, _, want) in CASES.items()
} | {
    "build_fingerprint": """SELECT s_nationkey, sha256('[' || string_agg('{"commit_sha":"' || b || '","full_name":"' || s_name || '"}', ',' ORDER BY s_name, b) || ']') AS fingerprint
FROM (SELECT s_nationkey, s_name, trunc(s_acctbal)::BIGINT::VARCHAR AS b FROM supplier) GROUP BY 1"""
}
