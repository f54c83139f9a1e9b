"""Queries of the adapters: files written from the supplied keys, and in SQL the rows that must come of them.

Each case is (adapter, path, text, rows): ``~`` stands for a line end, rows are (kind, name, relation, target, line) in
DuckDB's SQL over the same keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.sources import adapters
from stratagraph.sources.files import language_coverage

from .projections import table

Case = tuple[str, str, str, tuple[tuple[str, str, str, str, int], ...]]

CASES: dict[str, Case] = {
    "ad_dotenv": ("config-dotenv", "'a' || k || '/.env'", "'# c~export KEY_' || k || '=''x y'' # z~EMPTY=~bad line~'",
                  (("EnvVar", "'KEY_' || k", "REFERENCES_ENV_VAR", "'set'", 2), ("EnvVar", "'EMPTY'", "REFERENCES_ENV_VAR", "'empty'", 3))),
    "ad_cname": ("config-cname", "'s' || k || '/CNAME'", "'Docs' || k || '.Example.org~not a domain~'", (("Domain", "'docs' || k || '.example.org'", "REFERENCES_DOMAIN", "path", 1),)),
    "ad_domain_env": ("config-domain-env", "'c' || k || '.py'", "'u = ''https://api' || k || '.example.com/x''~v = os.getenv(''TOKEN_' || k || ''')~'",
                      (("Domain", "'api' || k || '.example.com'", "REFERENCES_DOMAIN", "path", 1), ("EnvVar", "'TOKEN_' || k", "REFERENCES_ENV_VAR", "path", 2))),
    "ad_openapi": ("config-openapi", "'d' || k || '/openapi.json'", "'{\"paths\": {\"/a/{x}/' || k || '\": {\"get\": {}, \"delete\": {}, \"summary\": \"s\"}}}'",
                   (("Endpoint", "'GET /a/{x}/' || k", "DOCUMENTS_ENDPOINT", "path", 1), ("Endpoint", "'DELETE /a/{x}/' || k", "DOCUMENTS_ENDPOINT", "path", 1))),
    "ad_grpc": ("config-grpc-proto", "'p' || k || '.proto'", "'package shop.v1;~/* service Old {~ rpc Gone(A) returns (B); } */~service Cart' || k || ' {~  rpc Add(Item) returns (Ok); // rpc No(~}~'",
                (("Endpoint", "'POST /shop.v1.Cart' || k || '/Add'", "EXPOSES_ENDPOINT", "'shop.v1.Cart' || k", 5),)),
    "ad_kubernetes": ("config-kubernetes-yaml", "'k' || k || '.yaml'",
                      "'apiVersion: apps/v1~kind: Deployment~metadata: {name: web' || k || '}~spec:~  template:~    metadata:~      labels: {app: web}~---~apiVersion: v1~kind: Service~metadata: {name: web' || k || '}~spec:~  selector: {app: web}~'",
                      (("DeployTarget", "'default/web' || k", "DEPLOYS_VIA_CONFIG", "'Deployment'", 1), ("DeployTarget", "'default/web' || k", "HAS_LABEL", "'app=web'", 1), ("Service", "'default/web' || k", "SELECTS", "'app=web'", 1))),
    "ad_serverless": ("config-serverless-yaml", "'s' || k || '/serverless.yml'", "'functions:~  f:~    events:~    - http: GET users/' || k || '~    - sqs: arn:aws:sqs:eu:1:jobs' || k || '~    - schedule: rate(1 day)~'",
                      (("Endpoint", "'GET /users/' || k", "EXPOSES_ENDPOINT", "'f'", 1), ("EventChannel", "'sqs:jobs' || k", "CONSUMES_EVENT", "'f'", 1))),
    "ad_terraform": ("config-terraform", "'t' || k || '.tf'", "'resource \"aws_sqs_queue\" \"jobs\" {~  name = \"jobs-' || k || '\"~}~resource \"x\" \"y\" {~  event_source_arn = aws_sqs_queue.jobs.arn~  host = \"h' || k || '.example.com\" # note~}~'",
                     (("EventChannel", "'jobs-' || k", "DEFINES_CHANNEL", "'aws_sqs_queue.jobs'", 2), ("EventChannel", "'aws_sqs_queue.jobs'", "CONSUMES_EVENT", "'x.y'", 5), ("Domain", "'h' || k || '.example.com'", "REFERENCES_DOMAIN", "'x.y'", 6))),
    "ad_cdn": ("terraform-cdn", "'c' || k || '/main.tf'", "'variable \"host\" {~  default = \"w' || k || '.example.com\"~}~resource \"aws_cloudfront_distribution\" \"d\" {~  aliases = [\"cdn' || k || '.example.com\", var.host]~  origin {~    domain_name = aws_s3_bucket.b.id~  }~}~'",
               (("Variable", "'c' || k || '|var.host'", "DEFAULTS_TO", "'w' || k || '.example.com'", 2), ("Distribution", "'c' || k || '|aws_cloudfront_distribution.d'", "HAS_ALIAS", "'cdn' || k || '.example.com'", 5),
                ("Distribution", "'c' || k || '|aws_cloudfront_distribution.d'", "HAS_ALIAS", "'c' || k || '|var.host'", 5), ("Distribution", "'c' || k || '|aws_cloudfront_distribution.d'", "HAS_ORIGIN", "'c' || k || '|aws_s3_bucket.b'", 7))),
    "ad_zappa": ("config-zappa", "'z' || k || '/zappa_settings.json'", "'{\"prod\": {\"project_name\": \"pay' || k || '\", \"domain\": \"Pay' || k || '.example.com\"}}'",
                 (("DeployTarget", "'pay' || k || '-prod'", "DEPLOYS_VIA_CONFIG", "'zappa_lambda'", 1), ("Domain", "'pay' || k || '.example.com'", "ROUTES_DOMAIN_TO_DEPLOY", "'pay' || k || '-prod'", 1))),
    "ad_vhost": ("config-apache-vhost", "'v' || k || '.conf'", "'<VirtualHost *:80>~ServerName a' || k || '.example.com:80~WSGIScriptAlias / /srv/' || k || '.wsgi~</VirtualHost>~ServerName out.example.com~'",
                 (("Domain", "'a' || k || '.example.com'", "ROUTES_DOMAIN_TO_DEPLOY", "'/srv/' || k || '.wsgi'", 2),)),
    "ad_dotnet": ("dotnet-endpoints", "'n' || k || '.cs'", "'[Route(\"api/[controller]\")]~public class Cart' || k || 'Controller {~[HttpGet(\"{id}\")]~void G();~}~app.MapPost(\"/pay\", p);~'",
                  (("CodeSymbol", "'Cart' || k || 'Controller'", "DEFINED_IN", "path", 2), ("Endpoint", "'GET /api/cart' || k || '/{id}'", "EXPOSES_ENDPOINT", "'Cart' || k || 'Controller'", 3), ("Endpoint", "'POST /pay'", "EXPOSES_ENDPOINT", "path", 6))),
    "ad_csharp": ("dotnet-csharp", "'m' || k || '.cs'", "'using System.Linq;~namespace Shop;~public class Cart' || k || ' : IConsumer<Paid> {~  public int Add(Item x) {~    return Total(x);~  }~}~'",
                  (("CodeModule", "path", "IMPORTS", "'System.Linq'", 1), ("CodeSymbol", "'Shop:Cart' || k", "HAS_KIND", "'class'", 3), ("EventChannel", "'message:Paid'", "CONSUMES_EVENT", "path", 3),
                   ("CodeSymbol", "'Shop:Cart' || k || '.Add'", "HAS_KIND", "'method'", 4), ("CodeSymbol", "'Shop:Cart' || k || '.Add'", "CALLS", "'Total'", 5))),
    "ad_channels": ("event-channel-text", "'q' || k || '.ini'", "'[a]~queue_name = orders-' || k || '~'", (("EventChannel", "'orders-' || k", "REFERENCES_EVENT_CHANNEL", "path", 2),)),
    "ad_manifests": ("package-manifests", "'r' || k || '/requirements.txt'", "'# c~Lib' || k || '[x]>=4~own @ git+https://h/o/lib.git~-r other.txt~'",
                     (("ExternalPackage", "'Lib' || k", "DEPENDS_ON", "'registry'", 2), ("ExternalPackage", "'own'", "DEPENDS_ON", "'git_url'", 3))),
    "ad_python": ("python-ast", "'app/m' || k || '.py'", "'from .db import q~@app.get(''/u/' || k || ''')~def user(id):~    return q(id)~'",
                  (("CodeModule", "'app.m' || k", "DEFINED_IN", "path", 1), ("CodeModule", "'app.m' || k", "IMPORTS", "'.db'", 1), ("CodeSymbol", "'app.m' || k || ':user'", "DEFINED_IN", "'app.m' || k", 3),
                   ("Endpoint", "'GET /u/' || k", "EXPOSES_ENDPOINT", "'app.m' || k || ':user'", 2), ("CodeSymbol", "'app.m' || k || ':user'", "CALLS", "'app.get'", 2), ("CodeSymbol", "'app.m' || k || ':user'", "CALLS", "'q'", 4))),
    "ad_receivers": ("python-receivers", "'app/r' || k || '.py'", "'from x import C as D~def f(a):~    b = D()~    b.go' || k || '()~    a.no()~'",
                     (("CodeModule", "'app.r' || k", "IMPORTS_NAME", "'x|C|D'", 1), ("CodeSymbol", "'app.r' || k || ':f'", "HAS_KIND", "'function'", 2), ("CodeSymbol", "'app.r' || k || ':f'", "CONSTRUCTS", "'D'", 3),
                      ("CodeSymbol", "'app.r' || k || ':f'", "CALLS_METHOD", "'D|go' || k", 4))),
    "ad_constants": ("python-constants", "'cfg/c' || k || '.py'", "'HOST = ''h' || k || '.example''~URL = HOST + ''/v1''~N = 3~'",
                     (("Constant", "'cfg.c' || k || '.HOST'", "BOUND_TO", "'[[\"text\", \"h' || k || '.example\"]]'", 1), ("Constant", "'cfg.c' || k || '.URL'", "BOUND_TO", "'[[\"name\", \"cfg.c' || k || '.HOST\"], [\"text\", \"/v1\"]]'", 2))),
    "ad_builtins": ("python-builtins", "'h' || k || '.py'", "'def len(x): ...~def f(print):~    print(1)~    len(2)~    return sorted(max(' || k || ', 1))~class A:~    def g(self):~        return open(''x'')~'",
                    (("ExternalSymbol", "'builtins.sorted'", "CALLS_BUILTIN", "'h' || k || ':f'", 5), ("ExternalSymbol", "'builtins.max'", "CALLS_BUILTIN", "'h' || k || ':f'", 5), ("ExternalSymbol", "'builtins.open'", "CALLS_BUILTIN", "'h' || k || ':A.g'", 8))),
    "ad_http_client": ("python-http-client", "'o' || k || '.py'", "'BASE = ''https://api.example.com''~requests.post(BASE + ''/pay/' || k || ''')~requests.get(where)~'",
                       (("Endpoint", "'POST https://api.example.com/pay/' || k", "CALLS_ENDPOINT", "path", 2),)),
    "ad_transport": ("python-boto3-transport", "'b' || k || '.py'", "'import boto3~sqs = boto3.client(''sqs'')~def run():~    sqs.send_message(QueueUrl=''https://sqs.eu.amazonaws.com/1/jobs' || k || ''')~    other.send_message(QueueUrl=''https://sqs.eu.amazonaws.com/1/no'')~    sqs.receive_message(QueueUrl=find())~'",
                     (("EventChannel", "'sqs:jobs' || k", "PRODUCES_EVENT", "path", 4), ("EventChannel", "'find()'", "UNRESOLVED_CHANNEL", "path", 6))),
    "ad_routes": ("python-web-routes", "'w' || k || '.py'", "'r = APIRouter(prefix=''/shop' || k || ''')~@r.get(''/cart'')~def cart(): ...~urlpatterns = [path(''u/<int:id>/'', views.user), path(''sub/'', include(''x''))]~'",
                  (("Endpoint", "'GET /shop' || k || '/cart'", "EXPOSES_ENDPOINT", "'cart'", 2), ("Endpoint", "'ANY /u/<int:id>/'", "EXPOSES_ENDPOINT", "'views.user'", 4))),
    "ad_models": ("python-django-models", "'shop/models' || k || '.py'", "'from django.db import models~class Item(models.Model):~    name = models.CharField()~    owner = models.ForeignKey(''crm.Person' || k || ''')~'",
                  (("CodeSymbol", "'shop.models' || k || ':Item'", "DECLARES_FIELD", "'shop.models' || k || ':Item.name|CharField'", 3), ("CodeSymbol", "'shop.models' || k || ':Item'", "DECLARES_FIELD", "'shop.models' || k || ':Item.owner|ForeignKey'", 4),
                   ("CodeSymbol", "'shop.models' || k || ':Item.owner'", "RELATES_TO_MODEL", "'crm.Person' || k", 4))),
    "ad_authz": ("python-authz", "'web/a' || k || '.py'", "'from flask_login import login_required~@app.route(''/me' || k || ''')~@login_required~def me():~    if current_user.is_authenticated: pass~'",
                 (("CodeSymbol", "'web.a' || k || '.me'", "HANDLES_ENDPOINT", "'GET /me' || k", 2), ("CodeSymbol", "'web.a' || k || '.me'", "APPLIES_AUTHZ_POLICY", "'flask_login.login_required|authenticated'", 3),
                  ("CodeSymbol", "'web.a' || k || '.me'", "USES_AUTHZ_CHECK", "'current_user.is_authenticated|authenticated'", 5))),
    "ad_typescript": ("typescript-text", "'x' || k || '.ts'", "'import x from ''./x' || k || '''~app.get(''/health'', h)~fetch(''/api/users'')~'",
                      (("CodeModule", "path", "IMPORTS", "'./x' || k", 1), ("Endpoint", "'GET /health'", "EXPOSES_ENDPOINT", "path", 2), ("Endpoint", "'GET /api/users'", "CALLS_ENDPOINT", "path", 3))),
    "ad_script_routes": ("typescript-routes", "'y' || k || '.ts'", "'const api = Router()~app.use(''/v' || k || ''', api)~api.get(''/users'', h)~export const http = axios.create({ baseURL: ''https://p.example'' })~http.post(''/pay'', x)~'",
                         (("Endpoint", "'GET /v' || k || '/users'", "EXPOSES_ENDPOINT", "path", 3), ("Client", "path || '|http'", "EXPORTS_CLIENT", "'https://p.example|exported'", 4), ("Endpoint", "'POST /pay'", "CALLS_BY_CLIENT", "path || '|http'", 5))),
    "ad_script_messages": ("typescript-message-transport", "'e' || k || '.ts'", "'@EventPattern(''made' || k || ''') m() {}~this.client.emit(''made' || k || ''', 1)~// client.emit(''no'')~client.send(name, 2)~'",
                           (("EventChannel", "'pattern:made' || k", "CONSUMES_EVENT", "path", 1), ("EventChannel", "'pattern:made' || k", "PRODUCES_EVENT", "path", 2), ("EventChannel", "'name'", "UNRESOLVED_CHANNEL", "path", 4))),
    "ad_opportunities": ("opportunities", "'f' || k || '.py'", "'requests.get(x' || k || ')~# requests.get(y)~'", (("Opportunity", "'python'", "CALLS_ENDPOINT", "path", 1),)),
}


def files(spark: SparkSession, sf_dir: str, path: str, text: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return rows.select(F.expr(path).alias("path"), F.translate(F.expr(text), "~", "\n").alias("text"))


def _query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    name, path, text, _ = case

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = adapters.extract(files(spark, sf_dir, path, text), (name,))
        return out.select("path", "kind", "name", "relation", "target", F.col("line").cast("long").alias("line"), "error")

    return run


def _oracle(case: Case) -> str:
    _, path, _, rows = case
    each = [f"SELECT path, '{kind}' AS kind, {name} AS name, '{relation}' AS relation, {target} AS target, {line}::BIGINT AS line, NULL::VARCHAR AS error FROM f" for kind, name, relation, target, line in rows]
    return f"WITH f AS (SELECT s_suppkey AS k, {path} AS path FROM supplier) " + " UNION ALL ".join(each)


def adapter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where adapters worked and failed: every third file can't be parsed."""
    text = "CASE k % 3 WHEN 0 THEN 'def (:~' ELSE 'HOST = ''x''~' END"
    return adapters.coverage(adapters.extract(files(spark, sf_dir, "'c' || k || '.py'", text), ("python-constants", "python-ast")))


def language_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five suffixes, two of them without an adapter and one of no known language."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("py", "ts", "go", "rs", "none")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(suffix.alias("suffix"))
    return language_coverage(rows, {"python": "python-ast", "typescript": "typescript-text"})


QUERIES = {name: _query(case) for name, case in CASES.items()} | {"adapter_errors": adapter_errors, "language_states": language_states}
ORACLES = {name: _oracle(case) for name, case in CASES.items()} | {
    "language_states": """SELECT language, adapter, CASE WHEN adapter IS NULL THEN 'uninstrumented' ELSE 'instrumented' END AS state, count(*) AS files FROM (
SELECT ['python', 'typescript', 'go', 'rust'][s_suppkey % 5 + 1] AS language, ['python-ast', 'typescript-text', NULL, NULL][s_suppkey % 5 + 1] AS adapter FROM supplier WHERE s_suppkey % 5 < 4) GROUP BY 1, 2""",
    "adapter_errors": """SELECT adapter, state, count(*) AS files FROM (SELECT unnest(['python-constants', 'python-ast']) AS adapter, CASE WHEN s_suppkey % 3 = 0 THEN 'uninstrumented' ELSE 'instrumented' END AS state FROM supplier) GROUP BY 1, 2"""
}
