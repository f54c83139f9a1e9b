import json

from stratagraph.sources import adapters, files, snapshot
from stratagraph.streaming import deltas

TREE = {
    ".env": "# c\nexport API_KEY='x y' # z\nEMPTY=\nbad line\n",
    "site/CNAME": "Docs.Example.org\nnot a domain\n",
    "app/api.py": "import os\nfrom .db import q\n@app.route('/u/<id>', methods=['GET', 'POST'])\ndef user(id):\n    return q(os.getenv('DB_URL'))\nclass A:\n    async def m(self):\n        self.run()\n",
    "app/out.py": "import requests, boto3\nBASE = 'https://api.example.com'\nURL = BASE + '/v1'\nrequests.post(f'{URL}/pay/{id}')\nclient.request('PUT', '/x')\nrequests.get(where)\n"
    "sqs = boto3.client('sqs')\ndef send(url):\n    sqs.send_message(QueueUrl=url, MessageBody='')\ndef run():\n    send('https://sqs.eu-west-1.amazonaws.com/1/jobs')\n"
    "    sqs.receive_message(QueueUrl=find())\n    other.send_message(QueueUrl='https://sqs.eu-west-1.amazonaws.com/1/no')\n    sqs.delete_message(QueueUrl='https://sqs.eu-west-1.amazonaws.com/1/no')\n"
    "    q = boto3.resource('sqs').get_queue_by_name(QueueName='mail')\n    q.receive_messages()\n    boto3.client('sns').publish(TopicArn='arn:aws:sns:eu:1:news')\n",
    "app/urls.py": "r = APIRouter(prefix='/shop')\n@r.get('/cart')\ndef cart(): ...\nurlpatterns = [path('u/<int:id>/', views.user), path('sub/', include('x'))]\n",
    "app/broken.py": "def (:\n",
    "spec/openapi.json": json.dumps({"paths": {"/a/{x}": {"get": {}, "delete": {}, "summary": "s"}}}),
    "p/svc.proto": "package shop.v1;\n/* service Old {\n rpc Gone(A) returns (B); } */\nservice Cart {\n  rpc Add(Item) returns (Ok); // rpc No(\n}\n",
    "k/all.yaml": "apiVersion: apps/v1\nkind: Deployment\nmetadata: {name: web}\nspec:\n  template:\n    metadata:\n      labels: {app: web, tier: front}\n---\n"
    "apiVersion: v1\nkind: Service\nmetadata: {name: web}\nspec:\n  selector: {app: web}\n---\napiVersion: v1\nkind: Service\nmetadata: {name: no}\nspec:\n  selector: {app: web, tier: back}\n---\n"
    "kind: Ingress\napiVersion: n/v1\nmetadata: {name: i}\nspec:\n  rules:\n  - host: Shop.example.com\n    http:\n      paths:\n      - backend: {service: {name: web}}\n",
    "serverless.yml": "functions:\n  f:\n    events:\n    - http: GET users/{id}\n    - sqs: arn:aws:sqs:eu:1:jobs\n    - schedule: rate(1 day)\n",
    "infra/main.tf": 'resource "aws_sqs_queue" "jobs" {\n  name = "jobs"\n}\nresource "x" "y" {\n  event_source_arn = aws_sqs_queue.jobs.arn\n  host = "api.example.com" # note\n  doc = <<EOF\n  host = "no.example.com"\nEOF\n}\n',
    "zappa_settings.json": json.dumps({"prod": {"project_name": "pay", "domain": "Pay.example.com", "events": [{"event_source": {"arn": "arn:a:sqs:e:1:q"}}]}}),
    "v/site.conf": "<VirtualHost *:80>\nServerName a.example.com\nServerAlias b.example.com:80\nWSGIScriptAlias / /srv/app.wsgi\n</VirtualHost>\n<VirtualHost *:81>\nServerName open.example.com\n",
    "web/index.ts": "import x from './x'\nconst y = require(\"y\")\napp.get('/health', h)\nfetch('/api/users')\n",
    "net/C.cs": '[Route("api/[controller]")]\npublic class CartController {\n[HttpGet("{id}")]\nvoid G();\n}\napp.MapPost("/pay", p);\n',
    "q.ini": "[a]\nqueue_name = orders\n",
    "requirements.txt": "# c\nDjango[x]>=4 ; python_version > '3'\nlib @ git+https://h/o/lib.git\n-r other.txt\n",
    "package.json": json.dumps({"dependencies": {"a": "^1.0", "b": "workspace:*", "c": "file:../c", "d": "git+ssh://x"}}),
    "proj.csproj": '<Project>\n<PackageReference Include="N.Json" Version="1" />\n<ProjectReference Include="..\\b.csproj" />\n</Project>\n',
    "node_modules/z/index.js": "require('never')\n",
    "yarn.lock": "x", "main.go": "package main\n",
}


def test_tree(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = files.read_files(spark, f"file://{tmp_path}")
    assert {r.path for r in tree.select("path").collect()} == {p for p in TREE if not p.startswith(("node_modules", ".env"))}
    assert not {r.name for r in adapters.extract(tree.selectExpr("path", "decode(content, 'UTF-8') AS text")).where("adapter = 'python-boto3-transport'").collect()} & {"sqs:no", "no"}
    assert [tuple(r) for r in files.unsupported(tree, ("python", "typescript", "dotnet")).collect()] == [("go", 1, ["main.go"])]
    small, large = files.config_files(tree, ("yml", "yaml", "lock"))
    assert {r.path for r in small.collect()} == {"k/all.yaml", "serverless.yml"} and large.count() == 0
    texts = tree.selectExpr("path", "decode(content, 'UTF-8') AS text").union(files.read_dotenv(spark, f"file://{tmp_path}"))
    rows = adapters.extract(texts)
    got = {(r.adapter, r.name, r.relation, r.target) for r in rows.where("error IS NULL").collect()}
    want = {
        ("config-dotenv", "API_KEY", "REFERENCES_ENV_VAR", "set"), ("config-dotenv", "EMPTY", "REFERENCES_ENV_VAR", "empty"),
        ("config-cname", "docs.example.org", "REFERENCES_DOMAIN", "site/CNAME"), ("python-ast", "app.api:user", "DEFINED_IN", "app.api"),
        ("python-ast", "GET /u/<id>", "EXPOSES_ENDPOINT", "app.api:user"), ("python-ast", "POST /u/<id>", "EXPOSES_ENDPOINT", "app.api:user"),
        ("python-ast", "app.api", "IMPORTS", ".db"), ("python-ast", "app.api:user", "CALLS", "q"), ("python-ast", "app.api:A.m", "CALLS", "self.run"),
        ("python-ast", "DB_URL", "REFERENCES_ENV_VAR", "app.api"), ("config-openapi", "GET /a/{x}", "DOCUMENTS_ENDPOINT", "spec/openapi.json"),
        ("config-openapi", "DELETE /a/{x}", "DOCUMENTS_ENDPOINT", "spec/openapi.json"), ("config-grpc-proto", "POST /shop.v1.Cart/Add", "EXPOSES_ENDPOINT", "shop.v1.Cart"),
        ("python-http-client", "POST https://api.example.com/v1/pay/{}", "CALLS_ENDPOINT", "app/out.py"), ("python-http-client", "PUT /x", "CALLS_ENDPOINT", "app/out.py"),
        ("python-boto3-transport", "sqs:jobs", "PRODUCES_EVENT", "app/out.py"), ("python-boto3-transport", "find()", "UNRESOLVED_CHANNEL", "app/out.py"),
        ("python-boto3-transport", "sqs:mail", "CONSUMES_EVENT", "app/out.py"), ("python-boto3-transport", "sns:news", "PRODUCES_EVENT", "app/out.py"),
        ("python-boto3-transport", "url", "UNRESOLVED_CHANNEL", "app/out.py"),
        ("python-web-routes", "GET /shop/cart", "EXPOSES_ENDPOINT", "cart"), ("python-web-routes", "ANY /u/<int:id>/", "EXPOSES_ENDPOINT", "views.user"),
        ("config-kubernetes-yaml", "shop.example.com", "ROUTES_DOMAIN_TO_DEPLOY", "default/web"), ("config-serverless-yaml", "GET /users/{id}", "EXPOSES_ENDPOINT", "f"),
        ("config-serverless-yaml", "sqs:jobs", "CONSUMES_EVENT", "f"), ("config-terraform", "jobs", "DEFINES_CHANNEL", "aws_sqs_queue.jobs"),
        ("config-terraform", "aws_sqs_queue.jobs", "CONSUMES_EVENT", "x.y"), ("config-terraform", "api.example.com", "REFERENCES_DOMAIN", "x.y"),
        ("config-zappa", "pay-prod", "DEPLOYS_VIA_CONFIG", "zappa_lambda"), ("config-zappa", "pay.example.com", "ROUTES_DOMAIN_TO_DEPLOY", "pay-prod"),
        ("config-apache-vhost", "b.example.com", "ROUTES_DOMAIN_TO_DEPLOY", "/srv/app.wsgi"), ("typescript-text", "web/index.ts", "IMPORTS", "y"),
        ("typescript-text", "GET /health", "EXPOSES_ENDPOINT", "web/index.ts"), ("typescript-text", "GET /api/users", "CALLS_ENDPOINT", "web/index.ts"),
        ("dotnet-endpoints", "GET /api/cart/{id}", "EXPOSES_ENDPOINT", "CartController"), ("dotnet-endpoints", "POST /pay", "EXPOSES_ENDPOINT", "net/C.cs"),
        ("event-channel-text", "orders", "REFERENCES_EVENT_CHANNEL", "q.ini"), ("package-manifests", "Django", "DEPENDS_ON", "registry"),
        ("package-manifests", "lib", "DEPENDS_ON", "git_url"), ("package-manifests", "b", "DEPENDS_ON", "workspace"), ("package-manifests", "c", "DEPENDS_ON", "file_path"),
        ("package-manifests", "N.Json", "DEPENDS_ON", "registry"),
    }
    assert want <= got
    assert not {g for g in got if g[1] in ("no.example.com", "open.example.com", "POST /shop.v1.Cart/No", "-r")}
    assert {(r.path, r.error.split(":")[0]) for r in rows.where("error IS NOT NULL").collect()} == {("app/broken.py", "SyntaxError")}
    assert {tuple(r) for r in adapters.selected(rows).collect()} == {("default/web", "default/web")}
    assert adapters.coverage(rows).where("state = 'uninstrumented'").count() == 9  # each adapter of Python files
    used = rows.where("relation = 'IMPORTS'").select("path", "target")
    refused = adapters.refused_stacks(used, {"requests": "requests", "boto3": "boto3", "flask": "flask"}, ("requests",))
    assert [tuple(r) for r in refused.collect()] == [("boto3", 1, "no_adapter_for_known_stack")]


def test_snapshot_round_trip(spark, tmp_path):
    schema = snapshot.SCHEMAS["facts"]
    facts = spark.createDataFrame([(2, "f1", "CALLS", "a", "b", {}, None), (1, "f1", "CALLS", "a", "b", {"x": "1"}, "demoted"), (3, "f2", "IMPORTS", "a", "c", None, "")], schema)
    ent = spark.createDataFrame([(1, "e", "u", "Repo", {}, {}, "canonical")], snapshot.SCHEMAS["entities"])
    rest = {n: spark.createDataFrame([], snapshot.SCHEMAS[n]) for n in ("support_facts", "evidence", "coverage")}
    snapshot.write_snapshot({"entities": ent, "facts": facts, **rest}, f"{tmp_path}/s")
    back = snapshot.read_snapshot(spark, f"{tmp_path}/s")
    assert sorted((r.fact_id, r.ordinal, r.canonical_status) for r in back["facts"].collect()) == [("f1", 1, "demoted"), ("f2", 3, "canonical")]
    assert not (tmp_path / "s/support_facts").exists() and back["support_facts"].count() == 0
    assert [tuple(r) for r in snapshot.conflicts(facts, "fact_id").collect()] == [("f1", 2)]
    assert snapshot.merged([facts, facts], "fact_id").count() == 2
    refs = [("r", "c", "p", 1, 2), ("r", "c", "", 1, 2), ("r", "c", "p", 0, 2), ("r", "c", "p", 3, 2), None]
    rows = spark.createDataFrame([(r,) for r in refs], "bytes_ref struct<repo:string,commit_sha:string,path:string,line_start:int,line_end:int>")
    assert [r[0] for r in rows.select(snapshot.valid_coordinate()).collect()] == [True, False, False, False, False]
    repos = spark.createDataFrame([("a", "1"), ("b", "2")], "repo string, commit_sha string")
    assert snapshot.fingerprint(repos) == snapshot.fingerprint(repos.orderBy("commit_sha", ascending=False).union(repos))
    heads = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "repo string, commit_sha string")
    assert sorted(r.repo for r in deltas.stale_repos(repos, heads).collect()) == ["b", "c"]


def test_stream_of_deltas_keeps_the_first(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "id string, ordinal long, x string"

    def put(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("id", "ordinal", "x"), r, strict=True))) + "\n" for r in rows))
        q = deltas.start(deltas.read_deltas(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", "id", "ordinal", f"{tmp_path}/cp")
        q.awaitTermination()
        assert q.exception() is None
        return sorted((r.id, r.x) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert put("1.json", ("a", 2, "late"), ("a", 1, "first"), (None, 3, "no")) == [("a", "first")]
    assert put("2.json", ("a", 0, "again"), ("b", 5, "new")) == [("a", "first"), ("b", "new")]
