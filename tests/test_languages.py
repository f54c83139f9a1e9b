from pyspark.sql import functions as F

from stratagraph.operators import linking
from stratagraph.sources import adapters, languages

FILES = {
    "cfg/base.py": "import os\nHOST = 'api.example'\nURL = f'https://{HOST}/v1'\nREGION = os.getenv('REGION', 'eu')\nclass C:\n    NAME = 'q-' + REGION\nX = Y\nY = X\nif 1:\n    MODE = 'a'\nelse:\n    MODE = 'b'\nN = 3\n",
    "app/use.py": "from cfg.base import URL as U, MODE\nimport cfg.base as b\nPAY = U + '/pay'\nQUEUE = b.C.NAME\nM = MODE\nBOTH = MODE + '!'\nrequests.get(PAY)\n# requests.get(no)\n",
    "web/api.ts": "import { http } from './http'\nconst api = Router()\napp.use('/v1', api)\napi.get('/users/:id', h)\nhttp.post('/pay', x)\n@Controller('cats')\nclass K {\n  @Get(':id') one() {}\n  @MessagePattern({ cmd: 'sum' }) s() {}\n  @EventPattern('made') m() {}\n}\n"
    "this.client.emit('made', 1)\n// client.emit('no')\nsqs.send(new SendMessageCommand({ MessageBody: '', QueueUrl: 'https://sqs/1/jobs' }))\nclient.send(name, 2)\nfetch(url)\n",
    "web/http.ts": "export const http = axios.create({ baseURL: 'https://pay.example/' })\n",
    "net/Cart.cs": "using System.Linq;\nnamespace Shop.Core;\npublic class Cart : IConsumer<Paid> {\n  // void No() {}\n  public async Task<int> Add(Item x) {\n    var s = \"Fake(\";\n    await bus.Publish(new Added());\n    return Total(x);\n  }\n  private int Total(Item x) => x.Price();\n"
    "  public void Send() {\n    var s = client.CreateSender(\"orders\");\n  }\n}\npublic interface ICart { }\n",
    "infra/cdn.tf": 'variable "host" {\n  default = "www.example.com"\n}\nlocals {\n  more = ["A.example.com", "b.example.com"]\n}\nresource "aws_cloudfront_distribution" "site" {\n  aliases = ["cdn.example.com", var.host]\n  origin {\n    domain_name = aws_s3_bucket.site.bucket_regional_domain_name\n  }\n}\n'
    'resource "aws_cloudfront_distribution" "more" {\n  aliases = local.more\n  origin {\n    domain_name = aws_s3_bucket.m.id\n  }\n}\nresource "aws_cloudfront_distribution" "live" {\n  aliases = ["live.example.com"]\n  origin {\n    domain_name = "backend.example.com"\n  }\n}\n',
    "other/cdn.tf": 'resource "aws_cloudfront_distribution" "x" {\n  aliases = [var.host]\n  origin {\n    domain_name = aws_s3_bucket.x.id\n  }\n}\n',
}


def rows(spark, *names):
    out = adapters.extract(spark.createDataFrame(list(FILES.items()), "path string, text string"), names)
    assert out.where("error IS NOT NULL").count() == 0
    return out


def test_constants_over_modules(spark):
    bound = rows(spark, "python-constants").select("name", F.col("target").alias("parts"))
    got = {(r["name"], r.value) for r in linking.resolved_constants(bound).collect()}
    assert got == {
        ("cfg.base.HOST", "api.example"), ("cfg.base.URL", "https://api.example/v1"), ("cfg.base.REGION", "eu"), ("cfg.base.C.NAME", "q-eu"), ("cfg.base.MODE", "a"), ("cfg.base.MODE", "b"),
        ("app.use.PAY", "https://api.example/v1/pay"), ("app.use.QUEUE", "q-eu"), ("app.use.M", "a"), ("app.use.M", "b"),
    }


def test_scripts(spark):
    got = {(r.name, r.relation) for r in rows(spark, "typescript-message-transport").collect()}
    assert got == {("pattern:sum", "CONSUMES_EVENT"), ("pattern:made", "CONSUMES_EVENT"), ("pattern:made", "PRODUCES_EVENT"), ("sqs:jobs", "PRODUCES_EVENT"), ("name", "UNRESOLVED_CHANNEL")}
    out = rows(spark, "typescript-routes")
    assert {r.name for r in out.where("relation = 'EXPOSES_ENDPOINT'").collect()} == {"GET /v1/users/:id", "GET /cats/:id"}
    part = lambda c, k: F.split_part(F.col(c), F.lit("|"), F.lit(k))
    calls = out.where("relation = 'CALLS_BY_CLIENT'").select(part("target", 1).alias("path"), part("target", 2).alias("client"), F.substring_index("name", " ", 1).alias("method"), F.substring_index("name", " ", -1).alias("route"))
    clients = out.where("relation = 'EXPORTS_CLIENT'").select(part("name", 1).alias("path"), part("name", 2).alias("client"), part("target", 1).alias("url"))
    imports = spark.createDataFrame([("web/api.ts", "web/http.ts", "http", "http")], "path string, resolved string, name string, alias string")
    assert [tuple(r) for r in linking.client_calls(calls, clients, imports).collect()] == [("web/api.ts", "POST https://pay.example/pay")]


def test_csharp(spark):
    got = {(r.name, r.relation, r.target) for r in rows(spark, "dotnet-csharp").collect()}
    assert got == {
        ("net/Cart.cs", "IMPORTS", "System.Linq"), ("Shop.Core:Cart", "HAS_KIND", "class"), ("message:Paid", "CONSUMES_EVENT", "net/Cart.cs"), ("Shop.Core:Cart.Add", "HAS_KIND", "method"),
        ("Shop.Core:Cart.Add", "CALLS", "bus.Publish"), ("Shop.Core:Cart.Add", "CALLS", "Added"), ("message:Added", "PRODUCES_EVENT", "net/Cart.cs"), ("Shop.Core:Cart.Add", "CALLS", "Total"),
        ("Shop.Core:Cart.Total", "HAS_KIND", "method"), ("Shop.Core:Cart.Send", "HAS_KIND", "method"), ("Shop.Core:Cart.Send", "CALLS", "client.CreateSender"),
        ("servicebus:orders", "PRODUCES_EVENT", "net/Cart.cs"), ("Shop.Core:ICart", "HAS_KIND", "interface"),
    }


def test_delivery(spark):
    out = rows(spark, "terraform-cdn").select("name", "relation", "target")
    assert {(r.domain, r.target) for r in linking.delivered(out).collect()} == {
        ("cdn.example.com", "infra|aws_s3_bucket.site"), ("www.example.com", "infra|aws_s3_bucket.site"), ("a.example.com", "infra|aws_s3_bucket.m"), ("b.example.com", "infra|aws_s3_bucket.m"),
    }


def test_opportunities_and_blanks(spark):
    got = {(r.name, r.relation, r.target, r.line) for r in rows(spark, "opportunities").collect()}
    assert ("python", "CALLS_ENDPOINT", "app/use.py", 7) in got and ("python", "CALLS_ENDPOINT", "app/use.py", 8) not in got
    assert ("typescript", "CALLS_ENDPOINT", "web/api.ts", 16) in got and ("terraform", "REFERENCES_DOMAIN", "infra/cdn.tf", 2) in got
    assert languages.blanked("a 'b\\'c' // d\n\"e\" /* f\ng */ h") == "a '    '     \n\" \"     \n     h"


def test_configurations_inherit(spark):
    configs = [("a", "b", None, None), ("b", "c", "src", {"@/*": "./*"}), ("c", "a", "lib", {"x": "y"}), ("d", "missing", ".", {"~/*": "app/*"}), ("e", None, None, None)]
    out = linking.chained_aliases(spark.createDataFrame(configs, "config string, extends string, base_url string, aliases map<string,string>"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", "src", "@/*", "./*"), ("b", "src", "@/*", "./*"), ("c", "lib", "x", "y"), ("d", ".", "~/*", "app/*")]
