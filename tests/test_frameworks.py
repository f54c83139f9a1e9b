from pyspark.sql import functions as F

from stratagraph.operators import linking
from stratagraph.sources import adapters, frameworks

FILES = {
    "app/clients.py": "class Client:\n    def send(self): ...\n    async def poll(self): ...\nclass Other:\n    def send(self): ...\nasync def top(): ...\n",
    "app/use.py": (
        "from app.clients import Client, Other as O\nimport app.clients as c\nimport app.clients\nclass Local:\n    def run(self): ...\n"
        "def f(x):\n    a = Client()\n    a.send()\n    a.nothing()\n    if x:\n        a = O()\n        a.send()\n    a.poll()\n    x.send()\n"
        "def g(Client):\n    b = Client()\n    b.send()\n    Local().run()\n    d = c.Client()\n    d.poll()\n    for d in x:\n        d.poll()\n    e: O = O()\n    e.send()\n    app.clients.Other().send()\n"
    ),
    "shop/models.py": "from django.db import models\nclass Item(models.Model):\n    name = models.CharField(max_length=9)\n    owner = models.ForeignKey('crm.Person', on_delete=1)\n    parent = models.ForeignKey('self', null=True)\n    x = 3\n",
    "crm/models.py": "from django.db import models as m\nfrom shop.models import Item\nclass Person(m.Model):\n    items = m.ManyToManyField(Item)\n",
    "shop/api.py": (
        "from rest_framework import serializers, permissions\nfrom rest_framework.exceptions import PermissionDenied\nfrom .models import Item\nfrom celery import shared_task\n"
        "class ItemSerializer(serializers.ModelSerializer):\n    class Meta:\n        model = Item\nclass Own(permissions.BasePermission): ...\n"
        "class ItemView(GenericAPIView):\n    queryset = Item.objects.all()\n    permission_classes = [permissions.AllowAny, Own]\n    def get(self, request):\n        if not request.user.is_staff:\n            raise PermissionDenied('x')\n"
        "@shared_task\ndef sweep():\n    Item.objects.filter(a=1).delete()\n"
    ),
    "shop/urls.py": "from django.urls import path\nfrom .api import ItemView\nurlpatterns = [path('items/', ItemView.as_view())]\n",
    "web/app.py": "from flask import Flask\nfrom flask_login import login_required\napp = Flask(1)\n@app.route('/me', methods=['GET', 'POST'])\n@login_required\ndef me(): ...\n",
}


def rows(spark, name):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return adapters.extract(files, (name,))


def test_receivers(spark):
    out = rows(spark, "python-receivers")
    assert out.where("error IS NOT NULL").count() == 0
    kinds = {r.name: r.target for r in out.where("relation = 'HAS_KIND'").collect()}
    assert kinds["app.clients:top"] == "async_function" and kinds["app.clients:Client.poll"] == "method" and kinds["app.use:Local"] == "class"
    method = F.when(F.col("relation") == "CALLS_METHOD", F.substring_index("target", "|", -1))
    calls = out.where("relation IN ('CALLS_METHOD', 'CONSTRUCTS')").select(F.col("name").alias("caller"), F.substring_index("target", "|", 1).alias("made"), method.alias("method"), "line")
    parts = F.split("target", r"\|")
    imports = out.where("relation = 'IMPORTS_NAME'").select(F.col("name").alias("module"), parts[0].alias("target"), parts[1].alias("name"), parts[2].alias("alias"))
    symbols = out.where("relation = 'HAS_KIND'").select(F.col("name").alias("symbol"), F.col("target").alias("symbol_kind"))
    got = {(r.caller.split(":")[1], r.line, r.callee, r.rule) for r in linking.typed_calls(calls, imports, symbols).collect()}
    assert got == {
        ("f", 7, "app.clients:Client", "constructor"), ("f", 8, "app.clients:Client.send", "receiver"), ("f", 11, "app.clients:Other", "constructor"), ("f", 12, "app.clients:Other.send", "receiver"),
        ("g", 18, "app.use:Local", "constructor"), ("g", 18, "app.use:Local.run", "receiver"), ("g", 19, "app.clients:Client", "constructor"), ("g", 20, "app.clients:Client.poll", "receiver"),
        ("g", 23, "app.clients:Other", "constructor"), ("g", 24, "app.clients:Other.send", "receiver"), ("g", 25, "app.clients:Other", "constructor"), ("g", 25, "app.clients:Other.send", "receiver"),
    }


def test_models(spark):
    out = rows(spark, "python-django-models")
    got = {(r.name, r.relation, r.target) for r in out.collect()}
    assert got == {
        ("shop.models:Item", "DECLARES_FIELD", "shop.models:Item.name|CharField"), ("shop.models:Item", "DECLARES_FIELD", "shop.models:Item.owner|ForeignKey"),
        ("shop.models:Item", "DECLARES_FIELD", "shop.models:Item.parent|ForeignKey"), ("shop.models:Item.owner", "RELATES_TO_MODEL", "crm.Person"),
        ("shop.models:Item.parent", "RELATES_TO_MODEL", "shop.models.Item"), ("crm.models:Person", "DECLARES_FIELD", "crm.models:Person.items|ManyToManyField"),
        ("crm.models:Person.items", "RELATES_TO_MODEL", "shop.models.Item"), ("shop.api:ItemSerializer", "SERIALIZES_MODEL", "shop.models.Item"),
        ("shop.api:ItemView", "HANDLES_MODEL", "shop.models.Item"), ("shop.api:sweep", "TASK_USES_MODEL", "shop.models.Item"),
    }
    symbols = rows(spark, "python-receivers").where("relation = 'HAS_KIND'").select(F.col("name").alias("symbol"))
    met = linking.named_symbols(out.where("relation = 'RELATES_TO_MODEL'").select("name", F.col("target").alias("named")), symbols)
    assert {(r["name"], r.symbol) for r in met.collect()} == {
        ("shop.models:Item.owner", "crm.models:Person"), ("shop.models:Item.parent", "shop.models:Item"), ("crm.models:Person.items", "shop.models:Item"),
    }


def test_authorisation(spark):
    got = {(r.name, r.relation, r.target) for r in rows(spark, "python-authz").collect()}
    assert got == {
        ("shop.api.Own", "DEFINES_AUTHZ_POLICY", "rest_framework.permissions.BasePermission|"), ("shop.api.ItemView", "APPLIES_AUTHZ_POLICY", "rest_framework.permissions.AllowAny|public"),
        ("shop.api.ItemView", "APPLIES_AUTHZ_POLICY", "shop.api.Own|custom"), ("shop.api.ItemView.get", "USES_AUTHZ_CHECK", "request.user.is_staff|privileged"),
        ("shop.api.ItemView.get", "USES_AUTHZ_CHECK", "rest_framework.exceptions.PermissionDenied|permission_denied"), ("shop.api.ItemView", "HANDLES_ENDPOINT", "ANY /items/"),
        ("web.app.me", "HANDLES_ENDPOINT", "GET /me"), ("web.app.me", "HANDLES_ENDPOINT", "POST /me"), ("web.app.me", "APPLIES_AUTHZ_POLICY", "flask_login.login_required|authenticated"),
    }


def test_names_of_a_package():
    import ast

    names = frameworks.Names("a.b", ast.parse("from . import c\nfrom ..d import e as f\nimport g.h\nimport i.j as k\n"), True)
    assert names.known == {"c": "a.b.c", "f": "a.d.e", "g": "g", "k": "i.j"}
