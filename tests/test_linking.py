from stratagraph.operators import linking


def test_imports(spark):
    imports = [("app.web.views", ".models"), ("app.web.views", "..core.db"), ("app.web.views", "app.core.db.session"), ("app.web.views", "os.path"),
               ("app.web.views", "My_Lib.x"), ("app.web.views", "nowhere"), ("app.web.views", "...gone"), ("app.web.views", ".")]
    modules = [("app",), ("app.web",), ("app.web.models",), ("app.core.db",), ("app.web.views",)]
    out = linking.classified_imports(
        spark.createDataFrame(imports, "module string, target string"), spark.createDataFrame(modules, "module string"), spark.createDataFrame([("my-lib",)], "package string")
    )
    got = {r.target: (r.category, r.resolved) for r in out.collect()}
    assert got == {
        ".models": ("relative_internal_module", "app.web.models"), "..core.db": ("relative_internal_module", "app.core.db"), "app.core.db.session": ("internal_module", "app.core.db"),
        "os.path": ("stdlib", None), "My_Lib.x": ("third_party", None), "nowhere": ("unknown", None), "...gone": ("unknown", None), ".": ("relative_internal_module", "app.web"),
    }


def test_calls(spark):
    symbols = [("m:f",), ("m:A",), ("m:A.run",), ("n:g",), ("n:h",), ("o:h",)]
    calls = [("m:A.run", "self.run"), ("m:A.run", "f"), ("m:f", "g"), ("m:f", "h"), ("m:f", "x.g"), ("m:A.run", "self.none"), ("m:", "A")]
    out = linking.resolved_calls(spark.createDataFrame(calls, "caller string, name string"), spark.createDataFrame(symbols, "symbol string"))
    got = {r.name: (r.callee, r.rule) for r in out.collect()}
    assert got == {"self.run": ("m:A.run", "enclosing_class"), "f": ("m:f", "same_module"), "g": ("n:g", "unique_name"), "h": (None, None), "x.g": (None, None), "self.none": (None, None), "A": ("m:A", "same_module")}


def test_packages(spark):
    providers = [("h/o/lib", "Lib_A"), ("h/o/one", "dup"), ("h/o/two", "dup"), ("h/o/git", "other")]
    deps = [("c1", "lib.a", None), ("c2", "lib-a", None), ("c1", "dup", None), ("c1", "ext", None), ("c1", "fork", "git+ssh://git@h/o/git.git"), ("c2", "fork", None)]
    out = linking.linked_packages(spark.createDataFrame(deps, "consumer string, package string, target_url string"), spark.createDataFrame(providers, "repo string, name string"))
    got = {r.package: (r.consumers, r.providers, r.provider, r.bucket) for r in out.collect()}
    assert got == {
        "lib-a": (2, 1, "h/o/lib", "candidate_internal"), "dup": (1, 2, None, "candidate_internal_ambiguous"),
        "ext": (1, 0, None, "consumer_manifest_external"), "fork": (2, 1, None, "candidate_internal_ambiguous"),
    }


def test_script_imports(spark):
    files = ["src/a/x.ts", "src/a/y/index.tsx", "src/lib/z.d.ts", "src/lib/special/z.ts", "src/app.css", "shared/util.js"]
    wanted = {
        "./x": ("relative_internal_module", "src/a/x.ts"), "../a/y": ("relative_internal_module", "src/a/y/index.tsx"), "../app.css": ("relative_resource_module", "src/app.css"),
        "@lib/z": ("internal_module", "src/lib/z.d.ts"), "@lib/special/z": ("internal_module", "src/lib/special/z.ts"), "shared/util": ("internal_module", "shared/util.js"),
        "node:fs": ("node_builtin", None), "react-dom/server": ("third_party", None), "@o/p/sub": ("third_party", None), "./none": ("unknown", None), "left": ("unknown", None),
    }
    imports = spark.createDataFrame([("src/a/main.ts", t) for t in wanted], "path string, target string")
    out = linking.resolved_script_imports(
        imports, spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([("@lib/*", "src/lib/*"), ("@lib/special/*", "src/lib/special/*")], "pattern string, replacement string"),
        spark.createDataFrame([("react-dom",), ("@o/p",)], "package string"),
    )
    assert {r.target: (r.category, r.resolved) for r in out.collect()} == wanted


def test_possible_matches_against_the_plain_choice(spark):
    """Left keys choose in their order, each the best that is left."""
    import random
    from difflib import SequenceMatcher

    from stratagraph.operators import joins

    random.seed(4)
    words = ["user", "users", "order", "orders", "item", "items", "pay", "list"]
    make = lambda: "/" + "/".join(random.choice([*words, "v1", "v2"]) + random.choice(["", "_id", "-x"]) for _ in range(random.randint(1, 4)))
    left, right = sorted({make() for _ in range(60)}), sorted({make() for _ in range(60)})
    right = [r for r in right if r not in left]
    segments = lambda k: {s for s in k.replace("_", "/").replace("-", "/").split("/") if s and not (s[0] == "v" and s[1:].isdigit())}
    used, want = set(), set()
    for a in left:
        near = [b for b in right if b not in used and min(len(a), len(b)) / max(len(a), len(b)) >= 0.35 and (segments(a) & segments(b) or a[:4] == b[:4])]
        scored = [(round(SequenceMatcher(None, a, b).ratio(), 3), b) for b in near]
        scored = [x for x in scored if x[0] >= 0.78]
        if scored:
            best = max(scored)
            used.add(best[1])
            want.add((a, best[1], best[0]))
    one = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    got = {tuple(r) for r in joins.possible_matches(one(left), one(right), "key").collect()}
    assert got == want and len(want) > 10
