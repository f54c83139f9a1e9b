from stratagraph.sources import changes

DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +3,4 @@ def f():
@@ -9 +12 @@
@@ -20,3 +22,0 @@
--- a/gone.py
+++ /dev/null
@@ -1,3 +0,0 @@
--- /dev/null
+++ b/new dir/y.py\t2020
@@ -0,0 +1,7 @@
"""


def test_ranges_of_the_new_side():
    assert changes.diff_ranges(DIFF) == [("x.py", 3, 6), ("x.py", 12, 12), ("new dir/y.py", 1, 7)]


def test_owners(spark):
    text = "# all\n* @all\n*.js @web # scripts\n/docs/ @docs\nsrc/**/core @core @all\nsecret.txt\n"
    files = spark.createDataFrame([(p,) for p in ("a", "x/b.js", "docs/x/y.js", "x/docs/z", "src/a/b/core/m.py", "q/secret.txt")], "path string")
    got = {r.path: r.owners for r in changes.owned(spark, files, text).collect()}
    assert got == {"a": "@all", "x/b.js": "@web", "docs/x/y.js": "@docs", "x/docs/z": "@all", "src/a/b/core/m.py": "@core @all", "q/secret.txt": ""}
    assert [r.owners for r in changes.owned(spark, files.limit(1), "# none").collect()] == [None]
