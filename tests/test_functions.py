import pytest
from pyspark.sql import functions as F

from stratagraph.functions import columns as C

CASES = [
    (C.normal_path, r".\src\a.py", "src/a.py"), (C.normal_path, ".env", "env"), (C.normal_path, "../a", "a"), (C.normal_path, None, None),
    (C.path_shape, "/a/:id/<int:x>/{y}/7/b/", "/a/{}/{}/{}/{}/b"), (C.path_shape, "/", "/"),
    (C.package_name, " My_Pkg..Name-x ", "my-pkg-name-x"), (C.dimension_package_name, "My_Pkg.x", "my-pkg.x"),
    (C.tokens, "getHTTPServer_name2", ["get", "httpserver", "name2"]), (C.slug, " A  b/C! ", "a_b_c"),
    (C.host, "https://u:p@Host.COM:80/x", "host.com"), (C.url_path, "http://h/a/b?q#f", "/a/b"), (C.url_path, "http://h", "/"),
    (C.git_identity, "git@GitHub.com:Own/Name.git", "github.com/Own/Name"), (C.git_identity, "git+https://www.x.org/o/n.git#main", "x.org/o/n"),
    (C.git_identity, "ssh://git@h:22/o/n", "h/o/n"), (C.git_identity, "plain", None),
    (C.is_queue_name, "jobs.fifo", True), (C.is_queue_name, "a b", False), (C.is_domain, "*.A-b.example.com", True), (C.is_domain, "-a.com", False),
    (C.is_ipv4, "1.2.3.255", True), (C.is_ipv4, "1.2.3.256", False), (C.urn_part, "a b/c", "a%20b%2Fc"), (C.status, "", "canonical"),
    (C.status, None, "canonical"), (C.is_test_path, "src/tests/x.py", True), (C.is_test_path, "a/b.spec.ts", True), (C.is_test_path, "contest/a.py", False),
    (C.path_environment_rank, "deploy/eu-Prod/x.yaml", 0), (C.domain_environment_rank, "stage-one.x", 2), (C.path_environment_rank, "x", 1), (C.path_environment_rank, None, 4),
    (C.unversioned, "/v1/Users/{}/posts", ["users", "posts"]),
]


@pytest.mark.parametrize("f, given, want", CASES)
def test_scalar(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(f("x")).first()[0] == want


def test_of_two(spark):
    row = spark.range(1)
    assert row.select(C.repo_matches(F.lit("Own/Name"), F.lit("name"))).first()[0]
    assert not row.select(C.repo_matches(F.lit("own/name"), F.lit("other/name"))).first()[0]
    assert row.select(C.common_prefix_length(F.lit("abcd"), F.lit("abx"))).first()[0] == 2
    labels, some, none = (F.create_map(*[F.lit(x) for x in m]) for m in (("a", "1", "b", "2"), ("a", "1"), ("a", "2")))
    assert row.select(C.contains_map(labels, some)).first()[0] and not row.select(C.contains_map(labels, none)).first()[0]
    assert row.select(C.arn_part(F.lit("arn:aws:sqs:eu:1:q:x"), 6)).first()[0] == "q:x"
    assert row.select(C.masked(F.lit("secret"), 2)).first()[0] == "se****"
    assert row.select(C.stable_hash("ent_", F.lit("a"), F.lit(None), F.lit("b"))).first()[0] == "ent_" + __import__("hashlib").sha256(b"a|b").hexdigest()[:24]
