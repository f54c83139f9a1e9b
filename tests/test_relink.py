import hashlib
import json

import pytest

from stratagraph.sources import relink, snapshot


def stable(prefix, *parts):
    said = [json.dumps(p, sort_keys=True, separators=(",", ":")) if isinstance(p, dict) else str(p) for p in parts]
    return prefix + hashlib.sha256("|".join(said).encode()).hexdigest()[:24]


def rows(tenant="t"):
    a, b = ({"tenant_id": tenant, "repo": "r", "module": m} for m in ("x", "ü"))
    ids = [stable("ent_", "CodeModule", i) for i in (a, b)]
    ents = [(k, i, f"u{k}", "CodeModule", d, {}, "canonical") for k, (i, d) in enumerate(zip(ids, (a, b), strict=True))]
    fact = (0, stable("fact_", "IMPORTS", *ids, {"c": "d"}), "IMPORTS", *ids, {"c": "d"}, "canonical")
    seen = (0, "e1", "fact", fact[1], "deterministic_static", "py", {}, None, None, "2024-01-01T00:00:00Z")
    return {"entities": ents, "facts": [fact], "evidence": [seen]}


def write(spark, root, made, **manifest):
    snapshot.write_snapshot({n: spark.createDataFrame(r, snapshot.SCHEMAS[n]) for n, r in made.items()}, str(root))
    (root / "manifest.json").write_text(json.dumps({"repo_path": "/r", "commit_sha": "c", "tenant_id": "t"} | manifest))


def test_strict_read(spark, tmp_path):
    write(spark, tmp_path / "a", rows())
    found, tables = relink.read_strict(spark, str(tmp_path / "a"))
    assert found["commit_sha"] == "c" and tables["entities"].count() == 2 and tables["evidence"].count() == 1
    with pytest.raises(ValueError, match="tenant override"):
        relink.read_strict(spark, str(tmp_path / "a"), tenant="z")
    with pytest.raises(FileNotFoundError):
        relink.read_strict(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(
    "what, change, said",
    [
        ("entities", lambda r: (*r[:1], "ent_x", *r[2:]), "does not match"), ("entities", lambda r: (*r[:6], "odd"), "canonical_status"), ("facts", lambda r: (*r[:2], "", *r[3:]), "predicate"),
        ("facts", lambda r: (*r[:1], "fact_x", *r[2:]), "fact_id"), ("evidence", lambda r: (*r[:2], "thing", *r[3:]), "target_type"), ("evidence", lambda r: (*r[:9], None), "ingested_at"),
    ],
)
def test_what_a_strict_read_refuses(spark, tmp_path, what, change, said):
    made = rows()
    made[what][0] = change(made[what][0])
    write(spark, tmp_path / "a", made)
    with pytest.raises(ValueError, match=said):
        relink.read_strict(spark, str(tmp_path / "a"))


def test_folders(spark, tmp_path):
    for name, text in (("a", {"repo_path": "/r", "commit_sha": "c"}), ("b", {"repo_path": "/q", "commit_sha": "d"}), ("_fleet", {"build_type": "fleet_relink"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(text))
    (tmp_path / "plain").mkdir()
    assert relink.snapshot_folders(spark, [str(tmp_path)]) == [f"{tmp_path}/a", f"{tmp_path}/b"]
    assert relink.snapshot_folders(spark, [f"{tmp_path}/a", f"{tmp_path}/a"]) == [f"{tmp_path}/a"]
    assert relink.snapshot_folders(spark, [str(tmp_path)], (f"{tmp_path}/a",)) == [f"{tmp_path}/b"]
    for bad, kind in ((tmp_path / "none", FileNotFoundError), (tmp_path / "a" / "manifest.json", NotADirectoryError), (tmp_path / "plain", FileNotFoundError)):
        with pytest.raises(kind):
            relink.snapshot_folders(spark, [str(bad)])
    (tmp_path / "b" / "manifest.json").write_text("{}")
    with pytest.raises(ValueError, match="not a valid snapshot"):
        relink.snapshot_folders(spark, [str(tmp_path)])
    relink.unique_identities([{"repo_path": "/x/r", "owner": "o"}, {"repo_path": "/y/q", "owner": "o"}])
    for twice in ([{"repo_path": "/x/r"}, {"repo_path": "/y/r"}], [{"repo_path": "/a", "tenant_id": "t"}, {"repo_path": "/b", "tenant_id": "u"}]):
        with pytest.raises(ValueError):
            relink.unique_identities(twice)


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root, one = str(tmp_path / "out"), spark.range(1)
    relink.publish(spark, root, {"cross_repo_links": one}, {"n": 1})
    relink.publish(spark, root, {"cross_repo_links": spark.range(3), "runtime_links": one}, {"n": 2})
    assert spark.read.parquet(f"{root}/cross_repo_links").count() == 3 and json.loads((tmp_path / "out" / "manifest.json").read_text()) == {"n": 2}
    move = relink.Folder.move

    def fails(self, name, to):
        if name == "manifest.json" and ".staged-" in self.path:
            raise OSError("disk")
        return move(self, name, to)

    monkeypatch.setattr(relink.Folder, "move", fails)
    with pytest.raises(OSError):
        relink.publish(spark, root, {"cross_repo_links": spark.range(9)}, {"n": 3})
    monkeypatch.undo()
    assert spark.read.parquet(f"{root}/cross_repo_links").count() == 3 and spark.read.parquet(f"{root}/runtime_links").count() == 1
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == {"n": 2} and len(list(tmp_path.iterdir())) == 1


def test_classifications(spark):
    schema = "classification_id string, entity_id string, bucket string"
    good = spark.createDataFrame([("a", "e", "unknown")], schema)
    assert relink.checked_classifications(good).count() == 1
    for bad in ([("a", "e", "odd")], [("a ", "e", "unknown")], [("a", "e", "unknown")] * 2, [(None, "e", "unknown")]):
        with pytest.raises(ValueError):
            relink.checked_classifications(spark.createDataFrame(bad, schema))
