"""An organisation's repositories: which are kept, what was synced and built, and whether a build is needed.

Configuration and state are two small JSON files in the organisation's folder.  Listing and fetching are given as
functions, so that any forge will do; a repository that fails keeps its last state and doesn't stop the others.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from fnmatch import fnmatch
from pathlib import Path

PROTOCOLS = ("https", "ssh")
CONFIG, STATE = "config.json", "state.json"


def _write(path: Path, value: dict) -> None:
    """Written beside its place and moved there, so that a reader never sees half of it."""
    beside = path.with_name(f".{path.name}.tmp")
    beside.write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(beside, path)


def _read(path: Path) -> dict:
    try:
        out = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as e:
        raise ValueError(f"{path} is not valid JSON: {e}") from e
    if not isinstance(out, dict):
        raise ValueError(f"{path} must contain a JSON object")
    return out


def checked(config: dict) -> dict:
    """A configuration: provider, org, include and exclude patterns, and how repositories are fetched."""
    out = {"include": [], "exclude": [], "clone_protocol": "https"} | config
    for k in ("provider", "org"):
        if not isinstance(out.get(k), str) or not out[k].strip():
            raise ValueError(f"{k} must be a non-empty string")
    for k in ("include", "exclude"):
        if not isinstance(out[k], list | tuple) or not all(isinstance(p, str) and p for p in out[k]):
            raise ValueError(f"{k} must be a list of patterns")
    if out["clone_protocol"] not in PROTOCOLS:
        raise ValueError(f"clone_protocol must be one of {PROTOCOLS}")
    return out


def init(home: str, **config) -> dict:
    """Write the configuration, and an empty state unless there is one."""
    root, out = Path(home), checked(config)
    root.mkdir(parents=True, exist_ok=True)
    _write(root / CONFIG, out)
    if not (root / STATE).exists():
        _write(root / STATE, {"repos": []})
    return out


def load(home: str) -> tuple[dict, dict]:
    """(configuration, state)."""
    root = Path(home)
    state = _read(root / STATE) if (root / STATE).exists() else {"repos": []}
    if not isinstance(state.get("repos"), list):
        raise ValueError("state.json: repos must be a list")
    return checked(_read(root / CONFIG)), state


def chosen(repos: Iterable[dict], config: dict) -> list[dict]:
    """The repositories (name, full_name) that an include pattern takes, if there are any, and no exclude pattern does."""
    hit = lambda r, patterns: any(fnmatch(r["full_name"], p) or fnmatch(r["name"], p) for p in patterns)
    return [r for r in repos if (not config["include"] or hit(r, config["include"])) and not hit(r, config["exclude"])]


def fetched(repo: dict, folder: str) -> str:
    """Clone or update one repository by git, and tell its commit."""
    run = lambda *args, cwd=None: subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True).stdout.strip()
    if (Path(folder) / ".git").exists():
        run("fetch", "--depth", "1", "origin", repo.get("default_branch") or "HEAD", cwd=folder)
        run("reset", "--hard", "FETCH_HEAD", cwd=folder)
    else:
        run("clone", "--depth", "1", repo["clone_url"], folder)
    return commit_of(folder)


def commit_of(folder: str) -> str:
    """The commit that a working tree is at; ``unknown`` if it is none of git's."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, check=True, capture_output=True, text=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def sync(home: str, repos: Iterable[dict], fetch: Callable[[dict, str], str] = fetched, go_on: bool = True) -> dict:
    """Fetch the chosen repositories and save the state; tells how many changed, stayed and failed."""
    config, state = load(home)
    before = {r["full_name"]: r for r in state["repos"]}
    now, kept, errors, changed = datetime.now(UTC).isoformat(), [], [], 0
    for repo in chosen(repos, config):
        folder = str(Path(home) / "repos" / repo["name"].replace("/", "_"))
        old = before.get(repo["full_name"])
        try:
            commit = fetch(repo, folder)
        except Exception as e:
            if not go_on:
                raise
            errors.append({"repo": repo["full_name"], "error": type(e).__name__, "message": str(e)})
            kept += [old] if old else []
            continue
        changed += old is None or old["commit_sha"] != commit
        kept.append({**repo, "local_path": folder, "commit_sha": commit, "synced_at": now})
    state |= {"repos": sorted(kept, key=lambda r: r["full_name"]), "last_synced_at": now, "last_sync_errors": errors}
    _write(Path(home) / STATE, state)
    return {"repos": len(kept), "changed": changed, "unchanged": len(kept) - changed - sum(e["repo"] in before for e in errors), "failed": len(errors), "errors": errors}


def fingerprint(state: dict) -> str:
    rows = [{"commit_sha": r["commit_sha"], "full_name": r["full_name"]} for r in sorted(state["repos"], key=lambda r: r["full_name"])]
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def build(home: str, make: Callable[[list[str], str], dict], force: bool = False) -> dict:
    """Build the snapshot by ``make(folders, snapshot folder)``, unless nothing has changed since the last one."""
    _, state = load(home)
    if not state["repos"]:
        raise ValueError("no synced repositories: sync first")
    now, out = fingerprint(state), Path(home) / "snapshot"
    if not force and state.get("last_build_fingerprint") == now and (out / "manifest.json").exists():
        return {"skipped": True, "fingerprint": now}
    made = make([r["local_path"] for r in state["repos"]], str(out))
    _write(Path(home) / STATE, state | {"last_built_at": datetime.now(UTC).isoformat(), "last_build_fingerprint": now})
    return {"skipped": False, "fingerprint": now, "manifest": made}
