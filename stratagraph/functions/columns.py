"""Scalar functions on columns: hashes, labels, names, paths, routes.

All but ``json_object`` are built from JVM expressions.  Nulls give nulls unless said otherwise.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_hash(prefix: str, *parts: ColumnOrName) -> Column:
    """``prefix`` and the first 24 hex digits of the SHA-256 of the parts, joined by ``|``; nulls are left out."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256), 1, 24))


def status(x: ColumnOrName) -> Column:
    """A canonical status: missing and empty ones read as ``canonical``."""
    return F.when(F.coalesce(_c(x), F.lit("")) == "", "canonical").otherwise(_c(x))


def is_canonical(x: ColumnOrName) -> Column:
    return status(x) == "canonical"


def normal_path(x: ColumnOrName) -> Column:
    """Slashes instead of backslashes, without the leading run of dots and slashes (``.env`` becomes ``env``)."""
    return F.regexp_replace(F.translate(_c(x), "\\", "/"), r"^[./]+", "")


def path_shape(x: ColumnOrName) -> Column:
    """A route with its parameters (``:x``, ``<t:x>``, ``{x}``, numbers) as ``{}``, without a trailing slash."""
    bare = F.regexp_replace(_c(x), r"(.)/+$", "$1")
    segment = r"^(:[^/]+|<[^/>]*>|\{[^/}]*\}|[0-9]+)$"
    return F.array_join(F.transform(F.split(bare, "/"), lambda s: F.when(s.rlike(segment), "{}").otherwise(s)), "/")


def has_path_prefix(shape: ColumnOrName, prefix: ColumnOrName) -> Column:
    """Whether whole segments of ``prefix`` begin ``shape``."""
    return (_c(shape) == _c(prefix)) | F.startswith(_c(shape), F.concat(_c(prefix), F.lit("/")))


def package_name(x: ColumnOrName) -> Column:
    """The linker's form: lower case, runs of ``-_.`` as one dash."""
    return F.regexp_replace(F.lower(F.trim(_c(x))), r"[-_.]+", "-")


def dimension_package_name(x: ColumnOrName) -> Column:
    """The form of the dimension rules: lower case, underscores as dashes."""
    return F.replace(F.lower(F.trim(_c(x))), F.lit("_"), F.lit("-"))


def identifier_parts(x: ColumnOrName) -> Column:
    """The parts of an identifier, cut at ``/ . - _``, at spaces, and before a capital that follows none."""
    spaced = F.regexp_replace(F.translate(_c(x), "/.-_", "    "), r"([^\p{Lu}\s])(?=\p{Lu})", "$1 ")
    return F.filter(F.split(F.trim(spaced), r"\s+"), lambda s: s != "")


def normal_token(x: ColumnOrName) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(_c(x), r"[^\p{L}\p{N}]+", ""))


def tokens(x: ColumnOrName) -> Column:
    """The lower-case words of an identifier."""
    return F.filter(F.transform(identifier_parts(x), normal_token), lambda s: s != "")


def slug(x: ColumnOrName) -> Column:
    """Runs of letters and digits in lower case, joined by underscores; ``anchor`` if there is none."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(made == "", "anchor").otherwise(made)


def host(url: ColumnOrName) -> Column:
    """The host of a URL in lower case, without user and port; empty strings if there is none."""
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def url_path(url: ColumnOrName) -> Column:
    """The path of a URL, ``/`` if it has none."""
    found = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def git_identity(url: ColumnOrName) -> Column:
    """host/owner/name of a git URL (a scheme, ``git+``, ``github:`` or ``user@host:path``); null if it has no owner and name.

    The host is in lower case without ``www.``, user and port; the name is without ``.git``.
    """
    plain = F.regexp_replace(F.trim(_c(url)), r"^git\+", "")
    plain = F.regexp_replace(plain, r"^github:", "https://github.com/")
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)"
    scp = r"^(?:[^@/:]+@)?([^/:]+):([^?#]+)"
    has = plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    part = lambda k: F.when(has, F.regexp_extract(plain, scheme, k)).otherwise(F.regexp_extract(plain, scp, k))
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    steps = F.filter(F.split(F.try_url_decode(F.replace(part(2), F.lit("+"), F.lit("%2B"))), "/"), lambda p: p != "")
    path = F.regexp_replace(F.array_join(steps, "/"), r"\.git$", "")
    return F.when((host != "") & (F.size(steps) >= 2), F.concat(host, F.lit("/"), path))


def arn_part(arn: ColumnOrName, n: int) -> Column:
    """The ``n``th of an ARN's six parts (1: ``arn`` to 6: the resource); null if it isn't one."""
    parts = F.split(_c(arn), ":", 6)
    return F.when(F.startswith(_c(arn), F.lit("arn:")) & (F.size(parts) == 6), F.element_at(parts, n))


def is_queue_name(x: ColumnOrName) -> Column:
    """1 to 80 ASCII letters, digits, dashes and underscores, or 1 to 75 before ``.fifo``."""
    return _c(x).rlike(r"^(?:[A-Za-z0-9_-]{1,80}|[A-Za-z0-9_-]{1,75}\.fifo)$")


def channel(x: ColumnOrName) -> Column:
    """(broker_kind, channel_address) of a queue URL or of an ARN of a queue, topic, stream, table's stream or bus; null for others."""
    value, name = F.trim(_c(x)), r"[A-Za-z0-9_-]+"
    arn = lambda service, resource: rf"^arn:aws:{service}:[A-Za-z0-9-]+:[0-9]+:{resource}$"
    out, kinds = None, (
        ("sqs", arn("sqs", r"(.+)")), ("sns", arn("sns", rf"({name})")), ("kinesis", arn("kinesis", rf"stream/({name})")),
        ("dynamodb_stream", arn("dynamodb", rf"table/({name})/stream/.*")), ("eventbridge", arn("events", rf"event-bus/({name})")),
        ("sqs", r"^https?://sqs\.[A-Za-z0-9-]+\.amazonaws\.com/+[0-9]+/+([^/?#]+)/*(?:[?#].*)?$"),
    )
    for kind, pattern in kinds:
        found = F.regexp_extract(value, pattern, 1)
        fits = is_queue_name(found) if kind == "sqs" else found != ""
        made = F.struct(F.lit(kind).alias("broker_kind"), found.alias("channel_address"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def is_domain(x: ColumnOrName) -> Column:
    return F.lower(_c(x)).rlike(r"^(\*\.)?([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$")


def is_ipv4(x: ColumnOrName) -> Column:
    """Four decimal numbers up to 255 without leading zeros."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return _c(x).rlike(rf"^{octet}(\.{octet}){{3}}$")


def is_ipv6(x: ColumnOrName) -> Column:
    """Eight groups of hex digits, or fewer around one ``::``; the last two may be an IPv4 address; a zone may follow."""
    value = F.regexp_replace(_c(x), r"%[^%]+$", "")
    tail = F.regexp_extract(value, r":([0-9.]+)$", 1)
    v4 = F.contains(tail, F.lit("."))
    value = F.when(v4 & is_ipv4(tail), F.regexp_replace(value, r"[0-9.]+$", "0:0")).otherwise(value)
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    shape = value.rlike(r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?$")
    return shape & F.contains(value, F.lit(":")) & F.when(F.contains(value, F.lit("::")), groups <= 7).otherwise(groups == 8)


def is_ip_address(x: ColumnOrName) -> Column:
    return is_ipv4(x) | is_ipv6(x)


def is_api_gateway(x: ColumnOrName) -> Column:
    """A host of the cloud's API gateway."""
    return F.contains(F.lower(_c(x)), F.lit(".execute-api.")) & F.endswith(F.lower(_c(x)), F.lit(".amazonaws.com"))


def masked(x: ColumnOrName, shown: int = 0) -> Column:
    """A literal with all but its first characters as asterisks, eight at most."""
    rest = F.least(F.lit(8), F.greatest(F.char_length(_c(x)) - shown, F.lit(0)))
    return F.concat(F.substring(_c(x), 1, shown), F.repeat(F.lit("*"), rest)) if shown else F.repeat(F.lit("*"), rest)


def urn_part(x: ColumnOrName) -> Column:
    return F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20"))


def contains_map(labels: ColumnOrName, selector: ColumnOrName) -> Column:
    """Whether ``labels`` has every key of ``selector`` with an equal value; an empty selector selects nothing."""
    whole = F.forall(F.map_entries(_c(selector)), lambda e: F.coalesce(_c(labels)[e["key"]] == e["value"], F.lit(False)))
    return (F.size(_c(selector)) > 0) & whole


def common_prefix_length(a: ColumnOrName, b: ColumnOrName) -> Column:
    n = F.least(F.char_length(_c(a)), F.char_length(_c(b)))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substr(_c(a), F.lit(1), k) == F.substr(_c(b), F.lit(1), k))
    return F.array_max(same)


def key_segments(key: ColumnOrName) -> Column:
    """The distinct pieces of a key between ``/``, ``_`` and ``-``, without versions such as ``v2``."""
    return F.array_distinct(F.filter(F.split(_c(key), r"[/_-]"), lambda s: (s != "") & ~s.rlike(r"^v[0-9]+$")))


def unversioned(path: ColumnOrName) -> Column:
    """The segments of a route that aren't empty, a version or a parameter."""
    return F.filter(F.split(F.lower(_c(path)), "/"), lambda s: (s != "") & ~s.rlike(r"^v[0-9]+$") & (s != "{}"))


def is_test_path(x: ColumnOrName) -> Column:
    """A folder or file called test, tests or __tests__, or a file name that begins or goes on as tests do."""
    segments = F.transform(F.split(_c(x), "/"), normal_token)
    name = F.lower(F.element_at(F.split(F.rtrim(_c(x), F.lit("/")), "/"), -1))
    return F.arrays_overlap(segments, F.array(F.lit("test"), F.lit("tests"))) | name.rlike(r"^test_|_test\.|\.test\.|\.spec\.")


def repo_matches(repo: ColumnOrName, wanted: ColumnOrName) -> Column:
    """Equal but for case; if at most one side names an owner, the last parts are enough."""
    a, b = F.lower(_c(repo)), F.lower(_c(wanted))
    either = ~(F.contains(a, F.lit("/")) & F.contains(b, F.lit("/")))
    return (a == b) | (either & (F.substring_index(a, "/", -1) == F.substring_index(b, "/", -1)))


# Words that name an environment with its rank, and the ending that a part of a path may have instead.
ENVIRONMENTS = ((("prod", "production"), 0, "-prod"), (("staging", "stage", "qa"), 2, "-staging"), (("dev", "test", "sandbox", "local"), 3, "-dev"))


def parts_end(parts: Column, ending: str) -> Column:
    return F.exists(parts, lambda p: F.endswith(p, F.lit(ending)))


def _rank(parts: Column, endings: bool, missing: Column) -> Column:
    out = F.when(missing, 4)
    for names, rank, ending in ENVIRONMENTS:
        hit = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
        if endings:
            hit = hit | parts_end(parts, ending)
        out = out.when(hit, rank)
    return out.otherwise(1)


def domain_environment_rank(domain: ColumnOrName) -> Column:
    """0 production, 1 unmarked, 2 staging, 3 development, 4 unknown, by the pieces of a domain's first label."""
    first = F.substring_index(F.lower(_c(domain)), ".", 1)
    return _rank(F.split(first, "[-_]"), False, _c(domain).isNull())


def path_environment_rank(path: ColumnOrName) -> Column:
    """The same by the parts of a path, cut at slashes and dots, or their endings."""
    return _rank(F.split(F.translate(F.lower(_c(path)), "_", "-"), "[./]"), True, _c(path).isNull())


def joined_route(prefix: ColumnOrName, path: ColumnOrName) -> Column:
    """Prefix and path with one slash before each; ``/`` for nothing."""
    bare = lambda x: F.nullif(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^/+|/+$", ""), F.lit(""))
    return F.concat(F.lit("/"), F.concat_ws("/", bare(prefix), bare(path)))


def controller_route(route: ColumnOrName, class_name: ColumnOrName) -> Column:
    """A route with ``[controller]`` as the class's last name in lower case, without its ending ``Controller``."""
    name = F.lower(F.regexp_replace(F.element_at(F.split(_c(class_name), r"\."), -1), r"Controller$", ""))
    return F.replace(_c(route), F.lit("[controller]"), name)


def posix_path(x: ColumnOrName) -> Column:
    """The steps of a path joined by slashes, without empty ones and ``.``; null if none is left."""
    steps = F.filter(F.split(F.translate(F.trim(_c(x)), "\\", "/"), "/"), lambda s: ~s.isin("", "."))
    return F.nullif(F.array_join(steps, "/"), F.lit(""))


def has_path_suffix(path: ColumnOrName, suffix: ColumnOrName) -> Column:
    """Whether whole steps of ``suffix`` end ``path``."""
    return (_c(path) == _c(suffix)) | F.endswith(_c(path), F.concat(F.lit("/"), _c(suffix)))


def common_folder(paths: ColumnOrName) -> Column:
    """The folder that holds all of an array of relative paths; ``.`` if it is the top, or if one path lies there."""
    folders = F.transform(_c(paths), lambda p: F.split(F.regexp_replace(p, r"/?[^/]*$", ""), "/"))
    least, most = F.array_min(folders), F.array_max(folders)  # what these share, all share
    n = F.least(F.size(least), F.size(most))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.slice(least, F.lit(1), k) == F.slice(most, F.lit(1), k))
    made = F.array_join(F.slice(least, F.lit(1), F.array_max(same)), "/")
    return F.when(F.coalesce(made, F.lit("")) == "", ".").otherwise(made)


def scope_key(repo: ColumnOrName, commit: ColumnOrName, path: ColumnOrName) -> Column:
    """``repo@commit:path``, a file's key."""
    return F.concat(_c(repo), F.lit("@"), _c(commit), F.lit(":"), _c(path))


def scope_parts(key: ColumnOrName) -> Column:
    """(repo, commit_sha, path) of a file's key; null if a part is missing."""
    pattern = r"^([^:]+)@([^@:]+):(.+)$"
    part = lambda k: F.regexp_extract(_c(key), pattern, k)
    return F.when(_c(key).rlike(pattern), F.struct(part(1).alias("repo"), part(2).alias("commit_sha"), part(3).alias("path")))


def instant(x: ColumnOrName) -> Column:
    """The time that an ISO text tells, ``Z`` and missing offsets as UTC; null if it is none."""
    value = _c(x)
    zoned = value.rlike(r"([+-][0-9]{2}:?[0-9]{2}|Z)$") & F.contains(value, F.lit(":"))
    whole = F.when(zoned, value).when(F.contains(value, F.lit(":")), F.concat(value, F.lit("Z"))).otherwise(F.concat(value, F.lit("T00:00:00Z")))
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:|$)"), F.try_to_timestamp(whole))


def first_unique(values: ColumnOrName, limit: int) -> Column:
    """The first ``limit`` different texts of an array, trimmed, without empty ones, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(_c(values), lambda s: F.trim(s)), lambda s: s != "")), 1, limit)


def has_run(values: ColumnOrName, run: ColumnOrName) -> Column:
    """Whether ``run`` is a stretch of ``values``."""
    last = F.size(_c(values)) - F.size(_c(run)) + 1
    return F.when(last < 1, F.lit(False)).otherwise(
        F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.slice(_c(values), k, F.size(_c(run))) == _c(run))
    )


def top_counts(counts: ColumnOrName, limit: int) -> Column:
    """The ``limit`` entries of a map of numbers with the greatest values, by name among equals, as (key, n)."""
    rows = F.transform(F.map_entries(_c(counts)), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key")))
    return F.transform(F.slice(F.array_sort(rows), 1, limit), lambda r: F.struct(r["key"].alias("key"), (-r["less"]).alias("n")))


def deploy_kind(deploy_type: ColumnOrName, target_type: ColumnOrName, source_kind: ColumnOrName) -> Column:
    """How something is deployed, by the target's type, else the fact's, and by the kind of source."""
    empty = lambda x: F.coalesce(_c(x), F.lit(""))
    target, source = empty(target_type), empty(source_kind)
    kind = F.when(empty(deploy_type) != "", empty(deploy_type)).otherwise(target)
    return (
        F.when((kind == "wsgi") | (source == "apache_vhost"), "apache_wsgi")
        .when((kind == "zappa_lambda") | source.isin("zappa_settings", "zappa_domain"), "zappa_lambda")
        .otherwise(F.nullif(kind, F.lit("")))
    )


def reference_kind(source_kind: ColumnOrName, domain: ColumnOrName) -> Column:
    """What a reference to a domain says about its deployment; null for none."""
    source = F.lower(F.coalesce(_c(source_kind), F.lit("")))
    return (
        F.when(source.isin("apache_server_name", "zappa_domain"), F.concat(source, F.lit("_reference")))
        .when(source.isin("terraform_literal", "terraform_module_source"), "terraform_domain_reference")
        .when(source == "static_site_cname", "static_site_cname_reference")
        .when(source.isin("dotenv_assignment", "domain_env"), "env_domain_reference")
        .when(source == "source_domain_literal", None)
        .when(source == "kubernetes_ingress", "kubernetes_ingress_domain_reference")
        .when(is_api_gateway(domain), "api_gateway_domain_reference")
        .when(is_ip_address(domain), "internal_address_reference")
    )


def dotenv_value(raw: ColumnOrName) -> Column:
    """An assigned value: within its quotes, or up to a comment; a backslash keeps the next character."""
    value = F.trim(_c(raw))
    upto = lambda end: F.regexp_extract(value, rf"^{end}((?:\\.|[^\\{end or '#'}]|\\$)*)", 1)
    body = F.when(F.startswith(value, F.lit("'")), upto("'")).when(F.startswith(value, F.lit('"')), upto('"')).otherwise(upto(""))
    return F.trim(F.regexp_replace(body, r"\\(.)", "$1"))


def _ascii(json_text: Column) -> Column:
    """JSON with every character past ASCII as an escape, those past the basic plane as two."""
    code = lambda c: F.ascii(c)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    high = lambda c: F.lit(0xD800) + F.floor((code(c) - 0x10000) / 0x400)
    low = lambda c: F.lit(0xDC00) + (code(c) - 0x10000) % 0x400
    each = lambda c: F.when(code(c) < 128, c).when(code(c) < 0x10000, unit(code(c))).otherwise(F.concat(unit(high(c)), unit(low(c))))
    return F.when(json_text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(json_text, ""), each), "")).otherwise(json_text)


def canonical_json(entries: ColumnOrName) -> Column:
    """A map as JSON in ASCII with its keys in order and without spaces."""
    return _ascii(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(entries))))))


def first_object(text: str | None) -> str | None:
    """The JSON object that a text is, that a fenced block of it is, or that begins at one of its braces; canonical, null if there is none."""
    if text is None:
        return None
    bare = text.strip()
    fenced = [b.strip() for b in bare.split("```")[1::2]]
    for candidate in [bare, *(b.removeprefix("json").strip() for b in fenced)]:
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return json.dumps(found, sort_keys=True, separators=(",", ":"))
    for m in re.finditer(r"\{", text):
        try:
            found, _ = json.JSONDecoder().raw_decode(text, m.start())
        except ValueError:
            continue
        return json.dumps(found, sort_keys=True, separators=(",", ":"))
    return None


def json_object(text: ColumnOrName) -> Column:
    """``first_object`` of a column, by Arrow batches: no built-in function finds where an object ends."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(_c(text))


def nested(text: ColumnOrName, *path: str) -> Column:
    """The scalar at a path of keys in JSON; null where a step is no object or lacks the key."""
    return F.get_json_object(_c(text), "$" + "".join(f"['{p}']" for p in path))


# Of each kind of entity its name in a URN and the parts of its identity, in order.
URN_PARTS = {
    "Repo": ("repo", "tenant_id host owner name"), "Service": ("service", "tenant_id namespace repo slug"), "CodeModule": ("code-module", "tenant_id repo module"),
    "CodeSymbol": ("code-symbol", "tenant_id repo module qualname symbol_kind"), "ExternalPackage": ("external-package", "tenant_id repo name"),
    "ExternalSymbol": ("external-symbol", "tenant_id repo language module name symbol_kind"), "Domain": ("domain", "tenant_id repo name"),
    "EnvVar": ("env-var", "tenant_id repo name"), "EventChannel": ("event-channel", "tenant_id broker_kind channel_address"),
    "DeployTarget": ("deploy-target", "tenant_id repo type target"), "Endpoint": ("endpoint", "tenant_id repo protocol method host path"),
}


def urn(scheme: str, kind: ColumnOrName, identity: ColumnOrName) -> Column:
    """An entity's URN: its encoded parts, or the hash of its identity if a part is missing or the kind has none; a host may be missing."""
    hashed = F.concat(F.lit(f"{scheme}://"), F.lower(_c(kind)), F.lit("/"), stable_hash("", canonical_json(identity)))
    out = F.when(F.lit(False), hashed)
    for name, (short, parts) in URN_PARTS.items():
        made = []
        for p in parts.split():
            part = F.nullif(F.trim(_c(identity)[p]), F.lit(""))
            made.append(F.coalesce(urn_part(part), F.lit("_")) if p == "host" and name == "Endpoint" else urn_part(part))
        lacks = F.concat(F.lit(f"{scheme}://{short}/"), stable_hash("", canonical_json(identity)))
        whole = F.concat(F.lit(f"{scheme}://{short}/"), *[x for m in made for x in (m, F.lit("/"))][:-1])
        out = out.when(_c(kind) == name, F.coalesce(whole, lacks))
    return out.otherwise(hashed)


def call_site(qualifier: ColumnOrName) -> Column:
    """(source_line, source_excerpt) that a call's qualifier holds, blank ones as null; null without either."""
    said = lambda k: F.when(F.trim(_c(qualifier)[k]) != "", _c(qualifier)[k])
    made = F.struct(said("source_line").alias("source_line"), said("source_excerpt").alias("source_excerpt"))
    return F.when(said("source_line").isNotNull() | said("source_excerpt").isNotNull(), made)
