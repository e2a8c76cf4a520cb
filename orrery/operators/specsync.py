"""Comparing API specs with their stored versions and with the catalog.

Endpoints: (spec_id, endpoint_id, params, headers, body_mode, json_body, hash). All joins share the key (spec_id, endpoint_id),
so a few giant specs don't skew them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_walk import structure_keys
from ..functions.payload import sanitize_tag

KEY = ["spec_id", "endpoint_id"]


def not_in(a: Column, b: Column) -> Column:
    """Members of ``a`` that ``b`` lacks; repeated ones stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed, modified or unchanged for each endpoint id, both hashes side by side."""
    joined = old.select(*KEY, F.col("hash").alias("old_hash")).join(new.select(*KEY, F.col("hash").alias("new_hash")), KEY, "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return joined.withColumn("change", change)


def head_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whether title, version or description of each spec changed; empty counts as missing."""
    clean = lambda c: F.nullif(c, F.lit(""))
    pair = old.alias("a").join(new.alias("b"), F.col("a.spec_id") == F.col("b.spec_id"))
    return pair.select(F.col("a.spec_id").alias("spec_id"), *[(~clean(F.col(f"a.{c}")).eqNullSafe(clean(F.col(f"b.{c}")))).alias(f"{c}_changed") for c in ("title", "version", "description")])


# What is compared of an API key and of OAuth2, beyond the first list by type of grant.
API_KEY = ["key", "placement"]
OAUTH2 = ["grantType", "scope"]
GRANTS = {"authorization_code": ["authorizationUrl", "accessTokenUrl"], "implicit": ["authorizationUrl"], "password": ["accessTokenUrl"], "client_credentials": ["accessTokenUrl"]}
FORMS = ["formUrlEncoded", "multipartForm"]


def drift(spec: DataFrame, catalog: DataFrame) -> DataFrame:
    """inSync, modified, localOnly or missing for each endpoint of the catalog or the spec, with a text of the changes.

    Compared, repeated ones among them: parameters (name:type), header names, body mode, auth mode; if both have the same auth mode, the
    fields that count for an API key or for the type of grant; if both have the same form, its fields (``form``: names, or name:type for a
    multipart form); if both bodies are JSON, whether there is one and their key structure. JSON that can't be read is not compared.

    The columns ``auth_mode``, ``auth`` (a map) and ``form`` may be absent; a missing mode is ``none``.
    """
    optional = {"auth_mode": "string", "auth": "map<string,string>", "form": "array<string>"}

    def side(df: DataFrame, p: str) -> DataFrame:
        df = df.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in df.columns})
        mode = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none")).alias(f"{p}_{c}")
        rows = lambda c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(f"{p}_{c}")
        body = F.nullif(F.col("json_body"), F.lit(""))
        # JSON of null counts as none
        return df.select(*KEY, F.lit(True).alias(f"{p}_there"), *map(rows, ("params", "headers", "form")), *map(mode, ("body_mode", "auth_mode")), F.col("auth").alias(f"{p}_auth"), (body.isNull() | (F.trim(body) == "null")).alias(f"{p}_empty"), structure_keys(body).alias(f"{p}_keys"))

    joined = side(spec, "s").join(side(catalog, "c"), KEY, "full_outer")
    both = lambda c: (F.col(f"s_{c}"), F.col(f"c_{c}"))
    differ = lambda c: both(c)[0] != both(c)[1]
    same = lambda c, *values: (both(c)[0] == both(c)[1]) & both(c)[0].isin(*values)
    field = lambda names: F.lit(False) if not names else ~F.col("s_auth")[names[0]].eqNullSafe(F.col("c_auth")[names[0]]) | field(names[1:])
    grant = F.coalesce(F.nullif(F.col("s_auth")["grantType"], F.lit("")), F.col("c_auth")["grantType"])
    by_grant = F.lit(False)
    for name, fields in GRANTS.items():
        by_grant = by_grant | (grant.eqNullSafe(F.lit(name)) & field(fields))
    config = (same("auth_mode", "apikey") & field(API_KEY)) | (same("auth_mode", "oauth2") & (field(OAUTH2) | by_grant))
    forms = same("body_mode", *FORMS) & differ("form")
    empty = both("empty")
    readable = F.col("s_keys").isNotNull() & F.col("c_keys").isNotNull()
    schema = same("body_mode", "json") & F.when(empty[0] & empty[1], False).when(empty[0] | empty[1], F.coalesce("s_keys", "c_keys").isNotNull()).otherwise(readable & (F.array_sort("s_keys") != F.array_sort("c_keys")))
    count = lambda sign, a, b, what: F.when(F.size(not_in(F.col(a), F.col(b))) > 0, F.concat(F.lit(sign), F.size(not_in(F.col(a), F.col(b))).cast("string"), F.lit(f" {what}")))
    lists = {c: [count("+", f"c_{c}", f"s_{c}", what), count("-", f"s_{c}", f"c_{c}", what)] for c, what in (("params", "params"), ("headers", "headers"), ("form", "form fields"))}
    texts = [*lists["params"], *lists["headers"], *[F.when(differ(c), F.concat(F.lit(f"{what}: "), F.col(f"c_{c}"))) for c, what in (("body_mode", "body"), ("auth_mode", "auth"))], F.when(config, "auth config"), *[F.when(forms, x) for x in lists["form"]], F.when(schema, "body schema")]
    changed = differ("params") | differ("headers") | differ("body_mode") | differ("auth_mode") | config | forms | F.coalesce(schema, F.lit(False))
    there = F.col("s_there") & F.col("c_there")
    text = F.when(there, F.concat_ws(", ", *texts))
    status = F.when(F.col("c_there").isNull(), "missing").when(F.col("s_there").isNull(), "localOnly").when(changed, "modified").otherwise("inSync")
    return joined.select(*KEY, status.alias("drift"), F.when(text != "", text).alias("changes"))


def categorize(remote_drift: DataFrame, spec_modified: DataFrame, local_modified: DataFrame, merge_base: bool = True) -> DataFrame:
    """What to do with each endpoint: spec-added, spec-removed, spec-updated (with conflict) or local-updated."""
    flag = lambda df, name: df.select(*KEY).distinct().withColumn(name, F.lit(merge_base))
    joined = remote_drift.where("drift <> 'inSync'").join(flag(spec_modified, "by_spec"), KEY, "left").join(flag(local_modified, "by_user"), KEY, "left")
    spec, user = F.coalesce("by_spec", F.lit(False)), F.coalesce("by_user", F.lit(False))
    action = F.when(F.col("drift") == "missing", "spec-added").when(F.col("drift") == "localOnly", "spec-removed").when(user & ~spec, "local-updated").otherwise("spec-updated")
    return joined.select(*KEY, action.alias("action"), ((F.col("drift") == "modified") & spec & user).alias("conflict"))


def merge_params(spec: DataFrame, user: DataFrame) -> DataFrame:
    """Spec parameters with the user's ``enabled`` where name and value agree; the user's first match wins."""
    first = user.groupBy(*KEY, "name", "value").agg(F.min_by("enabled", "pos").alias("user_enabled"))
    joined = spec.alias("s").join(first.alias("u"), (F.col("s.spec_id") == F.col("u.spec_id")) & (F.col("s.endpoint_id") == F.col("u.endpoint_id")) & (F.col("s.name") == F.col("u.name")) & F.col("s.value").eqNullSafe(F.col("u.value")), "left")
    return joined.select(*[F.col(f"s.{c}") for c in (*KEY, "pos", "name", "value")], F.coalesce("u.user_enabled", "s.enabled").alias("enabled"))


def override_params(path_params: DataFrame, own_params: DataFrame) -> DataFrame:
    """Parameters of an operation: those of its path that it doesn't override (same name and place), then its own."""
    kept = path_params.join(own_params.select("endpoint_id", "name", "place"), ["endpoint_id", "name", "place"], "left_anti")
    return kept.withColumn("origin", F.lit(0)).unionByName(own_params.withColumn("origin", F.lit(1)))


def overview(remote_drift: DataFrame, local_drift: DataFrame, spec_diff: DataFrame) -> DataFrame:
    """Counts of each spec: endpoints in the catalog, in sync, changed locally, pending from the spec, in conflict."""
    r = remote_drift.groupBy("spec_id").agg(F.count_if(F.col("drift") != "missing").alias("total"), F.count_if(F.col("drift") == "inSync").alias("in_sync"))
    c = local_drift.groupBy("spec_id").agg(F.count_if(F.col("drift") != "inSync").alias("changed"))
    p = spec_diff.groupBy("spec_id").agg(F.count_if(F.col("change") != "unchanged").alias("pending"))
    conflicts = modified_on_both(spec_diff.where("change = 'modified'"), local_drift.where("drift = 'modified'")).groupBy("spec_id").agg(F.count("*").alias("conflicts"))
    return r.join(c, "spec_id", "left").join(p, "spec_id", "left").join(conflicts, "spec_id", "left").na.fill(0)


def modified_on_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def by_first_tag(endpoints: DataFrame) -> DataFrame:
    """Endpoints of each spec by their first usable tag; those without one form the group ``(untagged)``."""
    return endpoints.groupBy("spec_id", F.coalesce(sanitize_tag(F.col("tag")), F.lit("(untagged)")).alias("folder")).agg(F.count("*").alias("n"))


def by_path(endpoints: DataFrame) -> DataFrame:
    """Nested folders by path segment, with the number of endpoints at or below each; no segments is ``Root``."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))
    folders = F.when(F.size(segments) == 0, F.array(F.lit("Root"))).otherwise(prefixes)
    return endpoints.select("spec_id", F.explode(folders).alias("folder")).groupBy("spec_id", "folder").agg(F.count("*").alias("n"))
