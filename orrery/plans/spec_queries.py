"""Queries over specs and the catalog's endpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import json_walk as J
from ..operators import specsync as S
from ..sources import catalogs as A
from ..sources.catalogs import spec_endpoints
from ..sources.scratch import shared_dir
from . import views as V
from .registry import query

E = V.ctes("endpoints")
DIFF = E + """, diffed AS (
  SELECT COALESCE(a.spec_id, b.spec_id) AS spec_id, COALESCE(a.endpoint_id, b.endpoint_id) AS endpoint_id, a.hash AS old_hash, b.hash AS new_hash,
    CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'modified' ELSE 'unchanged' END AS change
  FROM (FROM endpoints WHERE side = 'old') a FULL JOIN (FROM endpoints WHERE side = 'new') b ON a.spec_id = b.spec_id AND a.endpoint_id = b.endpoint_id)
"""


@query("c2_spec_diff", DIFF + "SELECT spec_id, endpoint_id, old_hash, new_hash, change FROM diffed")
def c2(spark, sf):
    return S.diff(V.endpoints(spark, sf, "old"), V.endpoints(spark, sf, "new"))


@query("c2_spec_head_changes", "SELECT s_suppkey::VARCHAR AS spec_id, s_suppkey % 3 = 0 AS title_changed, FALSE AS version_changed, s_suppkey % 2 = 0 AS description_changed FROM supplier")
def c2b(spark, sf):
    s = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("spec_id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("version"), F.lit("d").alias("description"), "s_suppkey")
    new = s.withColumns({"title": F.when(F.col("s_suppkey") % 3 == 0, F.concat("title", F.lit("2"))).otherwise(F.col("title")), "version": F.lit(""), "description": F.when(F.col("s_suppkey") % 2 == 0, F.lit("")).otherwise(F.lit("d"))})
    return S.head_changes(s, new)


DRIFTED = """drift_{0} AS (
  SELECT COALESCE(s.spec_id, c.spec_id) AS spec_id, COALESCE(s.endpoint_id, c.endpoint_id) AS endpoint_id,
    CASE WHEN s.pos IS NOT NULL AND c.pos IS NOT NULL THEN CONCAT_WS(', ',
      CASE WHEN s.changed <> c.changed THEN '+1 params' END, CASE WHEN s.changed <> c.changed THEN '-1 params' END,
      CASE WHEN c.xnew AND NOT s.xnew THEN '+1 headers' END, CASE WHEN s.xnew AND NOT c.xnew THEN '-1 headers' END,
      CASE WHEN s.mode <> c.mode THEN 'body: ' || c.mode END, CASE WHEN s.mode = 'json' AND c.mode = 'json' AND s.changed <> c.changed THEN 'body schema' END) END AS changes,
    CASE WHEN c.pos IS NULL THEN 'missing' WHEN s.pos IS NULL THEN 'localOnly' WHEN changes = '' THEN 'inSync' ELSE 'modified' END AS drift
  FROM (FROM described WHERE side = '{0}') s FULL JOIN (FROM described WHERE side = 'catalog') c ON s.spec_id = c.spec_id AND s.endpoint_id = c.endpoint_id)"""
DRIFTS = DIFF.rstrip() + ", described AS (SELECT *, changed AND pos % 2 = 0 AS xnew, CASE WHEN changed AND pos % 3 = 0 THEN 'xml' ELSE 'json' END AS mode FROM endpoints),\n" + DRIFTED.format("new") + ",\n" + DRIFTED.format("old") + "\n"


def drifts(spark, sf):
    catalog = V.endpoints(spark, sf, "catalog")
    return S.drift(V.endpoints(spark, sf, "new"), catalog), S.drift(V.endpoints(spark, sf, "old"), catalog)


@query("c3_catalog_drift", DRIFTS + "SELECT spec_id, endpoint_id, drift, NULLIF(changes, '') AS changes FROM drift_new")
def c3(spark, sf):
    return drifts(spark, sf)[0]


@query("c3_auth_and_form_drift", """WITH p AS (SELECT p_partkey AS n, 'spec' || (p_size % 3) AS spec_id, 'GET:/' || p_partkey AS endpoint_id, p_partkey % 4 AS m, (p_partkey // 4) % 4 AS g, p_partkey % 3 AS b FROM part),
told AS (SELECT *, CONCAT_WS(', ',
  CASE WHEN n % 11 = 0 AND m <> 3 THEN 'auth: basic' END,
  CASE WHEN n % 11 > 0 AND ((m = 1 AND n % 5 = 0) OR (m = 2 AND ((g <= 1 AND n % 9 = 0) OR (g <> 1 AND n % 7 = 0)))) THEN 'auth config' END,
  CASE WHEN b > 0 AND n % 5 = 1 THEN '+1 form fields, -1 form fields' END,
  CASE WHEN b = 0 AND n % 8 = 1 THEN 'body schema' END) AS changes FROM p)
SELECT spec_id, endpoint_id, CASE WHEN changes = '' THEN 'inSync' ELSE 'modified' END AS drift, NULLIF(changes, '') AS changes FROM told""")
def c3b(spark, sf):
    p, n = V.table(spark, sf, "part"), F.col("p_partkey")
    pick = lambda at, *names: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    words, bodies = [F.col("p_brand"), F.col("p_type")], pick(n % 3, "json", "formUrlEncoded", "multipartForm")
    kind = F.when(n % 3 == 2, ":text").otherwise("")

    def side(mode, moved, field, body):
        auth = F.create_map(*[F.lit(x) if isinstance(x, str) else x for pair in {
            "key": F.col("p_brand"), "placement": F.when(moved & (n % 5 == 0), "query").otherwise("header"), "grantType": pick(F.floor(n / 4) % 4, "authorization_code", "implicit", "password", "client_credentials"), "scope": F.lit("read"),
            "authorizationUrl": F.when(moved & (n % 9 == 0), "https://b").otherwise("https://a"), "accessTokenUrl": F.when(moved & (n % 7 == 0), "https://u").otherwise("https://t"),
        }.items() for x in pair])
        none = F.array().cast("array<string>")
        return p.select(
            F.concat(F.lit("spec"), (F.col("p_size") % 3).cast("string")).alias("spec_id"), F.concat(F.lit("GET:/"), n.cast("string")).alias("endpoint_id"), none.alias("params"), none.alias("headers"), bodies.alias("body_mode"),
            mode.alias("auth_mode"), auth.alias("auth"), F.array(F.concat(words[0], kind), F.concat(field, kind)).alias("form"), body.alias("json_body"),
        )

    mode = pick(n % 4, "none", "apikey", "oauth2", "basic")
    spec = side(mode, F.lit(False), words[1], F.lit('{"a":1}'))
    return S.drift(spec, side(F.when(n % 11 == 0, "basic").otherwise(mode), F.lit(True), F.when(n % 5 == 1, "extra").otherwise(words[1]), F.when(n % 8 != 1, '{"a":2}')))


@query("c4_three_way", DRIFTS + """SELECT d.spec_id, d.endpoint_id,
  CASE WHEN d.drift = 'missing' THEN 'spec-added' WHEN d.drift = 'localOnly' THEN 'spec-removed' WHEN l.drift = 'modified' AND COALESCE(f.change, '') <> 'modified' THEN 'local-updated' ELSE 'spec-updated' END AS action,
  d.drift = 'modified' AND COALESCE(f.change, '') = 'modified' AND COALESCE(l.drift, '') = 'modified' AS conflict
FROM drift_new d LEFT JOIN diffed f USING (spec_id, endpoint_id) LEFT JOIN drift_old l USING (spec_id, endpoint_id) WHERE d.drift <> 'inSync'""")
def c4(spark, sf):
    remote, local = drifts(spark, sf)
    spec = S.diff(V.endpoints(spark, sf, "old"), V.endpoints(spark, sf, "new"))
    return S.categorize(remote, spec.where("change = 'modified'"), local.where("drift = 'modified'"))


@query("d11_sync_overview", DRIFTS + """SELECT spec_id, (SELECT COUNT(*) FROM drift_new d WHERE d.spec_id = s.spec_id AND drift <> 'missing') AS total, (SELECT COUNT(*) FROM drift_new d WHERE d.spec_id = s.spec_id AND drift = 'inSync') AS in_sync,
  (SELECT COUNT(*) FROM drift_old d WHERE d.spec_id = s.spec_id AND drift <> 'inSync') AS changed, (SELECT COUNT(*) FROM diffed d WHERE d.spec_id = s.spec_id AND change <> 'unchanged') AS pending,
  (SELECT COUNT(*) FROM diffed f JOIN drift_old d USING (spec_id, endpoint_id) WHERE f.spec_id = s.spec_id AND f.change = 'modified' AND d.drift = 'modified') AS conflicts
FROM (SELECT DISTINCT spec_id FROM drift_new) s""")
def d11(spark, sf):
    remote, local = drifts(spark, sf)
    return S.overview(remote, local, S.diff(V.endpoints(spark, sf, "old"), V.endpoints(spark, sf, "new")))


@query("g4_modified_on_both_sides", DRIFTS + "SELECT spec_id, endpoint_id FROM diffed WHERE change = 'modified' INTERSECT SELECT spec_id, endpoint_id FROM drift_old WHERE drift = 'modified'")
def g4(spark, sf):
    spec = S.diff(V.endpoints(spark, sf, "old"), V.endpoints(spark, sf, "new"))
    return S.modified_on_both(spec.where("change = 'modified'"), drifts(spark, sf)[1].where("drift = 'modified'"))


@query("g3_list_differences", E + "SELECT a.endpoint_id, CASE WHEN b.changed THEN 'page:query' ELSE '' END AS added, CASE WHEN b.changed THEN 'id:path,id:path' ELSE '' END AS removed FROM endpoints a JOIN endpoints b USING (spec_id, endpoint_id) WHERE a.side = 'old' AND b.side = 'new'")
def g3(spark, sf):
    a, b = V.endpoints(spark, sf, "old"), V.endpoints(spark, sf, "new").select("spec_id", "endpoint_id", F.col("params").alias("new_params"))
    twice = F.concat("params", F.array(F.element_at("params", -1)))
    return a.join(b, ["spec_id", "endpoint_id"]).select("endpoint_id", F.array_join(S.not_in(F.col("new_params"), F.col("params")), ",").alias("added"), F.array_join(S.not_in(twice, F.col("new_params")), ",").alias("removed"))


def param_rows(spark, sf):
    p = V.table(spark, sf, "part")
    base = p.select(F.lit("s").alias("spec_id"), F.col("p_brand").alias("endpoint_id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 3 != 0, (F.col("p_size") % 3).cast("string")).alias("value"), F.lit(True).alias("enabled"), "p_partkey")
    return base.where("p_partkey % 2 = 0").drop("p_partkey"), base.where("p_partkey % 2 = 1").withColumn("enabled", F.col("p_partkey") % 4 == 1).drop("p_partkey")


@query("c5_merged_params", """WITH rows AS (SELECT p_partkey AS pos, p_brand AS endpoint_id, p_type AS name, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size % 3 AS VARCHAR) END AS value FROM part),
mine AS (SELECT endpoint_id, name, COALESCE(value, '(none)') AS v, ARG_MIN(pos % 4 = 1, pos) AS enabled FROM rows WHERE pos % 2 = 1 GROUP BY 1, 2, 3)
SELECT 's' AS spec_id, r.endpoint_id, pos, r.name, value, COALESCE(m.enabled, TRUE) AS enabled FROM rows r LEFT JOIN mine m ON m.endpoint_id = r.endpoint_id AND m.name = r.name AND m.v = COALESCE(r.value, '(none)') WHERE pos % 2 = 0""")
def c5(spark, sf):
    return S.merge_params(*param_rows(spark, sf))


@query("c6_overridden_params", """WITH a AS (SELECT DISTINCT p_brand AS endpoint_id, p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'query' ELSE 'path' END AS place FROM part WHERE p_size < 25),
b AS (SELECT DISTINCT p_brand AS endpoint_id, p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'query' ELSE 'path' END AS place FROM part WHERE p_size > 40)
SELECT *, 0 AS origin FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 1 FROM b""")
def c6(spark, sf):
    rows = V.table(spark, sf, "part").select(F.col("p_brand").alias("endpoint_id"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 0, "query").otherwise("path").alias("place"), "p_size")
    return S.override_params(rows.where("p_size < 25").drop("p_size").distinct(), rows.where("p_size > 40").drop("p_size").distinct())


@query("d13_by_tag", E + "SELECT spec_id, COALESCE(SPLIT_PART(tag, ' ', 1) || '_co', '(untagged)') AS folder, COUNT(*) AS n FROM endpoints WHERE side = 'new' GROUP BY 1, 2")
def d13(spark, sf):
    return S.by_first_tag(V.endpoints(spark, sf, "new"))


@query("d14_by_path", E + """, s AS (SELECT spec_id, STRING_SPLIT(SUBSTRING(path, 2), '/') AS p FROM endpoints WHERE side = 'new')
SELECT spec_id, ARRAY_TO_STRING(p[1:i], '/') AS folder, COUNT(*) AS n FROM s, (VALUES (1), (2), (3)) v(i) GROUP BY 1, 2""")
def d14(spark, sf):
    return S.by_path(V.endpoints(spark, sf, "new"))


@query("s8_structure_keys", E + "SELECT endpoint_id, spec_id, CASE WHEN changed THEN 'name,extra,extra[].a' ELSE 'name,size' END AS keys FROM endpoints WHERE side = 'new'")
def s8(spark, sf):
    return V.endpoints(spark, sf, "new").select("endpoint_id", "spec_id", F.array_join(J.structure_keys(F.col("json_body")), ",").alias("keys"))


@query("a4_spec_endpoints", """SELECT p_partkey::VARCHAR AS spec_id, m || ':/' || LOWER(p_type) || '/:id' AS endpoint_id, CASE m WHEN 'GET' THEN 'q' ELSE '' END AS query_params, 'id' AS path_params, CASE m WHEN 'POST' THEN 'application/json' END AS content_type FROM part, (VALUES ('GET'), ('POST')) v(m)""")
def a4(spark, sf):
    text = F.concat(F.lit('{"paths":{"/'), F.lower("p_type"), F.lit('/{id}/":{"parameters":[{"name":"id","in":"path"},{"name":"q","in":"query"}],"summary":"x","get":{"tags":["t"]},"post":{"parameters":[{"name":"q","in":"header"},{"name":"q","in":"query"}],"requestBody":{"content":{"application/json":{},"text/xml":{}}}}}}}'))
    text = F.replace(text, F.lit('{"name":"q","in":"header"},{"name":"q","in":"query"}'), F.lit('{"name":"q","in":"header"}'))
    out = spec_endpoints(V.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("spec_id"), text.alias("json")))
    return out.select("spec_id", "endpoint_id", F.when(F.col("method") == "GET", F.array_join("query_params", ",")).otherwise("").alias("query_params"), F.array_join("path_params", ",").alias("path_params"), "content_type")


def exported(spark, sf):
    """Folder of collection exports: a file for every hundred customers, its folders and requests inside; one in seven is unreadable."""
    orders = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("t")))).alias("o"))
    request = lambda x: F.struct(F.concat(F.lit("o"), x["k"].cast("string")).alias("uid"), F.lit("http-request").alias("type"), F.array(x["t"]).alias("tags"))
    folder = F.struct("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uid"), F.lit("folder").alias("type"), F.col("c_name").alias("name"), F.transform("o", request).alias("items"))
    bucket = F.floor(F.col("c_custkey") / 100).alias("bucket")
    files = V.table(spark, sf, "customer").join(orders, "c_custkey", "left").groupBy(bucket).agg(F.sort_array(F.collect_list(folder)).alias("items"))
    uid = F.concat(F.lit("g"), F.col("bucket").cast("string"))
    path = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}"
    files.select("bucket", uid.alias("uid"), F.when(F.col("bucket") % 7 == 1, "x").alias("seq"), F.transform("items", lambda c: c.dropFields("c_custkey")).alias("items")).write.partitionBy("bucket").json(path)
    return path


@query("a1_loaded_catalog", """WITH c AS (SELECT *, c_custkey // 100 AS bucket FROM customer WHERE (c_custkey // 100) % 7 <> 1)
SELECT DISTINCT 'g' || bucket AS uid, NULL AS parent_uid, 'collection' AS type, 0 AS pos, NULL AS tag FROM c
UNION ALL SELECT 'c' || c_custkey, 'g' || bucket, 'folder', (ROW_NUMBER() OVER (PARTITION BY bucket ORDER BY c_custkey) - 1)::INT, NULL FROM c
UNION ALL SELECT 'o' || o_orderkey, 'c' || c_custkey, 'http-request', (ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY o_orderkey, o_orderpriority) - 1)::INT, o_orderpriority FROM orders JOIN c ON c_custkey = o_custkey""")
def a1(spark, sf):
    return A.load_catalog(spark, exported(spark, sf))[0].select("uid", "parent_uid", "type", "pos", F.get("tags", F.lit(0)).alias("tag"))


@query("a2_unreadable_files", "SELECT DISTINCT c_custkey // 100 AS bucket, 'unreadable JSON' AS error FROM customer WHERE (c_custkey // 100) % 7 = 1")
def a2(spark, sf):
    return A.load_catalog(spark, exported(spark, sf))[1].select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "error")


@query("a9_file_statistics", "SELECT DISTINCT 'bucket=' || (c_custkey // 100) AS collection, 1::BIGINT AS n_files, TRUE AS has_bytes FROM customer")
def a9(spark, sf):
    return A.file_statistics(spark, exported(spark, sf)).select("collection", "n_files", (F.col("n_bytes") > 0).alias("has_bytes"))


@query("a3_resource_exports", """SELECT 'req' || c_custkey AS uid, CASE WHEN c_custkey % 2 = 0 THEN 'fld' || c_custkey END AS parent_uid, 'http-request' AS type, c_name AS name FROM customer UNION ALL SELECT 'fld' || c_custkey, NULL, 'folder', c_mktsegment FROM customer""")
def a3(spark, sf):
    from ..sources.catalogs import load_resources

    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit('{"resources":[{"_type":"workspace","_id":"wrk_1"},{"_type":"request_group","_id":"fld'), k, F.lit('","parentId":"wrk_1","name":"'), "c_mktsegment", F.lit('"},{"_type":"request","_id":"req'), k, F.lit('","parentId":"'), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("fld"), k)).otherwise("wrk_1"), F.lit('","name":"'), "c_name", F.lit('"}]}'))
    return load_resources(V.table(spark, sf, "customer").select(text.alias("json")))
