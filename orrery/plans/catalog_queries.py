"""Queries over the catalog tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from . import views as V
from .registry import query

ITEMS = V.ctes("items")
TREE = ITEMS + """, closure AS (
  SELECT uid, uid AS ancestor_uid, 0 AS up FROM items
  UNION ALL SELECT uid, parent_uid, 1 FROM items WHERE parent_uid IS NOT NULL
  UNION ALL SELECT a.uid, b.parent_uid, 2 FROM items a JOIN items b ON b.uid = a.parent_uid WHERE b.parent_uid IS NOT NULL
  UNION ALL SELECT a.uid, c.parent_uid, 3 FROM items a JOIN items b ON b.uid = a.parent_uid JOIN items c ON c.uid = b.parent_uid WHERE c.parent_uid IS NOT NULL)
"""


@query("c11_closure", TREE + "SELECT uid, ancestor_uid, up FROM closure")
def c11(spark, sf):
    return C.closure(V.items(spark, sf))


@query("b1_tag_filter", ITEMS + "SELECT uid FROM items WHERE type LIKE '%-request' AND (list_contains(tags, 'F') OR list_contains(tags, '1-URGENT')) AND NOT list_contains(tags, '5-LOW')")
def b1(spark, sf):
    return V.items(spark, sf).where(F.col("type").isin(C.REQUESTS) & C.tag_filter(F.col("tags"), ["F", "1-URGENT"], ["5-LOW"])).select("uid")


@query("b2_runnable_requests", TREE + """SELECT i.uid FROM items i WHERE type IN ('http-request', 'graphql-request') AND NOT list_contains(tags, '5-LOW')
  AND NOT EXISTS (SELECT 1 FROM closure c JOIN items t ON t.uid = c.ancestor_uid WHERE c.uid = i.uid AND t.is_transient)""")
def b2(spark, sf):
    items = V.items(spark, sf)
    return C.runnable(items, C.closure(items), [], ["5-LOW"]).select("uid")


@query("b3_has_checks", """SELECT event_id, event_id % 5 = 0 OR event_id % 4 = 1 AS has_checks FROM events""")
def b3(spark, sf):
    scripts = F.array(F.lit("// test('no')\nrun()"), F.lit("const a = 1; test('x', () => {})"), F.lit("my.test('no') /* test( */"), F.lit('say("test(1)")'))
    e = V.table(spark, sf, "events").withColumn("script", F.element_at(scripts, (F.col("event_id") % 4 + 1).cast("int")))
    return e.select("event_id", C.has_checks(F.col("event_id") % 5 == 0, F.col("script")).alias("has_checks"))


@query("d8_request_counts", TREE + "SELECT ancestor_uid, COUNT(*) AS n_requests FROM closure JOIN items USING (uid) WHERE up > 0 AND type IN ('http-request', 'graphql-request') AND NOT is_transient GROUP BY 1")
def d8(spark, sf):
    items = V.items(spark, sf)
    return C.request_counts(items, C.closure(items))


@query("d9_distinct_tags", ITEMS + "SELECT DISTINCT UNNEST(tags) AS tag FROM items")
def d9(spark, sf):
    return C.distinct_tags(V.items(spark, sf))


@query("e1_suffixed_names", ITEMS + "SELECT uid, CASE WHEN k = 1 THEN name ELSE name || '_' || (k - 1) END AS unique_name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_uid, name ORDER BY pos) AS k FROM items)")
def e1(spark, sf):
    return C.suffixed_names(V.items(spark, sf)).select("uid", "unique_name")


@query("e2_free_names", ITEMS + "SELECT uid, CASE WHEN k = 1 THEN name ELSE name || '_' || (k - 1) END AS free_name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_uid, name ORDER BY pos) AS k FROM items)")
def e2(spark, sf):
    return C.free_names(V.items(spark, sf)).select("uid", "free_name")


@query("e2_operation_names", """WITH o AS (SELECT o_custkey % 50 AS spec_uid, o_orderkey AS uid, o_orderpriority AS name, CASE WHEN o_orderkey % 7 <> 0 THEN ['GET', 'POST', 'PUT'][o_orderkey % 3 + 1] END AS extra FROM orders),
seen AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY spec_uid, name ORDER BY uid) > 1 AS again FROM o),
told AS (SELECT *, again AND extra IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY spec_uid, name, extra, again ORDER BY uid) = 1 AS by_extra FROM seen)
SELECT spec_uid, uid, CASE WHEN NOT again THEN name WHEN by_extra THEN name || ' (' || extra || ')'
  ELSE name || ' (' || (COUNT(*) FILTER (again AND NOT by_extra) OVER (PARTITION BY spec_uid, name ORDER BY uid ROWS UNBOUNDED PRECEDING)) || ')' END AS operation_name FROM told""")
def e2b(spark, sf):
    o, n = V.table(spark, sf, "orders"), F.col("o_orderkey")
    method = F.when(n % 7 != 0, F.element_at(F.array(*map(F.lit, ("get", "post", "put"))), (n % 3 + 1).cast("int")))
    return C.operation_names(o.select((F.col("o_custkey") % 50).alias("spec_uid"), n.alias("uid"), n.alias("pos"), F.col("o_orderpriority").alias("name"), method.alias("method")))


@query("e3_filled_seq", ITEMS + """SELECT uid, COALESCE(NULLIF(seq, 0), ROW_NUMBER() OVER (PARTITION BY parent_uid, COALESCE(seq, 0) = 0 ORDER BY pos))::DOUBLE AS filled_seq FROM items WHERE type NOT IN ('collection', 'folder')""")
def e3(spark, sf):
    return C.filled_seq(V.items(spark, sf)).select("uid", "filled_seq")


ORDERED = ITEMS + """, folders AS (SELECT *, COALESCE(seq > 0 AND seq = FLOOR(seq), FALSE) AS numbered FROM items WHERE type IN ('collection', 'folder')),
ranked AS (
  SELECT *, DENSE_RANK() OVER (PARTITION BY parent_uid, numbered ORDER BY seq) AS nth, ROW_NUMBER() OVER (PARTITION BY parent_uid, numbered ORDER BY name, pos) - 1 AS place,
    COUNT(*) FILTER (NOT numbered) OVER (PARTITION BY parent_uid) AS rest FROM folders),
sibling AS (
  SELECT uid, ROW_NUMBER() OVER (PARTITION BY parent_uid ORDER BY CASE WHEN numbered THEN LEAST(seq - nth, rest) ELSE place END, numbered DESC, CASE WHEN numbered THEN nth END, name, pos) - 1 AS sibling FROM ranked
  UNION ALL SELECT uid, 1099511627776 + ROW_NUMBER() OVER (PARTITION BY parent_uid ORDER BY seq NULLS LAST, pos) FROM items WHERE type NOT IN ('collection', 'folder'))
"""


@query("f1_sibling_order", ORDERED + "SELECT uid, sibling FROM sibling")
def f1(spark, sf):
    return C.sibling_order(V.items(spark, sf))


@query("f2_run_plan", ORDERED + """SELECT o.uid, CONCAT_WS('/', LPAD(r.sibling::VARCHAR, 14, '0'), LPAD(n.sibling::VARCHAR, 14, '0'), LPAD(c.sibling::VARCHAR, 14, '0'), LPAD(s.sibling::VARCHAR, 14, '0')) AS path_key
FROM items o JOIN sibling s USING (uid) JOIN items ci ON ci.uid = o.parent_uid JOIN sibling c ON c.uid = ci.uid JOIN items ni ON ni.uid = ci.parent_uid JOIN sibling n ON n.uid = ni.uid JOIN sibling r ON r.uid = ni.parent_uid
WHERE o.type IN ('http-request', 'graphql-request') ORDER BY path_key""")
def f2(spark, sf):
    items = V.items(spark, sf)
    return C.run_plan(items, C.closure(items), C.sibling_order(items)).orderBy("path_key")


KV = V.ctes("items", "paths", "key_values") + """, rows AS (SELECT item AS uid, name, value, level, pos FROM paths JOIN key_values ON uid = node WHERE enabled),
best AS (SELECT uid, name, ARG_MAX(value, level * 10 + pos) AS value, MIN(level * 10 + pos) AS first FROM rows GROUP BY 1, 2)
"""


def request_levels(spark, sf):
    items = V.items(spark, sf)
    requests = C.levels(C.closure(items)).where(F.col("uid").startswith("o"))
    return items, requests


@query("e6_inherited_headers", KV + "SELECT uid, STRING_AGG(name || ': ' || value, ', ' ORDER BY first) AS headers FROM best GROUP BY uid")
def e6(spark, sf):
    items = V.items(spark, sf)
    rows = C.inherited_list(items, V.key_values(spark, sf), items.where(F.col("uid").startswith("o")))
    return rows.select("uid", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), ", ").alias("headers"))


@query("e7_scoped_variables", V.ctes("items", "paths", "key_values") + """, rows AS (SELECT item AS uid, name, value, level, pos, CASE level WHEN 0 THEN 'c' WHEN 3 THEN 'r' ELSE 'f' END AS s FROM paths JOIN key_values ON uid = node WHERE enabled),
best AS (SELECT uid, s, name, ARG_MAX(value, level * 10 + pos) AS value FROM rows GROUP BY 1, 2, 3)
SELECT uid, STRING_AGG(name || '=' || value, ',' ORDER BY name) FILTER (s = 'c') AS collection_vars, STRING_AGG(name || '=' || value, ',' ORDER BY name) FILTER (s = 'f') AS folder_vars, STRING_AGG(name || '=' || value, ',' ORDER BY name) FILTER (s = 'r') AS request_vars FROM best GROUP BY uid""")
def e7(spark, sf):
    items = V.items(spark, sf)
    out = C.scoped(items, V.key_values(spark, sf), items.where(F.col("uid").startswith("o")))
    return out.select("uid", *[F.array_join(F.transform(F.map_entries(f"{s}_vars"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(f"{s}_vars") for s in ("collection", "folder", "request")])


def auth_rows(items):
    n = F.substring("uid", 2, 20).cast("long")
    folder = F.when(n % 4 == 0, "basic").when(n % 4 == 1, "none").otherwise("inherit")
    request = F.when(n % 3 == 0, "bearer").otherwise("inherit")
    return items.select("uid", F.when(F.col("type") == "collection", F.when(n % 2 == 0, "apikey").otherwise("none")).when(F.col("type") == "folder", folder).otherwise(request).alias("mode"))


@query("e8_effective_auth", V.ctes("items", "paths") + """, auth AS (
  SELECT uid, type, CASE type WHEN 'collection' THEN CASE WHEN pos % 2 = 0 THEN 'apikey' ELSE 'none' END WHEN 'folder' THEN CASE pos % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'none' ELSE 'inherit' END ELSE CASE WHEN pos % 3 = 0 THEN 'bearer' ELSE 'inherit' END END AS mode FROM items),
above AS (SELECT item AS uid, ARG_MAX(mode, level) AS mode FROM paths JOIN auth ON auth.uid = node WHERE type = 'collection' OR (type = 'folder' AND mode = 'basic') GROUP BY item)
SELECT a.uid, CASE WHEN a.mode = 'inherit' THEN COALESCE(b.mode, 'none') ELSE a.mode END AS mode FROM auth a LEFT JOIN above b USING (uid) WHERE type IN ('http-request', 'graphql-request')""")
def e8(spark, sf):
    items, levels = request_levels(spark, sf)
    return C.effective_auth(items, levels, auth_rows(items))


def variable_rows(spark, sf):
    """Variables of customers in six scopes, a name shared by several."""
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    entries = [("global", 0, "a", F.lit("g"), k % 2 == 0, F.lit(True)), ("collection", 0, "a", F.lit("c"), k % 3 == 0, F.lit(False)), ("environment", 0, "a", F.when(k % 5 == 0, "").otherwise("env"), F.lit(True), k % 7 == 0), ("folder", 1, "b", F.lit("f1"), F.lit(True), F.lit(False)), ("folder", 2, "b", F.lit("f2"), k % 4 == 0, F.lit(False)), ("runtime", 0, "b", F.when(k % 6 != 0, "rt"), k % 2 == 1, F.lit(False)), ("request", 3, "a", F.col("c_mktsegment"), k % 11 == 0, F.lit(False))]
    made = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(level).alias("level"), F.lit(n).alias("name"), v.alias("value"), on.alias("enabled"), x.alias("secret")) for s, level, n, v, on, x in entries])
    return c.select(k.alias("uid"), F.explode(made).alias("e")).select("uid", "e.*")


VARS = """WITH vars AS (
  SELECT c_custkey AS uid, 'global' AS scope, 0 AS level, 'a' AS name, 'g' AS value, c_custkey % 2 = 0 AS enabled, TRUE AS secret FROM customer
  UNION ALL SELECT c_custkey, 'collection', 0, 'a', 'c', c_custkey % 3 = 0, FALSE FROM customer
  UNION ALL SELECT c_custkey, 'environment', 0, 'a', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'env' END, TRUE, c_custkey % 7 = 0 FROM customer
  UNION ALL SELECT c_custkey, 'folder', 1, 'b', 'f1', TRUE, FALSE FROM customer
  UNION ALL SELECT c_custkey, 'folder', 2, 'b', 'f2', c_custkey % 4 = 0, FALSE FROM customer
  UNION ALL SELECT c_custkey, 'runtime', 0, 'b', CASE WHEN c_custkey % 6 <> 0 THEN 'rt' END, c_custkey % 2 = 1, FALSE FROM customer
  UNION ALL SELECT c_custkey, 'request', 3, 'a', c_mktsegment, c_custkey % 11 = 0, FALSE FROM customer)
"""


@query("e9_effective_variables", VARS + """SELECT uid, name, scope, CASE WHEN secret THEN REPEAT('*', LENGTH(value)) ELSE value END AS value FROM vars
WHERE enabled AND (scope <> 'environment' OR COALESCE(value, '') <> '')
QUALIFY ROW_NUMBER() OVER (PARTITION BY uid, name ORDER BY LIST_POSITION(['global', 'collection', 'environment', 'folder', 'request', 'oauth2', 'runtime', 'prompt'], scope) DESC, level DESC) = 1""")
def e9(spark, sf):
    return C.effective_variables(variable_rows(spark, sf))


@query("c13_variable_scopes", VARS + """SELECT uid, name, scope, value FROM vars WHERE enabled AND (scope NOT IN ('global', 'runtime') OR COALESCE(value, '') <> '')
QUALIFY ROW_NUMBER() OVER (PARTITION BY uid, name ORDER BY LIST_POSITION(['request', 'folder', 'environment', 'collection', 'global', 'runtime'], scope), level DESC) = 1""")
def c13(spark, sf):
    return C.variable_scopes(variable_rows(spark, sf))


@query("b15_violations", ITEMS + """SELECT uid, 'seq-min' AS rule FROM items WHERE seq < 1 UNION ALL SELECT uid, 'tag-pattern' FROM items WHERE len(list_filter(tags, lambda t: NOT regexp_full_match(t, '[\\w-]+'))) > 0""")
def b15(spark, sf):
    return C.violations(V.items(spark, sf))


@query("b15_request_violations", """WITH o AS (SELECT *, LOWER(SUBSTRING(o_orderpriority, 3)) AS word, ROUND(o_totalprice)::BIGINT AS price FROM orders),
r AS (SELECT CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'o' || o_orderkey END AS uid, price, word, o_orderstatus AS status, o_custkey AS c FROM o)
SELECT uid, UNNEST(LIST_FILTER([CASE WHEN uid = '' THEN 'uid-required' END, CASE WHEN price % 9 = 0 THEN 'name-min-length' END, CASE WHEN status = 'P' THEN 'type-enum' END, CASE WHEN price % 5 = 0 THEN 'seq-min' END,
  CASE WHEN word LIKE '% %' THEN 'tag-pattern' END, CASE WHEN c % 4 = 0 THEN 'parent-required' END, CASE WHEN status <> 'P' AND price % 3 <> 0 THEN 'body-mode-enum' END, CASE WHEN status = 'O' AND price % 7 = 0 THEN 'auth-mode-enum' END,
  CASE WHEN price % 100 > 50 THEN 'max-redirects-range' END, CASE WHEN word = 'low' THEN 'param-type-enum' END, CASE WHEN c % 2 = 1 THEN 'operator-enum' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def b15b(spark, sf):
    price, word, status, c = F.round("o_totalprice").cast("long"), F.lower(F.substring("o_orderpriority", 3, 20)), F.col("o_orderstatus"), F.col("o_custkey")
    pick = lambda test, a, b: F.when(test, a).otherwise(b)
    rows = V.table(spark, sf, "orders").select(
        pick(c % 11 == 0, F.lit(""), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("uid"), F.when(price % 9 != 0, word).alias("name"), pick(status == "P", "soap-request", "http-request").alias("type"),
        pick(price % 5 == 0, 0.0, 1.0).alias("seq"), F.array(word).alias("tags"), F.when(c % 4 != 0, "c").alias("parent_uid"), F.when(price % 3 == 0, "json").when(price % 3 == 1, "yaml").alias("body_mode"),
        pick((status == "O") & (price % 7 == 0), "kerberos", "basic").alias("auth_mode"), (price % 100).alias("max_redirects"), F.array(F.lit("query"), pick(word == "low", "cookie", "path")).alias("param_types"), F.array(pick(c % 2 == 1, "equals", "eq")).alias("operators"),
    )
    return C.violations(rows)


@query("c14_changed_items", "SELECT 'o' || o_orderkey AS uid FROM orders WHERE o_orderkey % 13 = 0")
def c14(spark, sf):
    old = V.items(spark, sf).where("uid like 'o%'")
    n = F.substring("uid", 2, 20).cast("long")
    new = old.withColumn("name", F.when(n % 13 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name"))).withColumn("seq", F.lit(1.0))
    return C.changed_items(old, new, ["name", "type", "tags"])
