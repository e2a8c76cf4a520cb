"""Literal cases of the jobs' rules."""

import itertools
import json
import math
import os
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.catalogue import QUERIES
from orrery.functions import json_lists as L
from orrery.functions import json_walk as J
from orrery.functions import payload as P
from orrery.functions import urls as U
from orrery.operators import catalog as C
from orrery.operators import checks as K
from orrery.operators import cookies as CK
from orrery.operators import results as R
from orrery.operators import running as RU
from orrery.operators import search as S
from orrery.operators import specsync as SY
from orrery.operators import templating as T
from orrery.plans import views as V
from orrery.plans.views import CHECK
from orrery.sources import catalogs as A
from orrery.sources import scratch

DOCUMENT = {"customer": {"address": {"city": "bangalore"}, "orders": [{"id": "order-1", "items": [{"id": 1, "amount": 10}, {"id": 2, "amount": 20}]}, {"id": "order-2", "items": [{"id": 3, "amount": 30}, {"id": 4, "amount": 40}]}]}}


@pytest.mark.parametrize(
    ("path", "want"),
    [("customer.address.city", "bangalore"), ("customer.orders.items.amount", [10, 20, 30, 40]), ("customer.orders.items.amount[0]", 10), ("..amount", [10, 20, 30, 40]), ("..items[5].amount", None), ("..id", ["order-1", 1, 2, "order-2", 3, 4]), ("..address", [{"city": "bangalore"}]), ("..nothing", None), ("customer.orders[1].id", "order-2"), ("..items.amount", [10, 20, 30, 40])],
)
def test_paths(path, want):
    assert J.walk(DOCUMENT, J.compile_path(path)) == want


def test_json_helpers(spark):
    texts = [json.dumps({"a": {"b": [{"c": 1}, {"d": None}]}, "e": "x", "f": True}), "broken", None, "[]", "3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", J.flattened(F.col("t")).alias("flat"), J.structure_keys(F.col("t")).alias("keys"), J.json_get(F.col("t"), "a.b.c").alias("c")).orderBy("i").collect()
    assert rows[0]["flat"] == {"a.b[0].c": "1", "a.b[1].d": None, "e": "x", "f": "true"} and rows[0]["c"] == "[1]"
    assert rows[0]["keys"] == ["a", "a.b", "a.b[].c", "e", "f"] and rows[3]["keys"] == [] and rows[4]["flat"] == {"": "3"}
    assert [r["flat"] for r in rows[1:3]] == [None, None] == [r["keys"] for r in rows[1:3]]


@pytest.mark.parametrize(
    ("query", "decode", "want"),
    [("a=1&b=2", False, "a:1,b:2"), ("a=1=2&b&=c#d=4", False, "a:1=2,b:"), ("", False, ""), (None, False, ""), ("a=x%20y+z", True, "a:x y+z"), ("a=%zz&b=1", True, ""), ("a=%zz", False, "a:%zz"), ("q=a|b", False, "q:a|b")],
)
def test_query_params(spark, query, decode, want):
    shown = F.array_join(F.transform(U.query_params(F.lit(query).cast("string"), decode), lambda p: F.concat(p["name"], F.lit(":"), p["value"])), ",")
    assert spark.range(1).select(shown).first()[0] == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("http://a/b?x=1 2&y=é#h?i", "http://a/b?x=1%202&y=%C3%A9#h?i"), ("http://a/b", "http://a/b"), ("http://a/?x=a%20b", "http://a/?x=a%2520b"), ("http://a/?x=(1)!~*'", "http://a/?x=(1)!~*'"), ("http://a?b=1?c=2", "http://a?b=1%3Fc%3D2")],
)
def test_reencoded_urls(spark, url, want):
    assert spark.range(1).select(U.reencode_url(F.lit(url))).first()[0] == want


def test_url_parts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(U.strip_origin(F.lit("https://example.com"))) == "/" and one(U.strip_origin(F.lit("https://e.com/a?b#c"))) == "/a?b#c"
    assert one(U.comparable_path(F.lit("{{base}}/users/{id}//x/?q=1"))) == "/users/:id/x" and one(U.comparable_path(F.lit(None).cast("string"))) == ""
    assert one(U.path_param_names(F.lit("https://h/u/:id/Orders(:key,x=':k2')/:id"))) == ["id", "key", "k2"]
    assert one(U.url_path(F.lit("https://h"))) == "/"


def test_payload_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(P.human_size(F.lit(n).cast("long"))) for n in (None, 0, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**3)] == ["0B", "0B", "1023B", "1.0KB", "1.5KB", "5.0MB", "3.0GB"]
    assert [one(P.sanitize_tag(F.lit(t))) for t in (" a b ", "##", "é/ü", "__x-y__", "")] == ["a_b", None, "é_ü", "x-y", None]
    assert one(P.sanitize_tags(F.array(F.lit("a b"), F.lit("a_b"), F.lit("#")))) == ["a_b"]
    assert one(P.normalize_variables(F.lit("{{ _.base }}/x y/{{a}}"))) == "{{base}}/x y/{{a}}"
    assert [one(P.sniff_type(F.lit(b))) for b in (b"%PDF-1.4", b"\xff\xd8\xff\xe0", b" <svg a>", b"plain text", bytes(range(1, 30)), b"RIFF0000WEBPxx")] == ["application/pdf", "image/jpeg", "image/svg+xml", "text/plain", None, "image/webp"]
    assert [one(P.status_number(F.lit(t))) for t in ("200", "", "x")] == [200, None, None]


CHECKS = [
    ('"a"', "eq a", 1), ('"123"', "eq 123", 0), ("123", 'eq "123"', 0), ('"123"', 'eq "123"', 1), ("123", "eq 123", 1), ("null", "eq null", 1), ('"null"', "eq null", 0), ('"null"', 'eq "null"', 1), (None, "eq undefined", 1), ("true", "eq true", 1), ('"true"', "eq true", 0),
    ("9007199254740993", "eq 9007199254740993", 0), ("{}", "eq {}", 0), ("[1,2]", "contains 2", 1), ("[1,2]", "contains 3", 0), ('"abc"', "contains b", 1), ("null", "notContains b", 0), ("5", "notContains 5", 0), ('"abc"', "notContains z", 1),
    ("5", "gt 4", 1), ("5", "gte 5", 1), ("5", "lt 5", 0), ("5", "lte 5", 1), ('"5"', "gt 4", 0), ("5", "between 1,5", 1), ("5", "between 6,9", 0), ("2", "in [1,2]", 1), ('"2"', "in 1,2", 0), ('"2"', "notIn 1,2", 1), ('"abc"', "length 3", 1), ("[1,2]", "length 2", 1), ("5", "length 1", 0),
    ('"abc"', "matches /^a/", 1), ("123", "matches ^1", 1), (None, "matches x", 0), (None, "notMatches x", 1), ('"abc"', "startsWith a", 1), ('"abc"', "endsWith c", 1), ('""', "isEmpty", 1), ("[]", "isEmpty", 1), ("{}", "isEmpty", 1), ("0", "isEmpty", 0), ("null", "isNotEmpty", 0), ("[1]", "isNotEmpty", 1),
    ("null", "isNull", 1), (None, "isNull", 0), (None, "isUndefined", 1), ("null", "isDefined", 1), ("true", "isTruthy", 1), ("1", "isTruthy", 0), ("false", "isFalsy", 1), ("0", "isFalsy", 0), ("{}", "isJson", 1), ("[]", "isJson", 0), ("1", "isNumber", 1), ('"1"', "isString", 1), ("true", "isBoolean", 1), ("[]", "isArray", 1), ('"x y"', "x y", 1), ("1", "neq 2", 1), ("1", "neq 1", 0),
]


def test_check_operators(spark):
    df = spark.createDataFrame([(i, v, e, True) for i, (v, e, _) in enumerate(CHECKS)] + [(999, "1", "eq 2", False)], "i int, lhs_json string, expression string, enabled boolean")
    got = {r["i"]: r["status"] for r in K.evaluate(df).collect()}
    assert got.keys() == set(range(len(CHECKS)))
    assert [i for i, (_, _, ok) in enumerate(CHECKS) if (got[i] == "pass") != bool(ok)] == []
    assert {e.split()[0] for _, e, _ in CHECKS} >= set(K.BINARY + K.UNARY)


def test_a_list_of_checks_on_every_row(spark):
    """Each check of a list meets each row, as if the rows had been written out with it."""
    lists = [(v, e) for v, e, _ in CHECKS if v is not None]
    values = sorted({v for v, _ in lists})
    rows = spark.createDataFrame([(i, v, None) for i, v in enumerate([*values, None, "1"])], "i int, v string, none string")
    checks = [("v", e) for e in sorted({e for _, e in lists})] + [("none", "isUndefined"), ("v", "eq 1"), ("v", "eq 1")]
    each = K.evaluate_each(rows, checks).select("i", "pos", "operator", "operand", "status", "error").collect()
    written_out = spark.createDataFrame([(i, p, r, e, True) for i, v, n in rows.collect() for p, (f, e) in enumerate(checks) for r in [v if f == "v" else n]], "i int, pos int, lhs_json string, expression string, enabled boolean")
    assert len(each) == (len(values) + 2) * len(checks)
    assert sorted(map(repr, each)) == sorted(map(repr, K.evaluate(written_out).select("i", "pos", "operator", "operand", "status", "error").collect()))


def test_checks_of_a_small_file_are_dealt_out(spark):
    """A file of one row group gives as many tasks as the session has shuffle partitions, and no check is shuffled."""
    from orrery.catalogue import QUERIES

    df = QUERIES["b8_checks"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == 8
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()


def results(spark, rows):
    check = lambda s, script=False: {"status": s, "description": "d", "lhs": "l", "rhs": "r", "operator": "eq", "error": "e", "is_script_error": script}
    data = [(1, i, None if a is None else [check(s) for s in a], None if t is None else [check(s.strip("!"), s.endswith("!")) for s in t], status, status == "skipped", "boom" if status == "error" else None) for i, (a, t, status) in enumerate(rows)]
    df = spark.createDataFrame(data, f"run_id int, seq int, assertions array<{CHECK}>, tests array<{CHECK}>, status string, skipped boolean, error string")
    return df.withColumns({"pre_tests": F.lit(None).cast(f"array<{CHECK}>"), "post_tests": F.lit(None).cast(f"array<{CHECK}>"), "run_duration": F.lit(1.2345678), "name": F.lit("n"), "url": F.lit("u"), "response_time": F.lit(0.0), "response_data": F.lit(None).cast("string")})


def test_summary_verdicts(spark):
    rows = [(["pass"], ["pass"], None), (["fail"], None, "error"), (None, None, "error"), (["fail"], ["fail"], "skipped"), (None, ["fail!"], None), (None, None, None)]
    df = results(spark, rows)
    s = R.run_summary(df, "run_id").first()
    assert (s["total_requests"], s["passed_requests"], s["failed_requests"], s["error_requests"], s["skipped_requests"]) == (6, 2, 2, 1, 1)
    assert (s["total_assertions"], s["passed_assertions"], s["failed_assertions"]) == (3, 1, 1) and (s["total_tests"], s["passed_tests"], s["failed_tests"]) == (2, 1, 0)
    assert [r["gate_open"] for r in R.run_gate(df).collect()] == [False]
    m = R.report_metrics(df).first()
    assert (m["bytes_received"], m["mean_response_time"], m["total_duration"]) == (12, "-", "7.407")
    assert [r["seq"] for r in R.bail_cut(df).orderBy("seq").collect()] == [0, 1]


def test_report_metrics_add_in_order(spark):
    """Sums next to half a millisecond are those of adding one by one in order of seq, whatever the order of the rows."""
    draw = random.Random(3)
    prices = {run: [draw.randrange(100_000, 50_000_000) / 100 for _ in range(25)] for run in range(400)}
    rows = [(run, seq, price, price / 1000) for run, of_run in prices.items() for seq, price in enumerate(of_run)]
    draw.shuffle(rows)
    none = F.lit(None).cast(f"array<{CHECK}>")
    df = spark.createDataFrame(rows, "run_id int, seq int, response_time double, run_duration double").withColumns({"pre_tests": none, "tests": none, "post_tests": none, "response_data": F.lit(None).cast("string")})
    got = {r["run_id"]: (r["total_duration"], r["mean_response_time"]) for r in R.report_metrics(df).collect()}
    want = {}
    for run, of_run in prices.items():
        seconds = waited = 0.0
        for price in of_run:
            seconds, waited = seconds + price / 1000, waited + price
        want[run] = f"{math.floor(seconds * 1000 + 0.5) / 1000:.3f}", str(math.floor(waited / len(of_run) + 0.5))
    assert got == want


def test_report_cases(spark, tmp_path):
    df = results(spark, [(["pass", "fail"], None, None), (["fail"], ["pass"], "error"), (["pass"], None, "skipped")])
    cases = R.report_cases(df).orderBy("seq", "case_pos").collect()
    assert [(c["seq"], c["case_name"], c["case_status"], c["case_time"], c["failure"]) for c in cases][:2] == [(0, "l r", "pass", "0.617", None), (0, "l r", "fail", "0.617", "e")]
    assert [(c["seq"], c["case_name"], c["case_error"]) for c in cases if c["seq"] == 1] == [(1, "Test suite has no errors", "boom")]
    assert [tuple(s)[3:7] for s in R.report_suites(df).orderBy("seq").collect()] == [(2, 1, 0, 0), (1, 1, 1, 0), (1, 0, 0, 1)]
    R.write_xml_report(df, f"file://{tmp_path}/xml")
    text = "".join(p.read_text() for p in (tmp_path / "xml").glob("part-*"))
    assert text.count("<testsuite ") == 3 and text.count("<testcase ") == 4 and 'name="Test suite has no errors"' in text
    R.write_report(df, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json/summary").count() == 1 and spark.read.json(f"file://{tmp_path}/json/results").count() == 3


def test_report_of_many_runs_in_few_files(spark, tmp_path):
    df = V.run_results(spark, "/root/testdata/sf0.001")
    path = f"file://{tmp_path}/many"
    R.write_report(df, path, rows_a_file=200)
    runs = df.groupBy("run_id").count().collect()
    files = [p for p in (tmp_path / "many" / "results").glob("part-*")]
    assert len(files) < len(runs) / 2 and max(len(p.read_text().splitlines()) for p in files) <= 200
    manifest = spark.read.parquet(f"{path}/manifest").where("part = 'results'").groupBy("run_id").agg(F.sum("rows").alias("count")).collect()
    assert sorted(map(tuple, manifest)) == sorted(map(tuple, runs))
    some = sorted(r["run_id"] for r in runs)[:2]
    one = R.read_report(spark, path, "results", df.schema, some)
    assert 0 < len(one.inputFiles()) < len(files)
    assert sorted(one.collect(), key=lambda r: r["seq"]) == sorted(df.where(F.col("run_id").isin(some)).collect(), key=lambda r: r["seq"])
    assert R.read_report(spark, path, "results", df.schema, [-5]).count() == 0


def test_report_summaries_tell_the_written_results(spark, tmp_path):
    """Results are made once: even if they come out differently each time, summaries are those of the results in the files; also compressed."""
    coin = F.udf(lambda: random.choice(["skipped", "error", None]), "string").asNondeterministic()
    df = results(spark, [(["pass"], None, None)] * 300).withColumn("status", coin())
    path = f"file://{tmp_path}/once"
    R.write_report(df, path, rows_a_file=100, compression="gzip")
    assert {p.suffix for part in ("results", "summary") for p in (tmp_path / "once" / part).glob("part-*")} == {".gz"}
    rows = R.read_report(spark, path, "results", df.schema)
    want = R.run_summary(rows, "run_id")
    assert rows.count() == 300 and R.read_report(spark, path, "summary", want.schema).collect() == want.collect()


def test_checks_are_shuffled_without_texts(spark):
    """Lists of checks are those of the rows of checks, and no text of a check goes through the shuffle."""
    sf = "/root/testdata/sf0.001"
    made = V.run_results(spark, sf)
    fields = ["status", "description", "lhs", "rhs", "operator", "error", "is_script_error"]
    want: dict = {}
    for r in V.check_rows(spark, sf).orderBy("pos").collect():
        want.setdefault((r["seq"], r["grp"]), []).append(tuple(r[f] for f in fields))
    got = {(r["seq"], g): list(map(tuple, r[g])) for r in made.collect() for g in V.GROUPS if r[g] is not None}
    assert got == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "res.body.q" in plan and "res.body.q" not in below


def test_interpolation(spark):
    variables = spark.createDataFrame([(1, "a", "A"), (1, "a.b", "dotted"), (1, "o", '{"b":"x","l":[{"k":7}],"k":"v"}'), (1, "n", "<{{a}}{{m}}>"), (1, "m", "({{n}})"), (2, "a", "other"), (1, "name", "N")], "scope_uid int, name string, value string")
    texts = ["{{a}}-{{a.b}}-{{o.b}}", "{{o.l[0].k}} {{o['k']}}", "{{ name }} {{missing}} {{name}}", "{{n}}", "plain", "", "{{o}}"]
    got = dict(T.interpolate(spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)] + [(99, 3, "{{a}}")], "template_uid int, scope_uid int, text string"), variables).collect())
    assert got == {0: "A-dotted-x", 1: "7 v", 2: "{{ name }} {{missing}} N", 3: "<A({{n}})>", 4: "plain", 5: "", 6: '{"b":"x","l":[{"k":7}],"k":"v"}', 99: "{{a}}"}


def test_interpolation_of_shared_and_deep_variables(spark):
    """A variable met on two branches is replaced on both, and chains of any length end."""
    rows = [(1, "a", "{{b}}{{c}}"), (1, "b", "{{c}}"), (1, "c", "x"), (1, "o", '{"k":"{{c}}"}'), (1, "p", "{{o.k}}{{a}}")] + [(1, f"v{i}", f"{{{{v{i + 1}}}}}") for i in range(14)] + [(1, "v14", "end")]
    variables = spark.createDataFrame(rows, "scope_uid int, name string, value string")
    texts = spark.createDataFrame([(0, 1, "{{a}}"), (1, 1, "{{v0}}"), (2, 1, "{{p}}")], "template_uid int, scope_uid int, text string")
    assert dict(T.interpolate(texts, variables).collect()) == {0: "xx", 1: "end", 2: "xxx"}


def test_json_paths_and_lists(spark):
    body = '{"a":[{"b":1,"c":[1,2]},{"b":"x","c":[]},{"d":null,"c":[3]}],"k":7}'
    df = spark.createDataFrame([(body,), ("not json",)], "body string")
    want = {"$.k": "[7]", "$.a[1].b": '["x"]', "$.a[*].b": '[1,"x"]', "$.a[*].c[*]": "[1,2,3]", "$.none": "[]", "$.k[*]": "[]"}
    for path, found in want.items():
        assert [r[0] for r in df.select(L.json_path(F.col("body"), path)).collect()] == [found, "not json"]
    rows = df.limit(1).select(F.array(F.struct(F.lit(1).alias("id"), F.lit("u").alias("n")), F.struct(F.lit(None).cast("int").alias("id"), F.lit("v").alias("n"))).alias("l"))
    got = rows.select(F.size(L.matching(F.col("l"), {"id": 1, "n": "u"})), F.size(L.matching(F.col("l"), {"id": None})), F.size(L.kept(F.col("l"), lambda x: x["id"] > 0)), L.mapped(F.col("l"), lambda x: x["id"]), L.pick(F.col("l"), 5)).first()
    assert tuple(got) == (1, 1, 1, [1], None)
    fields = spark.createDataFrame([('{"k":7}',), ('{"k":"s"}',), ('{"k":null}',), ('{"x":1}',), ("[]",), ("?",), (None,)], "b string")
    assert [tuple(r) for r in fields.select(J.field(F.col("b"), "k"), J.json_get(F.col("b"), "k")).collect()] == [("7",) * 2, ('"s"',) * 2, *[(None,) * 2] * 5]


def test_operation_names(spark):
    rows = [(1, "a", 0, "get", "get"), (1, "b", 1, "get", "post"), (1, "c", 2, "get", "post"), (1, "d", 3, "get (1)", "put"), (1, "e", 4, "get", "post"), (2, "f", 0, "get", "get")]
    got = {r["uid"]: r["operation_name"] for r in C.operation_names(spark.createDataFrame(rows, "spec_uid int, uid string, pos int, name string, method string")).collect()}
    assert got == {"a": "get", "b": "get (POST)", "c": "get (1)", "d": "get (1) (PUT)", "e": "get (2)", "f": "get"}


def test_free_names_against_one_by_one(spark):
    """Any mix of repeated names and names that look like made ones, against choosing one at a time."""
    draw = random.Random(5)
    rows = [(f"p{draw.randrange(9)}", f"u{i:03}", i, draw.choice(["a", "a", "a_1", "a_1_1", "a_2", "b", "b", "_1", "", None])) for i in range(600)] + [("hot", f"v{i}", i, "x") for i in range(300)]
    want, taken = {}, set()
    for parent, uid, _, name in rows:
        new, n = name, 0
        while name is not None and (parent, new) in taken:
            n += 1
            new = f"{name}_{n}"
        taken.add((parent, new))
        want[uid] = new
    got = C.free_names(spark.createDataFrame(rows, "parent_uid string, uid string, pos int, name string"))
    assert {r["uid"]: r["free_name"] for r in got.collect()} == want
    methods = [(p, u, i, n, draw.choice(["get", "post", None])) for p, u, i, n in rows]
    want, taken = {}, set()
    for parent, uid, _, name, method in methods:
        tries = [name, *([f"{name} ({method.upper()})"] if method else []), *[f"{name} ({k})" for k in range(1, 400)]]
        new = next(t for t in tries if name is None or (parent, t) not in taken)
        taken.add((parent, new))
        want[uid] = new
    got = C.operation_names(spark.createDataFrame(methods, "spec_uid string, uid string, pos int, name string, method string"))
    assert {r["uid"]: r["operation_name"] for r in got.collect()} == want


def test_inherited_values_against_walks(spark):
    """Lists and maps of random trees, leaves and inner items, against a walk from the root down."""
    draw = random.Random(11)
    nodes = [("c0", None, "collection"), ("c1", None, "collection"), ("lost", "gone", "http-request")]
    for i in range(150):
        nodes.append((f"i{i}", draw.choice([u for u, _, kind in nodes if kind != "http-request"]), draw.choice(["folder", "http-request", "http-request"])))
    pairs = [(uid, pos, draw.choice(["a", "A", "b", "c"]), draw.choice(["x", "y", "z", None]), draw.random() < 0.8) for uid, _, _ in nodes for pos in range(draw.randrange(4))]
    items = spark.createDataFrame(nodes, "uid string, parent_uid string, type string")
    key_values = spark.createDataFrame(pairs, "uid string, pos int, name string, value string, enabled boolean")
    parent, kind = {u: p for u, p, _ in nodes}, {u: k if k != "http-request" else "request" for u, _, k in nodes}
    lists, maps = {}, {}
    for uid in parent:
        walk, at = [], uid
        while at in parent:
            walk, at = [at, *walk], parent[at]
        found, by_scope = {}, {"collection": {}, "folder": {}, "request": {}}
        for at in walk:
            for _, _, name, value, enabled in sorted(p for p in pairs if p[0] == at and p[4]):
                found[name] = value
                by_scope[kind[at]][name] = value
        if found:
            lists[uid], maps[uid] = list(found.items()), by_scope
    assert {r["uid"]: list(map(tuple, r["headers"])) for r in C.inherited_list(items, key_values, items).collect()} == lists
    got = {r["uid"]: {s: r[f"{s}_vars"] for s in ("collection", "folder", "request")} for r in C.scoped(items, key_values, items).collect()}
    assert got == maps


@pytest.mark.parametrize("name", ["e6_inherited_headers", "e7_scoped_variables"])
def test_inheritance_repeats_no_leaf_for_every_ancestor(spark, monkeypatch, name):
    seen, closure = [], C.closure
    monkeypatch.setattr(C, "closure", lambda items: seen.append(items.count()) or closure(items))
    sf = "/root/testdata/sf0.001"
    QUERIES[name](spark, sf).count()
    inner = sum(V.table(spark, sf, t).count() for t in ("region", "nation", "customer"))
    assert seen and max(seen) <= inner


def test_unique_names_sort_rows_once(spark):
    """A task holds its rows in one window, or in two if there are extras; roots are siblings too."""
    rows = [(None, "a", 0, "x"), (None, "b", 1, "x"), (None, "c", 2, "x_1"), (None, "d", 3, "x"), (None, "e", 4, "y"), (None, "f", 5, "y"), ("p", "g", 6, "x")]
    names = C.free_names(spark.createDataFrame(rows, "parent_uid string, uid string, pos int, name string"))
    assert {r["uid"]: r["free_name"] for r in names.collect()} == {"a": "x", "b": "x_1", "c": "x_1_1", "d": "x_2", "e": "y", "f": "y_1", "g": "x"}
    windows = lambda df: re.findall("windowspecdefinition[^\n]*?\\[?(?=\n)", df._jdf.queryExecution().optimizedPlan().toString())
    assert len(windows(names)) == 1
    rows = [(1, "a", 0, "x", "get"), (1, "b", 1, "x", "get"), (1, "c", 2, "x", "post"), (1, "d", 3, "x", "get"), (1, "e", 4, "x", None), (1, "f", 5, "x", "post")]
    names = C.operation_names(spark.createDataFrame(rows, "spec_uid int, uid string, pos int, name string, method string"))
    assert {r["uid"]: r["operation_name"] for r in names.collect()} == {"a": "x", "b": "x (GET)", "c": "x (POST)", "d": "x (1)", "e": "x (2)", "f": "x (3)"}
    assert len(windows(names)) == 3  # the last two over rows in the same order


def test_sibling_order_against_insertion(spark):
    """Numbered folders put in one by one at place seq - 1, equal ones side by side, give the windows' order."""
    draw = random.Random(7)
    rows = [(f"p{p}", f"{p}-{i}", "folder", draw.choice(["a", "b", "C", "d_1"]), draw.choice([None, 0.0, -2.0, 1.5, 1.0, 2.0, 3.0, 4.0, 9.0, 30.0, 31.0]), i) for p in range(60) for i in range(draw.randrange(1, 14))]
    items = spark.createDataFrame(rows, "parent_uid string, uid string, type string, name string, seq double, pos long")
    got: dict = {}
    for r in C.sibling_order(items).join(items.select("uid", "parent_uid"), "uid").orderBy("sibling").collect():
        got.setdefault(r["parent_uid"], []).append(r["uid"])
    for parent in got:
        named = sorted((r for r in rows if r[0] == parent), key=lambda r: (r[3].lower(), r[5]))
        numbered = [r for r in named if r[4] and r[4] > 0 and r[4] == int(r[4])]
        slots = [[r] for r in named if r not in numbered]
        for r in sorted(numbered, key=lambda r: r[4]):
            place = int(r[4]) - 1
            if place < len(slots) and slots[place][0] in numbered and slots[place][0][4] == r[4]:
                slots[place].append(r)
            else:
                slots.insert(place, [r])
        assert got[parent] == [r[1] for slot in slots for r in slot]


def test_violations_of_modes(spark):
    rows = [("a", "http-request", "json", "basic", 5, ["query"], ["eq"]), ("b", "http-request", "yaml", None, 51, ["header"], ["same"]), ("c", "folder", None, None, None, None, None)]
    items = spark.createDataFrame([(u, "p", t, "n", 1.0, [], *rest) for u, t, *rest in rows], "uid string, parent_uid string, type string, name string, seq double, tags array<string>, body_mode string, auth_mode string, max_redirects int, param_types array<string>, operators array<string>")
    assert sorted((r["uid"], r["rule"]) for r in C.violations(items).collect()) == [("b", x) for x in ("auth-mode-enum", "body-mode-enum", "max-redirects-range", "operator-enum", "param-type-enum")]


def test_sibling_order_and_run_plan(spark):
    def order(rows):
        items = spark.createDataFrame([(str(i), "p", "folder", n, float(s) if s else None, i, [], False) for i, (n, s) in enumerate(rows)], "uid string, parent_uid string, type string, name string, seq double, pos long, tags array<string>, is_transient boolean")
        names = {str(i): n for i, (n, _) in enumerate(rows)}
        return [names[r["uid"]] for r in C.sibling_order(items).orderBy("sibling").collect()]

    assert order([("FOLDER_3", 0), ("folder_1", 0), ("Folder_2", 0)]) == ["folder_1", "Folder_2", "FOLDER_3"]
    assert order([("folder-2", 0), ("folder_1", 0), ("folder 3", 0)]) == ["folder 3", "folder_1", "folder-2"]
    assert order([("c", 2), ("a", 0), ("b", 0), ("d", 2)]) == ["a", "c", "d", "b"]
    assert order([("x", 100), ("y", 1), ("z", 50)]) == ["y", "z", "x"]
    tree = [("c", None, "collection", "c", None, 0), ("f", "c", "folder", "f", None, 1), ("r1", "c", "http-request", "r1", 1.0, 2), ("r2", "f", "http-request", "r2", 2.0, 3), ("r3", "f", "http-request", "r3", 1.0, 4)]
    items = spark.createDataFrame([(*t, [], False) for t in tree], "uid string, parent_uid string, type string, name string, seq double, pos long, tags array<string>, is_transient boolean")
    assert [r["uid"] for r in C.run_plan(items, C.closure(items), C.sibling_order(items)).orderBy("path_key").collect()] == ["r3", "r2", "r1"]


def test_tags_and_scripts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    tags = F.array(F.lit("a"), F.lit("b"))
    assert [one(C.tag_filter(t, i, e)) for t, i, e in ((tags, [], []), (tags, ["a"], []), (tags, ["z"], []), (tags, ["a"], ["b"]), (F.lit(None).cast("array<string>"), ["a"], []), (F.lit(None).cast("array<string>"), [], ["a"]))] == [True, True, False, False, False, True]
    assert [one(C.has_test_call(F.lit(s))) for s in ("test('a')", "// test(1)", "x.test(1)", "'test(1)'", "a; test (1)", "mytest(1)", "/* test( */", "// /*\ntest(1) // */", "/* // */ test(1)", "a.test(1); b.my_test\u00a0(2)", "'it\\'s test(1)'", "`a\n${test(1)}`", "x = 'a\\\\'; test(1)", "'" + "\\'" * 9000 + "' test (1)")] == [True, False, False, False, True, True, False, True, False, True, False, False, True, True]


def test_cookies_for_urls(spark):
    rows = [("example.com", "/", "a", "1", None, False, False), ("example.com", "/a", "b", "2", None, True, False), ("other.com", "/", "c", "3", None, False, False), ("x.example.com", "/", "d", "4", "2020-01-01 00:00:00", False, True), ("example.com", "/", "h", "5", None, False, True)]
    cookies = spark.createDataFrame(rows, "domain string, path string, key string, value string, expires string, secure boolean, host_only boolean").withColumn("expires", F.col("expires").cast("timestamp"))
    urls = spark.createDataFrame([(1, "https://x.example.com/a/b"), (2, "http://example.com/a"), (3, "http://example.com/ab")], "url_id int, url string")
    got = dict(CK.cookie_strings(CK.for_urls(urls, cookies, "2024-01-01 00:00:00")).collect())
    assert got == {1: "b=2; a=1", 2: "a=1; h=5", 3: "a=1; h=5"}
    gone = urls.where("url_id = 1").withColumn("key", F.lit("b"))
    assert {r["key"] for r in CK.without_named(cookies, gone, "2024-01-01 00:00:00").collect()} == {"a", "c", "d", "h"}


def test_text_differences():
    assert S.segments(["a", " ", "b"], ["a", " ", "c"]) == [("a ", "unchanged"), ("b", "deleted"), ("c", "added")]
    assert S.segments([], ["x"]) == [("x", "added")] and S.segments(["x"], []) == [("x", "deleted")] and S.segments([], []) == []
    old, new = S.WORDS.findall("the quick brown fox"), S.WORDS.findall("the slow brown dog")
    got = S.segments(old, new)
    assert "".join(t for t, s in got if s != "added") == "the quick brown fox" and "".join(t for t, s in got if s != "deleted") == "the slow brown dog"


def test_words_and_shortest_differences():
    """Separators are tokens of their own, other signs belong to words; as many tokens stay unchanged as by trying all."""
    assert S.WORDS.findall("a_b(c), d-e  f@g.h") == ["a", "_", "b(c),", " ", "d", "-", "e", " ", " ", "f", "@", "g", ".", "h"]
    draw = random.Random(11)
    for _ in range(80):
        a, b = ([draw.choice("abc") for _ in range(draw.randrange(8))] for _ in range(2))
        subsequences = lambda x: {tuple(t for i, t in enumerate(x) if m >> i & 1) for m in range(1 << len(x))}
        got = S.segments(a, b)
        assert sum(len(t) for t, s in got if s == "unchanged") == max(map(len, subsequences(a) & subsequences(b)))
        assert "".join(t for t, s in got if s != "added") == "".join(a) and "".join(t for t, s in got if s != "deleted") == "".join(b)


def test_search_equals_trying_every_pair(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcé/ X") for _ in range(draw.randrange(9)))
    items = [(f"u{i}", draw.choice(["collection", "folder", "http-request", "js"]), draw.choice([None, word(), word()]), draw.choice([None, word()]), draw.choice([None, word()])) for i in range(120)]
    asked = [(i, draw.choice([word(), word(), "a", "é", "b/", "ab", "/", "", "?", "xab a", "a/b c", None])) for i in range(60)]
    rows, queries = spark.createDataFrame(items, "uid string, type string, name string, url string, path string"), spark.createDataFrame(asked, "query_id int, query string")
    found = S.search(rows, queries)
    want = set()
    for q, text in asked:
        text = re.sub("/+", "/", (text or "").strip(" "))
        terms = [t for t in re.split(r"[\s/]+", text.lower()) if t]
        if text in ("", "/") or (len(text) == 1 and not re.match("[a-zA-Z0-9]", text)) or not terms:
            continue
        for uid, kind, *fields in items:
            name, url, path = (all(t in (f or "").lower() for t in terms) for f in fields)
            kind = kind if kind in ("collection", "folder") else "request"
            match = kind if name else "url" if kind == "request" and url else "path" if kind != "collection" and "/" in text and path else None
            if match:
                want.add((q, uid, kind, fields[0], match))
    got = list(map(tuple, found.collect()))
    assert set(got) == want and len(got) == len(want) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_differences_of_long_texts():
    """Beyond the table's bound, words kept between two changed ends stay unchanged."""
    kept = [f"w{i % 997}" for i in range(6000)]
    got = S.segments(["a", *kept[:3000], "x", *kept[3000:], "b"], ["c", *kept[:3000], "y", "z", *kept[3000:], "d"])
    assert [s for _, s in got] == ["deleted", "added", "unchanged"] * 2 + ["deleted", "added"]
    assert [t for t, s in got if s == "unchanged"] == ["".join(kept[:3000]), "".join(kept[3000:])]


def table_walk(a, b):
    """The same rule over the whole table of common lengths."""
    longest = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row = longest[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
        longest.append(row)
    longest.reverse()
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("unchanged", a[i]))
            i, j = i + 1, j + 1
        elif longest[i + 1][j] >= longest[i][j + 1]:
            out.append(("deleted", a[i]))
            i += 1
        else:
            out.append(("added", b[j]))
            j += 1
    return out + [("deleted", x) for x in a[i:]] + [("added", x) for x in b[j:]]


def test_differences_follow_one_rule_at_any_length():
    draw = random.Random(3)
    pairs = [([draw.choice("abcd") for _ in range(draw.randrange(14))], [draw.choice("abcde") for _ in range(draw.randrange(14))]) for _ in range(1500)]
    pairs += [([str(draw.randrange(60)) for _ in range(400)], [str(draw.randrange(60)) for _ in range(280)]) for _ in range(10)]
    # one pair of more than 16 million cells
    pairs.append(([str(draw.randrange(300)) for _ in range(4100)], [str(draw.randrange(300)) for _ in range(4100)]))
    for a, b in pairs:
        assert S._common(a, b) == table_walk(a, b)


def test_turn_differences_query(spark):
    """The registered query against the rule over whole turns."""
    sf = "/root/testdata/sf0.001"
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = {}
    for r in QUERIES["s24_turn_differences"](spark, sf).collect():
        got.setdefault((r["conv_id"], r["turn"]), {})[r["pos"]] = (r["text"], r["status"])
    wanted = {(c, t): x for (c, t), x in turns.items() if (c, t + 1) in turns}
    assert got.keys() == wanted.keys() and got
    for (c, t), old in wanted.items():
        whole = table_walk(S.WORDS.findall(old or ""), S.WORDS.findall(turns[c, t + 1] or ""))
        runs = [[k, "".join(x for _, x in g)] for k, g in itertools.groupby(whole, key=lambda x: x[0])]
        found = [got[c, t][k] for k in sorted(got[c, t])]
        # equal ends are set aside before the rule applies
        assert "".join(x for x, s in found if s != "added") == (old or "") and "".join(x for x, s in found if s != "deleted") == (turns[c, t + 1] or "")
        assert sum(len(x) for x, s in found if s == "unchanged") > 0 or not any(k == "unchanged" for k, _ in runs)
        assert sum(len(S.WORDS.findall(x)) for x, s in found if s == "unchanged") == sum(k == "unchanged" for k, _ in whole)


def test_number_literals(spark):
    texts = ["7d", "7f", "0x10", "0X1f", "-0x10", "0b101", "0o17", "1.", ".5", "5e", "1e3", "+5", " 12 ", "Infinity", "-Infinity", "NaN", "1_0", "0x", "9007199254740991", "9007199254740993", "0x1fffffffffffff", "0x3fffffffffffff", "0xffffffffffffffffff", "1e400", "", "0x1p3"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", K.literal(F.col("t")).alias("v")).orderBy("i").collect()
    s = lambda t: ("string", t)
    n = lambda t: ("number", t)
    assert [tuple(r["v"]) for r in rows] == [s("7d"), s("7f"), n("16"), n("31"), s("-0x10"), n("5"), n("15"), n("1."), n(".5"), s("5e"), n("1e3"), n("+5"), n("12"), s("Infinity"), n("-Infinity"), s("NaN"), s("1_0"), s("0x"), n("9007199254740991"), s("9007199254740993"), n("9007199254740991"), s("0x3fffffffffffff"), s("0xffffffffffffffffff"), s("1e400"), s(""), s("0x1p3")]
    checks = spark.createDataFrame([("7", "eq 7d"), ("16", "eq 0x10"), ("7", "between 0x5,0b1000"), ("7", "between 5d,9d"), ("5", "in [0x5, 6]")], "lhs_json string, expression string").withColumn("enabled", F.lit(True))
    assert [r["status"] for r in K.evaluate(checks).collect()] == ["fail", "pass", "pass", "fail", "pass"]


def test_drift_by_auth_and_forms(spark):
    schema = "spec_id string, endpoint_id string, params array<string>, headers array<string>, body_mode string, json_body string, auth_mode string, auth map<string,string>, form array<string>"
    key = {"key": "k", "placement": "header", "value": "secret"}
    oauth = {"grantType": "password", "scope": "r", "accessTokenUrl": "t", "authorizationUrl": "a"}
    cases = [
        (("none", "", None, None, None), (None, "", None, None, None), None),
        (("none", "", "basic", None, None), ("none", "", "bearer", None, None), "auth: bearer"),
        (("none", "", "apikey", key, None), ("none", "", "apikey", {**key, "value": "other"}, None), None),
        (("none", "", "apikey", key, None), ("none", "", "apikey", {**key, "placement": "query"}, None), "auth config"),
        (("none", "", "oauth2", oauth, None), ("none", "", "oauth2", {**oauth, "authorizationUrl": "b"}, None), None),
        (("none", "", "oauth2", oauth, None), ("none", "", "oauth2", {**oauth, "accessTokenUrl": "b"}, None), "auth config"),
        (("none", "", "oauth2", {**oauth, "grantType": None}, None), ("none", "", "oauth2", oauth, None), "auth config"),
        (("none", "", "inherit", key, None), ("none", "", "inherit", None, None), None),
        (("multipartForm", "", None, None, ["f:text"]), ("multipartForm", "", None, None, ["f:file"]), "+1 form fields, -1 form fields"),
        (("formUrlEncoded", "", None, None, ["a", "b"]), ("formUrlEncoded", "", None, None, ["b", "a"]), None),
        (("formUrlEncoded", "", None, None, ["a"]), ("multipartForm", "", None, None, ["b:text"]), "body: multipartForm"),
        (("json", '{"a":1}', None, None, None), ("json", "", None, None, None), "body schema"),
        (("json", '{"a":1}', None, None, None), ("json", "{broken", None, None, None), None),
        (("json", "", None, None, None), ("json", "null", None, None, None), None),
        (("json", "", None, None, None), ("json", "{broken", None, None, None), None),
        (("formUrlEncoded", "", None, None, ["a", "a"]), ("formUrlEncoded", "", None, None, ["a"]), ""),
    ]
    side = lambda k: spark.createDataFrame([("s", str(i), ["q:query"], ["h"], *case[k]) for i, case in enumerate(cases)], schema)
    got = {int(r["endpoint_id"]): (r["drift"], r["changes"]) for r in SY.drift(side(0), side(1)).collect()}
    assert got == {i: ("inSync" if c[2] is None else "modified", c[2] or None) for i, c in enumerate(cases)}


def test_catalog_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps({"uid": "c", "name": "C", "items": [{"uid": "f", "type": "folder", "name": "F", "items": [{"uid": "r", "type": "http-request", "name": "R", "tags": ["t"]}]}, {"uid": "q", "type": "http-request", "name": "Q"}]}, indent=1))
    (tmp_path / "a" / "bad.json").write_text("{broken")
    (tmp_path / "node_modules" / "no.json").write_text("{}")
    items, bad = A.load_catalog(spark, f"file://{tmp_path}", depth=3)
    assert {(r["uid"], r["parent_uid"], r["type"], r["pos"]) for r in items.collect()} == {("c", None, "collection", 0), ("f", "c", "folder", 0), ("q", "c", "http-request", 1), ("r", "f", "http-request", 0)}
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]
    stats = A.file_statistics(spark, f"file://{tmp_path}").collect()
    assert [(r["collection"], r["n_files"]) for r in stats] == [("a", 2)]


def test_deep_catalogs_are_whole(spark, tmp_path):
    item = {"uid": "i11", "type": "http-request"}
    for i in range(10, -1, -1):
        item = {"uid": f"i{i}", "type": "folder" if i else None, "items": [item]}
    (tmp_path / "deep.json").write_text(json.dumps(item))
    (tmp_path / "bad.json").write_text(json.dumps({"uid": "b", "items": [{"uid": "c", "items": [{"uid": "d", "seq": "x"}]}]}))
    items, bad = A.load_catalog(spark, f"file://{tmp_path}", depth=3)
    assert sorted((r["uid"], r["parent_uid"]) for r in items.collect()) == sorted((f"i{i}", f"i{i - 1}" if i else None) for i in range(12))
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]


def test_catalog_files_are_parsed_once(spark, tmp_path):
    """What is loaded no longer hangs on the files: no level is parsed again for those below it."""
    for i in range(5):
        (tmp_path / f"{i}.json").write_text(json.dumps({"uid": f"c{i}", "items": [{"uid": f"f{i}", "type": "folder", "items": [{"uid": f"q{i}", "type": "http-request"}]}]}))
    items, bad = A.load_catalog(spark, f"file://{tmp_path}")
    assert items.count() == 15 and bad.count() == 0
    assert all("from_json" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (items, bad))


def test_differences_hold_few_rows_as_objects(spark):
    """A full batch takes no more Python memory than a few rows, and gives each row's own result."""
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(40)) for _ in range(3001)]
    pairs = [(texts[i], texts[i + 1]) if i % 7 else (None, texts[i]) for i in range(3000)]
    old, new = (pa.array([p[i] for p in pairs]) for i in (0, 1))
    peaks = []
    for n in (100, 3000):
        tracemalloc.start()
        made = S.differences(old.slice(0, n), new.slice(0, n), S.WORDS.findall)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]
    want = [[{"text": t, "status": s} for t, s in S.segments(S.WORDS.findall(x or ""), S.WORDS.findall(y))] for x, y in pairs]
    assert made.to_pylist() == want
    df = spark.createDataFrame(pairs[:200], "a string, b string").coalesce(1)
    assert [[x.asDict() for x in r[0]] for r in df.select(S.text_diff(F.col("a"), F.col("b"))).collect()] == want[:200]


def test_closure_of_deep_trees_and_cycles(spark):
    rows = [(f"u{i}", f"u{i - 1}" if i else None) for i in range(25)]
    got = C.closure(spark.createDataFrame(rows, "uid string, parent_uid string")).where("uid = 'u24'").collect()
    assert sorted((r["up"], r["ancestor_uid"]) for r in got) == [(k, f"u{24 - k}") for k in range(25)]
    for ring in (1, 2, 5):
        rows = [("leaf", "u0"), *[(f"u{i}", f"u{(i + 1) % ring}") for i in range(ring)]]
        with pytest.raises(ValueError, match="cycle"):
            C.closure(spark.createDataFrame(rows, "uid string, parent_uid string"))


def test_closure_of_a_thousand_levels_takes_ten_rounds(spark, monkeypatch):
    rounds = []
    keep = C.written
    monkeypatch.setattr(C, "written", lambda df, name: rounds.append(name) or keep(df, name))
    rows = [(f"u{i}", f"u{i - 1}" if i else "gone") for i in range(1000)]
    got = C.closure(spark.createDataFrame(rows, "uid string, parent_uid string"))
    assert got.agg(F.count("*"), F.max("up"), F.sum("up")).first() == (500500, 999, sum(i * (i + 1) // 2 for i in range(1000)))
    assert got.distinct().count() == 500500 and rounds.count("leap") <= 10


def test_running_values_under_a_key_with_half_of_all_rows(spark):
    draw = random.Random(9)
    rows = [(draw.choice([None, "hot", "hot", "hot", "a", "b"]), i, draw.choice([None, i, -i]), draw.random() < 0.01) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i long, v long, f boolean").repartition(6)
    for itself in (True, False):
        got = {r["i"]: r for r in RU.running(df, ["k"], ["i"], {"n": RU.number(), "s": RU.total(F.col("v")), "m": RU.most(F.col("f")), "l": RU.last(F.col("v"))}, itself).collect()}
        seen = {}
        for k, i, v, f in rows:
            past = seen.setdefault(k, [])
            now = past + [(v, f)] if itself else list(past)
            values = [x for x, _ in now if x is not None]
            want = (len(now) or None, sum(values) if values else None, max((x for _, x in now), default=None), values[-1] if values else None)
            assert (got[i]["n"], got[i]["s"], got[i]["m"], got[i]["l"]) == want, (k, i)
            past.append((v, f))
    # no task of the windows has more than a cell
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = RU.cells(df, ["k"], ["i"]).groupBy("k", "_cell").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 4000 / 8 * 1.5


def test_scratch_tables_lie_in_one_folder_that_can_be_cleared(spark, tmp_path, monkeypatch):
    assert scratch.shared_dir(spark).endswith(f"/orrery-{spark.sparkContext.applicationId}")
    monkeypatch.setattr(scratch, "shared_dir", lambda session: f"file://{tmp_path}/orrery-x")
    assert C.closure(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d")], "uid string, parent_uid string")).count() == 15
    assert [p.name for p in tmp_path.iterdir()] == ["orrery-x"] and len(list((tmp_path / "orrery-x").iterdir())) > 1
    scratch.clear(spark)
    assert not list(tmp_path.iterdir())


def test_without_a_named_folder_a_local_session_has_one(spark):
    class Nameless:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default: default)

    first = scratch.shared_dir(Nameless)
    assert first == scratch.shared_dir(Nameless) and os.path.isdir(os.path.dirname(first))
    Nameless.sparkContext = type("Cluster", (), {"master": "spark://host:7077"})
    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(Nameless)


def test_bulk_text_round_trip(spark):
    df = spark.createDataFrame([(1, "a: 1\n//b:2\nno\nc:x:y")], "k int, text string")
    pairs = A.bulk_pairs(df, "k")
    assert A.bulk_text(pairs, "k").first()["text"] == "a:1\n//b:2\nc:x:y"


def test_environments(spark):
    df = spark.createDataFrame([(1, '{"variables":[{"name":"a","value":"1"},{"name":"b","enabled":false,"secret":true}]}'), (2, '{"name":"x"}'), (3, "broken")], "k int, json string")
    good, bad = A.environment_variables(df, "k")
    assert [tuple(r) for r in good.orderBy("name").collect()] == [(1, "a", "1", "text", True, False), (1, "b", None, "text", False, True)]
    assert sorted(r["k"] for r in bad.collect()) == [2, 3]
