"""Declarative checks over typed values.

A value is a struct (type, text): type is one of undefined, null, boolean, number, string, array, object; text is the plain
text of scalars and the JSON of arrays and objects. SQL's null alone could not tell undefined from null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

# The operators; the second list ignores what follows the operator.
BINARY = ["eq", "neq", "gt", "gte", "lt", "lte", "in", "notIn", "contains", "notContains", "length", "matches", "notMatches", "startsWith", "endsWith", "between"]
UNARY = ["isEmpty", "isNotEmpty", "isNull", "isUndefined", "isDefined", "isTruthy", "isFalsy", "isJson", "isNumber", "isString", "isBoolean", "isArray"]

# A check's operator as a number, from 1: a row meets up to all of them and compares numbers faster than words.
CODES = {name: i for i, name in enumerate(BINARY + UNARY, 1)}

SAFE_INTEGER = float(2**53 - 1)


def typed(type_: Column, text: Column) -> Column:
    return F.struct(type_.alias("type"), text.alias("text"))


# The forms of a number; the second list has the base of each prefix.
DECIMAL = r"^[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"
BASES = {r"^0[xX]0*([0-9a-fA-F]{1,15})$": 16, r"^0[oO]0*([0-7]{1,20})$": 8, r"^0[bB]0*([01]{1,60})$": 2}


def plain_number(text: Column) -> Column:
    """Decimal text of a number in any of its forms, null for other texts; no suffixes, no sign before a base."""
    out = F.when(text.rlike(DECIMAL), text)
    for pattern, base in BASES.items():
        out = out.when(text.rlike(pattern), F.conv(F.regexp_extract(text, pattern, 1), base, 10))
    return out


def literal(text: Column) -> Column:
    """Typed value of a literal: true, false, null, undefined, quoted text, a number up to 2**53 - 1, else text."""
    t = F.trim(text)
    plain = plain_number(t)
    number = plain.try_cast("double") <= SAFE_INTEGER
    quoted = t.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(t) > 1)
    kind = F.when(text.isNull(), "undefined").when(t == "", "string").when(t.isin("true", "false"), "boolean").when(t.isin("null", "undefined"), t).when(quoted, "string").when(number, "number").otherwise("string")
    return typed(kind, F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).when(t.isin("null", "undefined"), F.lit(None)).when(number, plain).otherwise(t))


def of_json(text: Column) -> Column:
    """Typed value of a JSON text; SQL null (nothing was found) is undefined."""
    first = F.substring(text, 1, 1)
    kind = F.when(text.isNull(), "undefined").when(text == "null", "null").when(text.isin("true", "false"), "boolean").when(first == '"', "string").when(first == "[", "array").when(first == "{", "object").otherwise("number")
    plain = F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")
    return typed(kind, F.when(text == "null", F.lit(None)).when(first == '"', plain).otherwise(text))


def split_operator(expression: Column) -> Column:
    """Struct (operator, operand): no known operator word means eq with the whole text."""
    t = F.trim(expression)
    word = F.substring_index(t, " ", 1)
    rest = F.regexp_replace(t, r"^\S+ ?", "")
    return F.struct(F.when(word.isin(BINARY + UNARY), word).otherwise("eq").alias("operator"), F.when(word.isin(UNARY), "").when(word.isin(BINARY), rest).otherwise(expression).alias("operand"))


def same(a: Column, b: Column) -> Column:
    """Strict equality: type and value; objects and arrays never equal."""
    value = F.when(a["type"] == "number", a["text"].try_cast("double").eqNullSafe(b["text"].try_cast("double"))).otherwise(a["text"].eqNullSafe(b["text"]))
    return (a["type"] == b["type"]) & ~a["type"].isin("array", "object") & value


def parsed(expression: Column) -> Column:
    """An expression as operator, operand and what the operators read of it: literal, its number, list, bounds and pattern."""
    op = split_operator(expression)
    operand = op["operand"]
    rhs = literal(operand)
    return F.struct(
        op["operator"].alias("operator"),
        F.array_position(F.array(*map(F.lit, CODES)), op["operator"]).cast("int").alias("code"),
        operand.alias("operand"),
        rhs.alias("rhs"),
        F.when(rhs["type"] == "number", rhs["text"].try_cast("double")).alias("number"),
        F.when(op["operator"].isin("in", "notIn"), F.transform(F.split(F.regexp_replace(operand, r"[\[\]]", ""), ","), lambda x: literal(F.trim(x)))).alias("members"),
        F.when(op["operator"] == "between", F.transform(F.split(operand, ","), lambda x: plain_number(F.trim(x)).try_cast("double"))).alias("bounds"),
        F.regexp_replace(operand, "^/|/$", "").alias("pattern"),
    )


def holds(lhs: Column, check: Column) -> Column:
    """Whether a check passes, given as a column of ``parsed``. Wrong types fail, also for most negations."""
    kind, text, rhs, code = lhs["type"], lhs["text"], check["rhs"], check["code"]
    a, b = text.try_cast("double"), check["number"]
    numbers = (kind == "number") & (rhs["type"] == "number")
    bounds, pattern = check["bounds"], check["pattern"]
    listed = F.exists(check["members"], lambda m: same(lhs, m))
    elements = F.from_json(text, "array<string>")
    inside = F.when(kind == "string", F.contains(text, F.coalesce(rhs["text"], F.lit("")))).when(kind == "array", F.array_contains(elements, rhs["text"]))
    holder = kind.isin("string", "array", "object")
    length = F.when(kind == "string", F.length(text)).when(kind == "array", F.json_array_length(text)).when(kind == "object", F.size(F.json_object_keys(text)))
    shown = F.coalesce(text, kind)
    tests = {
        "eq": same(lhs, rhs),
        "neq": ~same(lhs, rhs),
        "gt": numbers & (a > b),
        "gte": numbers & (a >= b),
        "lt": numbers & (a < b),
        "lte": numbers & (a <= b),
        "between": (kind == "number") & a.between(F.get(bounds, F.lit(0)), F.get(bounds, F.lit(1))),
        "in": listed,
        "notIn": ~listed,
        "contains": holder & inside,
        "notContains": holder & ~F.coalesce(inside, F.lit(False)),
        "length": kind.isin("string", "array") & (length == b),
        "matches": (kind != "undefined") & F.regexp_like(shown, pattern),
        "notMatches": (kind == "undefined") | ~F.regexp_like(shown, pattern),
        "startsWith": (kind == "string") & F.startswith(text, F.coalesce(rhs["text"], F.lit(""))),
        "endsWith": (kind == "string") & F.endswith(text, F.coalesce(rhs["text"], F.lit(""))),
        "isEmpty": holder & (length == 0),
        "isNotEmpty": holder & (length > 0),
        "isNull": kind == "null",
        "isUndefined": kind == "undefined",
        "isDefined": kind != "undefined",
        "isTruthy": (kind == "boolean") & (text == "true"),
        "isFalsy": (kind == "boolean") & (text == "false"),
        "isJson": kind == "object",
        "isNumber": kind == "number",
        "isString": kind == "string",
        "isBoolean": kind == "boolean",
        "isArray": kind == "array",
    }
    # one flat CASE: nested ones make code too deep to compile
    out = F
    for name, test in tests.items():
        out = out.when(code == CODES[name], F.coalesce(test, F.lit(False)))
    return out.otherwise(F.lit(False))


def evaluate(checks: DataFrame) -> DataFrame:
    """Checks (…, lhs_json, expression, enabled) with operator, operand, status and error; disabled ones are left out.

    A dictionary of the distinct expressions holds them parsed, once each; rows meet it by their expression and carry typed operands only.
    """
    enabled = checks.where("enabled")
    dictionary = written(enabled.select("expression").distinct().withColumn("_check", parsed(F.col("expression"))), "expressions")
    met = enabled.join(dictionary.withColumnRenamed("expression", "_expression"), F.col("expression").eqNullSafe(F.col("_expression"))).drop("_expression")
    return judged(met.withColumn("_lhs", of_json(F.col("lhs_json"))))


def evaluate_each(rows: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """Every check (column with a JSON text, expression) of a list on every row: pos in the list and what ``evaluate`` adds.

    The list is parsed once and broadcast, as it is no longer than the job's own text; rows are not read for it. A column is typed once a row for
    all its checks. Each row becomes as many as there are checks where it lies, so rows should lie evenly.
    """
    names = sorted({name for name, _ in checks})
    listed = rows.sparkSession.createDataFrame([(i, names.index(name), x) for i, (name, x) in enumerate(checks)], "pos int, _at int, expression string")
    dictionary = written(listed.withColumn("_check", parsed(F.col("expression"))), "expressions")
    # by transform, which Spark compiles apart: in one method with the join both grew too long for the JVM to compile
    values = F.transform(F.array(*names).cast("array<string>"), of_json)
    met = rows.withColumn("_values", values).crossJoin(F.broadcast(dictionary))
    return judged(met.withColumn("_lhs", F.get("_values", F.col("_at"))).drop("_values", "_at"))


def judged(met: DataFrame) -> DataFrame:
    """Rows with their typed value (_lhs) and parsed check (_check), with operator, operand, status and error instead."""
    passed = holds(F.col("_lhs"), F.col("_check"))
    out = met.withColumns({"operator": F.col("_check.operator"), "operand": F.col("_check.operand"), "status": F.when(passed, "pass").otherwise("fail")})
    return out.withColumn("error", F.when(F.col("status") == "fail", F.concat_ws(" ", F.lit("expected"), F.coalesce("_lhs.text", "_lhs.type"), "operator", "operand"))).drop("_check", "_lhs")


def named(description: str, test: Column) -> Column:
    """A check of the user's own; a test that gives null fails."""
    ok = F.coalesce(test, F.lit(False))
    return F.struct(F.lit(description).alias("description"), F.when(ok, "pass").otherwise("fail").alias("status"), F.when(~ok, F.concat(F.lit(description), F.lit(" does not hold"))).alias("error"))


def post_response_variables(rows: DataFrame) -> DataFrame:
    """Variables set after responses (item_uid, pos, name, value, enabled): the last enabled write of a name wins."""
    return rows.where("enabled").groupBy("item_uid", "name").agg(F.max_by("value", "pos").alias("value"))
