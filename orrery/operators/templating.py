"""Template interpolation, prompts and variable use.

Variables: (scope_uid, name, value). ``value`` of a nested object is JSON text, its members are reached by dotted paths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, written

PLACEHOLDER = r"\{\{([^}]+)\}\}"


def placeholders(text: Column) -> Column:
    """Distinct placeholder names of a text in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)))


def prompts(text: Column) -> Column:
    """Distinct prompts ``{{?Question}}`` of a text in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\{\{\s*\?([^}]+)\}\}"), F.lit(1)), lambda p: F.trim(p)))


def json_escape(text: Column) -> Column:
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'^\{"x":"|"\}$', ""))


def _replaced(state: DataFrame, values: DataFrame, key: str, text: str, change) -> DataFrame:
    """One round: ``text`` of each row with the placeholders whose values its scope has; ``seen`` names are left."""
    wanted = F.filter(placeholders(F.col(text)), lambda p: ~F.array_contains("seen", p))
    asked = state.select(key, "scope_uid", F.explode(wanted).alias("wanted"))
    # the whole name first; if no variable is called so, its first step as a JSON document and the rest as a path
    head = F.regexp_extract("wanted", r"^[^.\[]+", 0)
    rest = F.regexp_replace("wanted", r"^[^.\[]+", "")
    path = F.concat(F.lit("$"), F.regexp_replace(rest, r"\[['\"]([^'\"]+)['\"]\]", ".$1"))
    direct = asked.withColumns({"name": F.col("wanted"), "path": F.lit(None).cast("string")})
    nested = asked.where(rest != "").withColumns({"name": head, "path": path})
    hits = direct.unionByName(nested).join(values, ["scope_uid", "name"]).withColumn("found", F.when(F.col("path").isNull(), F.col("value")).otherwise(F.expr("get_json_object(value, path)"))).where("found is not null")
    best = hits.groupBy(key, "wanted").agg(F.min_by("found", F.col("path").isNotNull()).alias("found"))
    known = best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("wanted", "found"))).alias("known"))
    # cut before and after placeholders, so that a value is not read as template text in the same round
    parts = F.split(text, r"(?=\{\{[^}]+\}\})|(?<=\}\})")
    name = lambda p: F.nullif(F.regexp_extract(p, "^" + PLACEHOLDER + "$", 1), F.lit(""))
    put = F.transform(parts, lambda p: F.coalesce(change(F.element_at("known", name(p))), p))
    joined = state.join(known, key, "left")
    return joined.withColumn(text, F.when(F.col("known").isNull(), F.col(text)).otherwise(F.array_join(put, ""))).withColumn("seen", F.array_distinct(F.concat("seen", F.coalesce(F.map_keys("known"), F.array().cast("array<string>"))))).drop("known")


def _round(state: DataFrame, values: DataFrame) -> DataFrame:
    """Variables (scope_uid, name, value, seen) after one replacement in their values."""
    asked = state.select("scope_uid", F.col("name").alias("own"), F.struct("scope_uid", "name").alias("var"), F.col("value").alias("text"), "seen")
    return _replaced(asked, values.select("scope_uid", "name", "value"), "var", "text", lambda c: c).select("scope_uid", F.col("own").alias("name"), F.col("text").alias("value"), "seen")


def expanded(variables: DataFrame) -> DataFrame:
    """Variables (scope_uid, name, value) with the placeholders inside their values replaced, at any depth.

    Dependencies first: a variable is expanded once all variables that it names are, so one used on several branches is replaced on each.
    Each round writes one layer, the variables that only wait for earlier layers, and looks for the next among those that name one of
    it; a variable is written once. What is left then hangs on a cycle; there every variable is expanded with names it has met left as
    they are, which cuts the cycle, until nothing changes. Variables are few beside the templates that use them, so the rounds run
    here and templates need one join.
    """
    spark = variables.sparkSession
    rows = variables.select("scope_uid", "name", "value")
    nested = F.coalesce(F.col("value").rlike(PLACEHOLDER), F.lit(False))
    waiting = written(rows.where(nested), "waiting")
    names = waiting.select("scope_uid", "name").distinct()
    asked = waiting.select("scope_uid", "name", F.explode(placeholders(F.col("value"))).alias("wanted"))
    # a name, and its first step in case that is a variable and the name is none
    asked = asked.select("scope_uid", F.col("name").alias("own"), F.explode(F.array_distinct(F.array("wanted", F.regexp_extract("wanted", r"^[^.\[]+", 0)))).alias("name"))
    needs = written(asked.join(names, ["scope_uid", "name"]).distinct(), "needs")
    degrees = needs.groupBy("scope_uid", "own").agg(F.count("*").alias("needed"))
    path = f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"
    layer = lambda n: spark.read.schema(rows.schema).parquet(f"{path}/{n}")
    rows.where(~nested).write.parquet(f"{path}/0")
    ready, at = names.join(degrees.withColumnRenamed("own", "name"), ["scope_uid", "name"], "left_anti"), 0
    while True:
        done, at = layer("*"), at + 1
        state = waiting.join(ready, ["scope_uid", "name"], "left_semi").withColumn("seen", F.array("name"))
        _round(state, done).drop("seen").write.parquet(f"{path}/{at}")
        if layer(at).isEmpty():
            break
        # those that name one of this layer, and how many of all that they name are done
        asking = needs.join(layer(at).select("scope_uid", "name"), ["scope_uid", "name"], "left_semi").select("scope_uid", "own").distinct()
        met = needs.join(asking, ["scope_uid", "own"], "left_semi").join(layer("*").select("scope_uid", "name").distinct(), ["scope_uid", "name"]).groupBy("scope_uid", "own").agg(F.count("*").alias("met"))
        ready = met.join(degrees, ["scope_uid", "own"]).where("met = needed").select("scope_uid", F.col("own").alias("name"))
    done = layer("*")
    left = written(waiting.join(done.select("scope_uid", "name"), ["scope_uid", "name"], "left_anti"), "cycles")
    state, values = left.withColumn("seen", F.array("name")), done.unionByName(left)
    changed = not left.isEmpty()
    while changed:
        after = written(_round(state, values), "cycles")
        changed = not after.join(state.select("scope_uid", "name", F.col("value").alias("before")), ["scope_uid", "name"]).where("value <> before").isEmpty()
        state = after
    return done.unionByName(state.drop("seen"))


def interpolate(templates: DataFrame, variables: DataFrame, escape_json: bool = False) -> DataFrame:
    """(template_uid, result) of ``templates`` (template_uid, scope_uid, text): placeholders replaced by the scope's values.

    Spaces in a name matter, unknown names stay, nested values are expanded beforehand. Only *used* names meet the variables:
    one equi-join on (scope, name), and a text is put together again over its few placeholders.
    """
    change = json_escape if escape_json else (lambda c: c)
    state = templates.select("template_uid", "scope_uid", "text", F.array().cast("array<string>").alias("seen"))
    return _replaced(state, expanded(variables), "template_uid", "text", change).select("template_uid", F.col("text").alias("result"))
