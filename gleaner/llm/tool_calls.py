"""Chat formatting: linking tool calls and results, in DataFrame functions only.

Calls and results are hash-joined on (conversation, call id); both are
reduced to the first row of an id for that, so a common id costs no pairs.
Further calls and results of an id are rows of their own, numbered, with what
the join found for their id.  Calls are put
in topological order: a call's level is one more than the highest level of
the calls that it waits for; calls on a cycle get none.  Chains are followed
by pointers that double in reach, so a long conversation takes few rounds.
Arguments are parsed as variants, checked against their tool's schema, and serialised as
canonical JSON (keys sorted, no spaces).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS, Stages, session

_SCHEMA = ("struct<required:array<string>, additionalProperties:boolean, properties:map<string, "
           "struct<type:string, minimum:double, maximum:double, `enum`:array<string>>>>")
#: Spark's names of variant types for the JSON schema types.
_TYPES = {"string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "object": "^OBJECT", "array": "^ARRAY",
          "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"}


def schema_table(spark: SparkSession, schemas: dict[str, dict]) -> DataFrame:
    """(tool, schema) from JSON schemas by tool name (required, properties, additionalProperties)."""
    names = list(schemas)
    rows = [F.struct(F.lit(n).alias("tool"), F.lit(json.dumps(schemas[n])).alias("text")) for n in names]
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("x")) if rows else spark.range(0).select(
        F.struct(F.lit("").alias("tool"), F.lit("{}").alias("text")).alias("x"))
    return one.select("x.tool", F.from_json("x.text", _SCHEMA).alias("schema"))


def _fits(kind: Column, want: Column) -> Column:
    ok = want.isNull()
    for name, pattern in _TYPES.items():
        ok = ok | ((want == name) & F.rlike(kind, F.lit(pattern)))
    return ok


def problems(args: str = "args", fields: str = "fields", schema: str = "schema") -> Column:
    """What is wrong with parsed arguments, as an array of short texts (empty: valid)."""
    has = F.map_keys(fields)
    props = F.coalesce(F.col(schema)["properties"], F.expr("map()").cast(
        "map<string,struct<type:string,minimum:double,maximum:double,`enum`:array<string>>>"))
    none = F.array().cast("array<string>")
    missing = F.transform(F.array_except(F.coalesce(F.col(schema)["required"], none), has), lambda k: F.concat(F.lit("missing "), k))
    extra = F.when(F.col(schema)["additionalProperties"] == F.lit(False), F.transform(
        F.array_except(has, F.map_keys(props)), lambda k: F.concat(F.lit("unexpected "), k))).otherwise(none)
    known = F.filter(has, lambda k: F.array_contains(F.map_keys(props), k))
    value = lambda k: F.try_element_at(F.col(fields), k)
    rule = lambda k: F.try_element_at(props, k)
    typed = F.transform(F.filter(known, lambda k: ~_fits(F.schema_of_variant(value(k)), rule(k)["type"])),
                        lambda k: F.concat(F.lit("wrong type of "), k))
    number = lambda k: F.try_variant_get(value(k), "$", "double")
    ranged = F.transform(F.filter(known, lambda k: F.rlike(F.schema_of_variant(value(k)), F.lit(_TYPES["number"])) & (
        F.coalesce(number(k) < rule(k)["minimum"], F.lit(False)) | F.coalesce(number(k) > rule(k)["maximum"], F.lit(False)))),
        lambda k: F.concat(F.lit("out of range "), k))
    listed = F.transform(F.filter(known, lambda k: rule(k)["enum"].isNotNull() & ~F.coalesce(F.array_contains(
        rule(k)["enum"], F.try_variant_get(value(k), "$", "string")), F.lit(False))),
        lambda k: F.concat(F.lit("not allowed "), k))
    return (F.when(F.col(args).isNull(), F.array(F.lit("not JSON")))
            .when(F.col(fields).isNull(), F.array(F.lit("not an object")))
            .when(F.col(schema).isNull(), F.array(F.lit("unknown tool")))
            .otherwise(F.array_sort(F.concat(missing, extra, typed, ranged, listed))))


def levels(calls: DataFrame, stages: Stages) -> DataFrame:
    """(conv, call, level) for calls(conv, call, waits_for array).

    A call that waits for an unknown call does not wait; one that waits for
    itself or lies behind a cycle gets no row.  Calls that wait for exactly
    one other form trees: each follows its pointer towards its tree's head (a
    call that waits for none or for several), and pointers double in reach
    every round, so a chain of n calls takes about log2(n) rounds.  What is
    left are the heads: one that waits for several gets its level once all of
    them have one, in as many rounds as such calls lie behind each other.
    """
    nodes = stages.put("nodes", calls.select("conv", "call").distinct())
    needs = stages.put("needs", calls.select("conv", "call", F.explode("waits_for").alias("before")).distinct()
                       .join(nodes.withColumnRenamed("call", "before"), ["conv", "before"], "left_semi"))
    fan = stages.put("fan", nodes.join(needs.groupBy("conv", "call").agg(F.count("*").alias("n"), F.min("before").alias("up")),
                                       ["conv", "call"], "left"))
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    jumps = _follow(fan.select("conv", "call", F.when(single, F.col("up")).otherwise(F.col("call")).alias("head"),
                               F.when(single, 1).otherwise(0).cast("long").alias("steps"), (~single).alias("at_head")), stages)
    several = needs.join(fan.where("n > 1"), ["conv", "call"], "left_semi")
    reach = jumps.where("at_head").select("conv", F.col("call").alias("before"), "head", (F.col("steps") + 1).alias("gap"))
    edges = stages.put("edges", several.join(reach, ["conv", "before"], "left").groupBy("conv", "call", "head").agg(F.max("gap").alias("gap")))
    top = _head_levels(fan.where("n is null").select("conv", "call", F.lit(0).cast("long").alias("level")), edges, stages)
    return (jumps.where("at_head").join(top.withColumnRenamed("call", "head"), ["conv", "head"])
            .select("conv", "call", (F.col("level") + F.col("steps")).alias("level")))


def _follow(start: DataFrame, stages: Stages) -> DataFrame:
    """Double the pointers of (conv, call, head, steps, at_head) until no further call reaches its head.

    A round settles at least one call of every chain that has a head, so a
    round without news leaves only calls on or behind a cycle.
    """
    jumps, n, known = stages.put("jump0", start), -1, 0
    turn = 0
    while n != known:
        turn, n = turn + 1, known
        target = jumps.select("conv", F.col("call").alias("head"), F.col("head").alias("h"), F.col("steps").alias("s"), F.col("at_head").alias("a"))
        moved = jumps.where("not at_head").join(target, ["conv", "head"]).select(
            "conv", "call", F.col("h").alias("head"), (F.col("steps") + F.col("s")).alias("steps"), F.col("a").alias("at_head"))
        jumps = stages.put(f"jump{turn}", jumps.where("at_head").union(moved))
        stages.drop(f"jump{turn - 1}")
        known = jumps.where("at_head").count()
    return jumps


def _head_levels(sources: DataFrame, edges: DataFrame, stages: Stages) -> DataFrame:
    """(conv, call, level) of sources and of the calls of edges(conv, call, head, gap) whose heads all have a level."""
    done = stages.put("level0", sources)
    n, known, turn = -1, 0, 0
    if edges.isEmpty():
        return done
    while n != known:
        turn, n = turn + 1, known
        level = done.select("conv", F.col("call").alias("head"), "level")
        ready = (edges.join(done, ["conv", "call"], "left_anti").join(level, ["conv", "head"], "left")
                 .groupBy("conv", "call").agg(F.max(F.col("level") + F.col("gap")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
                 .where("open = 0").select("conv", "call", "level"))
        done = stages.put(f"level{turn}", done.union(ready))
        stages.drop(f"level{turn - 1}")
        known = done.count()
    return done


_KEY = ["conv", "call"]


def _looked_up(table: DataFrame) -> DataFrame:
    """A stored table of one narrow row an id, to be broadcast if it is small."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _numbered(rows: DataFrame, order: list[str], stages: Stages, name: str) -> tuple[DataFrame, DataFrame]:
    """(first rows, further rows) of each (conv, call) by ``order``, with ``occurrence`` (from 1) and ``n``, the id's rows.

    Only rows of repeated ids are sorted: by range, so that one id may span
    many tasks, each of which counts on from the rows of the tasks before it.
    """
    many = stages.put(f"{name}-repeated", rows.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1"))
    one = lambda: F.lit(1).cast("long")
    if many.isEmpty():
        return rows.withColumn("occurrence", one()).withColumn("n", one()), rows.withColumn("occurrence", one()).withColumn("n", one()).where("false")
    tagged = rows.join(_looked_up(many), _KEY, "left")
    by = [*_KEY, *order, "salt"]  # the salt deals equal rows to several tasks
    placed = (tagged.where("n is not null").withColumn("salt", F.monotonically_increasing_id())
              .repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    placed = stages.put(f"{name}-placed", placed.withColumn("task", F.shiftright("at", 33)).drop("salt"))
    spans = placed.groupBy("task", *_KEY).agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    before = Window.partitionBy(*_KEY).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = stages.put(f"{name}-spans", spans.select("task", *_KEY, "start", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier")))
    counted = placed.join(spans, ["task", *_KEY]).withColumn("occurrence", F.col("at") - F.col("start") + F.col("earlier") + 1)
    counted = counted.select(*rows.columns, "occurrence", "n")
    single = tagged.where("n is null").select(*rows.columns, one().alias("occurrence"), one().alias("n"))
    return single.union(counted.where("occurrence = 1")), counted.where("occurrence > 1")


def link_all(calls: DataFrame, results: DataFrame, schemas: DataFrame, stages: Stages | None = None) -> DataFrame:
    """Link calls(conv, call, turn, name, arguments, waits_for) with results(conv, call, turn, content).

    One row per call, and one per result that is not in the record of a call:
    the first call of a (conversation, call id) takes the first result into
    its record, further results and results without a call (``problems`` then
    says so) have rows of their own.  Columns: conv, call, kind (call or
    result), occurrence (number of the call or result within its id, by turn
    and content), turn, level and name (a result has those of its call; the
    name is that of the first), valid, problems, n_results, record (canonical
    JSON; a result's holds no arguments).  Null ids take no part.  Texts that
    are not JSON, unknown tools and cycles are reported, never raised; empty
    tables give an empty table.
    """
    stages = stages or Stages(session(calls), "tool-calls")
    calls = calls.where("conv is not null and call is not null")
    results = results.where("conv is not null and call is not null")
    level = levels(calls.select("conv", "call", F.coalesce("waits_for", F.array().cast("array<string>")).alias("waits_for")), stages)
    first, again = _numbered(calls.select("conv", "call", "turn", "name", "arguments"), ["turn", "name", "arguments"], stages, "calls")
    answer, more = _numbered(results.select("conv", "call", "turn", "content"), ["turn", "content"], stages, "results")
    asked = first.withColumnRenamed("n", "n_calls").drop("occurrence")
    answered = answer.select("conv", "call", F.col("turn").alias("r_turn"), "content", F.col("n").alias("n_results"))
    both = asked.hint("shuffle_hash").join(answered.hint("shuffle_hash"), _KEY, "full").join(level, _KEY, "left")
    no = lambda kind: F.lit(None).cast(kind)
    is_call = F.col("n_calls").isNotNull()
    columns = [*_KEY, "kind", "occurrence", "turn", "level", "name", "arguments", "content", "n_calls", "n_results"]
    rows = both.select(*_KEY, F.when(is_call, "call").otherwise("result").alias("kind"), F.lit(1).cast("long").alias("occurrence"),
                       F.when(is_call, F.col("turn")).otherwise(F.col("r_turn")).alias("turn"), *columns[5:])
    # further rows look up what is known of their id, without texts
    repeated = stages.put("repeated", again.select(*_KEY).union(more.select(*_KEY)).distinct())
    if not repeated.isEmpty():
        known = both.select(*_KEY, "level", F.col("name").alias("first_name"), "n_calls", "n_results")
        known = _looked_up(stages.put("known", known.join(_looked_up(repeated), _KEY, "left_semi")))
        again = again.drop("n").join(known, _KEY).select(*_KEY, F.lit("call").alias("kind"), "occurrence", "turn", "level", "name", "arguments",
                                                         no("string").alias("content"), "n_calls", "n_results")
        more = more.drop("n").join(known, _KEY).select(*_KEY, F.lit("result").alias("kind"), "occurrence", "turn", "level",
                                                       F.col("first_name").alias("name"), no("string").alias("arguments"), "content", "n_calls", "n_results")
        rows = rows.union(again).union(more)
    rows = rows.join(schemas.withColumnRenamed("tool", "name"), "name", "left")  # a row per tool that the caller listed
    args = F.try_parse_json("arguments")
    rows = rows.withColumn("args", args)
    rows = rows.withColumn("fields", F.expr("case when schema_of_variant(args) like 'OBJECT%' then try_cast(args as map<string, variant>) end"))
    none = F.array().cast("array<string>")
    wrong = F.concat(problems(), F.when(F.col("n_calls") > 1, F.array(F.lit("repeated id"))).otherwise(none),
                     F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none))
    rows = rows.withColumn("problems", F.when(F.col("n_calls").isNull(), F.array(F.lit("result without call")))
                           .when(F.col("kind") == "result", none).otherwise(wrong))
    given = F.coalesce("args", F.to_variant_object(F.struct(F.col("arguments").alias("raw"))))
    record = F.to_json(F.struct(F.when(F.col("kind") == "call", given).alias("arguments"),
                                F.col("call").alias("id"), "name", F.col("content").alias("result")))
    return rows.select("conv", "call", "kind", "occurrence", "turn", "level", "name", (F.size("problems") == 0).alias("valid"),
                       F.array_join("problems", "; ").alias("problems"),
                       F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), record.alias("record"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, stages: Stages | None = None) -> DataFrame:
    """A summary of ``link_all``: one row per (conversation, call id), its first call, or its first result if none calls it."""
    return link_all(calls, results, schemas, stages).where("occurrence = 1").drop("kind", "occurrence")


TOOLS = {
    "search": {"required": ["limit", "text"], "additionalProperties": False, "properties": {
        "limit": {"type": "integer", "minimum": 1, "maximum": 400}, "text": {"type": "string"}}},
    "summarise": {"required": ["limit", "text"], "properties": {"limit": {"type": "integer"}, "text": {"type": "string"}}},
    "translate": {"required": ["lang", "text"], "properties": {"lang": {"type": "string"}, "text": {"type": "string"}}},
}


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read chat turns as tool use: (calls, results).

    A user turn calls the tool that its conversation's number picks, with its
    text and length as arguments, and waits for the user turn two before; an
    assistant turn is the result of the turn before it.
    """
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.pmod("conv", F.lit(len(TOOLS))) + 1).cast("int"))
    call = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    calls = rows.where("role = 'user'").select(
        "conv", call(F.col("turn")).alias("call"), "turn", name.alias("name"),
        F.to_json(F.struct("text", F.char_length("text").alias("limit"))).alias("arguments"),
        F.array(call(F.col("turn") - 2)).alias("waits_for"))
    results = rows.where("role = 'assistant'").select("conv", call(F.col("turn") - 1).alias("call"), "turn", F.col("text").alias("content"))
    return calls, results
