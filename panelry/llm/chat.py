"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls meet results in a hash join on the identifier.  Where every call comes after what it
depends on, the turns are the order already; other conversations are peeled in rounds of joins
until nothing is left to release, so calls on a cycle are told apart.  Arguments are checked
against the tool's schema and written as canonical JSON (sorted keys, no spaces).  All of it is
built-in expressions and joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelry.llm.common import written

#: JSON types and the variant types that stand for them.
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def calls_in(messages: DataFrame) -> DataFrame:
    """Calls of messages whose text is ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``."""
    shape = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
    found = messages.where("role = 'assistant'").select(
        "conv_id", "turn", F.explode(F.from_json("text", shape)["tool_calls"]).alias("c"))
    return found.select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after")


def results_in(messages: DataFrame) -> DataFrame:
    """Results of messages of role ``tool``: ``{"tool_call_id", "content"}``."""
    told = messages.where("role = 'tool'").withColumn("r", F.from_json("text", "struct<tool_call_id:string,content:string>"))
    return told.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))


def rounds(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``round``: when a call may run, -1 on or behind a cycle.

    Dependencies on unknown calls do not hold a call back.  Where all dependencies were made in
    earlier turns every call is in round 0 and the turns order them; otherwise calls of round r
    depend on rounds below r only.
    """
    own = calls.select("conv_id", "call_id", "turn")
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("needs"))
    made = own.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("made"))
    edges = edges.join(made, ["conv_id", "needs"])
    late = edges.where("made >= turn").select("conv_id").distinct()
    waiting = written(own.join(late, "conv_id", "left_semi").select("conv_id", "call_id"), "waiting")
    held = written(edges.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "needs"), "held")
    out, number = None, 0
    while not waiting.isEmpty():
        blocked = held.select("conv_id", "call_id").distinct()
        step = written(waiting.join(blocked.withColumn("blocked", F.lit(True)), ["conv_id", "call_id"], "left"), "round")
        free = step.where("blocked IS NULL").select("conv_id", "call_id")
        waiting = step.where("blocked").select("conv_id", "call_id")
        stuck = free.isEmpty()
        now = (waiting if stuck else free).withColumn("round", F.lit(-1 if stuck else number))
        out = now if out is None else out.unionByName(now)
        if stuck:
            break
        gone = free.select("conv_id", F.col("call_id").alias("needs"))
        held = written(held.join(gone, ["conv_id", "needs"], "left_anti").select("conv_id", "call_id", "needs"), "held")
        number += 1
    ordered = own.select("conv_id", "call_id")
    if out is None:
        return ordered.withColumn("round", F.lit(0))
    return ordered.join(out, ["conv_id", "call_id"], "left").withColumn("round", F.coalesce("round", F.lit(0)))


def errors_of(name: Column, given: Column, schemas: Mapping[str, Mapping[str, str]]) -> Column:
    """Messages for what is wrong with the arguments of a call, sorted.

    A schema maps fields to types; a type that ends in ``?`` is optional.  Fields it does not
    name are errors too.
    """
    fields = F.from_json(F.to_json(given), "map<string,string>")

    def fault(field, kind):
        value = F.try_variant_get(given, f"$.{field}", "variant")
        there = F.array_contains(F.map_keys(fields), field)
        seen = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        wrong = ~F.coalesce(seen.isin(*KINDS[kind.rstrip("?")]), F.lit(False))
        missing = F.lit(None) if kind.endswith("?") else F.lit(f"{field}: missing")
        return F.when(~there, missing).when(wrong, F.lit(f"{field}: not {kind.rstrip('?')}"))

    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, schema in schemas.items():
        known = F.array(*map(F.lit, schema)) if schema else F.array().cast("array<string>")
        extra = F.transform(F.array_except(F.map_keys(fields), known), lambda k: F.concat(k, F.lit(": not expected")))
        faults = F.array(*(fault(f, k) for f, k in schema.items())) if schema else F.array().cast("array<string>")
        out = F.when(name == tool, F.array_sort(F.array_compact(F.concat(faults, extra)))).otherwise(out)
    broken = given.isNull() | ~F.coalesce(F.schema_of_variant(given).startswith("OBJECT"), F.lit(False))
    return F.when(broken, F.array(F.lit("arguments are not an object"))).otherwise(out)


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """A row per call: ``conv_id``, ``round``, ``turn``, ``call_id``, ``valid``, ``errors``, ``message``.

    ``message`` is the call and its result as canonical JSON; sorted by conversation, round, turn
    and call the rows are a topological order.  Of several results of a call the earliest turn
    counts (ties to the smaller content), a call without one has ``"result":null``.  A call whose
    conversation or identifier is null, or that repeats an identifier of its conversation in a
    later turn, is left out; results without a call are left out.  Further columns are ignored,
    empty tables give an empty result.
    """
    keys = ["conv_id", "call_id"]
    first = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*keys).agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select(*keys, "c.*")
    told = results.groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r")).select(*keys, F.col("r.content").alias("result"))
    given = F.try_parse_json("arguments")
    linked = first.join(told, keys, "left").join(rounds(first), keys).withColumn("given", given)
    errors = errors_of(F.col("name"), F.col("given"), schemas)
    message = F.to_json(F.struct(
        F.col("given").alias("arguments"), "call_id", "name", "result"), {"ignoreNullFields": "false"})
    return linked.select("conv_id", "round", "turn", "call_id", errors.alias("errors"), message.alias("message")) \
        .withColumn("valid", F.size("errors") == 0)


#: Schema of the calls that ``turns_as_calls`` makes.
REPLY = {"reply": {"text": "string", "n_chars": "integer", "system": "string?"}}


def in_force(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``system_turn``, ``system``: the last system turn at or before each user turn.

    Only keys meet in the window over a conversation, the texts are joined after it.  Of several
    system turns of one number the smallest text counts; without a text or a number none is in force.
    """
    system = messages.where("role = 'system' AND conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    users = messages.where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL")
    marks = users.select("conv_id", "turn", F.lit(None).cast("long").alias("since")).unionByName(
        system.select("conv_id", "turn", F.col("turn").cast("long").alias("since")))
    under = marks.withColumn("system_turn", F.max("since").over(Window.partitionBy("conv_id").orderBy("turn"))) \
        .where("since IS NULL AND system_turn IS NOT NULL").select("conv_id", "turn", "system_turn").distinct()
    texts = system.groupBy("conv_id", F.col("turn").cast("long").alias("system_turn")).agg(F.min("text").alias("system"))
    return under.join(texts, ["conv_id", "system_turn"])


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls: a user turn calls for a reply, which the next turn of the assistant gives.

    A call depends on the call two turns before it, if that was one; the system turn in force is
    an argument of it.
    """
    key = F.concat_ws(":", "conv_id", "turn")
    told = messages.where("role = 'user'").join(in_force(messages), ["conv_id", "turn"], "left")
    asks = told.select(
        "conv_id", "turn", key.alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("text", F.length("text").alias("n_chars"), "system")).alias("arguments"),
        F.array(F.concat_ws(":", F.col("conv_id"), F.col("turn") - 2)).alias("after"))
    gives = messages.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("call_id"),
        F.col("text").alias("content"))
    return asks, gives


def own_row(turn: DataFrame, message: Column, errors: Column) -> DataFrame:
    """Rows of what no linked call holds: ``call_id`` is null, the round 0."""
    return turn.select(
        "conv_id", F.lit(0).alias("round"), "turn", F.lit(None).cast("string").alias("call_id"),
        F.array_compact(F.array(errors.cast("string"))).alias("errors"), message.alias("message")) \
        .withColumn("valid", F.size("errors") == 0)


def repeated_calls(calls: DataFrame) -> DataFrame:
    """Calls that ``link`` leaves out, in rows of their own that say why."""
    order = Window.partitionBy("conv_id", "call_id").orderBy("turn", "name", "arguments", "after")
    keyless = calls.where("conv_id IS NULL OR call_id IS NULL").withColumn("n", F.lit(0))
    later = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").withColumn("n", F.row_number().over(order)).where("n > 1")
    message = F.to_json(F.struct(
        F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.struct(F.col("arguments").alias("text")))).alias("arguments"),
        "call_id", "name"), {"ignoreNullFields": "false"})
    why = F.when(F.col("n") > 1, "repeats a call").when(F.col("conv_id").isNull(), "no conversation").otherwise("no identifier")
    return own_row(keyless.unionByName(later), message, why)


def lone_turns(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Turns that no call holds, in rows of their own: ``message`` is ``{"content", "role"}``.

    These are system turns in force for no user turn, assistant turns that answer none and make
    no call, results without a call or after the first, and turns of other roles.
    """
    made = F.from_json("text", "struct<tool_calls:array<struct<id:string>>>")["tool_calls"]
    told = F.from_json("text", "struct<tool_call_id:string,content:string>")
    role = F.coalesce("role", F.lit(""))
    # kind tells which calls can hold the turn; the order is that of link
    turns = messages.where((role != "user") & ~((role == "assistant") & F.coalesce(F.size(made) > 0, F.lit(False)))).select(
        "conv_id", "turn", "role", "text", F.when(role == "system", "system").otherwise("result").alias("kind"),
        F.when(role == "tool", told["tool_call_id"])
        .when((role == "assistant") & F.col("turn").isNotNull(), F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1))
        .when((role == "system") & F.col("text").isNotNull(), F.col("turn").cast("string")).alias("key"),
        F.when(role == "tool", told["content"]).otherwise(F.col("text")).alias("content"))
    # an assistant's call may have a result of the same key, and it counts when it is earlier
    rivals = messages.where((role == "assistant") & (F.size(made) > 0)).select(
        "conv_id", "turn", F.lit(None).cast("string").alias("role"), "text", F.lit("result").alias("kind"),
        F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("key"), F.col("text").alias("content"))
    held = calls.select("conv_id", F.lit("result").alias("kind"), F.col("call_id").alias("key")).unionByName(
        in_force(messages).select("conv_id", F.lit("system").alias("kind"), F.col("system_turn").cast("string").alias("key"))) \
        .where("conv_id IS NOT NULL AND key IS NOT NULL").distinct().withColumn("held", F.lit(True))
    keyed = "conv_id IS NOT NULL AND key IS NOT NULL"
    order = Window.partitionBy("conv_id", "kind", "key").orderBy("turn", "content")
    ranked = turns.where(keyed).withColumn("real", F.lit(True)).unionByName(rivals.where(keyed).withColumn("real", F.lit(False))) \
        .withColumn("n", F.row_number().over(order)).where("real").drop("real")
    lone = ranked.join(held, ["conv_id", "kind", "key"], "left").where("held IS NULL OR n > 1") \
        .select("conv_id", "turn", "role", "text", "n").unionByName(
            turns.where(f"NOT ({keyed})").select("conv_id", "turn", "role", "text", F.lit(1).alias("n")))
    why = F.when(F.col("role") == "tool", F.when(F.col("n") > 1, "repeats a result").otherwise("result without a call")) \
        .when(~F.coalesce(F.col("role").isin("system", "assistant"), F.lit(False)),
              F.concat(F.lit("unknown role "), F.coalesce("role", F.lit("null"))))
    return own_row(lone, F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}), why)


def format_turns(messages: DataFrame) -> DataFrame:
    """``link`` over the calls and results that JSON messages hold and those plain turns stand for.

    Every turn is found in the output: as a call, its result or its system argument, or else in a
    row of its own (``repeated_calls``, ``lone_turns``) with a null ``call_id``.  Calls that JSON
    messages hold keep their arguments as given, the system turn is not added to them.
    """
    asks, gives = turns_as_calls(messages)
    calls = asks.unionByName(calls_in(messages))
    linked = link(calls, gives.unionByName(results_in(messages)), REPLY)
    return linked.unionByName(repeated_calls(calls)).unionByName(lone_turns(messages, calls))
