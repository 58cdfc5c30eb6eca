"""Tool calls of conversations: linked with their results, checked against schemas, put in order and written as canonical JSON.

All in DataFrame functions. Calls and results are hash-joined by identifier. A call that refers to another one's result (an argument
{"$ref": "<call id>"}) comes after it: chains of references are walked by doubling, and where several meet, calls are placed once all they
refer to is. Arguments are parsed to variants, whose objects hold their keys in order, so that writing them gives one text for one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cyclelens.llm.common import table, written

#: What a schema's types accept, as patterns on the type of the parsed value. An object with $ref stands for any type.
TYPES = {
    "string": "^STRING",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN",
    "array": "^ARRAY",
    "object": "^OBJECT",
    "any": "",
}
REFERENCE = "^OBJECT<`?\\$ref`?: STRING>$"
#: Turns of a conversation that are numbered together.
TOGETHER = 1024


def quoted(text: Column) -> Column:
    """A JSON string, or null."""
    inside = F.to_json(F.array(text))
    return F.coalesce(inside.substr(F.lit(2), F.length(inside) - 2), F.lit("null"))


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that agree in keys, the one that is first by the other columns, counted before it is moved."""
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("row"))
    return least.select(*keys, *[F.col("row")[c].alias(c) for c in order])


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with `arguments` in canonical form, and `errors`, the ways in which they fail their tool's schema, in order.

    `schemas` has a row for each parameter: tool, param, type (a key of TYPES), required. Errors: "not JSON", "not an object", "no such
    tool", "missing:<param>", "type:<param>", "unknown:<param>". What is not JSON is kept as a JSON string; a null counts as {}.
    """
    pattern = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    params = schemas.select("tool", "param", F.coalesce(pattern[F.col("type")], F.lit("")).alias("pattern"), F.coalesce("required", F.lit(False)).alias("required"))
    # The parameters of a tool are a value of its row; a schema lists each once.
    tools = written(params.groupBy(F.col("tool").alias("of_tool")).agg(F.array_sort(F.collect_set(F.struct("param", "pattern", "required"))).alias("params")), "chat-schemas")
    rows = calls.withColumn("value", F.try_parse_json(F.coalesce("arguments", F.lit("{}"))))
    rows = rows.join(tools, rows["tool"] == tools["of_tool"], "left").drop("of_tool")
    rows = rows.withColumn("given", F.try_variant_get("value", "$", "map<string,variant>"))
    names = F.map_keys("given")
    kind = lambda p: F.schema_of_variant(F.element_at("given", p["param"]))
    label = lambda what, xs: F.transform(xs, lambda x: F.concat(F.lit(what), x))
    missing = F.transform(F.filter("params", lambda p: p["required"] & ~F.array_contains(names, p["param"])), lambda p: p["param"])
    mistyped = F.filter("params", lambda p: F.array_contains(names, p["param"]) & ~F.regexp_like(kind(p), p["pattern"]) & ~F.regexp_like(kind(p), F.lit(REFERENCE)))
    unknown = F.array_sort(F.array_except(names, F.transform("params", lambda p: p["param"])))
    errors = (
        F.when(F.col("value").isNull(), F.array(F.lit("not JSON")))
        .when(F.col("given").isNull(), F.array(F.lit("not an object")))
        .when(F.col("params").isNull(), F.array(F.lit("no such tool")))
        .otherwise(F.concat(label("missing:", missing), label("type:", F.transform(mistyped, lambda p: p["param"])), label("unknown:", unknown)))
    )
    written_out = F.coalesce(F.to_json("value"), quoted(F.col("arguments")))
    return rows.withColumn("errors", errors).withColumn("arguments", written_out).drop("value", "given", "params")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level, time) of calls (call_id, turn, arguments): a call's level is 2 more than the highest level it refers to, or 0.

    Its time is its turn, or the latest time that it refers to if that is later. References to calls that do not exist count for nothing;
    calls on a cycle, or behind one, get level -1 and their own turn. Chains of calls with one reference each, which may be as long as a
    conversation, are walked by doubling steps, so their rounds grow with the logarithm of the length. Calls with several references
    are then peeled off once all they refer to is placed, in as many rounds as such calls follow one another.
    """
    refs = F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref":"([^"\\]+)"'), F.lit(1))))
    nodes = calls.select("call_id", "turn")
    edges = calls.select(F.col("call_id").alias("to"), refs.alias("from"))
    edges = written(edges.join(nodes.select(F.col("call_id").alias("from")), "from", "left_semi"), "chat-references")
    counted = written(edges.groupBy("to").agg(F.count("*").alias("n"), F.min("from").alias("from")), "chat-reference-counts")
    placed = nodes.join(counted.select(F.col("to").alias("call_id")), "call_id", "left_anti")
    placed = written(placed.select("call_id", F.lit(0).cast("long").alias("level"), F.col("turn").alias("time")), "chat-level")
    jumps = _jumps(counted.where("n = 1"), nodes)
    several = edges.join(counted.where("n > 1").select("to"), "to", "left_semi")
    # A reference is followed to the end of its chain; an edge is open until the call there is placed.
    ends = jumps.select(F.col("id").alias("from"), F.col("ancestor").alias("end"), "steps", "latest")
    open_edges = several.join(ends, "from", "left").select("to", F.coalesce("end", "from").alias("from"), F.coalesce("steps", F.lit(0)).alias("steps"), "latest")
    open_edges = written(open_edges.withColumn("level", F.lit(None).cast("long")).withColumn("time", F.lit(None).cast("long")), "chat-open")
    ready, done = placed, placed
    while not open_edges.isEmpty() and not ready.isEmpty():
        at = ready.select(F.col("call_id").alias("from"), F.col("level").alias("new_level"), F.col("time").alias("new_time"))
        level = F.coalesce("level", F.col("new_level") + 2 * F.col("steps")).alias("level")
        time = F.coalesce("time", F.greatest("new_time", F.when(F.col("new_time").isNotNull(), F.col("latest")))).alias("time")
        marked = written(open_edges.join(at, "from", "left").select("to", "from", "steps", "latest", level, time), "chat-edges")
        closed = marked.groupBy("to").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max("level").alias("level"), F.max("time").alias("time")).where("open = 0")
        ready = closed.select(F.col("to").alias("call_id"), (F.col("level") + 2).alias("level"), "time").join(nodes, "call_id")
        ready = written(ready.select("call_id", "level", F.greatest("time", "turn").alias("time")), "chat-level")
        open_edges = written(marked.join(ready.select(F.col("call_id").alias("to")), "to", "left_anti"), "chat-open")
        done = done.union(ready)
    done = done.select(F.col("call_id").alias("end"), F.col("level").alias("end_level"), F.col("time").alias("end_time"))
    chained = jumps.join(done, jumps["ancestor"] == done["end"]).select(
        F.col("id").alias("call_id"), (F.col("end_level") + 2 * F.col("steps")).alias("level"), F.greatest("end_time", "latest").alias("time")
    )
    out = written(done.toDF("call_id", "level", "time").union(chained), "chat-levels")
    stuck = nodes.join(out.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(-1).cast("long").alias("level"), F.col("turn").alias("time"))
    return out.union(stuck).withColumn("level", F.col("level").cast("int"))


def _jumps(single: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, ancestor, steps, latest) of calls with one reference (to, from): the first call up the chain that has none or several, the steps
    to it, and the latest turn on the way. Calls that run into a cycle keep an ancestor with one reference."""
    first = single.join(nodes, single["to"] == nodes["call_id"])
    jumps = written(first.select(F.col("to").alias("id"), F.col("from").alias("ancestor"), F.lit(1).cast("long").alias("steps"), F.col("turn").alias("latest")), "chat-jumps")
    for _ in range(jumps.count().bit_length() + 1):
        on = jumps.toDF("on_id", "on_ancestor", "on_steps", "on_latest")
        moved = jumps.join(on, jumps["ancestor"] == on["on_id"], "left")
        if moved.where("on_id is not null").isEmpty():
            break
        jumps = written(
            moved.select(
                "id", F.coalesce("on_ancestor", "ancestor").alias("ancestor"), (F.col("steps") + F.coalesce("on_steps", F.lit(0))).alias("steps"), F.greatest("latest", "on_latest").alias("latest")
            ),
            "chat-jumps",
        )
    return jumps


def formatted(calls: DataFrame, results: DataFrame, schemas: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """One row per call, result and message: conv_id, position, level, kind, call_id, status, errors, json.

    `calls` has conv_id, call_id, turn, tool, arguments (JSON), `results` conv_id, call_id, turn, content; call ids are unique. Of rows that
    repeat an id the first by turn and then by the other columns stands. Rows without an id cannot be linked: calls are `unnamed`
    and results `orphan`, each row by itself. Status of a call: linked, unanswered, cyclic; of a result: linked, orphan. Position counts
    from 0 in a conversation: by time, then level, a result directly behind its call's level; no item comes before what it refers to.
    Null turns count as 0. Empty tables give no rows; other columns are not read. Where `calls` has `content`, what was said with the call, it
    is written with it. `messages` (conv_id, turn, role, content) are neither: each row is a `plain` item of level 0 by itself.
    """
    said = [c for c in calls.columns if c == "content"]
    calls = calls.select(F.col("conv_id").cast("long"), F.col("call_id"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "tool", "arguments", *[F.col(c).alias("said") for c in said])
    results = results.select(F.col("conv_id").cast("long"), F.col("call_id"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "content")
    named = _first(calls.where("call_id is not null"), ["call_id"], ["turn", "conv_id", "tool", "arguments", *["said" for _ in said]])
    answers = _first(results.where("call_id is not null"), ["call_id"], ["turn", "conv_id", "content"])
    valid = written(checked(named, schemas), "chat-calls")
    nameless = checked(calls.where("call_id is null"), schemas)
    placed = valid.join(levels(valid), "call_id")
    # Each id is on either side once, so no key is hot, and the smaller rows are hashed.
    linked = placed.hint("shuffle_hash").join(
        answers.select(F.col("call_id").alias("of_call"), F.col("conv_id").alias("result_conv"), F.col("turn").alias("result_turn"), "content"), F.col("call_id") == F.col("of_call"), "full"
    )
    linked = written(linked, "chat-linked")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    none = F.array().cast("array<string>")

    def call_json(call_id: Column) -> Column:
        content = [',"content":', quoted(F.col("said"))] if said else []
        return text('{"arguments":', F.col("arguments"), ',"call_id":', quoted(call_id), *content, ',"conv_id":', number("conv_id"), ',"role":"assistant","tool":', quoted(F.col("tool")), "}")

    status = F.when(F.col("level") < 0, "cyclic").when(F.col("of_call").isNull(), "unanswered").otherwise("linked")
    made = linked.where("call_id is not null").select(
        "conv_id", "time", "level", F.lit("call").alias("kind"), "call_id", status.alias("status"), "errors", call_json(F.col("call_id")).alias("json")
    )
    made = made.union(
        nameless.select("conv_id", F.col("turn").alias("time"), F.lit(0).alias("level"), F.lit("call").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("unnamed").alias("status"), "errors", call_json(F.lit(None).cast("string")).alias("json"))
    )

    def result_json(call_id: Column, conv: str) -> Column:
        return text('{"call_id":', quoted(call_id), ',"content":', quoted(F.col("content")), ',"conv_id":', number(conv), ',"role":"tool"}')

    orphan = F.col("call_id").isNull()
    made = made.union(
        linked.where("of_call is not null").select(
            F.when(orphan, F.col("result_conv")).otherwise(F.col("conv_id")).alias("conv_id"), F.when(orphan, F.col("result_turn")).otherwise(F.col("time")).alias("time"),
            F.when(orphan, F.lit(0)).when(F.col("level") < 0, F.lit(-1)).otherwise(F.col("level") + 1).alias("level"), F.lit("result").alias("kind"), F.col("of_call").alias("call_id"),
            F.when(orphan, "orphan").otherwise("linked").alias("status"), none.alias("errors"), result_json(F.col("of_call"), "result_conv").alias("json"),
        )
    )
    made = made.union(
        results.where("call_id is null").select("conv_id", F.col("turn").alias("time"), F.lit(0).alias("level"), F.lit("result").alias("kind"), "call_id", F.lit("orphan").alias("status"), none.alias("errors"), result_json(F.col("call_id"), "conv_id").alias("json"))
    )
    if messages is not None:
        turn, own = F.coalesce("turn", F.lit(0)).cast("long").alias("time"), F.col("conv_id").cast("long").alias("conv_id")
        message_json = text('{"content":', quoted(F.col("content")), ',"conv_id":', number("conv_id"), ',"role":', quoted(F.col("role")), "}")
        made = made.union(messages.select(own, turn, F.lit(0).alias("level"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("plain").alias("status"), none.alias("errors"), message_json.alias("json")))
    # Numbered within stretches of turns, behind all that the stretches before them hold: a long conversation is many stretches.
    items = written(made.withColumn("stretch", F.floor(F.col("time") / TOGETHER)), "chat-items")
    counts = items.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    bases = written(counts.select(F.col("conv_id").alias("of_conv"), F.col("stretch").alias("of_stretch"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "chat-bases")
    inside = W.partitionBy("conv_id", "stretch").orderBy("time", "level", "kind", "call_id", "json")
    ranked = items.withColumn("nth", F.row_number().over(inside))
    out = ranked.join(bases, ranked["conv_id"].eqNullSafe(bases["of_conv"]) & (ranked["stretch"] == bases["of_stretch"]))
    return out.select("conv_id", (F.col("base") + F.col("nth") - 1).alias("position"), "level", "kind", "call_id", "status", F.array_join("errors", ",").alias("errors"), "json")


#: The tools that conversations are read as calls of.
SCHEMAS = [
    ("reply", "after", "object", False),
    ("reply", "prompt", "string", True),
    ("reply", "words", "integer", True),
    ("open", "words", "integer", True),
    ("open", "system", "boolean", False),
]


def as_items(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as calls, results and messages, an item for every row: an assistant's turn calls `reply` with the turn before it as its
    prompt, or `open` at the first turn, and refers to the assistant's turn before; its whole text is the call's content. The user's next
    turn is the result. Turns of any other role, or none, are messages. Only rows that are equal in all columns are one. Of several rows with
    a turn and role the first by text is linked; the others, and rows without a conversation or turn, are unnamed calls and orphan results.
    A prompt is the first row of the turn before."""
    rows = written(conversations.select("conv_id", "turn", "role", "text").distinct(), "chat-rows")
    spoken = rows.where("role in ('assistant', 'user')")
    numbered = spoken.where("conv_id is not null and turn is not null")
    named = written(_first(numbered, ["conv_id", "turn", "role"], ["text"]).withColumn("named", F.lit(True)), "chat-named")
    others = spoken.alias("s").join(named.alias("n"), [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in rows.columns], "left_anti")
    spoken = written(named.unionByName(others.withColumn("named", F.lit(False))), "chat-spoken")
    turns = written(_first(rows.where("conv_id is not null and turn is not null"), ["conv_id", "turn"], ["role", "text"]), "chat-turns")
    messages = rows.where("role is null or role not in ('assistant', 'user')").select("conv_id", "turn", "role", F.col("text").alias("content"))
    unnamed = F.when(F.col("named"), F.col("call_id")).alias("call_id")
    calls, results = _calls(spoken, turns, "named"), _results(spoken, "named")
    return calls.withColumn("call_id", unnamed).drop("named"), results.withColumn("call_id", unnamed).drop("named"), messages


def _call_id(turn: Column) -> Column:
    return F.md5(F.concat_ws(":", F.col("conv_id"), turn).cast("binary"))


def _calls(rows: DataFrame, turns: DataFrame, *others: str) -> DataFrame:
    """The assistant's rows as calls; `turns` has one row per turn."""
    spoken = rows.where("role = 'assistant'")
    linked = spoken.where("named") if "named" in others else spoken
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.when(F.col("role") != "system", F.col("text")).alias("prompt"), F.lit(True).alias("any"))
    earlier = linked.select("conv_id", (F.col("turn") + 2).alias("turn"), _call_id(F.col("turn")).alias("earlier"))
    said = spoken.join(before, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left")
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), " "))
    arguments = F.to_json(
        F.struct(words.alias("words"), F.col("prompt"), F.when(F.col("earlier").isNotNull(), F.struct(F.col("earlier").alias("$ref"))).alias("after"))
    )
    tool = F.when(F.col("any"), "reply").otherwise("open").alias("tool")
    return said.select("conv_id", _call_id(F.col("turn")).alias("call_id"), "turn", tool, arguments.alias("arguments"), F.col("text").alias("content"), *others)


def _results(rows: DataFrame, *others: str) -> DataFrame:
    """The user's rows as results of the turn before."""
    return rows.where("role = 'user'").select("conv_id", _call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"), *others)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, messages = as_items(table(spark, sf_dir, "conversations"))
    return formatted(calls, results, spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean"), messages)


OP1_SQL = """
WITH n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text NULLS FIRST) AS k, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS f
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), r AS (
  SELECT *, CASE WHEN k = 1 AND conv_id IS NOT NULL AND turn IS NOT NULL THEN md5(conv_id || ':' || (turn - CASE WHEN role = 'user' THEN 1 ELSE 0 END)) END AS call_id FROM n
), a AS (
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn & 1 ORDER BY turn) AS run FROM r WHERE role = 'assistant' AND call_id IS NOT NULL
), placed AS (
  SELECT conv_id, turn, call_id, 2 * (row_number() OVER (PARTITION BY conv_id, turn & 1, run ORDER BY turn) - 1) AS level FROM a
), c AS (
  SELECT s.conv_id, s.turn, s.text, s.call_id, coalesce(p.level, 0) AS level, b.turn IS NOT NULL AS replies, CASE WHEN b.role <> 'system' THEN b.text END AS prompt,
         e.call_id AS earlier, len(string_split(trim(coalesce(s.text, ''), ' '), ' ')) AS words
  FROM r s LEFT JOIN placed p ON p.call_id = s.call_id LEFT JOIN n b ON b.conv_id = s.conv_id AND b.turn = s.turn - 1 AND b.f = 1
           LEFT JOIN placed e ON e.conv_id = s.conv_id AND e.turn = s.turn - 2
  WHERE s.role = 'assistant'
), items AS (
  SELECT c.conv_id, coalesce(c.turn, 0) AS time, c.level, 'call' AS kind, c.call_id,
         CASE WHEN c.call_id IS NULL THEN 'unnamed' WHEN u.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
         concat_ws(',', CASE WHEN replies AND prompt IS NULL THEN 'missing:prompt' END, CASE WHEN NOT replies AND earlier IS NOT NULL THEN 'unknown:after' END) AS errors,
         '{"arguments":{' || concat_ws(',', '"after":{"$ref":"' || earlier || '"}', '"prompt":' || CAST(to_json(prompt) AS VARCHAR), '"words":' || words)
           || '},"call_id":' || coalesce('"' || c.call_id || '"', 'null') || ',"content":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null')
           || ',"conv_id":' || coalesce(CAST(c.conv_id AS VARCHAR), 'null') || ',"role":"assistant","tool":"' || CASE WHEN replies THEN 'reply' ELSE 'open' END || '"}' AS json
  FROM c LEFT JOIN r u ON u.call_id = c.call_id AND u.role = 'user'
  UNION ALL
  SELECT u.conv_id, coalesce(p.turn, u.turn, 0), coalesce(p.level + 1, 0), 'result', u.call_id, CASE WHEN p.call_id IS NULL THEN 'orphan' ELSE 'linked' END, '',
         '{"call_id":' || coalesce('"' || u.call_id || '"', 'null') || ',"content":' || coalesce(CAST(to_json(u.text) AS VARCHAR), 'null')
           || ',"conv_id":' || coalesce(CAST(u.conv_id AS VARCHAR), 'null') || ',"role":"tool"}'
  FROM r u LEFT JOIN placed p ON p.call_id = u.call_id WHERE u.role = 'user'
  UNION ALL
  SELECT conv_id, coalesce(turn, 0), 0, 'message', NULL, 'plain', '', '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null')
           || ',"conv_id":' || coalesce(CAST(conv_id AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
  FROM n WHERE role IS NULL OR role NOT IN ('assistant', 'user')
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY time, level, kind, call_id NULLS FIRST, json) - 1 AS position, CAST(level AS INTEGER) AS level, kind, call_id,
       status, errors, json
FROM items
"""
