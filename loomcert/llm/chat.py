"""Chat formatting with tool calls, in DataFrame functions only: link, order, validate, serialise.

Calls and results are hash-joined by conversation and identifier. A call may come after others: their edges are ordered topologically by
levels, chains by doubling pointers; a result comes right after its call. Arguments are validated against a schema for each tool, and
every message is serialised as canonical JSON: keys in order, no blanks, equal numbers alike, absent fields left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import discard, stored

#: A tool's arguments: name, type (string, integer, number, boolean, array, object), required, least length or value.
Schema = dict[str, list[tuple[str, str, bool, int | None]]]
_VARIANT = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE|DECIMAL|BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}

ANSWER: Schema = {"answer": [("prompt", "string", True, 1), ("turn", "integer", True, 0)]}


def errors(name: Column, arguments: Column, schemas: Schema) -> Column:
    """An array of what is wrong with a call's arguments (JSON text): unknown tool, no object, and for each argument missing, type or small."""
    parsed = F.try_parse_json(arguments)
    found = [
        F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.lit("tool: unknown")),
        F.when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.lit("arguments: no object")),
    ]
    for tool, fields in schemas.items():
        for field, kind, needed, least in fields:
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            own = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            missing = own == "VOID"
            wrong = ~missing & ~own.rlike(f"^({_VARIANT[kind]})")
            problem = F.when(wrong, F.lit(f"{field}: type"))
            if needed:
                problem = F.when(missing, F.lit(f"{field}: missing")).otherwise(problem)
            if least is not None:
                size = F.char_length(F.try_variant_get(parsed, f"$.{field}", "string")) if kind == "string" else F.try_variant_get(parsed, f"$.{field}", "double")
                problem = F.coalesce(problem, F.when(~missing & (size < least), F.lit(f"{field}: small")))
            found.append(F.when(name == tool, problem))
    return F.array_compact(F.array(*found))


_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_TOKEN = r'"(?:[^"\\]|\\.)*"|' + _NUMBER + r'|[^"\d-]+'


def canonical_number(token: Column) -> Column:
    """A JSON number as the shortest plain decimal, so that equal numbers are written alike: 1e2, 100.0 and 100 are 100. What neither 38 digits
    nor 20 before and 18 after the point hold exactly is written as a double is."""
    real, whole = token.try_cast("double"), ~token.rlike("[.eE]")
    plain = lambda d: F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$|^-(?=0$|0\.$)", "")
    held = lambda d: d.isNotNull() & (whole | (d.cast("double") == real))
    mixed, long = token.try_cast("decimal(38,18)"), token.try_cast("decimal(38,0)")
    return F.when(held(mixed), plain(mixed)).when(held(long), plain(long)).when(F.abs(real) < F.lit(float("inf")), real.cast("string")).otherwise(token)


def canonical(json: Column) -> Column:
    """JSON text with its keys in order, without blanks, and with canonical numbers; null where it doesn't parse."""
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(json)), F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^{_NUMBER}$"), canonical_number(t)).otherwise(t)), "")


def _resolved(now: DataFrame) -> DataFrame:
    """Follows pointers (conv_id, call_id, to, level, stop) by doubling until none is left, but those within cycles.

    `to` is the next call or null; level counts the steps taken; stop is where they end: a call with several predecessors, or null.
    """
    now = stored(now, "levels")
    n, done = now.count(), 1
    while done <= 2 * n and now.where("to is not null").limit(1).count():
        ahead = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("further"), F.col("level").alias("more"), F.col("stop").alias("end"))
        step = now.join(ahead.hint("shuffle_hash"), ["conv_id", "to"], "left")
        now, old = stored(step.select("conv_id", "call_id", F.col("further").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.coalesce("stop", "end").alias("stop")), "levels"), now
        discard(old)
        done *= 2
    return now


def levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, after) with level: 0 without `after` or where no such call is there, else one more than the highest of those it comes after; null for what is in a cycle or comes after one.

    A call that stands in several rows comes after all that they name. Chains of calls with one predecessor each are followed by doubling,
    so n of them take about log2(n) rounds; calls with several predecessors are settled in rounds of their own, one for each such call
    on a path.
    """
    keys = ["conv_id", "call_id"]
    known = calls.select(*keys).distinct()
    edges = calls.where("after is not null").select(*keys, "after").distinct().join(known.select("conv_id", F.col("call_id").alias("after")).hint("shuffle_hash"), ["conv_id", "after"], "left_semi")
    edges = stored(edges.select(*keys, "after"), "edges")
    own = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("after").alias("after"))
    several = F.col("n") > 1
    start = known.join(own.hint("shuffle_hash"), keys, "left").select(
        *keys, F.when(F.col("n") == 1, F.col("after")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("level"), F.when(several, F.col("call_id")).alias("stop")
    )
    now = _resolved(start)
    found = now.where("to is null")
    if not found.where("stop = call_id").limit(1).count():
        return now.select(*keys, F.when(F.col("to").isNull() & F.col("stop").isNull(), F.col("level")).alias("level"))

    joints = found.where("stop = call_id").select(*keys)
    before = edges.join(joints, keys, "left_semi").join(now.select("conv_id", F.col("call_id").alias("after"), "to", "level", "stop"), ["conv_id", "after"])
    waits = stored(before.select(*keys, (F.col("level") + 1).alias("level"), "stop", F.col("to").isNotNull().alias("cyclic")), "waits")
    settled = stored(joints.limit(0).withColumn("level", F.lit(0).cast("long")), "settled")
    count = -1
    while count != (count := settled.count()):
        at = settled.select("conv_id", F.col("call_id").alias("stop"), F.col("level").alias("base"))
        each = waits.join(at.hint("shuffle_hash"), ["conv_id", "stop"], "left").withColumn("open", F.col("cyclic") | (F.col("stop").isNotNull() & F.col("base").isNull()))
        ready = each.groupBy(*keys).agg(F.max(F.col("level") + F.coalesce("base", F.lit(0))).alias("level"), F.max("open").alias("open")).where("not open").select(*keys, "level")
        settled, old = stored(ready, "settled"), settled
        discard(old)
    at = settled.select("conv_id", F.col("call_id").alias("stop"), F.col("level").alias("base"))
    whole = now.join(at.hint("shuffle_hash"), ["conv_id", "stop"], "left")
    known_end = F.col("to").isNull() & (F.col("stop").isNull() | F.col("base").isNotNull())
    return whole.select(*keys, F.when(known_end, F.col("level") + F.coalesce("base", F.lit(0))).alias("level"))


def format_chat(calls: DataFrame, results: DataFrame, others: DataFrame, schemas: Schema) -> DataFrame:
    """A row for each row of calls (conv_id, turn, role, call_id, name, arguments, after), results (conv_id, turn, role, call_id, content) and others (conv_id, turn, role, content).

    conv_id, turn, role, type, call_id, level, linked, errors (joined by "; ", null unless a call), json. Levels order a conversation: others
    stand at -1, a call at twice its level among the calls, its result one after, what has none (a result without its call, a call in a cycle
    or without an id, all of a null conv_id) at null. linked tells whether a call has a result, or a result its call; null ids are linked with
    nothing. An id that is used again is one call with several rows, which comes after all that any of them names; each result of it is
    linked. Null fields are left out of json. Only the named columns are read. Empty tables give an empty result.
    """
    level = levels(calls.where("call_id is not null"))
    answered = results.where("call_id is not null and conv_id is not null").select("conv_id", "call_id", F.lit(True).alias("linked")).distinct()
    keys = ["conv_id", "call_id"]
    wrong = errors(F.col("name"), F.col("arguments"), schemas)

    def text(name: str) -> Column:
        """A string in JSON, null where it is null: what stands in {"v":...}, cut by place, whatever characters it has."""
        whole = F.to_json(F.struct(F.col(name).cast("string").alias("v")))
        return F.when(F.col(name).isNotNull(), F.substring(whole, F.lit(6), F.char_length(whole) - 6))

    def field(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}":'), value)

    def json(*fields: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))

    columns = ["conv_id", "turn", "role", "type", "call_id", "level", "linked", "errors", "json"]
    sent = calls.join(level.hint("shuffle_hash"), keys, "left").join(answered.hint("shuffle_hash"), keys, "left").withColumns(
        {"type": F.lit("call"), "level": (F.col("level") * 2).cast("long"), "linked": F.coalesce("linked", F.lit(False)), "wrong": wrong, "canonical": canonical(F.col("arguments"))}
    )
    sent = sent.withColumns({
        "errors": F.concat_ws("; ", "wrong"),
        "json": json(field("arguments", F.coalesce("canonical", text("arguments"))), field("call_id", text("call_id")), field("name", text("name")), field("role", text("role")), F.lit('"type":"call"'), F.concat(F.lit('"valid":'), (F.size("wrong") == 0).cast("string"))),
    })
    got = results.join(level.withColumn("there", F.lit(True)).hint("shuffle_hash"), keys, "left").withColumns({
        "type": F.lit("result"), "level": (F.col("level") * 2 + 1).cast("long"), "linked": F.coalesce("there", F.lit(False)), "errors": F.lit(None).cast("string"),
        "json": json(field("call_id", text("call_id")), field("content", text("content")), field("role", text("role")), F.lit('"type":"result"')),
    })
    rest = others.withColumns({
        "type": F.lit("message"), "call_id": F.lit(None).cast("string"), "level": F.lit(-1).cast("long"), "linked": F.lit(False), "errors": F.lit(None).cast("string"),
        "json": json(field("content", text("content")), field("role", text("role")), F.lit('"type":"message"')),
    })
    return sent.select(columns).unionByName(got.select(columns)).unionByName(rest.select(columns))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and others of plain conversations (conv_id, turn, role, text).

    A user's turn is a call of `answer` with the text and turn as arguments, after the user's turn before; an assistant's turn is the result of
    the user's turn last before it, or of none; all else is neither. Turns of one number go in the order of role and text, null first. A user's
    turn without a number or conversation has no id.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = F.when(F.col("role") == "user", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    before = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumns({"own": own, "before": before})
    user, assistant = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = c.where(user).select("conv_id", "turn", "role", F.col("own").alias("call_id"), F.lit("answer").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.when(F.col("before") != F.col("own"), F.col("before")).alias("after"))
    results = c.where(assistant).select("conv_id", "turn", "role", F.col("before").alias("call_id"), F.col("text").alias("content"))
    return calls, results, c.where(~user & ~assistant).select("conv_id", "turn", "role", F.col("text").alias("content"))
