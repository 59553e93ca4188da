"""Tool-call linking for chat data: join, order, validate, serialise. DataFrame and SQL operations only.

Every call and every result is kept. Repeats of an identifier are numbered by position within their conversation, calls
and results apart, and the n-th call goes with the n-th result; what is left over has a row of its own. A call may name
the call whose result it builds on (`after`); calls are ordered topologically by their depth in that forest, found by
pointer doubling, in rounds that grow with the logarithm of the longest chain. `seq` numbers a conversation's calls in
that order (depth, position, call_id). Numbers come from ranges of rows and prefix sums (`shared.ranked`), so neither a
conversation nor an identifier is gathered in one task. Arguments are parsed to variants, checked against the tool's
schema and written as canonical JSON: sorted keys, no white space, and numbers by value: what is written with a fraction
or an exponent is a double, and if whole and below 1e15 an integer, so `1e2`, `100.0` and `100` are one.

Defined results of `link`: status `linked`, `no_result`, `no_call` (a result whose call is unknown), `invalid` (`errors`
says how: `not_an_object` for what is no JSON object, `duplicate_key` for an object that repeats a key at any depth, else
what breaks the schema), `cyclic` (dependencies that never end; level and seq are null). A dependency on an unknown call
is reported as `unresolved` in errors and counts as none; one on a repeated identifier means its latest call at an
earlier position, else its first. n_calls and n_results count an identifier's calls and results in all. A call or result
without a conversation or an identifier is a row of its own, without level and seq. Calls of one position are ordered
by their other columns; equal rows each get a number. A null name is an unknown tool, null arguments are no object, and a null
text or result leaves its field out. Very long arguments are handled whole (variants hold up to 128 MB). Columns beyond
the named ones are not read, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ranked, remove_table, table, written

#: For each tool its arguments: name to (variant type's prefix, required).
SCHEMAS = {
    "lookup": {"limit": ("BIGINT", True), "text": ("STRING", True)},
    "search": {"limit": ("BIGINT", False), "strict": ("BOOLEAN", False), "text": ("STRING", True)},
}
KEY = ["conv_id", "call_id"]


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, after) to depth, null in and behind cycles; `after` must be known calls or null."""
    now = written(calls.select(*KEY, F.col("after").alias("up"), F.when(F.col("after").isNull(), 0).otherwise(1).cast("bigint").alias("level")), "levels")
    n, most = now.count(), 1
    while most <= 2 * n + 2:
        if now.where("up is not null").isEmpty():
            return now.select(*KEY, "level")
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        step = now.join(above, ["conv_id", "up"], "left")
        later = written(step.select(*KEY, F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        remove_table(now)
        now, most = later, 2 * most
    return now.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _outside(raw: Column) -> Column:
    """The pieces of JSON text between double quotes: at even places what is outside strings. Valid JSON has no \\x01 and \\x02."""
    return F.split(F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02")), '"', -1)


def _number(token: Column) -> Column:
    v = token.try_cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).when(v.isNotNull() & (F.abs(v) < float("inf")), v.cast("string")).otherwise(token)


def parsed(raw: Column) -> Column:
    """The text as a variant, numbers by value; null if it is no JSON or repeats a key."""
    number = lambda t: F.when(t.rlike("^-?[0-9]") & t.rlike("[.eE]"), _number(t)).otherwise(t)
    plain = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit("(-?[0-9][-+0-9.eE]*|[^-0-9]+|-)")), number), "")
    pieces = F.transform(_outside(raw), lambda p, k: F.when(k % 2 == 0, plain(p)).otherwise(p))
    rebuilt = F.replace(F.replace(F.array_join(pieces, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(F.try_parse_json(raw).isNotNull(), F.try_parse_json(F.when(raw.rlike("[0-9][.eE]"), rebuilt).otherwise(raw)))


def _no_object(raw: Column) -> Column:
    """Why text that is no variant isn't one: what Spark's lenient reader takes, without its other quotes, repeats a key."""
    odd = F.exists(F.transform(_outside(raw), lambda p, k: F.when(k % 2 == 0, p).otherwise("")), lambda p: F.contains(p, F.lit("'")))
    return F.when(raw.rlike(r"^\s*\{") & F.get_json_object(raw, "$").isNotNull() & ~odd, "duplicate_key").otherwise("not_an_object")


def violations(name: Column, raw: Column, value: Column, schemas: dict = SCHEMAS) -> Column:
    """What of the arguments breaks the tool's schema: an array of codes, in order."""
    cases = F.when(F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT") == F.lit(False), F.array(F.lit("not_an_object")))
    for tool, wanted in sorted(schemas.items()):
        found = [F.transform(F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, sorted(wanted))))), lambda k: F.concat(F.lit("unknown:"), k))]
        for arg, (kind, required) in sorted(wanted.items()):
            own = F.schema_of_variant(F.try_variant_get(value, f"$.{arg}", "variant"))
            wrong = F.when(own.isNull(), F.lit(f"missing:{arg}") if required else F.lit(None).cast("string")).when(~own.startswith(kind), F.lit(f"type:{arg}"))
            found.append(F.array(wrong))
        cases = cases.when(name == tool, F.array_compact(F.concat(*found)))
    return cases.otherwise(F.array(F.lit("unknown_tool")))


def numbered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, nth, n_calls, n_results, c, r): the n-th call of an identifier beside its n-th result, by position.

    Rows without a conversation or an identifier are rows of their own, without nth.
    """
    c, r = F.struct("position", "name", "arguments", "after"), F.struct("position", "content")
    both = calls.select(*KEY, c.alias("c")).unionByName(results.select(*KEY, r.alias("r")), allowMissingColumns=True)
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    own = both.where(whole).withColumn("side", F.col("c").isNull())
    each = written(ranked(own, [*KEY, "side"], ["c", "r"], "nth"), "numbered")
    paired = each.groupBy(*KEY, "nth").agg(F.first("c", True).alias("c"), F.first("r", True).alias("r"))
    totals = each.groupBy(*KEY).agg(F.count("c").alias("n_calls"), F.count("r").alias("n_results"))
    alone = both.where(~whole).select(*KEY, F.lit(None).cast("bigint").alias("nth"), F.col("c").isNotNull().cast("bigint").alias("n_calls"), F.col("r").isNotNull().cast("bigint").alias("n_results"), "c", "r")
    return written(paired.join(totals, KEY).unionByName(alone), "calls")


def resolved(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, after, position, unresolved) of (conv_id, call_id, nth, position, after), call_id and after now with nth."""
    call = F.struct("call_id", "nth")
    own = calls.select("conv_id", F.col("call_id").alias("id"), "position", F.lit(1).alias("kind"), "nth")
    wish = calls.where("after is not null").select("conv_id", F.col("after").alias("id"), "position", F.lit(0).alias("kind"), call.alias("call"))
    same = Window.partitionBy("conv_id", "id")
    before = F.last("nth", True).over(same.orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = own.unionByName(wish, allowMissingColumns=True).select("conv_id", "id", "call", "position", before.alias("before"), F.min("nth").over(same).alias("least")).where("call is not null")
    to = F.coalesce("before", "least")
    found = found.select("conv_id", F.col("call").alias("call_id"), "position", F.when(to.isNotNull(), F.struct(F.col("id").alias("call_id"), to.alias("nth"))).alias("after"), to.isNull().alias("unresolved"))
    return calls.where("after is null").select("conv_id", call.alias("call_id"), "position").unionByName(found, allowMissingColumns=True)


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls: conv_id, call_id, position, name, arguments (JSON text), after. results: conv_id, call_id, position, content."""
    both = numbered(calls, results)
    after = resolved(both.where("c is not null and nth is not null").select(*KEY, "nth", "c.position", "c.after"))
    depth = after.select(*KEY, "position", "unresolved").join(levels(after), KEY).select("conv_id", "call_id.call_id", "call_id.nth", "level", "position", "unresolved")
    ordered = ranked(depth.where("level is not null"), ["conv_id"], ["level", "position", "call_id", "nth"], "seq")
    placed = ordered.unionByName(depth.where("level is null").withColumn("seq", F.lit(None).cast("bigint"))).drop("position")
    both = both.join(placed, [*KEY, "nth"], "left")
    both = both.select("*", *(F.col(f"c.{x}").alias(x) for x in ("name", "arguments")), F.coalesce("c.position", "r.position").alias("position"))
    found = F.coalesce(violations(F.col("name"), F.col("arguments"), F.col("v"), schemas), F.array(F.lit("not_an_object")))
    found = F.when(F.col("v").isNull(), F.array(F.coalesce(_no_object(F.col("arguments")), F.lit("not_an_object")))).otherwise(found)
    open_end = F.when(F.col("unresolved"), F.array(F.lit("unresolved"))).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("v", parsed(F.col("arguments"))).withColumn("errors", F.when(F.col("c").isNotNull(), F.concat(found, open_end)))
    status = F.when(F.col("c").isNull(), "no_call").when(F.size(F.array_remove("errors", "unresolved")) > 0, "invalid").when(F.col("nth").isNotNull() & F.col("level").isNull(), "cyclic").when(F.col("r").isNull(), "no_result").otherwise("linked")
    message = F.to_json(F.struct(F.col("v").alias("arguments"), "call_id", "conv_id", "name", F.col("r.content").alias("result")))
    return both.select(*KEY, "name", "level", "seq", "position", "n_calls", "n_results", status.alias("status"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), message.alias("message"))


def exchanges(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of plain conversations stand for.

    Each assistant turn calls a tool with its whole text, building on the call two turns before; the user turn behind
    it is the result. Some arguments are deliberately broken, as real models' are: by conversation number, the limit is
    text (7), left out (11), an argument is unknown (13), or the JSON is cut short (17) or repeats a key (19); some
    limits are written with a fraction (5).
    """
    c, t = F.col("conv_id"), F.col("turn").cast("bigint")
    name = lambda k: F.concat(F.lit("c"), c.cast("string"), F.lit("-"), k.cast("string"))
    plain = F.to_json(F.struct("text", t.alias("limit")))
    arguments = F.when(c % 17 == 0, F.lit('{"text": "cut')).when(c % 13 == 0, F.to_json(F.struct("text", t.alias("limit"), F.lit(1).alias("extra")))).when(c % 11 == 0, F.to_json(F.struct("text"))).when(c % 7 == 0, F.to_json(F.struct("text", t.cast("string").alias("limit")))).when(c % 19 == 0, F.concat(F.lit('{"limit":1,'), F.substring(plain, 2, F.length(plain)))).when(c % 5 == 0, F.concat(F.lit('{"limit":'), t.cast("string"), F.lit(".0,"), F.substring(F.to_json(F.struct("text")), 2, F.length(plain)))).otherwise(plain)
    calls = turns.where("role = 'assistant'").select(c, name(t).alias("call_id"), t.alias("position"), F.when(c % 2 == 0, "search").otherwise("lookup").alias("name"), arguments.alias("arguments"), F.when(t >= 3, name(t - 2)).alias("after"))
    results = turns.where("role = 'user' and turn > 0").select(c, name(t - 1).alias("call_id"), t.alias("position"), F.col("text").alias("content"))
    return calls, results


def op10_tool_calls(spark, sf_dir: str) -> DataFrame:
    got = link(*exchanges(table(spark, sf_dir, "conversations")))
    return got.withColumn("errors", F.array_join("errors", ","))


QUERIES = {"op10_tool_calls": op10_tool_calls}
ORACLE_SQL = {
    "op10_tool_calls": r"""
with calls as (
  select conv_id, turn::bigint as position, 'c' || conv_id || '-' || turn as call_id, text, case when conv_id % 2 = 0 then 'search' else 'lookup' end as name,
    case when turn >= 3 then 'c' || conv_id || '-' || (turn - 2) end as after,
    case when conv_id % 17 = 0 then 17 when conv_id % 13 = 0 then 13 when conv_id % 11 = 0 then 11 when conv_id % 7 = 0 then 7 when conv_id % 19 = 0 then 19 else 0 end as kind
  from conversations where role = 'assistant'
), c as (
  select conv_id, call_id, count(*) as n_calls, min(position) as position, any_value(name) as name, any_value(after) as after, any_value(kind) as kind, min(text) as text from calls group by all
  having true
), r as (
  select conv_id, 'c' || conv_id || '-' || (turn - 1) as call_id, count(*) as n_results, min(turn)::bigint as position, min(text) as content
  from conversations where role = 'user' and turn > 0 group by all having true
), deep as (
  with recursive d(conv_id, call_id, level) as (
    select conv_id, call_id, 0::bigint from c where after is null or not exists (select 1 from c u where u.conv_id = c.conv_id and u.call_id = c.after)
    union all select c.conv_id, c.call_id, d.level + 1 from c join d on c.conv_id = d.conv_id and c.after = d.call_id
  ) select * from d
), e as (
  select conv_id, call_id, c.name, deep.level, coalesce(c.position, r.position) as position, coalesce(n_calls, 0)::bigint as n_calls, coalesce(n_results, 0)::bigint as n_results,
    kind, c.text, content, c.call_id is null as lost,
    c.after is not null and not exists (select 1 from c u where u.conv_id = c.conv_id and u.call_id = c.after) as open
  from c full join r using (conv_id, call_id) left join deep using (conv_id, call_id)
), j as (
  select *, case when lost then '' else concat_ws(',',
    case when kind = 17 then 'not_an_object' when kind = 19 then 'duplicate_key' when kind = 13 then 'unknown:extra' when kind = 11 and name = 'lookup' then 'missing:limit' when kind = 7 then 'type:limit' end,
    case when open then 'unresolved' end) end as errors from e
)
select conv_id, call_id, name, level, case when level is not null then row_number() over (partition by conv_id, level is null order by level, position, call_id) end as seq, position, n_calls, n_results, errors,
  case when lost then 'no_call' when errors not in ('', 'unresolved') then 'invalid' when n_results = 0 then 'no_result' else 'linked' end as status,
  '{' || concat_ws(',',
    case when not lost and kind not in (17, 19) then '"arguments":{' || concat_ws(',', case when kind = 13 then '"extra":1' end,
      case kind when 11 then null when 7 then '"limit":"' || position || '"' else '"limit":' || position end, '"text":' || to_json(text)) || '}' end,
    '"call_id":"' || call_id || '"', '"conv_id":' || conv_id, '"name":"' || name || '"', '"result":' || to_json(content)) || '}' as message
from j""",
}
