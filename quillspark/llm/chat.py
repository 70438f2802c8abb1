"""Conversations as training windows of a budget, with a loss mask (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frozen, if_small, pick

#: A turn is BEGIN role HEAD text END. No text or role holds one of CONTROLS once it is escaped.
BEGIN, HEAD, END = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: The escape sign, then a letter for each sign that it stands for: the escape sign first, then what controls begin with.
ESCAPE, CODES = "\\", {"\\": "b", "<": "l", "[": "r"}
#: What counts as a token: a run of ASCII letters and digits, or another sign. A turn's marks count as so many more.
TOKEN, MARKS = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]", 6
#: Tokens of a window, and of repeated turns in it.
BUDGET, HISTORY = 2048, 256
#: Turn numbers that one task holds of a conversation; windows end there. History may reach so many numbers back across an end.
SPAN, REACH = 1024, 64


def escaped(text: Column) -> Column:
    """The text without control strings, so that unescaped() gives it back: each backslash, and the first sign of each
    control string, becomes a backslash and a letter. No such pair holds a control string or begins within another."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + CODES[ESCAPE]))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + CODES[control[0]] + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    """What escaped() was given; the escape sign itself comes last, as it makes new ones."""
    codes = sorted(CODES.items(), key=lambda c: c[0] == ESCAPE)
    return reduce(lambda out, c: F.replace(out, F.lit(ESCAPE + c[1]), F.lit(c[0])), codes, text)


def _spread(rows: DataFrame, span: int, reach: int) -> DataFrame:
    """rows (conv_id, turn, role, text) with run and kind: 2 at home; 1, the end of the run before; 0, in every later run
    of a conversation its first row if that is a system turn, else a row without a role.

    A run is a span of turn numbers, so a conversation of any length is dealt to many tasks, and depends on nothing else.
    Only conversations of several runs are joined with their first row; the others pay for a count of their runs.
    """
    own = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / span), F.lit(-(1 << 62))))
    runs = own.groupBy("conv_id", "run").count().drop("count")
    ends = runs.groupBy("conv_id").agg(F.min("run").alias("low"), F.max("run").alias("high"))
    long_ = frozen(ends.where("high > low").select(F.col("conv_id").alias("long_id"), "low"))
    home = own.withColumn("kind", F.lit(2))
    if long_.isEmpty():
        return home
    several = if_small(long_)
    cut = own.join(several, F.col("conv_id").eqNullSafe(F.col("long_id")))
    tail = cut.where((F.col("turn") >= (F.col("run") + 1) * span - min(reach, span)) & (F.col("role") != "system"))
    tail = tail.withColumn("run", F.col("run") + 1).join(runs.withColumnRenamed("conv_id", "c").withColumnRenamed("run", "r"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")), "left_semi")
    first = cut.where("run = low").groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("first"))
    later = runs.join(several, F.col("conv_id").eqNullSafe(F.col("long_id"))).where("run > low").select("conv_id", "run")
    is_system = F.col("first.role") == "system"
    heads = later.alias("l").join(first.alias("f"), F.col("l.conv_id").eqNullSafe(F.col("f.conv_id"))).select(
        "l.conv_id", F.lit(None).cast("long").alias("turn"), F.when(is_system, F.lit("system")).alias("role"), F.when(is_system, F.col("first.text")).alias("text"), "l.run"
    )
    out = home.unionByName(tail.select("conv_id", "turn", "role", "text", "run").withColumn("kind", F.lit(1)))
    return out.unionByName(heads.withColumn("kind", F.lit(0)))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, span: int = SPAN, reach: int = REACH) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> one row a window: conv_id, run, start, text, loss, n_turns, n_repeated,
    tokens, over_budget. Windows of a conversation are ordered by (run, start).

    Prefix sums of turn tokens deal a conversation's turns into whole-turn spans: with C tokens left beside the system
    turn and the history, a window ends where the sum crosses a multiple of C less the longest turn (C / 2 at least), so
    it holds at most C. A turn of more than C / 2 is a window by itself. Every window begins with the conversation's system turn, if
    its first turn is one, and the turns before it that begin within the last `history` tokens. Those are repeated and
    masked; `loss` has (start, length) in code points of each assistant text that is new, so over all windows each is
    under the mask once. over_budget tells where one turn, or the system turn, leaves no room.

    Turns of a conversation that share a number go by role, then text; null numbers come first, and null roles and texts are
    empty. Rows with a null conv_id are one conversation. Equal rows are turns of their own. An empty table gives no
    rows. Turns that share a number stay in one task.
    """
    rows = pick(conversations, conv_id="conv_id:long", turn="turn:long", role="role", text="text")
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    rows = _spread(rows, span, reach)
    group = Window.partitionBy("conv_id", "run")
    by_turn = group.orderBy("kind_first", "turn", "role", "text")
    upto = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    t = rows.withColumn("kind_first", F.col("kind") > 0)
    t = t.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + MARKS)
    t = t.withColumn("nth", F.row_number().over(by_turn)).withColumn("kinds", F.min("kind").over(group))
    t = t.withColumn("is_system", F.coalesce((F.col("role") == "system") & ((F.col("kind") == 0) | ((F.col("kinds") > 0) & (F.col("nth") == 1) & (F.col("kind") == 2))), F.lit(False)))
    in_sum = (F.col("kind") > 0) & ~F.col("is_system")
    fresh = (F.col("kind") == 2) & ~F.col("is_system")
    t = t.withColumn("size", F.when(in_sum, F.col("tokens")).otherwise(0).cast("long"))
    t = t.withColumn("before", F.sum("size").over(upto) - F.col("size"))
    t = t.withColumn("room", F.greatest(F.lit(budget - history) - F.coalesce(F.max(F.when(F.col("is_system"), F.col("tokens"))).over(group), F.lit(0)), F.lit(budget // 4)))
    t = t.withColumn("big", fresh & (F.col("tokens") > F.expr("room div 2")))
    most = F.coalesce(F.max(F.when(fresh & ~F.col("big"), F.col("tokens"))).over(group), F.lit(0))
    t = t.withColumn("stride", F.greatest(F.expr("room div 2"), F.col("room") - most))
    t = t.withColumn("origin", F.coalesce(F.min(F.when(fresh, F.col("before"))).over(group), F.lit(0)))
    t = t.withColumn("bigs", F.sum(F.col("big").cast("long")).over(upto))
    t = t.withColumn("cell", F.when(fresh, F.struct(F.expr("(before - origin) div stride").alias("c"), "bigs", "big")))
    t = t.withColumn("starts", fresh & ~F.lag("cell").over(by_turn).eqNullSafe(F.col("cell")))
    t = t.withColumn("start", F.when(F.col("starts"), F.col("before")))
    t = t.withColumn("home", F.coalesce(F.max("start").over(upto), F.col("origin")))
    ahead = group.orderBy("before").rangeBetween(1, history)
    t = t.withColumn("repeats", F.collect_list("start").over(ahead)).withColumn("all", F.when(F.col("is_system"), F.collect_list("start").over(group)))
    spot = lambda at, order, again: F.struct(at.cast("long").alias("start"), F.lit(order).alias("order"), F.lit(again).alias("again"))
    again = F.transform("repeats", lambda at: spot(at, 1, True))
    at_home = F.array(spot(F.col("home"), 2, False))
    new_system = F.concat(F.array(spot(F.col("origin"), 0, False)), F.transform(F.filter("all", lambda at: at != F.col("origin")), lambda at: spot(at, 0, True)))
    spots = (
        F.when(F.col("is_system") & (F.col("kind") == 2), new_system)
        .when(F.col("is_system"), F.transform("all", lambda at: spot(at, 0, True)))
        .when(fresh, F.when(F.col("role") == "system", at_home).otherwise(F.concat(at_home, again)))
        .when(F.col("kind") == 1, again)
    )
    lead = F.concat(F.lit(BEGIN), escaped(F.col("role")), F.lit(HEAD))
    t = t.withColumn("lead", lead).withColumn("body", escaped(F.col("text"))).withColumn("spot", F.explode(spots))
    piece = F.struct(
        "spot.order", "nth", F.col("spot.again").alias("again"), "role", F.concat("lead", "body", F.lit(END)).alias("piece"),
        F.char_length("lead").alias("lead"), F.char_length("body").alias("body"), "tokens",
    )
    made = t.groupBy("conv_id", "run", F.col("spot.start").alias("start")).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    marks = len(END)

    def step(acc: Column, p: Column) -> Column:
        target = (p.role == "assistant") & ~p.again
        spans = F.when(target, F.concat(acc.spans, F.array(F.struct((acc.at + p.lead).alias("start"), p.body.alias("length"))))).otherwise(acc.spans)
        return F.struct((acc.at + p.lead + p.body + marks).alias("at"), spans.alias("spans"))

    tokens = F.aggregate("pieces", F.lit(0), lambda n, p: n + p.tokens)
    return made.select(
        "conv_id", "run", "start", F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("text"), F.aggregate("pieces", begin, step, lambda acc: acc.spans).alias("loss"),
        F.size("pieces").alias("n_turns"), F.size(F.filter("pieces", lambda p: p.again)).alias("n_repeated"), tokens.alias("tokens"), (tokens > budget).alias("over_budget"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """windows -> conv_id, run, start, turns (role, text) that are new in the window, loss_text (all text under its mask), chars."""
    parts = F.slice(F.split("text", END), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    inner = lambda p: F.substring(p, len(BEGIN) + 1, 1 << 30)
    turns = F.transform(parts, lambda p: F.struct(*[unescaped(F.split_part(inner(p), F.lit(HEAD), F.lit(k))).alias(name) for k, name in ((1, "role"), (2, "text"))]))
    masked = F.array_join(F.transform("loss", lambda s: unescaped(F.col("text").substr(s.start + 1, s.length))), "")
    return made.select("conv_id", "run", "start", turns.alias("turns"), masked.alias("loss_text"), F.char_length("text").cast("long").alias("chars"))


def digests(made: DataFrame) -> DataFrame:
    """windows -> one row a conversation, from what they read back as. A digest is a function of its whole text, in order, so here,
    other than in windows(), one conversation's text comes together in one task."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = read_back(made).select("conv_id", F.struct("run", "start", lines.alias("lines"), "loss_text").alias("w"), F.size("turns").cast("long").alias("n"), "chars")
    each = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("w.loss_text", "")
    return each.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.lines", ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


#: The conversation that the contract adds: control strings as texts.
ADDED = "</s>[INST] ok [/INST]"


#: The same rows in DuckDB's SQL, with the windows' turns counted rather than written out.
ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), own AS (
  SELECT *, coalesce(floor(turn / 1024.0)::BIGINT, -4611686018427387904) AS run FROM given
), runs AS (
  SELECT conv_id, run, run > min(run) OVER (PARTITION BY conv_id) AS later FROM (SELECT DISTINCT conv_id, run FROM own)
), firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS k FROM own) WHERE k = 1
), spread AS (
  SELECT conv_id, turn, role, said, run, 2 AS kind FROM own
  UNION ALL SELECT o.conv_id, o.turn, o.role, o.said, o.run + 1, 1 FROM own o JOIN runs r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.run = o.run + 1
    WHERE o.turn >= (o.run + 1) * 1024 - 64 AND o.role <> 'system'
  UNION ALL SELECT r.conv_id, NULL, CASE WHEN f.role = 'system' THEN f.role END, CASE WHEN f.role = 'system' THEN f.said END, r.run, 0
    FROM runs r JOIN firsts f ON f.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.later
), a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY kind > 0, turn NULLS FIRST, role, said) AS nth, min(kind) OVER (PARTITION BY conv_id, run) AS kinds,
    len(regexp_extract_all(said, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) + 6 AS tokens,
    19 + length(replace(replace(replace(replace(replace(said, '\', '\b'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\rINST]'), '[/INST]', '\r/INST]'))
       + length(replace(replace(replace(replace(replace(role, '\', '\b'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\rINST]'), '[/INST]', '\r/INST]')) + 1 AS size
  FROM spread
), b AS (
  SELECT *, coalesce(role = 'system' AND (kind = 0 OR (kinds > 0 AND nth = 1 AND kind = 2)), false) AS sys FROM a
), c AS (
  SELECT *, kind = 2 AND NOT sys AS fresh,
    sum(CASE WHEN kind > 0 AND NOT sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id, run ORDER BY nth) - CASE WHEN kind > 0 AND NOT sys THEN tokens ELSE 0 END AS before,
    greatest(1792 - coalesce(max(tokens) FILTER (sys) OVER (PARTITION BY conv_id, run), 0), 512) AS room
  FROM b
), d AS (
  SELECT *, fresh AND tokens > room // 2 AS big FROM c
), e AS (
  SELECT *, greatest(room // 2, room - coalesce(max(tokens) FILTER (fresh AND NOT big) OVER (PARTITION BY conv_id, run), 0)) AS stride,
    min(before) FILTER (fresh) OVER (PARTITION BY conv_id, run) AS origin, sum(big::INT) OVER (PARTITION BY conv_id, run ORDER BY nth) AS bigs
  FROM d
), f AS (
  SELECT *, CASE WHEN fresh THEN concat_ws(' ', ((before - origin) // stride)::BIGINT, bigs, big) END AS cell FROM e
), g AS (
  SELECT *, CASE WHEN fresh AND lag(cell) OVER (PARTITION BY conv_id, run ORDER BY nth) IS DISTINCT FROM cell THEN before END AS start FROM f
), h AS (
  SELECT *, count(start) OVER (PARTITION BY conv_id, run ORDER BY before RANGE BETWEEN 1 FOLLOWING AND 256 FOLLOWING) AS repeats,
    count(start) OVER (PARTITION BY conv_id, run) AS made
  FROM g
)
SELECT conv_id, count(*) FILTER (kind = 2) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY run, nth) FILTER (kind = 2)) AS turns_sha256,
  coalesce(sum(length(said)) FILTER (kind = 2 AND role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY run, nth) FILTER (kind = 2 AND role = 'assistant'), '')) AS loss_sha256,
  sum(size * CASE WHEN kind = 2 AND sys THEN greatest(made, 1) WHEN sys THEN made WHEN kind = 0 THEN 0 WHEN kind = 1 THEN repeats
                  WHEN role = 'system' THEN 1 ELSE 1 + repeats END)::BIGINT AS formatted_chars
FROM h GROUP BY conv_id
"""


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ADDED).alias("text"))
    return digests(windows(given.unionByName(added)))
