"""Operator 6, chat formatting by quotation linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from regionspark.llm.common import dropped, load, written

#: Messages of a thread that are formatted into one row; a longer thread has several.
PART = 256
#: Turns whose messages are numbered together, so that a very long conversation is spread over tasks.
STRETCH = 1024
_SMALL = "abcdefghijklmnopqrstuvwxyz"
_MARK = r"^[ \t]*(?:>[ \t]?)+"


def _lines(text: Column) -> Column:
    """Lines as structs: level (number of leading '>'), body."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 0), "[^>]", ""))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARK, "").alias("body")))


def _normal(body: Column) -> Column:
    """What is hashed: lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(body), r"[\x20\x09-\x0D]+", " "))


def quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, origin): per message and quote level the earlier message that most of its quoted words
    come from (ties: the later message), so a short line that many messages have is outvoted by longer ones.

    A passage is a quoted line; its normalised text is hashed and joined to the first message of the conversation
    that has it outside quotes. Counting is combined before each shuffle, so a line that a conversation repeats very
    often is one row of the join. Blank lines link nothing.
    """
    rows = messages.select("conv_id", "turn", F.explode(_lines(F.col("text"))).alias("l")).select("conv_id", "turn", "l.level", _normal(F.col("l.body")).alias("body")).where("body <> ''")
    n = F.length("body") - F.length(F.replace("body", F.lit(" "))) + 1
    rows = rows.select("conv_id", "turn", "level", F.xxhash64("body").alias("h1"), F.hash("body").alias("h2"), n.alias("n"))
    first = rows.where("level = 0").groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("origin"))
    quoted = rows.where("level > 0").groupBy("conv_id", "turn", "level", "h1", "h2").agg(F.sum("n").alias("n"))
    votes = quoted.join(first, ["conv_id", "h1", "h2"]).where("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))
    return votes.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("n", "origin")).alias("m")).select("conv_id", "turn", "level", F.col("m.origin").alias("origin"))


def conversations(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotes and in reply order: conv_id, thread (turn of the first
    message of the reply tree), turn, role, parent (turn it replies to; null for a first message), n_quoted (quoted
    lines taken out), text (the rest, outer blank lines trimmed), formatted (role header and text).

    A message replies to the origin of its outermost linked quote. Sorting by (conv_id, thread, turn) lists each tree
    after its first message, every reply after what it answers. Trees are followed by pointer jumping, each round
    written to the shared folder, so a long chain takes few rounds and a large conversation is spread over tasks.
    Null text is empty, a null role is 'user'; rows without conv_id or turn keep their text and link nothing; rows
    that repeat a (conv_id, turn) share its links; an empty table gives no rows; other columns are ignored.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    links = quotations(messages.where("conv_id is not null and turn is not null"))
    up = written(links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "origin")).alias("m")).select("conv_id", "turn", F.col("m.origin").alias("parent")))
    top = up.withColumnRenamed("parent", "thread")
    while True:  # thread points at an ancestor; each round doubles the reach
        above = top.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("higher"))
        joined = top.join(above, (top.conv_id == F.col("c")) & (top.thread == F.col("t")), "left")
        new = written(joined.select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"), F.col("higher").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        if hasattr(top, "_scratch"):
            dropped(top)
        scratch, top = new._scratch, new.drop("moved")
        top._scratch = scratch
        if not moved:
            break
    linked = up.join(top, ["conv_id", "turn"])
    lines = F.col("_lines")
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    rows = messages.withColumn("_lines", _lines(F.col("text"))).join(linked, ["conv_id", "turn"], "left")
    role = F.coalesce("role", F.lit("user"))
    rows = rows.select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", role.alias("role"), "parent", F.size(F.filter(lines, lambda x: x["level"] > 0)).cast("long").alias("n_quoted"), F.regexp_replace(own, r"^(?:[\x20\x09-\x0D]*\n)+|[\x20\x09-\x0D]+$", "").alias("text"))
    return rows.withColumn("formatted", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def threads(messages: DataFrame) -> DataFrame:
    """The conversations of conversations() in reply order, without quotes: conv_id, thread, part (from 0; a thread of
    more than PART messages has several), n_messages, n_quoted, turns and parents (arrays in reply order, -1 for the
    parent of a first message and for a turn that is null), formatted. Messages are numbered in two levels, counts of
    stretches of turns and then inside a stretch, so no task holds a whole conversation. Nulls and repeated rows as in
    conversations(); rows that repeat a (conv_id, turn) follow each other by role and text."""
    rows = conversations(messages).withColumn("stretch", F.floor(F.coalesce("turn", F.lit(0)) / STRETCH))
    keys = ["conv_id", "thread", "stretch"]
    rows = written(rows)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("k"))
    counts = counts.withColumn("ahead", F.coalesce(F.sum("k").over(W.partitionBy("conv_id", "thread").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in keys], "ahead")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    inside = F.row_number().over(W.partitionBy(*keys).orderBy("turn", "role", "text")) - 1
    placed = rows.withColumn("spot", inside).join(counts, same[0] & same[1] & same[2]).withColumn("spot", F.col("spot") + F.col("ahead"))
    message = F.struct("spot", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("parent", F.lit(-1)).alias("parent"), "formatted")
    grouped = placed.groupBy("conv_id", "thread", F.floor(F.col("spot") / PART).alias("part")).agg(F.count("*").alias("n_messages"), F.sum("n_quoted").alias("n_quoted"), F.array_sort(F.collect_list(message)).alias("m"))
    return grouped.select("conv_id", "thread", "part", "n_messages", "n_quoted", F.col("m.turn").alias("turns"), F.col("m.parent").alias("parents"), F.array_join("m.formatted", "").alias("formatted"))


def quoted_surrogate(messages: DataFrame) -> DataFrame:
    """Messages whose texts quote as mail and forum posts do, made from a table without quotes. Every turn but the first
    and each fourth one after the third begins with the first half of the lines of the turn before, marked '> ', with
    spaces doubled in even turns and ASCII letters in upper case where the turn divides by 5; turns 2, 6, ... put the first line of the
    turn before that above it, marked '>> '. conv_id and turn must be a key."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    before = messages.select(F.col("conv_id").alias("c1"), (F.col("turn") + 1).alias("t1"), lines.alias("one"))
    earlier = messages.select(F.col("conv_id").alias("c2"), (F.col("turn") + 2).alias("t2"), F.get(lines, F.lit(0)).alias("two"))
    rows = messages.join(before, (F.col("conv_id") == F.col("c1")) & (F.col("turn") == F.col("t1")), "left").join(earlier, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
    half = F.slice("one", F.lit(1), F.ceil(F.size("one") / 2).cast("int"))
    edited = lambda x: F.when(F.col("turn") % 5 == 0, F.translate(x, _SMALL, _SMALL.upper())).when(F.col("turn") % 2 == 0, F.replace(x, F.lit(" "), F.lit("  "))).otherwise(x)
    quote = F.array_join(F.transform(half, lambda x: F.concat(F.lit("> "), edited(x))), "\n")
    nested = F.when((F.col("turn") % 4 == 2) & F.col("two").isNotNull(), F.concat(F.lit(">> "), "two", F.lit("\n"))).otherwise("")
    quotes = F.col("one").isNotNull() & (F.col("turn") % 4 != 3)
    return rows.select("conv_id", "turn", "role", F.when(quotes, F.concat(nested, quote, F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(quoted_surrogate(load(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, role, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
c AS (SELECT a.conv_id, a.turn, a.role, CASE WHEN b.conv_id IS NULL OR a.turn % 4 = 3 THEN a.text ELSE
        CASE WHEN a.turn % 4 = 2 AND d.conv_id IS NOT NULL THEN '>> ' || d.ls[1] || chr(10) ELSE '' END
        || array_to_string(list_transform(b.ls[1:ceil(len(b.ls) / 2)::BIGINT], lambda x: '> ' || CASE WHEN a.turn % 5 = 0 THEN translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN a.turn % 2 = 0 THEN replace(x, ' ', '  ') ELSE x END), chr(10))
        || chr(10) || coalesce(a.text, '') END AS text
      FROM c0 a LEFT JOIN c0 b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn LEFT JOIN c0 d ON d.conv_id = a.conv_id AND d.turn + 2 = a.turn),
m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM c),
l AS (SELECT conv_id, turn, role, generate_subscripts(ls, 1) AS i, unnest(ls) AS s FROM m),
q AS (SELECT *, length(regexp_replace(regexp_extract(s, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level, regexp_replace(s, '^[ \t]*(?:>[ \t]?)+', '') AS body FROM l),
n AS (SELECT *, trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM q),
f AS (SELECT conv_id, norm, min(turn) AS origin FROM n WHERE level = 0 AND norm <> '' GROUP BY conv_id, norm),
v AS (SELECT n.conv_id, n.turn, n.level, f.origin, sum(length(n.norm) - length(replace(n.norm, ' ', '')) + 1) AS c FROM n JOIN f ON f.conv_id = n.conv_id AND f.norm = n.norm WHERE n.level > 0 AND f.origin < n.turn GROUP BY ALL),
b AS (SELECT conv_id, turn, level, origin FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY c DESC, origin DESC) = 1),
p AS (SELECT conv_id, turn, origin AS parent FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level) = 1),
r(conv_id, turn, up) AS (SELECT conv_id, turn, parent FROM p UNION SELECT r.conv_id, r.turn, p.parent FROM r JOIN p ON p.conv_id = r.conv_id AND p.turn = r.up),
t AS (SELECT conv_id, turn, min(up) AS thread FROM r GROUP BY conv_id, turn),
x AS (SELECT conv_id, turn, any_value(role) AS role, count(*) FILTER (level > 0)::BIGINT AS n_quoted,
             regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), '^(?:[\x20\x09-\x0D]*\n)+|[\x20\x09-\x0D]+$', '', 'g') AS text FROM n GROUP BY conv_id, turn),
y AS (SELECT x.conv_id, coalesce(t.thread, x.turn) AS thread, x.turn, coalesce(p.parent, -1) AS parent, x.n_quoted, '<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10) AS formatted
      FROM x LEFT JOIN p USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)),
z AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) - 1) // 256 AS part FROM y)
SELECT conv_id, thread, part::BIGINT AS part, count(*)::BIGINT AS n_messages, sum(n_quoted)::BIGINT AS n_quoted, list(turn ORDER BY turn) AS turns, list(parent ORDER BY turn) AS parents, string_agg(formatted, '' ORDER BY turn) AS formatted
FROM z GROUP BY conv_id, thread, part
"""
