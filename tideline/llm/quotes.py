"""Quotation linking: replies joined to the messages they quote.

Lines are parsed into quote levels by their leading ``>``.  Neighbouring lines
of one level make a passage.  Quoted passages are normalised and hashed whole,
by paragraph, by line and by pair of lines, and joined to the hashes of what
messages say themselves, so that a passage that was cut or trimmed is still
found.  Each part is owed to the latest earlier message that said it, and the
message that most of a passage is owed to is its source.  A message replies to the latest message
before it in its conversation that said what it quotes at the lowest level.
Conversations come back without quotes, each message with its parent, the
first message of its thread, and its position in reply order, in which every
message is followed by the replies to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .winnowing import let

QUOTE = r"^(?:[ \t]*>)+[ \t]?"


def level(line: Column) -> Column:
    """How many ``>`` begin the line, with blanks between them."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[^>]", ""))


def normalised(text: Column) -> Column:
    """ASCII letters small, every run of white space one space, none at the ends."""
    small = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(small, r"[\x20\x09-\x0D]+", " "), r"^ | $", "")


def passages_of(text: Column) -> Column:
    """Passages of a text in order, ``array<struct<at, level, body>>``: neighbouring lines of one level from line ``at`` on, joined by newlines.

    Every line is looked at once and copied once.
    """

    def cut(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))

        def passage(starts: Column, start: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
            body = F.array_join(F.transform(F.slice(lines, start + 1, stop - start), lambda x: x["body"]), "\n")
            return F.struct(start.alias("at"), F.get(lines, start)["level"].alias("level"), body.alias("body"))

        return let(starts, lambda s: F.transform(s, lambda start, k: passage(s, start, k)))

    parsed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.struct(level(line).alias("level"), F.regexp_replace(line, QUOTE, "").alias("body")))
    return let(parsed, cut)


def _hash(norm: str) -> Column:
    return F.md5(F.col(norm).cast("binary"))


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, at, level, body, hash`` of every passage with a word; ``hash`` is that of the normalised body."""
    out = messages.select("conv_id", "turn", F.explode(passages_of(F.col("text"))).alias("p")).select("conv_id", "turn", "p.*", normalised(F.col("p.body")).alias("norm"))
    return out.where("norm <> ''").select("conv_id", "turn", "at", "level", "body", _hash("norm").alias("hash")).dropDuplicates(["conv_id", "turn", "at", "level", "hash"])


def units(found: DataFrame) -> DataFrame:
    """``unit`` (a hash) and ``size`` of each passage whole, of its paragraphs, its lines and its pairs of neighbouring lines, beside what tells the passage."""

    def lines_and_pairs(lines: Column) -> Column:
        pairs = F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda x, i: F.concat(x, F.lit("\n"), F.get(lines, i + 1)))
        return F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), lines, pairs)

    part = F.explode(F.array_distinct(let(F.split("body", "\n"), lines_and_pairs)))
    split = found.select("conv_id", "turn", "at", "level", "hash", part.alias("part")).withColumn("norm", normalised(F.col("part")))
    return split.where("norm <> ''").select("conv_id", "turn", "at", "level", "hash", _hash("norm").alias("unit"), F.length("norm").alias("size")).distinct()


def link_quotes(messages: DataFrame) -> DataFrame:
    """Conversations without quotes, in order of reply.

    ``messages`` has ``conv_id``, ``turn``, ``role`` and ``text``; other
    columns play no part.  Returns ``conv_id``, ``turn``, ``role``, ``body``
    (the text without quoted lines), ``n_quoted`` (quoted passages), ``n_linked``
    (of them those found in an earlier message of the conversation),
    ``parent_turn``, ``thread_turn`` (the message the thread began with),
    ``position`` (from 0, in the conversation: threads by their first turn, in
    them every message before the replies to it, replies by turn) and
    ``origin_conv``/``origin_turn`` (the first message anywhere, by
    ``conv_id`` and ``turn``, that says the most of what the message quotes
    first).

    A null text is an empty one; rows without ``conv_id`` or ``turn`` have no
    neighbours and come back with themselves as thread and without position.
    Repeated turns are one message for linking, which says and quotes what any
    of their texts does, and come back each, at one position.  A quote of
    itself or of a later message is no link.  An empty table gives an empty
    result.
    """
    placed = messages.where("conv_id is not null and turn is not null")
    found = written(passages(placed))
    quoted = units(found.where("level > 0"))
    hashes = quoted.select("unit").distinct()
    # only what somebody quotes is carried on; it is read twice, so kept
    said = written(units(found.where("level = 0")).select("conv_id", "turn", "unit").join(hashes, "unit", "left_semi").distinct())
    # the latest earlier message that said it: sums by (conversation, hash, quoting turn), never pairs of a common passage
    asked = quoted.select("conv_id", "unit", F.col("turn").alias("when")).distinct().withColumn("asks", F.lit(1))
    told = said.select("conv_id", "unit", F.col("turn").alias("when")).withColumn("asks", F.lit(0))
    timeline = told.join(asked.select("conv_id", "unit").distinct(), ["conv_id", "unit"], "left_semi").unionByName(asked)
    earlier = Window.partitionBy("conv_id", "unit").orderBy("when", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    answered = (
        timeline.withColumn("source", F.max(F.when(F.col("asks") == 0, F.col("when"))).over(earlier)).where("asks = 1").select("conv_id", "unit", F.col("when").alias("turn"), "source")
    )
    first = said.groupBy("unit").agg(F.min(F.struct("conv_id", "turn")).alias("origin"))
    passage = ["conv_id", "turn", "at", "level", "hash"]
    by_source = (
        quoted.join(answered, ["conv_id", "unit", "turn"], "left")
        .join(first, "unit", "left")
        .groupBy(*passage, "source")
        .agg(F.sum("size").alias("said"), F.min(F.when(F.col("origin").isNotNull(), F.struct((-F.col("size")).alias("minus"), "origin"))).alias("from"))
    )
    by_passage = by_source.groupBy(*passage).agg(F.max(F.when(F.col("source").isNotNull(), F.struct("said", "source"))).alias("best"), F.min("from").alias("from"))
    by_message = (
        by_passage.groupBy("conv_id", "turn")
        .agg(
            F.count("*").alias("n_quoted"),
            F.count("best").alias("n_linked"),
            F.min(F.when(F.col("best").isNotNull(), F.struct("level", (-F.col("best.source")).alias("minus")))).alias("lowest"),
            F.min(F.when(F.col("from").isNotNull(), F.struct("at", "hash", F.col("from.origin").alias("origin")))).alias("from"),
        )
        .select("conv_id", "turn", "n_quoted", "n_linked", (-F.col("lowest.minus")).alias("parent_turn"), F.col("from.origin").alias("origin"))
    )
    by_message = written(placed.select("conv_id", "turn").distinct().join(by_message, ["conv_id", "turn"], "left"))
    roots = _roots(by_message.where("parent_turn is not null").select("conv_id", "turn", "parent_turn"))
    positions = reply_order(by_message.select("conv_id", "turn", "parent_turn"))
    kept = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: level(line) == 0), "\n")
    body = messages.select("conv_id", "turn", "role", F.regexp_replace(kept, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("body"))
    some = body.where("conv_id is not null and turn is not null")
    for table in (by_message, roots, positions):
        some = some.join(table, ["conv_id", "turn"], "left")
    rest = body.where("conv_id is null or turn is null")
    columns = ["conv_id", "turn", "role", "body", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn"]
    done = some.select(*columns, F.coalesce("thread_turn", "turn").alias("thread_turn"), "position", F.col("origin.conv_id").alias("origin_conv"), F.col("origin.turn").alias("origin_turn"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    alone = rest.select(
        "conv_id", "turn", "role", "body", zero.alias("n_quoted"), zero.alias("n_linked"), null.alias("parent_turn"), F.col("turn").alias("thread_turn"), null.alias("position"), null.alias("origin_conv"), null.alias("origin_turn")
    )
    return done.unionByName(alone)


def _roots(parents: DataFrame) -> DataFrame:
    """The first message of each reply's thread, by doubling the reach of its parent link until none reaches further."""
    reach = written(parents.select("conv_id", "turn", F.col("parent_turn").alias("thread_turn")))
    while True:
        onward = reach.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("further"))
        both = reach.join(onward, ["conv_id", "thread_turn"], "left")
        if both.where("further is not null").isEmpty():
            return reach
        reach = written(both.select("conv_id", "turn", F.coalesce("further", "thread_turn").alias("thread_turn")))


def reply_order(nodes: DataFrame) -> DataFrame:
    """``conv_id, turn, position`` of messages with a ``parent_turn`` or none: every message before the replies to it.

    Each message is entered and left on a tour of its conversation's replies;
    how many are entered from a step on is summed by doubling its reach, so
    that no conversation and no chain of replies is gathered.
    """
    siblings = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    linked = nodes.withColumn("sibling", F.lead("turn").over(siblings))
    child = nodes.where("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    linked = linked.join(child, ["conv_id", "turn"], "left")
    step = lambda turn, leaving: F.struct(F.col(turn).alias("turn"), F.lit(leaving).alias("leaving"))
    enter = F.when(F.col("child").isNotNull(), step("child", False)).otherwise(step("turn", True))
    leave = F.when(F.col("sibling").isNotNull(), step("sibling", False)).when(F.col("parent_turn").isNotNull(), step("parent_turn", True))
    tour = written(
        linked.select("conv_id", step("turn", False).alias("at"), enter.alias("to"), F.lit(1).cast("long").alias("entered")).unionByName(
            linked.select("conv_id", step("turn", True).alias("at"), leave.alias("to"), F.lit(0).cast("long").alias("entered"))
        )
    )
    while not tour.where("to is not null").isEmpty():
        onward = tour.select("conv_id", F.col("at").alias("to"), F.col("to").alias("further"), F.col("entered").alias("more"))
        tour = written(tour.join(onward, ["conv_id", "to"], "left").select("conv_id", "at", F.col("further").alias("to"), (F.col("entered") + F.coalesce("more", F.lit(0))).alias("entered")))
    size = nodes.groupBy("conv_id").agg(F.count("*").alias("n"))
    return tour.where("not at.leaving").join(size, "conv_id").select("conv_id", F.col("at.turn").alias("turn"), (F.col("n") - F.col("entered")).alias("position"))


_NORM = "trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')"
_MARK = r"^(?:[ \t]*>)+[ \t]?"


def oracle_sql(table: str) -> str:
    """The rows of :func:`link_quotes` over a table of messages, for DuckDB."""
    return f"""
with recursive parsed as materialized (
  select conv_id, turn, text, pos, length(regexp_replace(regexp_extract(line, '{_MARK}'), '[^>]', '', 'g')) as level, regexp_replace(line, '{_MARK}', '') as body
  from (select conv_id, turn, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos
        from (select distinct conv_id, turn, text from {table} where conv_id is not null and turn is not null))
), islands as (
  select *, pos - row_number() over (partition by conv_id, turn, text, level order by pos) as island from parsed
), found as materialized (
  select distinct conv_id, turn, level, first_at, body, md5({_NORM.format(x="body")}) as hash from (
    select conv_id, turn, level, min(pos) as first_at, string_agg(body, chr(10) order by pos) as body from islands group by conv_id, turn, text, level, island)
  where {_NORM.format(x="body")} <> ''
), units as materialized (
  select distinct conv_id, turn, first_at, level, hash, md5({_NORM.format(x="part")}) as unit, length({_NORM.format(x="part")}) as size from (
    select conv_id, turn, first_at, level, hash, body as part from found
    union all select conv_id, turn, first_at, level, hash, unnest(regexp_split_to_array(body, '\\n[ \\t]*\\n')) from found
    union all select conv_id, turn, first_at, level, hash, unnest(string_split(body, chr(10))) from found
    union all select conv_id, turn, first_at, level, hash, unnest(list_transform(range(1, len(string_split(body, chr(10)))), lambda i: string_split(body, chr(10))[i] || chr(10) || string_split(body, chr(10))[i + 1])) from found)
  where {_NORM.format(x="part")} <> ''
), said as materialized (
  select distinct conv_id, turn, unit from units where level = 0
), quoted as (
  select q.*, (select max(s.turn) from said s where s.conv_id = q.conv_id and s.unit = q.unit and s.turn < q.turn) as source from units q where level > 0
), origins as (
  select unit, min((conv_id, turn)) as origin from said group by unit
), sources as (
  select conv_id, turn, first_at, level, hash, source, sum(size) as said from quoted where source is not null group by all
), passages as materialized (
  select q.conv_id, q.turn, q.first_at, q.level, q.hash,
    (select s.source from sources s where (s.conv_id, s.turn, s.first_at, s.level, s.hash) = (q.conv_id, q.turn, q.first_at, q.level, q.hash) order by s.said desc, s.source desc limit 1) as source,
    arg_min(o.origin, (-q.size, o.origin)) filter (o.origin is not null) as origin
  from quoted q left join origins o using (unit) group by q.conv_id, q.turn, q.first_at, q.level, q.hash
), messages as materialized (
  select conv_id, turn, count(*) as n_quoted, count(source) as n_linked, arg_min(source, (level, -source)) filter (source is not null) as parent_turn, arg_min(origin, (first_at, hash)) filter (origin is not null) as origin
  from passages group by conv_id, turn
), tree as (
  select n.conv_id, n.turn, m.parent_turn from (select distinct conv_id, turn from {table} where conv_id is not null and turn is not null) n left join messages m on m.conv_id = n.conv_id and m.turn = n.turn
), paths as (
  select conv_id, turn, [turn] as path from tree where parent_turn is null
  union all select t.conv_id, t.turn, list_append(p.path, t.turn) from paths p join tree t on t.conv_id = p.conv_id and t.parent_turn = p.turn
), ordered as (
  select conv_id, turn, path[1] as thread_turn, row_number() over (partition by conv_id order by path) - 1 as position from paths
)
select c.conv_id, c.turn, c.role,
  regexp_replace(array_to_string(list_filter(string_split(coalesce(c.text, ''), chr(10)), lambda x: not regexp_matches(x, '{_MARK}')), chr(10)), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as body,
  coalesce(m.n_quoted, 0) as n_quoted, coalesce(m.n_linked, 0) as n_linked, m.parent_turn, coalesce(t.thread_turn, c.turn) as thread_turn, t.position, m.origin[1] as origin_conv, m.origin[2] as origin_turn
from {table} c left join messages m on m.conv_id = c.conv_id and m.turn = c.turn
left join ordered t on t.conv_id = c.conv_id and t.turn = c.turn
"""


ORACLE_SQL = oracle_sql("conversations")

#: Messages of which every third quotes the message before it, cut by a line, and that one's predecessor, for DuckDB.
REPLIES_SQL = """(
  select conv_id, turn, role, case when turn % 3 = 2 and before is not null then
    coalesce('> > ' || string_split(earlier, chr(10))[1] || chr(10), '') || '> ' || array_to_string(string_split(before, chr(10))[1:3], chr(10) || '> ') || chr(10) || text else text end as text
  from (select *, lag(text, 1) over w as before, lag(text, 2) over w as earlier from conversations window w as (partition by conv_id order by turn)))"""


def with_replies(messages: DataFrame) -> DataFrame:
    """``messages`` in which every third turn quotes the first lines of the message before it, and the first line of the one before that."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = messages.withColumns({"before": F.lag("text", 1).over(w), "earlier": F.lag("text", 2).over(w)})
    far = F.coalesce(F.concat(F.lit("> > "), F.get(F.split("earlier", "\n"), F.lit(0)), F.lit("\n")), F.lit(""))
    near = F.concat(F.lit("> "), F.array_join(F.slice(F.split("before", "\n"), 1, 3), "\n> "))
    quoting = (F.col("turn") % 3 == 2) & F.col("before").isNotNull()
    return both.select("conv_id", "turn", "role", F.when(quoting, F.concat(far, near, F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"))
