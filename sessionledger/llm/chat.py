"""Chat formatting by a grammar round trip, as column expressions.

A rendered conversation is a row of turns::

    conversation = turn*
    turn         = "### " role ": " body "</turn>\\n"

``role`` is URL-encoded, so it holds no blank, colon, line end or mark. In a body
``</turn>`` and a ``### `` that opens a line are control strings. They are
escaped by one more backslash behind their first character: ``</turn>`` becomes
``<\\/turn>``, that becomes ``<\\\\/turn>``, and so on; reading takes one away. So an
escaped body holds no control string, and every text has exactly one escape.

Turns are first rendered as they are and parsed again. A turn that does not come
back as the one turn it was gets its end marks escaped, and if that is not
enough its heads too. As turns end with a mark that no kept body holds,
they can be strung together; the whole conversation is parsed once more all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MID, END = "### ", ": ", "</turn>"


def escape_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>")


def escape_heads(text: Column) -> Column:
    return F.regexp_replace(text, r"(^|\n)#(\\*)## ", r"$1#\\$2## ")


def unescaped(body: Column) -> Column:
    heads = F.regexp_replace(body, r"(^|\n)#\\(\\*)## ", r"$1#$2## ")
    return F.regexp_replace(heads, r"<\\(\\*)/turn>", r"<$1/turn>")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), F.url_encode(role), F.lit(MID), body, F.lit(END + "\n"))


def parsed(conversation: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), or NULL if it
    is not one by the grammar."""
    parts = F.split(conversation, END, -1)
    # What follows an end mark begins with the line end that belongs to it.
    turns = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda x, i: F.struct(F.when(i == 0, x).otherwise(F.substring(x, F.lit(2), F.length(x))).alias("s"), ((i == 0) | x.startswith("\n")).alias("ok")),
    )
    shape = r"(?s)^### ([^:\n ]*): (.*)$"
    read = F.transform(
        turns,
        lambda t: F.struct(
            F.when(
                t["ok"] & F.regexp_like(t["s"], F.lit(shape)) & ~F.regexp_like(F.regexp_extract(t["s"], shape, 2), F.lit(r"(^|\n)### ")),
                F.struct(
                    F.try_url_decode(F.regexp_extract(t["s"], shape, 1)).alias("role"),
                    unescaped(F.regexp_extract(t["s"], shape, 2)).alias("text"),
                ),
            ).alias("turn")
        ),
    )
    good = (F.element_at(parts, -1) == F.when(F.size(parts) == 1, "").otherwise("\n")) & F.forall(read, lambda t: F.isnotnull(t["turn"]["role"]))
    return F.when(good, F.transform(read, lambda t: t["turn"]))


def comes_back(role: Column, text: Column, body: Column) -> Column:
    """Whether the turn rendered with ``body`` is parsed as just this turn."""
    one = F.array(F.struct(role.alias("role"), text.alias("text")))
    return F.coalesce(parsed(rendered(role, body)) == one, F.lit(False))


def body_of(role: Column, text: Column) -> Column:
    """The least escaped body that comes back."""
    ends = escape_ends(text)
    return (
        F.when(comes_back(role, text, text), text)
        .when(comes_back(role, text, ends), ends)
        .otherwise(escape_heads(ends))
    )


def format_chats(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row per conversation: key, ``formatted`` (string), ``turn_starts`` (array of
    the code point at which each turn begins), ``loss_spans`` (array of (turn, start,
    length): the bodies of ``learn`` turns, as code points of ``formatted``, turns
    from 0) and ``round_trip`` (boolean: parsing gives the turns back; true for every text).

    Turns come by ``turn`` (NULL first), those of equal ``turn`` by role and text,
    repeated rows stay repeated. A NULL role or text is empty, a NULL key is a
    conversation like others. A table without rows gives none. Texts
    may be of any length, but a conversation is one string and so one row. Other
    columns are not read.
    """
    given = rows.select(
        F.col(key).alias("k"), F.col(turn).alias("at"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    bodies = given.withColumn("body", body_of(F.col("role"), F.col("text")))
    pieces = bodies.withColumn("piece", rendered(F.col("role"), F.col("body")))
    order = Window.partitionBy("k").orderBy("at", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "k", "role", "text", "piece",
        (F.row_number().over(order) - 1).alias("i"),
        F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long")).alias("start"),
        F.length("body").cast("long").alias("n"),
    )
    one = F.struct("i", "start", "piece", "role", "text", "n")
    turns = placed.groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == learn),
        lambda t: F.struct(
            t["i"].alias("turn"),
            (t["start"] + F.length(t["piece"]) - len(END) - 1 - t["n"]).alias("start"),
            t["n"].alias("length"),
        ),
    )
    whole = turns.select(
        "k", F.concat_ws("", F.transform("turns", lambda t: t["piece"])).alias("formatted"),
        F.transform("turns", lambda t: t["start"]).alias("turn_starts"), spans.alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    return whole.select(
        F.col("k").alias(key), "formatted", "turn_starts", "loss_spans",
        F.coalesce(parsed(F.col("formatted")) == F.col("source"), F.lit(False)).alias("round_trip"),
    )


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """From the output of ``format_chats`` alone, per conversation: key, ``turns``
    (array of (role, text)), ``learned`` (array of unescaped texts under the loss
    mask) and ``formatted_chars``."""
    ends = F.concat(F.slice("turn_starts", F.lit(2), F.size("turn_starts")), F.array(F.length("formatted").cast("long")))
    # Spans are cut out of their own turn, so long conversations are read once.
    pieces = F.transform(F.split("formatted", END + "\n", -1), lambda x: F.concat(x, F.lit(END + "\n")))
    span = lambda s: F.substring(F.element_at(pieces, s["turn"] + 1), (s["start"] - F.element_at("turn_starts", s["turn"] + 1) + 1).cast("int"), s["length"].cast("int"))
    fits = F.forall("loss_spans", lambda s: s["start"] + s["length"] <= F.element_at(ends, s["turn"] + 1))
    return chats.select(
        F.col(key).alias(key), parsed(F.col("formatted")).alias("turns"),
        F.when(fits, F.transform("loss_spans", lambda s: unescaped(span(s)))).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what ``read_back`` finds."""
    back = read_back(chats, key)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", "learned")
    return back.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars",
    )


ODD = r"\### Assistant: </turn> ok"
#: The texts as they came; only the length of what is rendered needs the escapes.
ORACLE = rf"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{ODD}' union all select -7, 1, 'assistant', '{ODD}'),
turns as (
  select *, length(regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '(^|\n)#(\\*)## ', '\1#\\\2## ', 'g')) as n
  from given),
said as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned,
    sum(n + length(url_encode(role)) + {len(HEAD + MID + END) + 1})::bigint as formatted_chars
  from turns group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, formatted_chars
from said"""
