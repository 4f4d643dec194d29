"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

An event log (conv_id, seq, turn, kind, role, text) is partitioned by conversation once; every later
step reuses that partitioning. Within a conversation events are taken by ``seq``:

* ``message``: starts turn ``turn`` with a role and a text (streams start with an empty one);
* ``delta``: appends its text to the turn;
* ``edit``: replaces the text of the turn so far;
* ``regenerate``: replaces the turn and takes back every later turn written before it.

A turn is folded by its own events only: the last event that sets a text, then the deltas after it.
What a regeneration takes back is found by a running maximum over the turns before. So nothing
of quadratic size is built and a turn, not a conversation, is the unit of sorting. The conversation
is gathered just once, for rendering: its rendered text is one value of the result.

Rendering: ``<|turn|>role\ntext<|end|>\n`` for each turn. A backslash is put before each backslash and
into each control string of this and other common templates, in texts and roles, so no text can
imitate a turn, and one pattern takes them out again. Spans of assistant text (the loss mask) are
in code points of the rendered text.

Defined results: null text counts as empty, a null role as an empty role. Events with equal ``seq`` in a
turn are taken in the order kind, role, text. A delta or an edit without a message starts its turn
with the event's role. Turns with a null number come first. An empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: A backslash goes between the first character and the rest of each of these.
_ANGLE = r"<(?=\||/?s>|/?<?SYS>>|<SYS>>|</SYS>>|(?:start|end)_of_turn>)"
_SQUARE = r"\[(?=/?(?:INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_RESULTS|TOOL_CALLS)\])"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, r"<\\"), _SQUARE, r"[\\")


def escape_role(role: Column) -> Column:
    """As ``escape``; a line break in a role becomes a backslash and an n, for the role ends at the first line break."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(parts, "\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _sets(e: Column) -> Column:
    return e["kind"] != F.lit("delta")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the state of each turn after all events."""
    rank = F.create_map(*[F.lit(x) for kv in (("message", 0), ("delta", 1), ("edit", 2), ("regenerate", 3)) for x in kv])
    kind = F.coalesce("kind", F.lit("message"))
    log = events.select(
        "conv_id", "turn",
        F.struct(F.col("seq"), F.coalesce(F.try_element_at(rank, kind), F.lit(9)).alias("order"), kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"),
        F.when(kind == "regenerate", F.col("seq")).alias("regenerated"),
    ).repartition("conv_id")
    turns = log.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("log"), F.max("regenerated").alias("regenerated"))
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("regenerated").over(before))
    turns = turns.withColumn("log", F.when(F.col("cut").isNull(), F.col("log")).otherwise(F.filter("log", lambda e: e["seq"] > F.col("cut")))).where(F.size("log") > 0)
    # The last event that sets the text, by its place from the end; the whole log where there is none.
    last = F.greatest(F.array_position(F.reverse(F.transform("log", lambda e: _sets(e))), True), F.lit(0))
    live = F.when(last > 0, F.slice("log", F.size("log") - last.cast("int") + 1, last.cast("int"))).otherwise(F.col("log"))
    setter = F.try_element_at(F.filter("log", lambda e: (e["kind"] == "message") | (e["kind"] == "regenerate")), F.lit(-1))
    return turns.select("conv_id", "turn", F.coalesce(setter["role"], F.col("log")[0]["role"]).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the rendered conversation and where the loss applies, in code points."""
    head = F.concat(F.lit(OPEN), escape_role("role"), F.lit("\n"))
    body = escape("text")
    parts = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    whole = F.concat("head", "body", F.lit(CLOSE + "\n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body") + F.lit(len(CLOSE) + 1)).over(order), F.lit(0)) + F.length("head"))
    piece = F.struct("at", whole.alias("whole"), F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))).alias("span"))
    got = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["span"].isNotNull()), lambda p: p["span"])
    return got.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["whole"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    each = F.filter(F.split(formatted, r"<\|turn\|>"), lambda s: s != "")
    shape = r"(?s)^([^\n]*)\n(.*)<\|end\|>\n$"
    return F.transform(each, lambda s: F.struct(unescape_role(F.regexp_extract(s, shape, 1)).alias("role"), unescape(F.regexp_extract(s, shape, 2)).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))


def turns_as_events(rows: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the event log that could have led to it.

    By a hash, a turn is streamed (an empty start and three deltas), edited (a wrong draft, an edit, the
    rest as a delta) or generated again (a wrong draft and a wrong turn after it, taken back, then two parts). Rows
    that repeat a turn's number stay apart.
    """
    again = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = rows.select("conv_id", (F.row_number().over(again) - 1).cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    one, two, three = F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, F.length("text"))

    def event(step: int, kind: str, text: Column, later: int = 0) -> Column:
        return F.struct((F.col("turn") + later).alias("turn"), (F.col("turn") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), F.col("role"), text.alias("text"))

    nothing, draft = F.lit(""), F.lit("draft <|end|>")
    streamed = F.array(event(0, "message", nothing), event(1, "delta", one), event(2, "delta", two), event(3, "delta", three))
    edited = F.array(event(0, "message", draft), event(1, "delta", two), event(2, "edit", one), event(3, "delta", F.concat(two, three)))
    regenerated = F.array(event(0, "message", draft), event(1, "delta", one), event(2, "message", draft, 1), event(3, "delta", one, 1), event(4, "regenerate", F.concat(one, two)), event(5, "delta", three))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    return turns.select("conv_id", F.explode(F.when(way == 0, streamed).when(way == 1, edited).otherwise(regenerated)).alias("e")).select("conv_id", "e.*")


def digests(rows: DataFrame) -> DataFrame:
    """Formats finished turns, reads the output back and reduces it to digests, one row per conversation."""
    done = render(final_messages(turns_as_events(rows))).select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
