"""Chat formatting from an event log, in DataFrame functions only.

Events (conversation, sequence, kind, message, role, text) are folded into final messages: `message` opens one with its
first text, `delta` appends, `edit` replaces the text (later deltas append to it), `regenerate` discards the text and
every later message that had been opened before. The final messages are rendered as

    <turn>role, new line, text</turn>, new line

with every backslash and `<` inside roles and texts escaped, so control strings stand only where the template puts
them. The loss mask is a list of character spans of the rendered string, one for each assistant text.

Defined results: null texts and roles count as empty; a null conversation id is a conversation of its own; events of
equal sequence are taken in the order of kind and text; repeated events count again; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"


def escaped(c: Column, line: bool = False) -> Column:
    """Backslash and < (and the new line, in a header) as two characters that never hold a <."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if line else c


def unescaped(c: Column, line: bool = False) -> Column:
    """The inverse: every backslash of an escaped text begins one code, so the codes can be replaced one after the other, the backslash's last."""
    if line:
        c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, opened, role, text of each message that is left. events: conv_id, seq, kind, message, role, text."""
    e = events.select("conv_id", F.col("seq").cast("long").alias("seq"), "kind", "message", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    resets = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.struct("seq", "kind", "text")))
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", "text")))
    m = e.groupBy("conv_id", "message").agg(
        F.min("seq").alias("opened"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
        resets.alias("reset"),
        parts.alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("reset").isNull() | (p >= F.col("reset")))
    m = m.withColumn("text", F.array_join(F.transform(live, lambda p: p["text"]), ""))
    before = Window.partitionBy("conv_id").orderBy("opened", "message").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("cut", F.max("redone").over(before))
    return m.where(F.col("cut").isNull() | (F.col("opened") > F.col("cut"))).select("conv_id", "opened", "message", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, spans (first character, characters) of the loss mask."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), line=True), F.lit("\n"))
    m = messages.select("conv_id", "opened", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    m = m.select("*", F.concat("head", "body", F.lit(CLOSE)).alias("piece"))
    before = Window.partitionBy("conv_id").orderBy("opened", "message").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.char_length("head")).cast("long").alias("first"), F.char_length("body").cast("long").alias("n")))
    out = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("opened", "message", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("spans"))
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "spans")


def parse(formatted: Column) -> Column:
    """The turns of a rendered string: array of (role, text)."""
    turns = F.split(formatted, CLOSE)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        return F.struct(unescaped(F.substring(p, F.lit(len(OPEN) + 1), line - F.lit(len(OPEN) + 1)), line=True).alias("role"), unescaped(F.substring(p, line + 1, F.char_length(p))).alias("text"))

    return F.transform(turns, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["first"] + 1).cast("int"), s["n"].cast("int"))))


#: What a log's discarded drafts say.
DRAFT = "a first draft, <turn> not to be seen"


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Finished turns as the log that a server would keep of them. Rows of a conversation by turn, ties by role and text.

    Every text is streamed in three pieces. By a hash of conversation and turn, a third of the messages is streamed at
    once; a third is drafted, edited to the first piece and streamed on; a third is drafted, answered by a message that is
    then abandoned, regenerated, and streamed. Folding the log gives the turns back."""
    c = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = c.withColumn("message", F.row_number().over(w).cast("long"))
    n, style = F.char_length("text"), F.pmod(F.xxhash64("conv_id", "message"), F.lit(3))
    third, two = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    pieces = [F.substring("text", F.lit(1), third), F.substring("text", third + 1, two - third), F.substring("text", two + 1, n - two)]
    none = F.lit(None).cast("string")

    def event(at: int, kind: str, text: Column, role: Column = none, message: Column = F.col("message")) -> Column:
        return F.struct(message.alias("message"), (16 * F.col("message") + at).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    opened, draft = event(0, "message", F.lit(""), F.col("role")), event(1, "delta", F.lit(DRAFT))
    stream = lambda at, which: [event(at + k, "delta", p) for k, p in enumerate(which)]
    at_once = F.array(*stream(1, pieces), opened)
    edited = F.array(draft, event(2, "edit", pieces[0]), *stream(3, pieces[1:]), opened)
    abandoned = [event(2, "message", F.lit(""), F.lit("assistant"), -F.col("message")), event(3, "delta", F.lit(DRAFT), none, -F.col("message"))]
    redone = F.array(*stream(5, pieces), event(4, "regenerate", F.lit("")), *abandoned, draft, opened)
    steps = F.when(style == 0, at_once).when(style == 1, edited).otherwise(redone)
    return c.select("conv_id", F.explode(steps).alias("e")).select("conv_id", "e.*")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = render(fold(events_of_turns(rows.unionByName(own))))
    out = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("spans")), "").alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


SQL_OP3 = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(text) + len(regexp_extract_all(role, '[\\<\n]')) + len(regexp_extract_all(text, '[\\<]'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
