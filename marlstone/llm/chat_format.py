"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conversation, sequence number, message, kind, role, text). Events are partitioned by conversation
and message, sorted by sequence number and folded: `message`, `edit` and `regenerate` set the text of a message anew,
`delta` appends to it. Final messages, in order of their first event, are rendered as

    <|turn|>ROLE<newline>TEXT<|end|>

`&`, `<` and `[` in roles and texts are written as `&amp;`, `&lt;` and `&lsqb;`, so no control string of this or
of the common instruction templates (`<|...|>`, `<s>`, `</s>`, `[INST]`) can appear inside a text, and unescaping
restores every text exactly. A line feed in a role is written as `&nl;`. The loss mask is a list of (start, length) code-point spans over the rendered string,
one for each assistant text.

Defined results: null texts and roles count as empty. Ties of the sequence number are ordered by kind (setting events
first), role and text. Repeated rows are events of their own. Null conversation ids form one conversation. Empty tables
give empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TURN, END = "<|turn|>", "<|end|>"
LOSS_ROLE = "assistant"


def escape(x) -> F.Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(x) -> F.Column:
    return F.replace(F.replace(F.replace(x, F.lit("&lsqb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of final messages from events (conv_id, message_id, seq, kind, role, text).

    Events are dealt by conversation, which serves the fold of each message and the rendering of each conversation: one exchange.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    item = F.struct(
        F.col("seq"),
        F.when(F.col("kind") == "delta", 1).otherwise(0).alias("is_delta"),
        role.alias("role"),
        text.alias("text"),
    )
    per = events.repartition("conv_id").groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(item)).alias("log"))
    # What precedes the last setting event is void; what follows it are deltas.
    last = F.aggregate(
        F.sequence(F.lit(1), F.size("log")),
        F.lit(1),
        lambda at, i: F.when(F.element_at("log", i)["is_delta"] == 0, i).otherwise(at),
    )
    per = per.select("conv_id", "log", last.alias("last"))
    live = F.slice("log", F.col("last"), F.size("log"))
    return per.select(
        "conv_id",
        F.col("log")[0]["seq"].alias("turn"),
        F.element_at("log", F.col("last"))["role"].alias("role"),
        F.when(F.size("log") == 1, F.col("log")[0]["text"]).otherwise(F.array_join(F.transform(live, lambda x: x["text"]), "")).alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length), n_turns from final messages (conv_id, turn, role, text).

    Turns are ordered by number, then role and text as they are, before anything is escaped.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn"), role, text)))

    def body(x):
        head = F.concat(F.lit(TURN), F.replace(escape(x["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
        return F.struct(x["role"].alias("role"), head.alias("head"), escape(x["text"]).alias("text"))

    per = messages.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.transform("turns", body).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc, x):
        at, n = acc["pos"] + F.char_length(x["head"]), F.char_length(x["text"])
        own = F.array(F.struct(at.cast("long").alias("start"), n.cast("long").alias("length")))
        return F.struct(
            (at + n + len(END)).cast("long").alias("pos"),
            F.when(x["role"] == LOSS_ROLE, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"),
        )

    return per.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
        F.size("turns").cast("long").alias("n_turns"),
    )


def parse(formatted) -> F.Column:
    """array<struct<role, text>> read back from a rendered string."""
    bodies = F.filter(F.split(formatted, F.lit(r"<\|end\|>")), lambda x: x != "")
    bare = lambda x: F.substring(x, len(TURN) + 1, 2**31 - 1)
    return F.transform(
        bodies,
        lambda x: F.struct(
            unescape(F.replace(F.substring_index(bare(x), "\n", 1), F.lit("&nl;"), F.lit("\n"))).alias("role"),
            unescape(F.substring(x, F.lit(len(TURN) + 2) + F.char_length(F.substring_index(bare(x), "\n", 1)), F.lit(2**31 - 1))).alias("text"),
        ),
    )


def loss_text(formatted, spans) -> F.Column:
    """The text under the loss mask, unescaped, read from the rendered string."""
    parts = F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return unescape(F.array_join(parts, ""))


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log of a plain table (conv_id, turn, role, text): each row is a message of its own, as the log of a chat that was never edited."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.select("conv_id", F.monotonically_increasing_id().alias("message_id"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Conversations of a plain table (conv_id, turn, role, text), folded from its events and rendered."""
    return render(fold_events(events_of(conversations)))
