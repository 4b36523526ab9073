"""Chat logs as tables (H1-H5, J4): feedback flags, feedback transcripts, context windows,
session-id validity. Long form throughout: a session is never gathered into one row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .order import with_position

# Fixed values of the chat rules.
MAX_HISTORY = 20
SESSION_TTL_SECONDS = 3600
FEEDBACK_WORD = "feedback"
SESSION_ID_MAX = 500


def with_previous(df: DataFrame, session: str, order: str, *cols: str) -> DataFrame:
    """``df`` with ``prev_<col>``: the columns of the row before it in its session (null for the first).

    Rows get their place in one distributed sort by (session, order); the row before is then a
    join on place - 1, so a session that holds a third of all rows is spread over tasks.
    Gaps in ``order`` do not matter; it must be unique within a session."""
    at = durable(with_position(df, session, order, name="__at"))
    prev = at.select((F.col("__at") + 1).alias("__at"), F.col(session).alias("__s"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    same = F.col(session).eqNullSafe(F.col("__s"))
    return at.join(prev, "__at", "left").select(
        *[at[c] for c in df.columns], *[F.when(same, F.col(f"prev_{c}")).alias(f"prev_{c}") for c in cols])


def with_next(df: DataFrame, session: str, order: str, *cols: str) -> DataFrame:
    """``df`` with ``next_<col>``: the columns of the row after it in its session, as ``with_previous``."""
    at = durable(with_position(df, session, order, name="__at"))
    follow = at.select((F.col("__at") - 1).alias("__at"), F.col(session).alias("__s"), *[F.col(c).alias(f"next_{c}") for c in cols])
    same = F.col(session).eqNullSafe(F.col("__s"))
    return at.join(follow, "__at", "left").select(
        *[at[c] for c in df.columns], *[F.when(same, F.col(f"next_{c}")).alias(f"next_{c}") for c in cols])


def flag_feedback(df: DataFrame, session: str = "session_id", order: str = "created_at", role: str = "role",
                  text: str = "content", keyword: str = FEEDBACK_WORD) -> DataFrame:
    """H1: a user message holding ``keyword`` (any case) is feedback, and the reply that
    follows it in the same session carries the same flag."""
    hit = df.withColumn("__hit", F.coalesce((F.col(role) == "user") & (F.instr(F.lower(F.col(text)), keyword.lower()) > 0), F.lit(False)))
    j = with_previous(hit, session, order, role, "__hit")
    flag = F.when(F.col(role) == "user", F.col("__hit")).when(
        (F.col(role) == "assistant") & (F.col(f"prev_{role}") == "user"), F.coalesce("prev___hit", F.lit(False))).otherwise(F.lit(False))
    return j.select(*[F.col(c) for c in df.columns], flag.alias("is_feedback"))


def feedback_transcripts(flagged: DataFrame, session: str = "session_id") -> DataFrame:
    """Every message of the sessions with at least one feedback message
    (semi join on the distinct flagged sessions)."""
    hot = flagged.where("is_feedback").select(session).distinct()
    return flagged.join(hot, session, "left_semi")


def last_messages(df: DataFrame, session: str = "session_id", order: str = "created_at", n: int = MAX_HISTORY) -> DataFrame:
    """H3: the last n messages per session, with their position from the end. ``row_number() <= n``
    lets Spark cut each group in every task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return df.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def valid_session_id(c: Column) -> Column:
    """H5: 1-500 characters and a UUID in any of the usual spellings
    (hyphens optional, braces and a 'urn:uuid:' prefix allowed)."""
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "urn:", ""), "uuid:", ""), r"^\{+|\}+$", "")
    hexed = F.regexp_replace(core, "-", "")
    return (F.length(c) >= 1) & (F.length(c) <= SESSION_ID_MAX) & hexed.rlike(r"^[0-9a-fA-F]{32}$")


def idle_sessions(df: DataFrame, session: str = "session_id", ts: str = "created_at",
                  as_of=None, ttl_seconds: int = SESSION_TTL_SECONDS) -> DataFrame:
    """H4 (batch form): sessions whose last message is older than the TTL at ``as_of``."""
    last = df.groupBy(session).agg(F.max(ts).alias("last_active"))
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return last.where(F.col("last_active") < now - F.make_interval(secs=F.lit(ttl_seconds)))


def exchange_rows(exchanges: DataFrame, session: str = "session_id", user_text: str = "user_text",
                  reply_text: str = "reply_text", ts: str = "created_at", keyword: str = FEEDBACK_WORD) -> DataFrame:
    """Each (user message, reply) exchange becomes two log rows that share one feedback
    flag (the user text holds ``keyword``)."""
    flag = F.instr(F.lower(F.col(user_text)), keyword.lower()) > 0
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col(user_text).alias("content"), F.lit(0).alias("seq")),
                   F.struct(F.lit("assistant").alias("role"), F.col(reply_text).alias("content"), F.lit(1).alias("seq")))
    return exchanges.select(session, ts, flag.alias("is_feedback"), F.inline(pair)) \
        .select(session, "role", "content", "is_feedback", ts, "seq")


def append_exchanges(exchanges: DataFrame, path: str, **kw) -> None:
    """W4 (batch): append the rows of a batch of exchanges to the log table."""
    exchange_rows(exchanges, **kw).write.mode("append").parquet(path)


def stream_exchanges(exchanges: DataFrame, path: str, checkpoint: str, available_now: bool = False, **kw):
    """W4 (stream): the same rows from a streaming source, appended exactly once per batch
    (the checkpoint records what was written). ``available_now`` processes what is there and stops."""
    w = exchange_rows(exchanges, **kw).writeStream.outputMode("append").format("parquet") \
        .option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start(path)
