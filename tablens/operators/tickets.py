"""Work tickets as a table (K1-K6, T2, A7): filters, order, statistics, batched changes,
deletes. Everything is a native expression, join or grouping set; ``wording`` tidies their texts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog, latest
from .order import with_position

# Ticket states and priorities.
STATUSES = ("open", "in_progress", "solved", "wont_fix")
PRIORITIES = ("low", "medium", "high", "critical")
CLOSED = ("solved", "wont_fix")
# Fixed value: listing order of priorities.
PRIORITY_ORDER = ("critical", "high", "medium", "low")
TITLE_MAX = 200

SCHEMA = ("id long, title string, description string, status string, priority string, tags array<string>, "
          "resolution string, created_at timestamp_ntz, updated_at timestamp_ntz, solved_at timestamp_ntz")
FIELDS = ("title", "description", "status", "priority", "tags", "resolution")


def priority_rank(c: Column) -> Column:
    r = F.lit(None).cast("int")
    expr = None
    for i, p in enumerate(PRIORITY_ORDER):
        expr = F.when(c == p, i) if expr is None else expr.when(c == p, i)
    return expr.otherwise(r)


def validate(df: DataFrame) -> DataFrame:
    """Enum and length checks (the table's CHECK constraints): a bad row fails the job."""
    good = (F.col("status").isin(*STATUSES) & F.col("priority").isin(*PRIORITIES)
            & F.length("title").between(1, TITLE_MAX))
    bad = ~F.coalesce(good, F.lit(False))      # a null is no valid status, priority or title
    # a filter predicate is always evaluated (a dropped check column would be pruned away)
    return df.where(F.when(bad, F.raise_error(F.concat(F.lit("invalid ticket "), F.col("id").cast("string"))))
                    .otherwise(F.lit(True)))


def numbered(new: DataFrame, as_of, start: int) -> DataFrame:
    """K4, the rows: defaults open / medium / []; ids from ``start`` + 1 on; validated."""
    base = new.select(
        F.col("title"), F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.lit("open").alias("status"), F.coalesce(F.col("priority"), F.lit("medium")).alias("priority"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        F.lit("").alias("resolution"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
        F.lit(as_of).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("solved_at"),
        F.monotonically_increasing_id().alias("__seq"))
    placed = with_position(base, "__seq", name="__pos").withColumn("id", F.col("__pos") + F.lit(start))
    return validate(placed.select(*[c.split()[0] for c in SCHEMA.split(", ")]))


def append(existing: DataFrame | None, new: DataFrame, as_of) -> DataFrame:
    """K4: validated batch append; ids continue after the max."""
    start = 0 if existing is None else (existing.agg(F.max("id")).first()[0] or 0)
    rows = numbered(new, as_of, start)
    return rows if existing is None else existing.unionByName(rows)


def list_tickets(df: DataFrame, status: str | None = None, priority: str | None = None,
                 tag: str | None = None) -> DataFrame:
    """K1: optional filters, AND-ed (pushed to the scan where the source allows)."""
    if status:
        df = df.where(F.col("status") == status)
    if priority:
        df = df.where(F.col("priority") == priority)
    if tag:
        df = df.where(F.array_contains("tags", tag))
    return df


def get(df: DataFrame, ticket_id: int) -> DataFrame:
    """One ticket by id (no row when absent)."""
    return df.where(F.col("id") == ticket_id)


def ordered(df: DataFrame) -> DataFrame:
    """Critical > high > medium > low, then newest first (id breaks ties); with ``position``."""
    return with_position(df, priority_rank(F.col("priority")), F.col("created_at").desc(), F.col("id"))


def stats(df: DataFrame) -> DataFrame:
    """(dimension, value, count) for the total, per status and per priority, in one pass."""
    g = df.groupingSets([[], ["status"], ["priority"]], "status", "priority").agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("__gid"))
    dim = F.when(F.col("__gid") == 3, "total").when(F.col("__gid") == 1, "status").otherwise("priority")
    val = F.when(F.col("__gid") == 1, F.col("status")).when(F.col("__gid") == 2, F.col("priority"))
    return g.select(dim.alias("dimension"), val.alias("value"), "count")


def apply_changes(df: DataFrame, changes: DataFrame, as_of, order: str | None = None) -> DataFrame:
    """K5: non-null fields overwrite; closing sets ``solved_at``, reopening clears it;
    ``updated_at`` moves only when something was given; unknown ids are ignored. Several changes
    of one id fold into one: each field takes its last non-null value by ``order``; without an
    ``order`` a repeated id fails the job. The result is validated. ``as_of`` is the batch's clock."""
    fields = [f for f in FIELDS if f in changes.columns]
    if order is None:
        folded = [F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a ticket id is changed twice and no order is given")))
                  .otherwise(F.any_value(f)).alias(f"__n_{f}") for f in fields]
    else:
        folded = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"__n_{f}") for f in fields]
    ch = changes.groupBy(F.col("id").alias("__cid")).agg(F.count(F.lit(1)).alias("__changes"), *folded)
    given = [f for f in FIELDS if f in changes.columns]
    j = df.join(ch, df.id == ch.__cid, "left")
    any_given = F.lit(False)
    for f in given:
        any_given = any_given | F.col(f"__n_{f}").isNotNull()
    now = F.lit(as_of).cast(df.schema["updated_at"].dataType)
    new_status = F.col("__n_status") if "status" in given else F.lit(None).cast("string")
    solved = (F.when(new_status.isin(*CLOSED), now)
              .when(new_status.isNotNull() & F.col("status").isin(*CLOSED), F.lit(None).cast(df.schema["solved_at"].dataType))
              .otherwise(F.col("solved_at")))
    cols = []
    for c in df.columns:
        if c in given:
            cols.append(F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(any_given, now).otherwise(F.col(c)).alias(c))
        elif c == "solved_at":
            cols.append(solved.alias(c))
        else:
            cols.append(F.col(c))
    return validate(j.select(*cols))


def delete(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6: (remaining tickets, ids that existed and were deleted)."""
    keys = ids.select(F.col("id").alias("__d")).distinct()
    return df.join(keys, df.id == keys.__d, "left_anti"), keys.join(df.select("id"), keys.__d == df.id, "left_semi") \
        .select(F.col("__d").alias("id"))


# ------------------------------------------------------------------ a table of tickets that changes (K4-K6)
class TicketStore:
    """Tickets under a commit log: appends and changes add rows for the tickets they touch, reads take each ticket's last row. A batch
    (source, number) is applied once however often it is replayed, so ``store.apply`` fits ``foreachBatch``."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = CommitLog(spark, root, {"tickets": SCHEMA}, {"tickets": "id"})

    def read(self, version: int | None = None) -> DataFrame:
        return latest(self.log.read("tickets", version), "id")

    def load(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Whole tickets, ids included."""
        return self.log.append({"tickets": validate(rows)}, batch)

    def append(self, new: DataFrame, as_of, batch: tuple[str, int] | None = None) -> bool:
        """K4: ids go on after the largest that was ever given, deleted ones included."""
        def make(version: int) -> dict:
            top = self.log.read("tickets", version, with_deleted=True).agg(F.max("id")).first()[0]
            return {"tickets": numbered(new, as_of, top or 0)}
        return self.log.update(make, batch)

    def apply(self, changes: DataFrame, as_of, order: str | None = None, batch: tuple[str, int] | None = None) -> bool:
        """K5: only the changed tickets are written again."""
        def make(version: int) -> dict:
            touched = self.read(version).join(changes.select("id").distinct(), "id", "left_semi")
            return {"tickets": apply_changes(touched, changes, as_of, order)}
        return self.log.update(make, batch)

    def delete(self, ids: list[int]) -> bool:
        """K6: one log entry."""
        return self.log.delete({"tickets": [str(i) for i in ids]})
