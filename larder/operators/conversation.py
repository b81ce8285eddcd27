"""Table jobs over conversations: (thread, turn, role, text, sql)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import one_line, preview
from larder.operators.chunked import CHUNK_ROWS, preceding_rows

# How much history a turn sees, and how a thread is previewed.
HISTORY_TURNS = 3
MESSAGES_PER_TURN = 2
PREVIEW_MESSAGES = 4
PREVIEW_WIDTH = 100

USER_ROLES = ["user", "human"]
USER_LABEL, SQL_LABEL, REPLY_LABEL = "Usuário", "SQL usado", "Assistente"


def history_window(
    messages: DataFrame,
    thread: str = "conv_id",
    order: str = "turn",
    columns: tuple[str, ...] = ("role", "text"),
    turns: int = HISTORY_TURNS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Each message with the last few before it as array ``history``, oldest first."""
    n = turns * MESSAGES_PER_TURN
    return preceding_rows(messages, n, order, columns, "history", [thread], chunk_rows)


def render_history(history: Column, has_sql: bool = False, reply_label: str = REPLY_LABEL) -> Column:
    """History as text: user lines, the SQL used, reply lines. Any role but the user's is a reply."""

    def line(m: Column) -> Column:
        reply = F.concat(F.lit(f"{reply_label}: "), m["text"])
        if has_sql:
            used = F.concat(F.lit(f"{SQL_LABEL}: "), one_line(m["sql"]), F.lit("\n"))
            known = F.coalesce(m["sql"], F.lit("")) != ""
            reply = F.concat(F.when(known, used).otherwise(""), reply)
        said = F.concat(F.lit(f"{USER_LABEL}: "), m["text"])
        return F.when(m["role"].isin(*USER_ROLES), said).otherwise(reply)

    return F.array_join(F.transform(history, line), "\n")


def thread_sizes(messages: DataFrame, thread: str = "conv_id") -> DataFrame:
    return messages.groupBy(thread).agg(F.count("*").alias("n_messages"))


def thread_preview(
    messages: DataFrame,
    thread: str = "conv_id",
    order: str = "turn",
    n: int = PREVIEW_MESSAGES,
    width: int = PREVIEW_WIDTH,
) -> DataFrame:
    """Last ``n`` messages of each thread, shortened, with the size of the thread.

    The row-number limit is applied before the shuffle, so a task sends at most n rows per thread.
    """
    latest = Window.partitionBy(thread).orderBy(F.col(order).desc())
    last = messages.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= n)
    rows = last.select(thread, order, "role", preview("text", width).alias("preview"))
    return rows.join(thread_sizes(messages, thread), thread)
