"""Agents: the log of what they did as tables, and a small loop over a model and tools that are given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

READ_TOOLS = ("read_file", "read_image")
WRITE_TOOLS = ("write_file", "edit_file", "hashline_edit", "apply_patch")
LEASED_TOOLS = ("write_file", "edit_file", "hashline_edit")
CONDENSE_FROM, KEEP_TOOL_RESULTS, PLACEHOLDER = 75_000, 4, "[condensed tool output omitted to preserve context window]"


def token_budget(log: DataFrame, most: int, by: str = "conv_id", order: str = "turn", tokens: str = "tokens") -> DataFrame:
    """log with used, remaining and exceeded (more used than `most`), running."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(w)
    return log.withColumn("used", used).withColumn("remaining", F.greatest(F.lit(0), F.lit(most) - F.col("used"))).withColumn("exceeded", F.col("used") > most)


def condense(log: DataFrame, threshold: int = CONDENSE_FROM, keep: int = KEEP_TOOL_RESULTS, by: str = "conv_id", order: str = "turn", tokens: str = "tokens", tool_role: str = "tool") -> DataFrame:
    """log(role, text) where, in conversations of at least `threshold` tokens, all tool results but the last `keep` are a placeholder."""
    total = F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(Window.partitionBy(by))
    back = F.row_number().over(Window.partitionBy(by, F.col("role") == tool_role).orderBy(F.desc(order)))
    old = (F.col("role") == tool_role) & (F.col("_total") >= threshold) & (F.col("_back") > keep)
    out = log.withColumn("_total", total).withColumn("_back", back).withColumn("condensed", F.coalesce(old, F.lit(False)))
    return out.withColumn("text", F.when(F.col("condensed"), PLACEHOLDER).otherwise(F.col("text"))).drop("_total", "_back")


def policy(calls: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """calls(session, seq, ended, tool, path, command, ok) with `blocked`: why the policy would have stopped the call, else null.

    A file that exists (existing(path); by default every one) must have been read by the session before it is written to; a
    command isn't run again once it succeeded; and a path that a running call still writes to isn't written to by another.
    A call runs from seq to ended (seq, if that is null).
    """
    before = Window.partitionBy("session", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("session", "_command").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    on_path = Window.partitionBy("path").orderBy("seq", "session").rowsBetween(Window.unboundedPreceding, -1)
    command = F.nullif(F.trim("command"), F.lit(""))
    c = calls.withColumn("_command", F.when(F.col("tool") == "run_shell", command))
    c = c.withColumn("_read", F.coalesce(F.max(F.when(F.col("tool").isin(*READ_TOOLS) & F.col("ok"), 1)).over(before), F.lit(0)))
    c = c.withColumn("_ran", F.coalesce(F.max(F.when(F.col("_command").isNotNull() & F.col("ok"), 1)).over(same), F.lit(0)))
    c = c.withColumn("_busy", F.max(F.when(F.col("tool").isin(*LEASED_TOOLS), F.coalesce("ended", "seq"))).over(on_path))
    if existing is not None:
        c = c.join(existing.select("path", F.lit(True).alias("_exists")).distinct(), "path", "left").withColumn("_exists", F.coalesce("_exists", F.lit(False)))
    else:
        c = c.withColumn("_exists", F.lit(True))
    unread = F.col("tool").isin(*WRITE_TOOLS) & F.col("path").isNotNull() & F.col("_exists") & (F.col("_read") == 0)
    again = F.col("_command").isNotNull() & (F.col("_ran") == 1)
    busy = F.col("tool").isin(*LEASED_TOOLS) & F.col("path").isNotNull() & F.coalesce(F.col("_busy") > F.col("seq"), F.lit(False))
    reason = F.when(unread, F.concat(F.lit("write-before-read blocked for "), F.col("path"))).when(again, F.concat(F.lit("repeated run_shell blocked for "), F.col("_command"))).when(busy, F.concat(F.lit("parallel write conflict blocked for "), F.col("path")))
    return c.select(*calls.columns, reason.alias("blocked"))


@dataclass
class Turn:
    """What the model said: text, tool calls (name, arguments), tokens."""

    text: str = ""
    calls: list[tuple[str, dict]] = field(default_factory=list)
    tokens: int = 0


def solve(objective: str, model: Callable[[list[dict]], Turn], tools: Callable[[str, dict], str], max_steps: int = 20, max_tokens: int | None = None, max_depth: int = 2, depth: int = 0) -> tuple[str | None, list[dict]]:
    """Asks the model and runs its tool calls until it answers without any; (answer, transcript). Ends without an answer when steps or tokens run out. A call of "subtask" with an objective solves that first, at most max_depth deep."""
    log: list[dict] = [{"role": "user", "text": objective, "tokens": 0}]
    used = 0
    for _ in range(max_steps):
        turn = model(log)
        used += turn.tokens
        log.append({"role": "assistant", "text": turn.text, "tokens": turn.tokens})
        if not turn.calls:
            return turn.text, log
        if max_tokens is not None and used > max_tokens:
            break
        for name, arguments in turn.calls:
            if name == "subtask":
                answer = solve(arguments["objective"], model, tools, max_steps, max_tokens, max_depth, depth + 1)[0] if depth < max_depth else None
                result = answer if answer is not None else "not solved"
            else:
                try:
                    result = tools(name, arguments)
                except Exception as e:  # a failing tool is told to the model
                    result = f"error: {e}"
            log.append({"role": "tool", "text": result, "tokens": 0})
    return None, log
