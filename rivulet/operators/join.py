"""Joins. Keys are compared as text, and null keys never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.errors import PlanError


def _text(c: Column) -> Column:
    return c.cast("string")


def hash_join(left: DataFrame, right: DataFrame, on: list[tuple[Column, Column]], how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Inner or left equi-join on any number of key pairs; Spark chooses broadcast, hash or sort merge by size."""
    if how not in ("inner", "left"):
        raise PlanError(f"join type {how!r} is not one of inner, left")
    if not on:
        raise PlanError("a join needs at least one pair of keys")
    cond = None
    for a, b in on:
        cond = _text(a) == _text(b) if cond is None else cond & (_text(a) == _text(b))
    return left.join(right, cond if condition is None else cond & condition, how)


def lookup_join(stream: DataFrame, table: DataFrame, on: list[tuple[Column, Column]], how: str = "inner", broadcast_rows: int = 0) -> DataFrame:
    """A stream against a table. With `broadcast_rows` the table is counted first and broadcast up to that many rows;
    without, adaptive execution decides by the sizes that it finds."""
    if broadcast_rows and table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table = F.broadcast(table)
    return hash_join(stream, table, on, how)


def within_join(left: DataFrame, right: DataFrame, on: list[tuple[Column, Column]], left_time: Column, right_time: Column, seconds: float, forward: bool = False, how: str = "inner") -> DataFrame:
    """Pairs with equal keys at most `seconds` apart; with `forward` the right one not before the left one.

    In batch, time is cut into slots as long as the distance and the right side stands in each slot it may meet, so
    a hot key is spread over its slots and a task compares neighbours in time only.
    """
    lt, rt = F.unix_micros(left_time), F.unix_micros(right_time)
    us = max(1, round(seconds * 1_000_000))
    near = (rt >= lt) & (rt <= lt + us) if forward else F.abs(lt - rt) <= us
    if left.isStreaming or right.isStreaming:
        d = F.make_dt_interval(secs=F.lit(float(seconds)))
        low = left_time if forward else left_time - d
        return hash_join(left, right, on, how, (right_time >= low) & (right_time <= left_time + d))
    if how == "left":
        return hash_join(left, right, on, how, near)
    slot = F.floor(rt / us)
    spread = F.explode(F.array(slot - 1, slot) if forward else F.array(slot - 1, slot, slot + 1))
    a, b = left.withColumn("__ls", F.floor(lt / us)), right.withColumn("__rs", spread)
    return hash_join(a, b, on, how, (F.col("__ls") == F.col("__rs")) & near).drop("__ls", "__rs")
