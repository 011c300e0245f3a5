"""Guidance codes, capture events and spoken messages of camera sessions, in batch."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from tactile.operators.frames import FOCUS_BLURRY, FOCUS_SHARP
from tactile.operators.ordered import DEFAULT, Bound, Scan, by_size
from tactile.operators.sessions import (
    ANY_SILENCE_MS, HOLD_MS, SAME_SILENCE_MS, Hold, Throttle, fold,
)

# What is said for each code. Codes without a text are only shown.
UTTERANCES = {
    "NO_DOC": "ยังไม่พบเอกสาร กรุณาส่องกล้องไปที่หนังสือ",
    "BLURRY": "ภาพยังเบลออยู่ ถือกล้องนิ่งๆ อีกนิดนะครับ",
    "HOLD_START": "ตัวอักษรชัดเจนแล้ว ถือค้างไว้นะครับ...",
    "WARN": "กำลังถ่ายภาพ อยู่นิ่งๆ นะครับ",
    "FIRE": "ถ่ายภาพสำเร็จ กำลังอ่านข้อความภาษาอังกฤษ...",
    "ALL_OUT": "ยังไม่เข้ามุม กรุณาขยับหนังสือให้ตรงกรอบ 4 มุม",
    "TOP": "มุมด้านบนหลุดกรอบ ให้เลื่อนกล้องขึ้นบน",
    "BOTTOM": "มุมด้านล่างหลุดกรอบ ให้เลื่อนกล้องลงล่าง",
    "LEFT": "มุมด้านซ้ายหลุดกรอบ ให้ขยับกล้องไปทางซ้าย",
    "RIGHT": "มุมด้านขวาหลุดกรอบ ให้ขยับกล้องไปทางขวา",
    "TL": "มุมบนซ้ายหลุดกรอบ",
    "TR": "มุมบนขวาหลุดกรอบ",
    "BL": "มุมล่างซ้ายหลุดกรอบ",
    "BR": "มุมล่างขวาหลุดกรอบ",
}
# Codes whose message passes the throttle in any case.
FORCED = ("WARN", "FIRE")

FOCUS_LIMITS = (FOCUS_BLURRY, FOCUS_SHARP)


def all_locked() -> Column:
    return F.col("lock_tl") & F.col("lock_tr") & F.col("lock_bl") & F.col("lock_br")


def ready(sharp: float = FOCUS_SHARP) -> Column:
    """Document, four corners, focus and stability: the frame counts towards a hold."""
    return F.col("has_document") & all_locked() & (F.col("focus") >= sharp) & F.col("stable")


def waiting_code(limits: tuple[float, float] = FOCUS_LIMITS) -> Column:
    """T2 without the hold: the code of a frame that is not ready, null if it is."""
    tl, tr, bl, br = (F.col(f"lock_{z}") for z in ("tl", "tr", "bl", "br"))
    return (
        F.when(~F.col("has_document"), "NO_DOC")
        .when(all_locked() & (F.col("focus") < limits[0]), "BLURRY")
        .when(all_locked() & (F.col("focus") < limits[1]), "ADJUSTING")
        .when(all_locked() & ~F.col("stable"), "MOVING")
        .when(all_locked(), F.lit(None))
        .when(~(tl | tr | bl | br), "ALL_OUT")
        .when(~(tl | tr), "TOP")
        .when(~(bl | br), "BOTTOM")
        .when(~(tl | bl), "LEFT")
        .when(~(tr | br), "RIGHT")
        .when(~tl, "TL")
        .when(~tr, "TR")
        .when(~bl, "BL")
        .otherwise("BR")
    )


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def judged(flags: DataFrame, limits: tuple[float, float] = FOCUS_LIMITS) -> DataFrame:
    """Input of the hold machine: time, readiness and the code of frames that are not ready."""
    return flags.withColumns(
        {"ms": millis(F.col("ts")), "ok": ready(limits[1]), "code": waiting_code(limits)}
    )


def guidance(
    rows: DataFrame,
    order: list[str] | None = None,
    hold_ms: int = HOLD_MS,
    warn_ms: int | None = None,
    auto_capture: bool = True,
    once: bool = False,
    bound: Bound = DEFAULT,
    idle_ms: int | None = None,
) -> DataFrame:
    """T2, T5, T6. What each frame of ``judged`` emits. ``once`` ends a session at its first FIRE,
    as a camera that closes after the shot; a pause of more than ``idle_ms`` starts anew."""
    order = order or ["ts"]
    machine = Hold(hold_ms, warn_ms, auto_capture, once)
    events = fold(rows, machine, ["session_id"], order, (), bound, idle_ms)
    return events.withColumns(
        {
            "forced": F.col("code").isin(*FORCED),
            "remaining_s": F.when(F.col("elapsed_ms").isNotNull(), remaining(F.col("elapsed_ms"), hold_ms)),
        }
    )


def remaining(elapsed_ms: Column, hold_ms: int = HOLD_MS) -> Column:
    """F15. Seconds left, one decimal, never below 0. An exact tie goes up; only quarters of a
    second are exact ties in binary."""
    left = F.greatest(F.lit(0), F.lit(hold_ms) - elapsed_ms)
    exact = F.when(left % 500 == 250, left + 50).otherwise(left) / F.lit(1000.0)
    return F.replace(F.format_number(exact, 1), F.lit(","), F.lit(""))


def held_runs(
    rows: DataFrame,
    order: list[str] | None = None,
    hold_ms: int = HOLD_MS,
    bound: Bound = DEFAULT,
) -> DataFrame:
    """W4. Runs of consecutive ready frames, and whether they were held long enough."""
    order = order or ["ts"]
    broken = {"run": Scan("sum_to", (~F.col("ok")).cast("long"))}
    rows = by_size(
        rows.select("session_id", *order, "ms", "ok"),
        ["session_id"],
        lambda df, how: how.scan(df, ["session_id"], order, broken),
        bound,
    )
    length = F.col("last_ms") - F.col("first_ms")
    return (
        rows.where("ok")
        .groupBy("session_id", "run")
        .agg(
            F.min("ms").alias("first_ms"),
            F.max("ms").alias("last_ms"),
            F.count(F.lit(1)).alias("frames"),
        )
        .withColumn("held", length >= hold_ms)
    )


def messages(events: DataFrame, voice: bool = True) -> DataFrame:
    """Messages that guidance events want to say. With ``voice`` off only forced ones remain."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(UTTERANCES.items())])
    said = events.withColumn("text", F.element_at(table, F.col("code")))
    said = said.where(F.col("text").isNotNull())
    return said if voice else said.where("forced")


def throttle(
    rows: DataFrame,
    order: list[str] | None = None,
    any_ms: int = ANY_SILENCE_MS,
    same_ms: int = SAME_SILENCE_MS,
    bound: Bound = DEFAULT,
    idle_ms: int | None = None,
) -> DataFrame:
    """T7. The messages that pass. Input: session_id, ts, text, forced."""
    order, carry = order or ["ts"], ("text", "forced")
    rows = rows.withColumn("ms", millis(F.col("ts")))
    machine = Throttle(any_ms, same_ms)
    return fold(rows, machine, ["session_id"], order, carry, bound, idle_ms)
