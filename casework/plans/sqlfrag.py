"""Small SQL fragments (DuckDB dialect) shared by the oracle queries."""

from __future__ import annotations

from casework import constants as K


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def filing_utc(c: str) -> str:
    return (f"coalesce(try_strptime({c}, '%Y%m%d%H%M%S'), "
            f"timezone('UTC', try_cast({c} AS TIMESTAMPTZ)))")


def instant_utc(c: str) -> str:
    return f"timezone('UTC', try_cast({c} AS TIMESTAMPTZ))"


def to_local(utc: str) -> str:
    return f"timezone({q(K.LOCAL_TIME_ZONE)}, timezone('UTC', {utc}))"


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def local_with_offset(utc: str) -> str:
    """'yyyy-MM-dd HH:mm:ss-03:00' of a UTC wall clock (null gives 'None')."""
    local = to_local(utc)
    mins = f"date_diff('minute', {utc}, {local})"
    return (f"CASE WHEN {utc} IS NULL THEN 'None' ELSE {ts_text(local)} || "
            f"CASE WHEN {mins} < 0 THEN '-' ELSE '+' END || "
            f"lpad(CAST(CAST(floor(abs({mins}) / 60) AS INTEGER) AS VARCHAR), 2, '0') || ':' || "
            f"lpad(CAST(abs({mins}) % 60 AS VARCHAR), 2, '0') END")


def contains_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def strip_ws(c: str) -> str:
    from casework.functions.text import PY_SPACE_CHARS
    chars = " || ".join(f"chr({ord(ch)})" for ch in PY_SPACE_CHARS)
    return f"trim({c}, {chars})"


def minstd(key: str, seed: int = 42) -> str:
    m = 2147483647
    return f"((({key} + {seed}) % {m}) * 48271) % {m}"
