"""Lookups, labels and text columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapspan.schema import POSITION_GROUPS, ROLE_CODES


def lookup(codes: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(codes.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def position_code(position: Column) -> Column:
    return lookup(POSITION_GROUPS, position, -1)


def role_code(role: Column) -> Column:
    return lookup(ROLE_CODES, role, -1)


def player_key(pid: Column, ball: str = "ball") -> Column:
    """Integer-like ids lose their decimals, other ids stay as text, null is the ball."""
    text = pid.cast("string")
    whole = text.try_cast("double").try_cast("bigint")
    return F.coalesce(whole.cast("string"), text, F.lit(ball))


def side_of(club: Column, possession: Column) -> Column:
    return F.when(club == possession, "offense").otherwise("defense")


def side_from_prefix(team: Column) -> Column:
    t = F.lower(team)
    return (F.when(t.startswith("off") | t.startswith("home"), "offense")
            .when(t.startswith("def") | t.startswith("away"), "defense"))


def play_type(kneel: Column, spike: Column, result: Column) -> Column:
    return (F.when(F.coalesce(kneel.cast("boolean"), F.lit(False)), "kneel")
            .when(F.coalesce(spike.cast("boolean"), F.lit(False)), "spike")
            .when(result.isin("C", "I", "IN"), "pass")
            .when(result == "S", "sack").when(result == "R", "scramble").otherwise("run"))


def is_touchdown(description: Column) -> Column:
    return F.coalesce(F.upper(description).contains("TOUCHDOWN"), F.lit(False))


def frame_type(frame: Column, snap: Column) -> Column:
    return F.when(frame < snap, "BEFORE_SNAP").when(frame == snap, "SNAP").otherwise("AFTER_SNAP")


def facing(o: Column, direction: Column) -> tuple[Column, Column]:
    """Body angle and where it came from: measured, else direction of travel, else 0."""
    return (F.coalesce(o, direction, F.lit(0.0)),
            F.when(o.isNotNull(), "measured").when(direction.isNotNull(), "from_dir").otherwise("assumed"))


def clean(v: Column, digits: int = 2) -> Column:
    """Rounded number for output; NaN becomes null."""
    return F.when(F.isnan(v), None).otherwise(F.round(v, digits))


def blank_to(v: Column, other: Column) -> Column:
    """``v`` unless it is null or an empty string."""
    return F.coalesce(F.nullif(v, F.lit("")), other)


# Target name in a play description, as published: "pass ... to F.Lastname" (fixed pattern).
TARGET_PATTERN = r"(?:pass|complete|incomplete)[^.]*?\bto\s+([A-Z][A-Za-z'.-]*\.\s?[A-Z][A-Za-z'-]+)"


def named_target(description: Column) -> Column:
    hit = F.regexp_extract(description, TARGET_PATTERN, 1)
    return F.nullif(F.regexp_replace(hit, " ", ""), F.lit(""))


def letters(v: Column) -> Column:
    return F.regexp_replace(F.lower(v), "[^a-z]", "")


def name_matches(short: Column, full: Column) -> Column:
    """Initial and surname agree; either surname may be a prefix of the other."""
    surname = letters(F.regexp_extract(short, r"^[^.]*\.(.*)$", 1))
    parts = F.filter(F.split(F.trim(full), r"\s+"), lambda p: p != "")
    last = letters(F.try_element_at(parts, F.lit(-1)))
    first = letters(F.try_element_at(parts, F.lit(1)))
    initial = letters(F.split(short, r"\.")[0])
    ok = (F.regexp_extract(short, r"^[^.]*\.(.+)$", 1) != "") & (F.size(parts) > 0)
    ok = ok & (last.startswith(surname) | surname.startswith(last))
    return F.coalesce(ok & (F.substring(initial, 1, 1) == F.substring(first, 1, 1)), F.lit(False))


def config_hash(cols: list[str], length: int = 12) -> Column:
    """Short stable hash of the settings a stage depends on."""
    return F.substring(F.sha1(F.to_json(F.struct(*cols))), 1, length)


def problem_list(*checks: tuple[Column, Column | str]) -> Column:
    """Texts of the checks that hold, in order."""
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in checks]))
