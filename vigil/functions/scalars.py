"""Column functions: severity, durations, titles, scores, identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import schemas as S


def lookup(key: Column, table: dict[str, object], default=None) -> Column:
    """A value from a small constant table."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def severity(incident_type: Column, event_count: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW; unknown types and null counts are LOW."""
    out = F.lit("LOW")
    for kind, levels in S.SEVERITY.items():
        for least, level in reversed(levels):
            out = F.when((incident_type == kind) & (event_count >= least), level).otherwise(out)
    return out


def mitre(incident_type: Column) -> Column:
    """The technique of an incident type as a struct; null for unknown types."""
    fields = [lookup(incident_type, {k: v[i] for k, v in S.MITRE.items()}).cast("string").alias(name) for i, name in enumerate(S.MITRE_FIELDS)]
    return F.when(incident_type.isin(*S.MITRE), F.struct(*fields))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; timestamps without zone count as UTC in a UTC session."""
    return F.unix_micros(ts.cast("timestamp"))


def duration(first: Column, last: Column) -> Column:
    """`42s`, `3m 5s` or `2h 7m`."""
    s = F.floor((micros(last) - micros(first)) / 1_000_000).cast("long")
    part = lambda x: x.cast("long").cast("string")
    minutes = F.concat(part(F.floor(s / 60)), F.lit("m "), part(s % 60), F.lit("s"))
    hours = F.concat(part(F.floor(s / 3600)), F.lit("h "), part(F.floor(s % 3600 / 60)), F.lit("m"))
    return F.when(s < 60, F.concat(part(s), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd HH:00")


def score_colour(score: Column) -> Column:
    out = F.lit(S.SCORE_COLOUR_LOW)
    for least, colour in reversed(S.SCORE_COLOUR):
        out = F.when(score >= least, colour).otherwise(out)
    return out


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.65, "high").when(score >= 0.5, "elevated").otherwise("normal")


def title(name: Column) -> Column:
    """`web_flood` as `Web Flood`."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def night(ts: Column, tz_offset_s: Column | None = None) -> Column:
    """1 if the local hour is before six; the offset is the event's own."""
    local = F.timestamp_micros(micros(ts) + F.coalesce(tz_offset_s, F.lit(0)).cast("long") * 1_000_000) if tz_offset_s is not None else ts
    return (F.hour(local) < 6).cast("int")


def port_sample(ports: Column, n: int = 8) -> Column:
    """The first ports, with dots if there are more."""
    return F.concat(F.array_join(F.slice(ports, 1, n).cast("array<string>"), ", "), F.when(F.size(ports) > n, "...").otherwise(""))


def good_text(text: Column, least: int = 20) -> Column:
    """Whether a text is usable prose: at least so many characters besides white space at its ends."""
    return F.coalesce(F.length(F.trim(text)) >= least, F.lit(False))


def token_cost(tokens_in: Column, tokens_out: Column, price: tuple[float, float] = S.TOKEN_PRICE) -> Column:
    return tokens_in / 1_000_000 * price[0] + tokens_out / 1_000_000 * price[1]


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5 identifiers, from SHA-1 in SQL."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
