"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.schemas import STATUSES
from jobtide.settings import DEBOUNCE_PREFIX, DLQ_PREFIX, IDEMPOTENCY_PREFIX, QUEUE_PREFIX, RATE_PREFIX

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def prefixed(name: Column, prefix: str) -> Column:
    """The name with the prefix once."""
    return F.when(name.startswith(prefix), name).otherwise(F.concat(F.lit(prefix), name))


def queue_key(name: Column) -> Column:
    return prefixed(name, QUEUE_PREFIX)


def dlq_key(name: Column) -> Column:
    return prefixed(name, DLQ_PREFIX)


def rate_limit_key(name: Column) -> Column:
    return prefixed(name, RATE_PREFIX)


def debounce_key(name: Column) -> Column:
    return prefixed(name, DEBOUNCE_PREFIX)


def idempotency_key(name: Column) -> Column:
    """Always with one more prefix, whatever the name starts with."""
    return F.concat(F.lit(IDEMPOTENCY_PREFIX), name)


def epoch_ms(t: Column) -> Column:
    """Milliseconds since the epoch of a naive timestamp, whatever the session's time zone."""
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000 + F.hour(t) * 3_600_000 + F.minute(t) * 60_000 + F.floor(F.extract(F.lit("SECOND"), t) * 1000).cast("long")


def from_ms(ms: Column) -> Column:
    whole = ms.cast("decimal(18,0)").cast("long")
    days = F.floor(whole / 86_400_000)
    return F.expr(EPOCH) + F.make_dt_interval(days=days.cast("int"), secs=((whole - days * 86_400_000) / 1000).cast("decimal(18,6)"))


def plus_seconds(t: Column, seconds: Column) -> Column:
    """Days and the seconds of a day are added apart: the seconds of an interval are too narrow for the range of timestamps."""
    days = F.floor(seconds / 86_400)
    return t + F.make_dt_interval(days=days.cast("int"), secs=(seconds - days * 86_400).cast("decimal(18,6)"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (epoch_ms(later) - epoch_ms(earlier)) / 1000.0


def backoff(retries: Column, base: float, cap: float) -> Column:
    """min(base * 2 ** min(max(retries, 1) - 1, 30), cap)."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(retries, F.lit(1)) - 1, F.lit(30))), F.lit(cap))


def spawn_delay_ms(n: Column) -> Column:
    return F.least(100 * F.pow(F.lit(2.0), F.least(n - 1, F.lit(10))), F.lit(2000.0))


def queue_wait_ms(start: Column, enqueue: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), epoch_ms(start) - epoch_ms(enqueue))


def known_status(s: Column, other: str | None = None) -> Column:
    return F.when(s.isin(*STATUSES), s).otherwise(F.lit(other))


def json_path(path: str) -> str | None:
    """The JSON path of a dotted one; a leading ``params.`` is dropped once; an empty segment gives none."""
    parts = path.removeprefix("params.").split(".")
    return None if any(not p for p in parts) else "$" + "".join(f"['{p}']" for p in parts)


def json_scalar(doc: Column, path: str) -> Column:
    """A non-empty string, number or boolean at a dotted path as text; null for anything else."""
    where = json_path(path)
    if where is None:
        return F.lit(None).cast("string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), where, "variant"))
    text = F.get_json_object(doc, where)
    return F.when(kind.isNotNull() & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID") & (text != ""), text)


def truncate_utf8(s: Column, most: int = 256) -> Column:
    """The longest prefix of whole characters with at most ``most`` bytes."""
    sizes = F.sequence(F.lit(0), F.least(F.length(s), F.lit(most)))
    fits = F.array_max(F.filter(sizes, lambda n: F.octet_length(F.left(s, n)) <= most))
    return F.when(F.octet_length(s) <= most, s).otherwise(F.left(s, fits))


def correlation(params: Column, trace: Column, mappings: dict[str, str], most_keys: int = 16, most_bytes: int = 64) -> Column:
    """The mapped values by key: the trace's non-empty value first, then the parameter at the path; null if there are none."""
    pairs = []
    for key in sorted(k.strip() for k in mappings)[:most_keys]:
        if 1 <= len(key.encode()) <= most_bytes:
            path = next(p for k, p in mappings.items() if k.strip() == key)
            value = F.coalesce(F.nullif(F.element_at(trace, F.lit(key)), F.lit("")), json_scalar(params, path))
            pairs.append((key, truncate_utf8(value)))
    if not pairs:
        return F.lit(None).cast("map<string,string>")
    found = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda k, v: v.isNotNull())
    return F.when(F.size(found) > 0, found)


def merge_trace(caller: Column, span: Column, overwrite: bool) -> Column:
    """Two maps; on a common key the caller's entry stays, or the span's if ``overwrite``."""
    winner, loser = (span, caller) if overwrite else (caller, span)
    empty = F.create_map().cast("map<string,string>")
    winner, loser = F.coalesce(winner, empty), F.coalesce(loser, empty)
    return F.map_concat(winner, F.map_filter(loser, lambda k, v: ~F.array_contains(F.map_keys(winner), k)))


def parse_time(s: Column) -> Column:
    """Epoch seconds of a number or of an RFC 3339 text; null for anything else, dates alone included."""
    number = s.try_cast("double")
    full = s.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.coalesce(number, F.when(full, F.floor(F.unix_millis(F.try_to_timestamp(s))) / 1000.0))


def json_value(s: Column) -> Column:
    """The text if it is JSON other than null in any case; else null."""
    return F.when((F.lower(s) != "null") & F.try_parse_json(s).isNotNull(), s)


def status_text(s: Column) -> Column:
    """In upper case; UNKNOWN for null."""
    return F.upper(F.coalesce(s, F.lit("UNKNOWN")))


def rfc3339(seconds: Column) -> Column:
    """Epoch seconds as a UTC time with its offset, with milliseconds where there are any."""
    ms = F.floor(seconds * 1000)
    t = from_ms(ms)
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(ms % 1000 != 0, F.date_format(t, ".SSS")).otherwise(""), F.lit("+00:00"))


def provisional_lock_ms(timeout: Column, extension: Column) -> Column:
    """(timeout + extension) in milliseconds while a job's own timeout is not known; null where the timeout is not positive, the extension negative, or the sum out of range."""
    total = F.try_multiply(F.try_add(timeout.cast("long"), extension.cast("long")), F.lit(1000).cast("long"))
    return F.when((timeout > 0) & (extension >= 0), total)


def ago(seconds: Column, fallback: Column) -> Column:
    """``Ns ago``, ``Nm ago`` or ``Nh ago`` below a day; else the fallback."""
    n = F.floor(seconds).cast("long")
    text = lambda d, u: F.concat(F.floor(n / d).cast("string"), F.lit(f"{u} ago"))
    return F.when(n < 60, text(1, "s")).when(n < 3600, text(60, "m")).when(n < 86_400, text(3600, "h")).otherwise(fallback)


def duration_text(seconds: Column) -> Column:
    """A length of time in microseconds, milliseconds, seconds, minutes or hours."""
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 0.001, F.format_string("%.0fμs", seconds * 1e6))
        .when(seconds < 1, F.format_string("%.0fms", seconds * 1e3))
        .when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def shortened(s: Column, n: int) -> Column:
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n - 3)), F.lit("...")))


def dsn_summary(dsn: Column) -> Column:
    """A connection string without its user and password."""
    return F.regexp_replace(dsn, r"://[^/@]*@", "://")


def frame(message: Column) -> Column:
    """A message with its length in front, four bytes, big-endian."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(message)), 8, "0")), F.encode(message, "UTF-8"))


def runner_of(function: Column) -> tuple[Column, Column]:
    """(runner or null, handler) of ``runner#handler``, cut at the first #."""
    at = F.instr(function, "#")
    return F.when(at > 1, F.left(function, at - 1)), F.when(at > 0, F.substring(function, at + 1, F.length(function))).otherwise(function)
