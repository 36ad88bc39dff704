"""Column functions of the market models. None depends on the session's time zone; bad input gives null, not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORIGIN = "timestamp_ntz'1970-01-01 00:00:00'"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_to_timestamp(epoch: Column | str) -> Column:
    """The UTC time of epoch seconds, without a zone."""
    return F.expr(_ORIGIN) + F.make_dt_interval(secs=col(epoch).cast("decimal(18,0)"))


def epoch_of(ts: Column | str) -> Column:
    """Whole epoch seconds of a time without a zone, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr(_ORIGIN), col(ts)) / 1_000_000).cast("long")


def epoch_day(epoch: Column | str) -> Column:
    """The UTC date of epoch seconds."""
    return F.date_from_unix_date(F.floor(col(epoch) / 86_400).cast("int"))


def day_gap(start: Column | str, end: Column | str) -> Column:
    return F.datediff(col(end), col(start)).cast("long")


def json_list(text: Column | str) -> Column:
    """The elements of a JSON array of scalars as text; null for anything else."""
    return F.from_json(col(text), "array<string>")


def json_list_guard(text: Column | str) -> Column:
    """Whether a text has the shape of a JSON array that isn't empty."""
    bare = F.ltrim(col(text))
    return F.coalesce((F.left(bare, F.lit(1)) == "[") & (F.trim(col(text)) != "[]"), F.lit(False))


def json_field(text: Column | str, path: str, kind: str) -> Column:
    """A leaf of a JSON text, cast leniently; JSON null and malformed text give null."""
    leaf = F.get_json_object(col(text), path)
    return F.when(leaf != "null", leaf).try_cast(kind)


def json_leaves(text: Column | str, paths: list[str]) -> Column:
    """Leaves of a JSON object (paths of one or two names) as a struct of texts, parsed once; what is missing is null."""
    top: dict[str, list[str]] = {}
    for path in paths:
        name, _, leaf = path.removeprefix("$.").partition(".")
        top.setdefault(name, []).extend([leaf] if leaf else [])
    fields = [f"`{n}` struct<" + ",".join(f"`{x}`:string" for x in leaves) + ">" if leaves else f"`{n}` string" for n, leaves in top.items()]
    return F.from_json(col(text), ", ".join(fields))


def first_of(items: Column | str, field: str) -> Column:
    """A field of the first element of an array of structs; null if there is none."""
    return F.get(col(items), F.lit(0)).getField(field).cast("string")


def iso_timestamp(text: Column | str) -> Column:
    """The UTC time of ISO text, whole seconds; text without a zone is UTC, bad text gives null."""
    t = F.trim(col(text))
    zoned = t.rlike(r"\d:\d\d.*([zZ]|[+-]\d\d(:?\d\d)?)$")
    whole = F.when(t.rlike(r"^\d+-\d+-\d+$"), F.concat(t, F.lit("T00:00:00Z"))).when(zoned, t).otherwise(F.concat(t, F.lit("Z")))
    return epoch_to_timestamp(F.unix_seconds(whole.try_cast("timestamp")))


def plain_timestamp(text: Column | str) -> Column:
    """The UTC time of ``2024-01-02 03:04:05`` or with a ``T``, fractions cut off; anything else gives null."""
    t = F.split_part(F.replace(col(text), F.lit("T"), F.lit(" ")), F.lit("."), F.lit(1))
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), t.try_cast("timestamp_ntz"))


def json_text_list(items: Column | str) -> Column:
    """An array of texts as JSON: separated by ``", "``, and ASCII only."""
    # Pairs of UTF-16 units, as JSON knows them, of characters beyond the printable ASCII ones.
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(c: Column) -> Column:
        out = F.when(c.rlike("^[^ -~]$"), units(c)).otherwise(c)
        for raw, written in short.items():
            out = F.when(c == raw, F.lit(written)).otherwise(out)
        return out

    def one(x: Column) -> Column:
        plain = ~x.rlike(r'[^ -~]|["\\]')
        each = F.transform(F.regexp_extract_all(x, F.lit("(?s)(.)"), 1), escaped)
        return F.when(x.isNull(), "null").otherwise(F.concat(F.lit('"'), F.when(plain, x).otherwise(F.array_join(each, "")), F.lit('"')))

    return F.concat(F.lit("["), F.array_join(F.transform(col(items), one), ", "), F.lit("]"))


def guarded_ratio(part: Column | str, whole: Column | str, digits: int | None = None) -> Column:
    """A quotient as double, rounded if asked for; null where the divisor is null or zero."""
    whole = col(whole)
    ratio = F.when(F.coalesce(whole, F.lit(0)) != 0, col(part).cast("double") / whole)
    return ratio if digits is None else F.round(ratio, digits)


def backoff(streak: Column | str, base: int, most: int) -> Column:
    """Seconds to wait after so many empty runs: doubled each time, up to a limit; a limit of 0 is none."""
    wait = F.lit(max(0, base)) * F.pow(F.lit(2.0), F.greatest(col(streak) - 1, F.lit(0)))
    return (F.least(wait, F.lit(float(most))) if most > 0 else wait).cast("long")


def plausible_token(token: Column | str, denied: tuple[str, ...] = ("open_token", "closed_token", "closed_no_data")) -> Column:
    """Whether a text can be an outcome token: no denied beginning; letters, digits and ``_`` only; with hexadecimal
    digits alone, 30 of them at least; else with a digit or ``_`` among them."""
    t = col(token)
    allowed = ~t.rlike("^(" + "|".join(denied) + ")") if denied else F.lit(True)
    hexadecimal = t.rlike(r"^[0-9a-fA-F]+\z")
    shape = F.when(hexadecimal, F.char_length(t) >= 30).otherwise(t.rlike(r"^[0-9A-Za-z_]+\z") & t.rlike("[0-9_]"))
    return F.coalesce(allowed & shape, F.lit(False))
