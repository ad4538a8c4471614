"""Text and scalar functions over audit records; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import PLACEHOLDERS, UID_NAMES

#: White space as Python has it, which is more than Java's \s.
SPACE = r"[\s\x1c-\x1f\x85 ]+"
UNSET = 4294967295


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def kv_map(raw: Column) -> Column:
    """key=value tokens as a map; quotes around values go, the last of equal keys counts (the session needs
    spark.sql.mapKeyDedupPolicy = LAST_WIN, see `plans.session`)."""
    tokens = F.filter(F.split(raw, SPACE), lambda t: F.instr(t, "=") > 1)
    value = lambda t: F.regexp_replace(F.substr(t, F.instr(t, "=") + 1), r"^[\"']+|[\"']+$", "")
    return F.map_from_entries(F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1), value(t))))


def audit_stamp(raw: Column) -> tuple[Column, Column]:
    """(epoch with three decimals, sequence) of `audit(EPOCH:SEQ)`, as texts; null if absent."""
    pattern = r"audit\((\d+(?:\.\d+)?):(\d+)\)"
    epoch = F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))
    return epoch.cast("decimal(20,3)").cast("string"), F.nullif(F.regexp_extract(raw, pattern, 2), F.lit(""))


def event_id(raw: Column, iso: Column, sequence: Column) -> Column:
    """EPOCH:SEQ of the raw text, else timestamp:sequence of the structured record, else the sequence alone."""
    epoch, seq = audit_stamp(raw)
    number = F.coalesce(seq, F.nullif(sequence, F.lit("")))
    return F.when(epoch.isNotNull(), F.concat(epoch, F.lit(":"), seq)).when(number.isNotNull(), F.concat_ws(":", F.nullif(iso, F.lit("")), number))


def hex_decode(x: Column) -> Column:
    """Text that is all pairs of hex digits (four at least), decoded; control characters become spaces. Plain words
    that look like hex are decoded too."""

    def read(t: Column) -> Column:
        decoded = F.make_valid_utf8(F.unhex(t).cast("string"))
        return F.when((F.length(t) >= 4) & t.rlike("^([0-9A-Fa-f]{2})+$"), F.trim(F.regexp_replace(decoded, r"[\x00-\x1f]", " "))).otherwise(x)

    return bound(F.trim(x), read)


def strip_control(x: Column) -> Column:
    """Caret notations and control characters become spaces, runs of spaces one; nothing left is null."""
    t = F.regexp_replace(x, r"\^[@A-Z\[\\\]^_]", " ")
    t = F.regexp_replace(t, rf"[\x00-\x1f\x7f{SPACE[1:-2]}]+", " ")
    return bound(F.trim(t), lambda t: F.nullif(t, F.lit("")))


def proctitle(x: Column) -> Column:
    return strip_control(hex_decode(x))


def to_id(x: Column) -> Column:
    """A number; -1 for text that is none and for the unsigned -1."""
    n = F.coalesce(x.try_cast("bigint"), F.lit(-1))
    return F.when(n == UNSET, F.lit(-1)).otherwise(n)


def clean_name(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin(*PLACEHOLDERS), F.nullif(x, F.lit("")))


def basename(x: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(x, "/+$", ""), "/"), -1), F.lit(""))


def uid_name(uid: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in UID_NAMES.items():
        out = F.when(uid == k, F.lit(v)).otherwise(out)
    return out


def success(*maps: Column) -> Column:
    """yes/no of the first map whose `success` or `res` says either."""

    def one(m: Column) -> Column:
        v = F.lower(filled(F.try_element_at(m, F.lit("success")), F.try_element_at(m, F.lit("res"))))
        return F.when(v.isin("yes", "success", "1", "true"), True).when(v.isin("no", "failed", "fail", "0", "false"), False)

    return F.coalesce(*map(one, maps))


def clean_key(x: Column) -> Column:
    """What stands before the first group separator, quote or space."""
    return F.nullif(F.substring_index(F.substring_index(F.substring_index(x, "\x1d", 1), '"', 1), " ", 1), F.lit(""))


def is_private(ip: Column) -> Column:
    """Loopback, private and link-local prefixes, and all of 172."""
    return ip.rlike(r"^(127\.0\.0\.1$|::1$|0\.0\.0\.0$|10\.|192\.168\.|169\.254\.|172\.|fe80|fc|fd)")


def execve_args(fields: Column) -> Column:
    """a0, a1, ... up to the first that is missing: decoded, cleaned, split at spaces. The map is made once, not at
    each look into it."""

    def values(f: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(f))  # one more than there can be
        return F.transform(numbers, lambda i: F.try_element_at(f, F.concat(F.lit("a"), i.cast("string"))))

    def read(found: Column) -> Column:
        before = F.slice(found, F.lit(1), F.array_position(F.transform(found, lambda v: v.isNull()), F.lit(True)).cast("int") - 1)
        return F.flatten(F.transform(before, lambda v: F.split(F.coalesce(proctitle(v), F.lit("")), " ")))

    known = F.coalesce(fields, F.expr("cast(map() as map<string,string>)"))
    return F.filter(bound(bound(known, values), read), lambda a: a != "")


def hex_number(h: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(h, at, digits), 16, 10).cast("bigint")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_text(h: Column) -> Column:
    """32 hex digits as an address: leading zeros go, the first longest run of zero groups becomes '::'."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.regexp_replace(F.substr(h, 1 + 4 * i, F.lit(4)), "^0{1,3}", "")))

    def short(s: Column) -> Column:
        out = F.substr(s, F.lit(2), F.length(s) - 2)
        for n in range(2, 9):
            run = ":" + "0:" * n
            at = F.instr(s, run)
            tail = F.regexp_replace(F.substr(s, at + len(run)), ":$", "")
            out = F.when(at > 0, F.concat(F.substr(s, F.lit(2), F.greatest(at - 2, F.lit(0))), F.lit("::"), tail)).otherwise(out)
        return out

    return bound(F.concat(F.lit(":"), F.array_join(parts, ":"), F.lit(":")), short)


def socket_address(saddr: Column) -> Column:
    """struct(ip, port) of a hex sockaddr: IPv4 or IPv6, else (null, -1)."""

    def read(h: Column) -> Column:
        family = hex_number(h, 1, 2) + 256 * hex_number(h, 3, 2)
        v4 = (family == 2) & (F.length(h) >= 16)
        v6 = (family == 10) & (F.length(h) >= 56)
        dotted = F.concat_ws(".", *(hex_number(h, at, 2).cast("string") for at in (9, 11, 13, 15)))
        ip = F.when(v4, dotted).when(v6, ipv6_text(F.substring(h, 17, 32)))
        return F.struct(ip.alias("ip"), F.when(v4 | v6, hex_number(h, 5, 4)).otherwise(F.lit(-1)).alias("port"))

    return bound(F.when(saddr.rlike("^[0-9A-Fa-f]+$"), F.upper(saddr)), read)


def iso_text(ts: Column) -> Column:
    """ISO 8601 in UTC: six decimals only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(part > 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def title_words(x: Column) -> Column:
    """Each part between underscores with a capital."""
    return F.array_join(F.transform(F.split(x, "_"), F.initcap), "_")


def band(score: Column) -> Column:
    from ..config import BANDS

    out = F.lit("informational")
    for name, least in reversed(BANDS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def rounded(x: Column, digits: int) -> Column:
    """Half up, for positive numbers."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def search_tokens(x: Column) -> Column:
    """Lower-case words, digits and underscores; an inner dot or apostrophe between such characters is kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*"), 0)


def bar(share: Column, width: int = 30) -> Column:
    n = F.round(share * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n))
