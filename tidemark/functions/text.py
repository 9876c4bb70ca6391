"""Field extraction and string decoding for audit records, as Column functions.

Patterns carry (?Ud): Unicode classes, and only a line feed ends a line. Absent strings are empty,
never null. The four normalizers differ on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?Ud)"
TYPE = U + r"\btype=(\S+)"
MESSAGE = U + r"\bmsg=audit\((\d+(?:\.\d+)?):(\d+)\)"
#: key=value with a quoted, a parenthesised or a bare value. The quoted form is unrolled and possessive, so long values need no stack.
FIELD = U + r'([^\s=]+)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|\([^)]*\)|\S+)'
PAM = U + r"\bmsg='([^']*)'"
HEX = "^[0-9A-Fa-f]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once and standing once in the plan, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return bind(c, lambda x: F.when(_spaced(x, 1) | _spaced(x, -1), F.regexp_replace(x, U + r"^\s+|\s+$", "")).otherwise(x))


def strip_end(c: Column) -> Column:
    return bind(c, lambda x: F.when(_spaced(x, -1), F.regexp_replace(x, U + r"\s+$", "")).otherwise(x))


def _spaced(c: Column, at: int) -> Column:
    """Whether white space stands first or last: only then is a text searched."""
    return F.substring(c, at, 1).rlike(U + r"\s")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def record_type(line: Column) -> Column:
    return bind(F.regexp_extract(line, TYPE, 1), lambda found: F.when(found == "", "?").otherwise(found))


def audit_header(line: Column) -> Column:
    """A struct of id ("epoch:serial" as written) and epoch (seconds) from the header; null without one."""
    inside = lambda found: F.substring(found, F.lit(11), F.length(found) - 11)  # noqa: E731  msg=audit(...)
    read = lambda x: F.struct(x.alias("id"), F.substring_index(x, ":", 1).try_cast("double").alias("epoch"))
    return bind(F.regexp_extract(line, MESSAGE, 0), lambda found: F.when(found != "", bind(inside(found), read)))


def body_of(line: Column) -> Column:
    """What follows the header, or else the whole line."""
    parts = F.split(line, U + r"\):\s*", 2)
    return F.when(F.size(parts) > 1, parts[1]).otherwise(line)


def entries(blob: Column) -> Column:
    """key=value pairs in order, as structs (k, v). A key holds no equals sign, so the first one parts them."""

    def parted(pair: Column) -> Column:
        return bind(F.substring_index(pair, "=", 1), lambda k: F.struct(k.alias("k"), F.substring(pair, F.length(k) + 2, F.length(pair)).alias("v")))

    return F.transform(F.regexp_extract_all(blob, F.lit(FIELD), 0), parted)


def last_wins(pairs: Column) -> Column:
    """A map of structs (k, v), later ones replacing earlier ones; most records repeat no key."""

    def kept(all_pairs: Column) -> Column:
        rest = lambda i: F.slice(all_pairs, i + 2, F.greatest(F.size(all_pairs) - i - 1, F.lit(0)))
        last = F.filter(all_pairs, lambda e, i: ~F.exists(rest(i), lambda later: later["k"] == e["k"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(all_pairs["k"])) == F.size(all_pairs), all_pairs).otherwise(last))

    return bind(pairs, kept)


def record_entries(line: Column) -> Column:
    """All pairs of a record: the body's parts between group separators, then the inside of msg='...'."""
    body = body_of(line)
    plain = F.flatten(F.transform(F.split(body, "\x1d"), entries))
    return F.concat(plain, entries(F.regexp_extract(body, PAM, 1)))


def parse_fields(blob: Column) -> Column:
    return last_wins(entries(blob))


def record_fields(line: Column) -> Column:
    return last_wins(record_entries(line))


def _quoted(v: Column) -> Column:
    return (F.length(v) >= 2) & v.startswith('"') & v.endswith('"')


def _inside(v: Column) -> Column:
    return F.substring(v, F.lit(2), F.length(v) - 2)


def _unquoted(v: Column) -> Column:
    return F.when(_quoted(v), _inside(v)).when(v.isin("(null)", "(none)"), "").otherwise(v)


def unquote(v: Column) -> Column:
    return bind(text(v), _unquoted)


def decode(v: Column, nul_to_space: bool = True) -> Column:
    """A quoted literal, or hex-encoded bytes read as UTF-8 with replacement characters, or the value itself."""

    def read(x: Column) -> Column:
        is_hex = x.rlike(HEX) & (F.length(x) % 2 == 0)
        raw = F.make_valid_utf8(F.unhex(x).cast("string"))
        shown = strip(F.replace(raw, F.lit("\0"), F.lit(" "))) if nul_to_space else raw
        return F.when(x == "", "").when(_quoted(x), _inside(x)).when(x.isin("(null)", "(none)", "?"), "").when(is_hex, shown).otherwise(x)

    return bind(text(v), read)


def clean(v: Column) -> Column:
    return bind(unquote(v), lambda bare: F.when(bare.isin("?", "unset", "none", "(none)", "(null)", "(unknown)"), "").otherwise(bare))


def field(v: Column) -> Column:
    return clean(decode(v))


def integer(v: Column, default: int) -> Column:
    return F.coalesce(strip(text(v)).try_cast("bigint"), F.lit(default).cast("bigint"))


def unsigned(v: Column) -> Column:
    """The low 32 bits, unsigned."""
    return F.pmod(v, F.lit(4294967296))


def command_line(pairs: Column) -> Column:
    """argv of EXECVE pairs: aN, or the chunks aN[k] decoded one by one and joined, which replace aN."""

    def arguments(entries: Column) -> Column:
        """(i, j, v): j is -1 for a whole argument."""
        own = F.filter(entries, lambda e: e["key"].rlike(r"^a\d{1,9}(\[\d{1,9}\])?\z"))
        chunk = lambda e: F.regexp_extract(e["key"], r"\[(\d+)", 1)
        place = lambda e: F.when(chunk(e) == "", F.lit(-1)).otherwise(chunk(e).try_cast("int"))
        return F.array_sort(F.transform(own, lambda e: F.struct(F.regexp_extract(e["key"], r"^a(\d+)", 1).cast("int").alias("i"), place(e).alias("j"), decode(e["value"], False).alias("v"))))

    def joined(args: Column) -> Column:
        # sorted by i and j: a whole argument goes if a chunk of the same i follows it; a space goes before each i but the first
        kept = F.filter(args, lambda e, n: (e["j"] >= 0) | ~F.coalesce(F.get(args, n + 1)["i"] == e["i"], F.lit(False)))
        spaced = lambda own: F.array_join(F.transform(own, lambda e, n: F.concat(F.when((n > 0) & (F.get(own, n - 1)["i"] != e["i"]), " ").otherwise(""), e["v"])), "")
        return bind(kept, spaced)

    return bind(arguments(F.map_entries(last_wins(pairs))), joined)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def socket_address(raw: Column) -> Column:
    """ip:port or [ip6]:port of a saddr blob; null for other families and for short or bad blobs."""

    def read(h: Column) -> Column:
        good = h.rlike(HEX) & (F.length(h) % 2 == 0) & (F.length(h) >= 8)
        number = lambda at, n: F.conv(F.substring(h, at, n), 16, 10)
        family = F.lower(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)))
        four = F.concat(F.concat_ws(".", *[number(9 + 2 * i, 2) for i in range(4)]), F.lit(":"), number(5, 4))
        groups = [F.regexp_replace(F.lower(F.substring(h, 17 + 4 * i, 4)), "^0{1,3}", "") for i in range(8)]
        six = F.concat(F.lit("["), F.concat_ws(":", *groups), F.lit("]:"), number(5, 4))
        return F.when(good & (family == "0002") & (F.length(h) >= 16), four).when(good & (family == "000a") & (F.length(h) >= 48), six)

    return bind(unquote(raw), read)


def show_epoch(epoch: Column) -> Column:
    """UTC, whole seconds, whatever the session's time zone."""
    seconds = F.floor(epoch).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    clock = [F.lpad(x.cast("string"), 2, "0") for x in (F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)]
    return F.concat(day.cast("string"), F.lit(" "), F.concat_ws(":", *clock))


def event_label(kind: Column, exe: Column, target: Column) -> Column:
    word = F.when(kind == "net-connect", "connect").when(kind == "net-accept", "accept").when(kind == "user-add", "useradd").otherwise(kind)
    return F.concat_ws(" ", word, F.when(kind == "exec", exe).otherwise(target))
