"""Predicates over URL and table-name columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualitas.functions import grammar as G
from qualitas.functions.predicates import whole

_NUMBER = r"^(0[xX][0-9a-fA-F]*|[0-9]+)\z"
# characters that no host may have, and letters or digits that would be mapped to ASCII ones
_NO_HOST = r"[\x00-\x20#/<>?@\[\\\]^|%\x7f]|[\P{ASCII}&&[^\p{L}\p{M}]]|[\uFF00-\uFFEF]"


def _number(part: Column) -> Column:
    """A decimal, octal (leading 0) or hexadecimal (0x) number of an address, or NULL."""
    octal = part.rlike(r"^0[0-9]+\z")
    return (F.when(part.rlike(r"^0[xX]"), F.conv(F.concat(F.lit("0"), F.substring(part, 3, 16)), 16, 10))
            .when(octal & part.rlike(r"^[0-7]+\z"), F.conv(part, 8, 10))
            .when(~octal & part.rlike(r"^[0-9]+\z"), part)).try_cast("long")


def _ipv4(host: Column) -> tuple[Column, Column]:
    """(is numeric, address or NULL): hosts whose last label is a number must be an IPv4 address in 1 to 4 parts."""
    parts = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.")
    numeric = F.element_at(parts, -1).rlike(_NUMBER)
    n = F.size(parts)
    numbers = F.transform(parts, _number)
    sound = (n <= 4) & F.forall(numbers, lambda x: x.isNotNull())
    head, last = F.slice(numbers, 1, n - 1), F.element_at(numbers, -1)
    small = F.forall(head, lambda x: x <= 255) & (last < F.pow(F.lit(256), 5 - n))
    high = F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return numeric, F.when(sound & small, high * F.pow(F.lit(256), 5 - n).cast("long") + last)


def is_public_url(url: Column) -> Column:
    """True for an http(s) URL whose host is neither blocked nor a private IPv4 address.

    The host is taken as a browser's URL parser takes it: white space around and line breaks inside are dropped,
    user information and port are split off (a port above 65535 makes no URL), percent escapes are decoded, and a
    host whose last label is a number is an IPv4 address written in decimal, octal or hexadecimal parts, such as
    2130706433 for 127.0.0.1.  A string without a sound host is not public.
    """
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    scheme = "|".join(G.ALLOWED_URL_SCHEMES)
    authority = F.regexp_extract(text, rf"(?i)^(?:{scheme}):[/\\]*([^/\\?#]*)", 1)
    place = F.regexp_extract(authority, r"^(?:.*@)?(.*)\z", 1)
    shape = r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?\z"
    port = F.regexp_extract(place, shape, 2)
    written = F.regexp_extract(place, shape, 1)
    host = F.lower(F.coalesce(F.try_url_decode(F.replace(written, F.lit("+"), F.lit("%2B"))), F.lit("%")))
    port_ok = (port == "") | (F.length(F.ltrim(port, F.lit("0"))) < 6) & (port.try_cast("long") <= 65535)
    bracketed = host.startswith("[")
    v6_ok = host.rlike(r"^\[[0-9a-f:.]*:[0-9a-f:.]*\]\z") & ~host.rlike(r"^\[[0:]*:0{0,3}[01]\]\z")
    numeric, address = _ipv4(host)
    quad = F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    a, b = F.shiftright(address, 24), F.shiftright(address, 16).bitwiseAND(255)
    private = (a.isin(10, 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
               | ((a == 169) & (b == 254)))
    v4_ok = address.isNotNull() & ~quad.isin(*G.BLOCKED_HOSTS) & ~private
    name_ok = (host != "") & ~host.rlike(_NO_HOST) & ~host.isin(*G.BLOCKED_HOSTS)
    ok = (text.rlike(rf"(?i)^(?:{scheme}):") & place.rlike(shape) & port_ok
          & F.when(bracketed, v6_ok).when(numeric, name_ok & v4_ok).otherwise(name_ok))
    return F.coalesce(ok, F.lit(False))


def is_valid_table_name(name: Column) -> Column:
    return F.coalesce(name.rlike(whole(G.TABLE_NAME_PATTERN)), F.lit(False))
