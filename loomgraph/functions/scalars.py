"""SPARQL's string, number and hash functions over plain values, as Spark columns. NULL in or a wrong operand: NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substr(text: Column, start, length=None) -> Column:
    """From start (1-based, code points); a start below 1 or a negative length is an error."""
    start = start if isinstance(start, Column) else F.lit(start)
    length = F.length(text) if length is None else length if isinstance(length, Column) else F.lit(length)
    return F.when((start >= 1) & (length >= 0), F.substring(text, start, length))


def before(text: Column, mark: Column) -> Column:
    at = F.position(mark, text)
    return F.when(text.isNull() | mark.isNull(), None).when((at > 0) & (F.length(mark) > 0), F.substring(text, F.lit(1), at - 1)).otherwise("")


def after(text: Column, mark: Column) -> Column:
    at = F.position(mark, text)
    return F.when(text.isNull() | mark.isNull(), None).when(F.length(mark) == 0, text).when(at > 0, F.substring(text, at + F.length(mark), F.length(text))).otherwise("")


def encode_for_uri(text: Column) -> Column:
    """Percent-encoding of all but unreserved characters."""
    out = F.url_encode(text)
    for have, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(have), F.lit(want))
    return out


def _flags(pattern: str, flags: str) -> str:
    if set(flags) - set("smixq"):
        raise ValueError(f"unknown flags in {flags!r}")
    if "q" in flags:
        pattern = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    kept = "".join(sorted(set(flags) - {"q"}))
    return f"(?U{kept})" + pattern


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    """REGEX: found anywhere; Unicode classes."""
    return text.rlike(_flags(pattern, flags))


def replaced(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, _flags(pattern, flags), by)


def to_integer(text: Column) -> Column:
    """xsd:integer of a string: no white space, 64 bits, else NULL."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def divided(a: Column, b: Column) -> Column:
    """Integer division gives a decimal in canonical form; by zero NULL."""
    q = F.try_divide(a.cast("decimal(20,0)"), b.cast("decimal(20,0)"))
    text = F.rtrim(q.cast("decimal(38,18)").cast("string"), F.lit("0"))
    return F.when(F.endswith(text, F.lit(".")), F.concat(text, F.lit("0"))).otherwise(text)


def if_else(condition: Column, then: Column, otherwise: Column) -> Column:
    """IF: a condition that is an error gives an error, not the second branch."""
    return F.when(condition, then).when(~condition, otherwise)


def added(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtracted(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiplied(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def lang_matches(language: Column, wanted: str) -> Column:
    """'*' matches any language; otherwise equal or followed by a hyphen, without case."""
    if wanted == "*":
        return F.length(language) > 0
    low = F.lower(language)
    return (low == wanted.lower()) | F.startswith(low, F.lit(wanted.lower() + "-"))


def rounded(number: Column, how: str) -> Column:
    """abs, ceil, floor, or round (halves up, as SPARQL has it)."""
    return {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda n: F.floor(n + F.lit(0.5))}[how](number)


def digest(text: Column, how: str) -> Column:
    """MD5, SHA1, SHA256, SHA384 or SHA512 of a string, in lower-case hex."""
    raw = text.cast("binary")
    return F.md5(raw) if how == "MD5" else F.sha1(raw) if how == "SHA1" else F.sha2(raw, int(how[3:]))


DATE_TIME = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)(Z|[+-][0-9]{2}:[0-9]{2})?$"


def date_part(lexical: Column, part: str) -> Column:
    """year, month, day, hours, minutes, seconds (as written) or tz of an xsd:dateTime, from its lexical form; NULL if it is none."""
    k = {"year": 1, "month": 2, "day": 3, "hours": 4, "minutes": 5, "seconds": 6, "tz": 7}[part]
    found = F.regexp_extract(lexical, DATE_TIME, k)
    return F.when(lexical.rlike(DATE_TIME), found if part in ("seconds", "tz") else found.try_cast("bigint"))


def to_boolean(text: Column) -> Column:
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def to_double(text: Column) -> Column:
    """xsd:double of a string: no white space, INF and NaN as XML writes them."""
    special = F.when(text == "INF", F.lit(float("inf"))).when(text == "-INF", F.lit(float("-inf"))).when(text == "NaN", F.lit(float("nan")))
    return F.coalesce(special, F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double")))


# -- names and keys ----------------------------------------------------------------------------------------


def ni_name(content: Column) -> Column:
    """RFC 6920 name of UTF-8 content: base64url of its SHA-256, no padding."""
    digest = F.base64(F.unhex(F.sha2(content.cast("binary"), 256)))
    return F.concat(F.lit("ni:///sha-256;"), F.rtrim(F.translate(digest, "+/", "-_"), F.lit("=")))


def _escaped(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def rule_name(seed: str, rule: str, inputs: list[Column], optional: list[Column] = ()) -> Column:
    """Version 8 UUID of a naming rule: SHA-256 of seed|rule and the escaped inputs; unbound optional inputs are left out."""
    text = F.concat(F.lit(f"{seed}|{rule}"), *(F.concat(F.lit("|"), _escaped(x)) for x in inputs), *(F.coalesce(F.concat(F.lit("|"), _escaped(x)), F.lit("")) for x in optional))
    h = F.sha2(text.cast("binary"), 256)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def lookup_key(text: Column) -> Column:
    """Values are looked up without surrounding XML white space and without case."""
    return F.lower(F.btrim(text, F.lit(" \t\r\n")))


def stable_label(*parts: Column) -> Column:
    """The first 128 bits of the SHA-256 of parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)


# Characters of RFC 3986.
UNRESERVED, SUB_DELIMITERS = r"A-Za-z0-9\-._~", r"!$&'()*+,;="


def percent_normal(text: Column, lower: bool = False) -> Column:
    """Percent codes of unreserved characters decoded, the hex digits of others in capitals; with lower, all else in small letters."""
    parts = F.regexp_extract_all(text, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    case = F.lower if lower else (lambda c: c)

    def one(part: Column) -> Column:
        char = F.char(F.conv(F.substring(part, 2, 2), 16, 10).cast("long"))
        return F.when(part.rlike("^%[0-9A-Fa-f]{2}"), F.when(char.rlike(f"^[{UNRESERVED}]$"), case(char)).otherwise(F.upper(part))).otherwise(case(part))

    return F.when(F.contains(text, F.lit("%")), F.array_join(F.transform(parts, one), "")).otherwise(case(text))


def without_dot_segments(path: Column) -> Column:
    """A path that is empty or begins with a slash, by RFC 3986 section 5.2.4; empty segments stay."""
    segments = F.split(F.substring(path, 2, 2147483647), "/")
    last = F.element_at(segments, -1)
    start = F.array().cast("array<string>")
    back = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    # One pass from the left: '..' takes the last segment back.
    kept = F.aggregate(segments, start, lambda acc, x: F.when(x == ".", acc).when(x == "..", back(acc)).otherwise(F.array_append(acc, x)))
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path == "", "").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def _ip_literal() -> str:
    """Pattern of what may stand in brackets: an IPv6 address, or a later version's."""
    h = "[0-9A-Fa-f]{1,4}"
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    low = rf"(?:{h}:{h}|{byte}(?:\.{byte}){{3}})"
    forms = [rf"(?:{h}:){{6}}{low}", *(rf"(?:(?:{h}:){{0,{k - 1}}}{h})?::(?:{h}:){{{5 - k}}}{low}" if k else rf"::(?:{h}:){{5}}{low}" for k in range(6))]
    forms += [rf"(?:(?:{h}:){{0,5}}{h})?::{h}", rf"(?:(?:{h}:){{0,6}}{h})?::", rf"[vV][0-9A-Fa-f]+\.[{UNRESERVED}{SUB_DELIMITERS}:]+"]
    return "(?:" + "|".join(forms) + ")"


def normal_base_url(url: Column) -> Column:
    """Scheme and host in small letters, default ports and leading zeros of ports gone, percent codes normal, dot segments and slashes
    at the end gone; NULL for what is no absolute URL with a host, or has user data, a query, a fragment, a blank or control
    character, a host that is no name or address, or a port above 65535."""
    m = rf"^([A-Za-z][A-Za-z0-9+.\-]*)://((?:[{UNRESERVED}{SUB_DELIMITERS}]|%[0-9A-Fa-f]{{2}})+|\[{_ip_literal()}\])(?::([0-9]*))?(/[^?#]*)?$"
    scheme, host, port, path = (F.regexp_extract(url, m, k) for k in (1, 2, 3, 4))
    scheme, digits = F.lower(scheme), F.ltrim(port, F.lit("0"))
    digits = F.when((digits == "") & (port != ""), "0").otherwise(digits)
    default = (digits == "") | ((scheme == "http") & (digits == "80")) | ((scheme == "https") & (digits == "443"))
    fits = (F.length(digits) <= 5) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535)
    tail = F.rtrim(without_dot_segments(percent_normal(path)), F.lit("/"))
    good = url.rlike(m) & ~url.rlike(r"[\x00-\x20\x7F]") & fits
    return F.when(good, F.concat(scheme, F.lit("://"), percent_normal(host, lower=True), F.when(default, "").otherwise(F.concat(F.lit(":"), digits)), tail))
