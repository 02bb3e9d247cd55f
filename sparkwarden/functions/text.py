"""Text functions with Python's meaning, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"
BREAKS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extension(path: Column) -> Column:
    """The last extension with its dot, lower case, '' if there is none; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def lines(texts: DataFrame, key: str, text: str, *carried: str) -> DataFrame:
    """(key, carried columns, line_no from 1, line) of every line; a line break at the end starts no further line; null and empty texts have none."""
    last = F.when(F.endswith(F.col(text), F.lit("\r\n")), 2).when(F.right(F.col(text), F.lit(1)).isin(*BREAKS), 1).otherwise(0)
    whole = F.substring(F.col(text), F.lit(1), F.char_length(text) - last)
    rows = texts.where(F.col(text) != "").select(key, *carried, F.posexplode(F.split(whole, LINE_BREAK)).alias("pos", "line"))
    return rows.select(key, *carried, (F.col("pos") + 1).alias("line_no"), "line")


def host(url: Column) -> Column:
    """The host, '' if the text is no URL with a scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def scheme(url: Column) -> Column:
    """The scheme in lower case, 'http' if there is none."""
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(found == "", "http").otherwise(found)


def host_or_self(url: Column) -> Column:
    """The host in lower case, the text itself if it has none."""
    return F.coalesce(F.nullif(F.lower(host(url)), F.lit("")), url)


def origin(url: Column) -> Column:
    """Scheme and authority, the port included; '' without a scheme."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def join_url(base: Column, path: Column) -> Column:
    """The base without trailing slashes, one slash, the path without leading ones."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def is_https(url: Column) -> Column:
    return scheme(url) == "https"


def quote(c: Column) -> Column:
    """Percent-encoding as for a path: space is %20, '/' stays."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of a string's characters; '' and null have 0."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars)
    return F.coalesce(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: acc - share(x) * F.log2(share(x))), F.lit(0.0))


def unbase64url(c: Column) -> Column:
    """The text that a base64url part holds, null if it is none."""
    padded = F.rpad(F.translate(c, "-_", "+/"), F.ceil(F.length(c) / 4).cast("int") * 4, "=")
    return F.try_to_binary(padded, F.lit("base64")).cast("string")
