"""Column functions over strings: tokens, patterns, formats and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    """White-space parts of a query without double quotes, split into tokens; any may match."""
    import re

    return list(dict.fromkeys(t for part in query.split() for t in re.split(r"[\W_]+", part.replace('"', "").lower()) if t))


def contains_like(col: Column, needle: str) -> Column:
    """Case-insensitive substring match in which % and _ stay wildcards and a backslash is itself."""
    return col.ilike("%" + needle.replace("\\", "\\\\") + "%")


def format_bytes_cli(n: Column) -> Column:
    """One decimal in GB, MB or KB, else bytes."""
    return F.when(n >= 1 << 30, F.format_string("%.1f GB", n / float(1 << 30))).when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n >= 1 << 10, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%d B", n.cast("long")))


def format_bytes_web(n: Column) -> Column:
    """Two decimals in GB, one in MB, none in KB."""
    return F.when(n >= 1 << 30, F.format_string("%.2f GB", n / float(1 << 30))).when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).otherwise(F.format_string("%.0f KB", n / 1024.0))


def format_distance(metres: Column) -> Column:
    """Kilometres with one decimal from 1000 m, else whole metres."""
    return F.when(metres >= 1000, F.format_string("%.1f km", metres / 1000.0)).otherwise(F.format_string("%.0f m", metres.cast("double")))


def extension_badge(name: Column) -> Column:
    """Upper-case file extension, or FILE."""
    ext = F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)
    return F.when(ext == "", "FILE").otherwise(F.upper(ext))


def xml_escape(s: Column) -> Column:
    """The five XML entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def percent_encode(s: Column) -> Column:
    """Percent encoding that keeps unreserved characters only."""
    s = F.url_encode(s)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def file_url(path: Column) -> Column:
    """file:// URL with percent signs, spaces, # and ? encoded."""
    for a, b in (("%", "%25"), (" ", "%20"), ("#", "%23"), ("?", "%3F")):
        path = F.replace(path, F.lit(a), F.lit(b))
    return F.concat(F.lit("file://"), path)


def trim_ascii(s: Column) -> Column:
    """Without surrounding blanks and NULs; empty becomes null."""
    t = F.regexp_replace(s, r"^[\x00\s]+|[\x00\s]+$", "")
    return F.when(t != "", t)


def is_sha256(s: Column) -> Column:
    """64 hexadecimal digits of either case."""
    return s.rlike("^[0-9a-fA-F]{64}$")


def is_uuid(s: Column) -> Column:
    return s.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")


def content_path(sha: Column, ext: Column | None = None, root: str = "") -> Column:
    """hh/hh/hash[.ext] below root (SNK16 to SNK18)."""
    path = F.concat_ws("/", *([F.lit(root)] if root else []), F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)
    return path if ext is None else F.when(ext.isNull() | (ext == ""), path).otherwise(F.concat(path, F.lit("."), ext))
