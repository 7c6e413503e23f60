"""Text expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at an end, of any kind that Unicode knows; the trim of SQL strips U+0020 only.
_ENDS = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"


def utrim(c: Column) -> Column:
    """Strip white space of any kind at both ends; NULL stays NULL."""
    return F.regexp_replace(c, _ENDS, "")


def non_blank(c: Column) -> Column:
    """Trimmed value, NULL where nothing remains."""
    return F.nullif(utrim(c), F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """First value that isn't blank, trimmed; '' if there is none."""
    return F.coalesce(*[non_blank(c) for c in cols], F.lit(""))


def article_id(url: Column) -> Column:
    """Lower-case hex SHA-1 of the trimmed URL, which is left as it is otherwise."""
    return F.sha1(utrim(url))


def keyword_list(raw: Column) -> Column:
    """Split at commas, trim, drop blanks; NULL where no value remains."""
    parts = F.filter(F.transform(F.split(raw, ","), utrim), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def first_image(images: Column) -> Column:
    """First non-blank ``loc`` of an array of images, trimmed; '' if there is none."""
    locs = F.filter(F.transform(images, lambda x: utrim(x["loc"])), lambda x: x != "")
    return F.coalesce(F.get(locs, F.lit(0)), F.lit(""))


def rfc3339(raw: Column) -> Column:
    """Strict RFC 3339 text as a timestamp (microseconds); NULL for anything else."""
    t = utrim(raw)
    shaped = t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$")
    micro = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.when(shaped, F.try_to_timestamp(micro))


def cut_bytes(c: Column, n: int) -> Column:
    """The first ``n`` bytes of a text's UTF-8 form; a code point that the cut splits is dropped."""
    head = F.substring(F.encode(c, "UTF-8"), 1, n)
    keep = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(c) <= n, c).otherwise(keep)


def feed_snippet(body: Column, n: int = 512) -> Column:
    """Trimmed body, cut after ``n`` bytes with an ellipsis; ``<empty>`` where blank."""
    t = utrim(body)
    return F.when(t == "", F.lit("<empty>")).when(F.octet_length(t) <= n, t).otherwise(F.concat(cut_bytes(t, n), F.lit("...")))


def page_snippet(body: Column, n: int = 1024) -> Column:
    """Trim, then cut after ``n`` bytes."""
    return cut_bytes(utrim(body), n)


def sink_snippet(body: Column, n: int = 512) -> Column:
    """Cut after ``n`` bytes, then trim."""
    return utrim(cut_bytes(body, n))
