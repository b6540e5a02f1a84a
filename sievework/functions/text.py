"""Text columns: extraction, cleaning, search terms, labels. All are native expressions.

Classes such as \\w and \\s are Unicode ones, by (?U), as texts are of many languages.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_quote(literal: str) -> str:
    """A literal inside a Java pattern, whatever it holds."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: White space of any kind; trim() by itself knows blanks only.
WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(x: Column | str, characters: str = WHITE) -> Column:
    """Without white space, or other characters, at both ends."""
    return F.trim(_col(x), F.lit(characters))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it; lambdas share no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def emails(text: Column | str, most: int | None = 10) -> Column:
    """Different addresses in order of appearance, the first `most` or all."""
    text = _col(text)
    every = F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + V.EMAIL), F.lit(0)))
    found = F.when(F.contains(text, F.lit("@")), every).when(text.isNotNull(), F.array().cast("array<string>"))  # most texts have none
    return F.slice(found, 1, most) if most else found


def without_contacts(x: Column) -> Column:
    """Without e-mail addresses and telephone numbers."""
    return F.regexp_replace(F.regexp_replace(x, "(?U)" + V.EMAIL, ""), "(?U)" + V.PHONE, "")


def has_term(text: Column | str, term: str) -> Column:
    """`term` as whole tokens, whatever its case."""
    return _col(text).rlike(r"(?iU)(?<!\w)" + java_quote(term) + r"(?!\w)")


def terms_of(question: Column | str, extra_stop_words: list[str] | tuple = (), most: int = 12) -> Column:
    """Search terms of a question: its quoted phrases or, without any, its telling words in order, repeats included."""
    low = F.lower(_col(question))
    quoted = F.regexp_extract_all(low, F.lit('"([^"]+)"'), F.lit(1))
    stop = F.array(*[F.lit(w) for w in sorted({*V.QUESTION_STOP_WORDS, *(w.lower() for w in extra_stop_words)})])
    words = F.transform(F.regexp_extract_all(low, F.lit(r"(?U)[\w+#.]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"\.+$", ""))
    telling = F.filter(words, lambda w: ~F.array_contains(stop, w) & ~w.rlike(r"^\d+$") & (F.length(w) > 1))
    return F.slice(F.when(F.size(quoted) > 0, quoted).otherwise(telling), 1, most)


def heading_of(line: Column | str) -> Column:
    """The heading that a line is, or null: a known title, or capitals with at most five words, one of them a title."""
    titles = F.array(*[F.lit(t) for t in V.SECTION_TITLES])

    def banner(low: Column) -> Column:
        return let(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda words: F.size(words).between(1, 5) & F.arrays_overlap(words, titles))

    def told(core: Column) -> Column:
        low = F.lower(core)
        shouted = (core == F.upper(core)) & core.rlike("[A-Za-z]")
        return F.when(F.length(core).between(1, 60), F.when(F.array_contains(titles, low), core).when(shouted, F.when(banner(low), core)))

    return let(stripped(F.rtrim(stripped(line), F.lit(":"))), told)


def sheet_safe(x: Column | str) -> Column:
    """Safe in a spreadsheet cell: no control characters but \\n and \\t, 32 000 code points, no formula."""
    clean = F.substring(F.regexp_replace(_col(x), r"[\x00-\x08\x0B-\x1F]", ""), 1, 32000)
    return F.when(clean.rlike(r"(?U)^\s*[=+\-@]") | clean.rlike(r"^[\t\r\n]"), F.concat(F.lit("'"), clean)).otherwise(clean)


def iso_utc(at: Column | str) -> Column:
    """Seconds of a timestamp as ISO 8601 in UTC; empty for null and for the epoch itself."""
    at = _col(at)
    return F.when(at.isNull() | (F.unix_timestamp(at) == 0), "").otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def source_link(file_id: Column | str, prefix: str = "https://drive.google.com/file/d/", suffix: str = "/view") -> Column:
    """T14."""
    return F.concat(F.lit(prefix), _col(file_id), F.lit(suffix))


def token_estimate(x: Column | str) -> Column:
    """A third of the ASCII characters, rounded up, and two for each other one."""
    wide = F.length(F.regexp_replace(_col(x), r"[\x00-\x7F]", ""))
    return (F.floor((F.length(_col(x)) - wide + 2) / 3) + 2 * wide).cast("long")


def location_label(page: Column, start: Column, end: Column, heading: Column) -> Column:
    """T16."""
    plain = F.concat(F.lit("page/part "), page.cast("string"), F.lit(", characters "), start.cast("string"), F.lit("–"), end.cast("string"))
    return F.when(heading.isNull() | (heading == ""), plain).otherwise(F.concat(plain, F.lit(" · section: "), heading))


def content_version(md5: Column, modified: Column, version: Column) -> Column:
    """The first of checksum, time and version that is there; an empty one is not."""
    return F.coalesce(*[F.when(c != "", c) for c in (md5.cast("string"), modified.cast("string"), version.cast("string"))], F.lit(""))


def initials(name: Column | str, most: int = 2) -> Column:
    """First letters of the first words, in capitals."""
    words = F.filter(F.split(_col(name), r"(?U)\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.substring(w, 1, 1)), ""))


def is_identifier(x: Column | str, longest: int = 40) -> Column:
    """Lower-case letters, digits and underscores."""
    return _col(x).rlike("^[a-z0-9_]{1,%d}$" % longest)


def equal_parts(text: Column | str, size: int = 900, most: int = 15) -> Column:
    """All of a text in parts of `size` code points, with weights that add up to 100; no parts if it needs more than `most`."""
    t = _col(text)
    none = F.array().cast("array<struct<part:int,text:string,weight:double>>")
    n = F.ceil(F.length(t) / size).cast("int")
    return F.when(n.between(1, most), F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("part"), F.substring(t, (i - 1) * size + 1, F.lit(size)).alias("text"), (F.lit(100.0) / n).alias("weight")))).otherwise(none)


def suffix_of(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(name), r"(\.[^./\\]+)$", 1))


def is_readable_name(name: Column | str, suffixes: tuple[str, ...] = (".pdf", ".docx", ".txt")) -> Column:
    """A name with one of the suffixes."""
    return suffix_of(name).isin(*suffixes)


def general_number(x: Column) -> Column:
    """A number as %g prints it: six significant digits, no trailing zeros, powers of ten outside 0.0001 to 999999."""
    x = x.cast("double")
    digits = F.format_string("%.5e", x)  # one digit, five more, and the power
    power = F.regexp_extract(digits, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(digits, r"^(.*)e", 1), r"0+$", ""), r"\.$", "")
    plain = F.lit(None).cast("string")
    for p in range(-4, 6):
        plain = F.when(power == p, F.format_string(f"%.{5 - p}f", x)).otherwise(plain)
    short = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")).otherwise(plain)
    large = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(x == 0, "0").when(power.between(-4, 5), short).otherwise(large)


def like_pattern_safe(name: str) -> str:
    """A Python-side check for identifiers that become part of a path or a statement."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name
