"""Text functions as Column expressions.

Nulls stay null unless said otherwise. Whitespace and lengths follow the web's rules: whitespace includes
no-break spaces and the byte order mark, a length counts UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the whitespace of the web's scripting language, as a regex class body.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Fixed value: control characters that are dropped or marked (tab and line ends stay).
CONTROL = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F"
#: Fixed value: characters that carry meaning in Markdown.
MARKDOWN = r"\\`*_\[\]{}()#+.!|>~<-"
INLINE_MARKDOWN = r"\\`*_\[\]{}()#+.!|>~-"

Text = Column | str


def _col(value: Text) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def trim(value: Text) -> Column:
    """Without whitespace at both ends (§1.4-2)."""
    return F.btrim(_col(value), F.lit(WS_CHARS))


def utf16_length(value: Text) -> Column:
    """Length in UTF-16 units (§1.4-1)."""
    return (F.octet_length(F.encode(_col(value), "UTF-16BE")) / 2).cast("long")


def decode_entities(value: Text) -> Column:
    """H1: numeric entities and amp, lt, gt, quot, apos, nbsp in one pass; others and impossible numbers stay literal.

    Each part of the text begins with at most one entity, so no decoded text is read again.
    """

    def one(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, r"(?i)^&(#\d+|#x[\da-f]+|amp|lt|gt|quot|apos|nbsp);", 1))
        rest = F.regexp_replace(part, r"^&[^;]*;", "")
        digits = F.regexp_replace(F.regexp_extract(name, r"^#x?([\da-f]+)$", 1), r"^0+(?=.)", "")
        # over eight digits is beyond every code point; conv reads either base
        code = F.when(F.length(digits) > 8, F.lit(None)).when(name.startswith("#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when(name == "", part)
            .when(name == "amp", F.concat(F.lit("&"), rest))
            .when(name == "lt", F.concat(F.lit("<"), rest))
            .when(name == "gt", F.concat(F.lit(">"), rest))
            .when(name == "quot", F.concat(F.lit('"'), rest))
            .when(name == "apos", F.concat(F.lit("'"), rest))
            .when(name == "nbsp", F.concat(F.lit(" "), rest))
            .when(valid, F.concat(char, rest))
            .otherwise(part)
        )

    def decoded(text: Column) -> Column:
        parts = F.split(text, r"(?i)(?=&(?:#\d+|#x[\da-f]+|amp|lt|gt|quot|apos|nbsp);)")
        # most texts hold no entity and skip the parts
        return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)

    return let(_col(value), decoded)


def escape_raw_html(value: Text) -> Column:
    """H2: ampersand and angle brackets as entities."""
    return F.replace(F.replace(F.replace(_col(value), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_inline_markdown(value: Text) -> Column:
    """H3: a backslash before the special characters of a line."""
    return F.regexp_replace(_col(value), rf"([{INLINE_MARKDOWN}])", r"\\$1")


def _visible(html: Column) -> Column:
    """Tags out, with line ends in place of breaks and block ends."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?\s*>|</p>|</div>", "\n")
    return F.regexp_replace(out, r"<[^>]+>", "")


def strip_html(value: Text) -> Column:
    """H4: visible text, escaped again so that no tag can come back; null gives an empty text."""
    out = escape_raw_html(decode_entities(_visible(F.coalesce(_col(value), F.lit("")))))
    return trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def clean_text(value: Text) -> Column:
    """H5: readable text: ``strip_html`` decoded again, without control characters."""
    return F.regexp_replace(decode_entities(strip_html(value)), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def terminal_safe(value: Text) -> Column:
    """H6: without control characters but tab and line ends."""
    return F.regexp_replace(_col(value), f"[{CONTROL}]", "")


def token_range(chars: Text) -> Column:
    """H7: the estimated range of tokens of a number of characters."""
    n = _col(chars).cast("double")
    return F.struct(F.floor(n / 2.2 + 0.5).cast("long").alias("tokmin"), F.floor(n / 1.4 + 0.5).cast("long").alias("tokmax"))


def safe_text(value: Text) -> Column:
    """H8: one safe line."""
    return trim(F.regexp_replace(escape_raw_html(F.coalesce(_col(value), F.lit(""))), r"[\r\n]+", " "))


def collapse_whitespace(value: Text) -> Column:
    """Runs of whitespace as one space, none at the ends."""
    return trim(F.regexp_replace(F.translate(_col(value), WS_CHARS, " " * len(WS_CHARS)), " {2,}", " "))


def normalize_author(value: Text) -> Column:
    """An author's name for comparison; null gives an empty name."""
    return F.lower(collapse_whitespace(F.coalesce(_col(value), F.lit(""))))


def normalize_html(value: Text) -> Column:
    """H9: the visible text for comparison, on one line."""
    return collapse_whitespace(decode_entities(_visible(F.coalesce(_col(value), F.lit("")))))


def mask_paths(value: Text) -> Column:
    """Absolute paths of either kind of system as ``[path]``, paths within URLs kept."""
    out = F.regexp_replace(_col(value), r"(?i)(?<![a-z0-9])[a-z]:[\\/](?!/)[^\s\"'<>|，。；]*", "[path]")
    return F.regexp_replace(out, r"(?<![\w:/.\]])/(?:[\w.\-]+/)+[\w.\-]*", "[path]")


def longest_backtick_run(value: Text) -> Column:
    """Length of the longest run of backticks, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(_col(value), F.lit("`+"), 0), F.length)), F.lit(0)).cast("int")


def count_lines(value: Text) -> Column:
    """0 for an empty text, else line ends plus 1; null counts as empty."""
    text = F.coalesce(_col(value), F.lit(""))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def neutralize_lines(value: Text) -> Column:
    """No line may become a heading rule or indented code: a line of equals signs is escaped, a leading blank becomes a no-break space."""

    def one(line: Column) -> Column:
        ruled = F.when(line.rlike(rf"^ {{0,3}}=+[{WS}]*\z"), F.regexp_replace(line, "^( {0,3})=", r"$1\\=")).otherwise(line)
        return F.regexp_replace(ruled, r"^[ \t]", "\u00a0")

    return F.array_join(F.transform(F.split(_col(value), "\n"), one), "\n")


def escape_markdown(value: Text) -> Column:
    """Untrusted text for Markdown: special characters escaped, control characters marked, lines neutralised; null gives ''."""
    escaped = F.regexp_replace(F.coalesce(_col(value), F.lit("")), rf"([{MARKDOWN}])", r"\\$1")
    return neutralize_lines(F.regexp_replace(escaped, f"[{CONTROL}]", "\ufffd"))


def format_time(seconds: Text) -> Column:
    """Unix seconds as local time of Shanghai; null and 0 give the mark for unknown."""
    s = _col(seconds)
    shown = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.timestamp_seconds(s).cast("timestamp_ntz")), "yyyy/M/d HH:mm:ss")
    return F.when(s.isNull() | (s == 0), "(未知)").otherwise(shown)


def numeric_or(value: Text, fallback: float) -> Column:
    """A finite number read from a text, else the fallback. Hexadecimal and boolean texts count as no number."""
    number = _col(value).try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(fallback)).otherwise(number)


def thousands(value: Text) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(_col(value), 0)


def answer_url(question: Text, answer: Text, base: str) -> Column:
    """The address of an answer below ``base``."""
    return F.concat(F.lit(base.rstrip("/") + "/question/"), _col(question), F.lit("/answer/"), _col(answer))


def valid_id(value: Text) -> Column:
    """An id of 1 to 20 digits."""
    return _col(value).rlike(r"\A[0-9]{1,20}\z")


def question_id(value: Text) -> Column:
    """The id in a bare number or in an address with ``question/<digits>``; otherwise null."""
    text = trim(value)
    found = F.regexp_extract(text, r"(?:\A|question/)([0-9]{1,20})(?:\z|[/?#].*\z)", 1)
    return F.when(found == "", F.lit(None)).otherwise(found)
