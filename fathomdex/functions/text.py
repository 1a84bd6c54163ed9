"""Text transforms as column expressions, so that they stay inside Catalyst plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of JavaScript's \s, which Java's \s doesn't cover.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPACES = " \t\n\x0b\x0c\r\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
NO_BREAK = r"[^\n\r\x{2028}\x{2029}]"

# Entities that HTML and office texts decode, in this order.
HTML_ENTITIES = (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"))
OFFICE_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, even where a lambda inside uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(text: Column) -> Column:
    """Without JavaScript white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")



def tidy(text: Column) -> Column:
    """Runs of blanks and tabs become a blank, three or more newlines two; trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def decimal_entities(text: Column) -> Column:
    """Each ``&#n;`` becomes the UTF-16 unit n mod 65536."""
    between = F.split(text, r"&#\d+;", -1)
    unit = lambda n: F.decode(F.unhex(F.lpad(F.hex((n.cast("decimal(38,0)") % 65536).cast("long")), 4, "0")), "UTF-16BE")
    decoded = F.transform(F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1)), unit)
    joined = F.array_join(F.zip_with(between, decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.contains("&#"), joined).otherwise(text)


def html_to_text(html: Column) -> Column:
    # These patterns and what replaces them, in this order.
    x = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style.*?</style>", " ")
    x = F.regexp_replace(x, r"(?i)</(?:p|div|br|li|tr|h[1-6])>", "\n")
    x = F.regexp_replace(x, rf"(?i)<br{SPACE}*/?>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for pattern, to in HTML_ENTITIES:
        x = F.regexp_replace(x, pattern, to)
    return tidy(decimal_entities(x))


def office_xml_to_text(xml: Column) -> Column:
    # These patterns and what replaces them, in this order.
    x = F.regexp_replace(xml, r"<text:tab/?>", "\t")
    x = F.regexp_replace(x, r"<text:line-break/?>|</text:p>|</a:p>|<a:br/?>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for pattern, to in OFFICE_ENTITIES:
        x = F.replace(x, F.lit(pattern), F.lit(to))
    return tidy(decimal_entities(x))


def pages_from_text(text: Column) -> Column:
    """One page without a number, or none if the text is blank."""

    def page(t: Column) -> Column:
        one = F.array(F.struct(F.lit(None).cast("int").alias("page"), t.alias("text")))
        return F.when(t != "", one).otherwise(F.array().cast("array<struct<page: int, text: string>>"))

    return let(trim(F.coalesce(text, F.lit(""))), page)



# The head of a message in chat exports of both mobile systems.
CHAT_HEAD = (
    rf"^{SPACE}*(?:\[)?\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}},?{SPACE}+\d{{1,2}}:\d{{2}}(?::\d{{2}})?{SPACE}*(?:[APap]\.?[Mm]\.?)?{SPACE}*(?:\])?{SPACE}*"
    rf"(?:-{SPACE}*)?([^:]{{1,80}}?):{SPACE}?({NO_BREAK}*)\z"
)
CHAT_LINES, CHAT_SHARE = 40, 0.6


def _lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def chat_heads(text: Column) -> Column:
    """(checked, matched): of the first 40 lines that aren't blank, how many are heads of messages."""
    first = F.slice(F.filter(_lines(text), lambda x: trim(x) != ""), 1, CHAT_LINES)
    return let(first, lambda f: F.struct(F.size(f).alias("checked"), F.size(F.filter(f, lambda x: x.rlike(CHAT_HEAD))).alias("matched")))


def is_chat(text: Column) -> Column:
    return let(chat_heads(text), lambda h: (h["checked"] > 0) & (h["matched"] / h["checked"] >= CHAT_SHARE))


def join_chat(text: Column) -> Column:
    """A line per message: its sender and text; further lines of a message are appended to it.

    A head begins a new line of the result, any other line after the first head
    continues one, so the result is the pieces put together in order.
    """

    def piece(line: Column, i: Column, first: Column) -> Column:
        sender, message = F.regexp_extract(line, CHAT_HEAD, 1), F.regexp_extract(line, CHAT_HEAD, 2)
        before = (first == 0) | (i + 1 < first)
        other = F.when(~before, F.concat(F.lit(" "), trim(line))).when(trim(line) != "", F.concat(F.lit("\n"), trim(line))).otherwise(F.lit(""))
        return F.when(line.rlike(CHAT_HEAD), F.concat(F.lit("\n"), trim(sender), F.lit(": "), message)).otherwise(other)

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["lines"], lambda line, i: piece(line, i, x["first"])), "")

    lines = let(_lines(text), lambda own: F.struct(own.alias("lines"), F.array_position(F.transform(own, lambda x: x.rlike(CHAT_HEAD)), True).alias("first")))
    return F.regexp_replace(let(lines, joined), r"^\n", "")


def plain_text(text: Column) -> Column:
    """Plain text, with chat exports normalised."""
    return F.when(is_chat(text), join_chat(text)).otherwise(text)


def is_header(cells: Column) -> Column:
    """Whether a first row labels its columns: some cell is neither empty nor a number."""
    return F.exists(F.transform(cells, trim), lambda c: (c != "") & ~c.rlike(r"^-?[\d.,]+\z"))


def labelled_row(header: Column, cells: Column) -> Column:
    """``name: value | ...`` for the cells that aren't empty; cells past the header are ignored; null for none."""
    parts = F.zip_with(header, F.slice(cells, F.lit(1), F.size(header)), lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c)))
    return F.nullif(F.array_join(parts, " | "), F.lit(""))


def joined_row(cells: Column) -> Column:
    return F.nullif(trim(F.array_join(cells, " | ")), F.lit(""))




def version_newer(a: Column, b: Column) -> Column:
    """Whether dotted version a is newer than b; parts that aren't numbers, or are missing, count as 0."""

    def parts(v: Column) -> Column:
        return F.transform(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long")))

    x, y = parts(a), parts(b)
    wide = F.greatest(F.size(x), F.size(y))
    pad = lambda p: F.concat(p, F.array_repeat(F.lit(0).cast("long"), wide - F.size(p)))
    return pad(x) > pad(y)
