"""Numbers of spreadsheets as they are shown: the format codes that ledgers use.

Serial dates, percentages, digits, thousands and text around them are rendered; of
codes with sections the one for the number's sign is taken. What a code has beyond that
(fractions, colours, conditions) is passed over.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

# The codes that spreadsheets know by number.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;(#,##0)", 39: "#,##0.00;(#,##0.00)",
    40: "#,##0.00;(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_PIECE = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|\[(h+|m+|s+)\]|\[[^\]]*\]|(AM/PM|A/P)|(y+|m+|d+|h+|s+(?:\.0+)?)|(.)', re.I | re.S)


def general(value: float) -> str:
    return f"{value:.11g}".replace("e", "E") if value != int(value) or abs(value) >= 1e11 else str(int(value))


# Codes are few and read once; what is made of them is kept for so many.
_kept = lru_cache(maxsize=1024)


@_kept
def _sections(code: str) -> list[str]:
    return re.findall(r'(?:"[^"]*"|\\.|[^;"\\])+|(?<=;)(?=;|$)', code) or ["General"]


@_kept
def is_date(code: str) -> bool:
    return any(m[5] or m[3] for m in _PIECE.finditer(code)) and "general" not in code.lower()


@_kept
def _ways(code: str) -> list[tuple[str, str]]:
    """Of each section its code and how numbers are shown by it: as they are, as a date or as a number."""
    own = [(x, "general" if x.strip().lower() in ("general", "@", "") else "date" if is_date(x) else "number") for x in _sections(code)]
    return own


def shown(text: str, code: str, since_1904: bool = False) -> str:
    """The number ``text`` under a format code; text that is no number stays."""
    try:
        value = float(text)
    except ValueError:
        return text
    ways = _ways(code)
    own, way = ways[1] if value < 0 and len(ways) > 1 else ways[2] if value == 0 and len(ways) > 2 else ways[0]
    if way == "general":
        return general(value) if own else ""
    if way == "date":
        return _date(value, own, since_1904)
    return _number(abs(value) if len(ways) > 1 else value, own)


@_kept
def _date_pieces(code: str) -> tuple[list[tuple], bool, bool]:
    """(text, field, whole or half of the day, whether it is minutes) of each piece; whether hours go to 12; whether seconds have parts."""
    pieces = [(m[1] if m[1] is not None else m[2] or m[6] or "", m[3], m[4], m[5]) for m in _PIECE.finditer(code)]
    clock = [k for k, p in enumerate(pieces) if p[3] or p[1]]
    out = []
    for k, (plain, total, half, field) in enumerate(pieces):
        minutes = False
        if field and not half and not total:
            place = clock.index(k)
            near = [(pieces[j][3] or pieces[j][1])[0].lower() for j in clock[max(0, place - 1) : place] + clock[place + 1 : place + 2]]
            minutes = field[0].lower() == "m" and len(field) <= 2 and bool((place and near[0] == "h") or near[-1:] == ["s"])
        out.append((plain, total, half, field, minutes))
    return out, any(p[2] for p in pieces), any(p[3] and "." in p[3] for p in pieces)


@lru_cache(maxsize=8192)  # days repeat
def _date(value: float, code: str, since_1904: bool) -> str:
    if value < 0:
        return general(value)
    # 1900 counts as a leap year: serial 60 is a day that never was
    day = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30 if value >= 60 else 31)
    at = day + timedelta(seconds=round(value * 86400, 3))
    pieces, noon, parts = _date_pieces(code)
    if not parts:
        at = (at + timedelta(milliseconds=500)).replace(microsecond=0)
    out = []
    for plain, total, half, field, minutes in pieces:
        if half:
            out.append(("AM", "PM")[at.hour >= 12][: len(half) // 2])
        elif total:
            seconds = round(value * 86400)
            out.append(str({"h": seconds // 3600, "m": seconds // 60, "s": seconds}[total[0].lower()]).zfill(len(total)))
        elif field:
            n, kind = len(field), field[0].lower()
            if minutes:
                out.append(str(at.minute).zfill(n))
            elif kind == "y":
                out.append(f"{at.year % 100:02d}" if n <= 2 else str(at.year))
            elif kind == "m":
                out.append(str(at.month).zfill(n) if n <= 2 else MONTHS[at.month - 1][: {3: 3, 5: 1}.get(n)])
            elif kind == "d":
                out.append(str(at.day).zfill(n) if n <= 2 else DAYS[at.weekday()][: 3 if n == 3 else None])
            elif kind == "h":
                out.append(str((at.hour + 11) % 12 + 1 if noon else at.hour).zfill(n))
            else:
                whole, _, part = field.partition(".")
                out.append(str(at.second).zfill(len(whole)) + (f".{at.microsecond:06d}"[: 1 + len(part)] if part else ""))
        else:
            out.append(plain)
    return "".join(out)


@_kept
def _number_pieces(code: str) -> tuple:
    """The code's text with a null character for the number, its digits, and what they say."""
    literal, digits = [], ""
    for m in _PIECE.finditer(code):
        if m[1] is not None or m[2]:
            literal.append(m[1] if m[1] is not None else m[2])
        elif m[6] and m[6] in "0#?.,":
            digits += m[6]
            literal.append("\0" if len(digits) == 1 else "")
        else:
            literal.append(m[6] or (m[5] or m[4] or ""))
    plain = "".join(literal)
    scale = len(digits) - len(digits.rstrip(","))  # commas at the end divide by thousands
    whole, _, part = digits.rstrip(",").partition(".")
    factor = Decimal(100 if "%" in plain else 1) / 1000**scale if "%" in plain or scale else None
    point = part == "" and "." in digits
    return plain, digits, factor, whole.count("0"), "," in whole, part.count("0"), Decimal(1).scaleb(-len(part)), point


def _number(value: float, code: str) -> str:
    plain, digits, factor, fill, thousands, least, unit, point = _number_pieces(code)
    if "E+" in code.upper():
        places = len(re.search(r"\.(0*)", code)[1]) if "." in code else 0
        mantissa, _, power = f"{value:.{places}E}".partition("E")
        return f"{mantissa}E{power[0]}{power[1:].zfill(2)}"
    if not digits:
        return plain
    exact = Decimal(repr(value))
    rounded = (exact if factor is None else exact * factor).quantize(unit, ROUND_HALF_UP)
    sign = "-" if rounded < 0 else ""
    units, _, rest = f"{abs(rounded):f}".partition(".")
    units = units.lstrip("0").zfill(fill)
    if thousands:
        units = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", units)
    rest = rest[:least] + rest[least:].rstrip("0")
    return sign + plain.replace("\0", units + ("." + rest if rest or point else ""), 1)
