"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. A battery of randomness tests adds
spans of kind ``random``: for every run of 20 or more base-64 characters the
encoding is inferred (the first of ``ENCODINGS`` that holds all its characters), and
the run is held against a uniform source over that alphabet by

* a chi-squared test of the symbol counts (upper tail, by the cube-root normal approximation),
* a runs test of the symbols' upper and lower half of the alphabet (two-sided),
* a serial-correlation test of neighbouring symbols (two-sided).

The least of the three p-values, times three, is the battery's p-value of a run. False
discoveries are controlled twice, per length octave over the runs of all documents,
each time by the Benjamini-Hochberg rule on a histogram of p-values:

1. Runs that the battery rejects at ``ALPHA`` aren't random; among those given up so,
   a share of ALPHA at most is random.
2. Short runs of text may pass the battery for want of symbols, so what remains must also be
   unlike text. Under text, character classes follow each other as in ``FOLLOWS`` (among
   those the encoding has), letters come as often as in European languages, and digits are
   uniform. The probability of the run under text over that under the uniform source is its
   p-value (by Markov's inequality text has a quotient of p or less with probability p at
   most); rejected runs count as never found. Runs that pass at ``FALSE_DISCOVERIES`` are found.

Digits alone can't be told from ordinary numbers.

Work is linear in a text but for the lists of its matches: these are made in chunks, at a cost
of the power 4/3 of their number.

Defined cases: null and empty texts have no span and the digest of the empty
string; repeated rows get the same answer; an empty table gives an empty result; the
input's columns pass through ``scan`` whatever their names, unless these are ``_base``
or ``_added``. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, read_table, staged

# The patterns of the base kinds, as the contract states them.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Kind, what a text must hold for the kind to occur, pattern, group to measure, least length of that group.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16}", ACCESS, 0, 20),
    ("hex", r"[0-9a-f]{24}", r"[0-9a-f]{24,}", 0, 24),
)
RUN = r"[A-Za-z0-9+/_-]{20,}"

UPPER, LOWER, DIGITS, SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/-_"
#: Pattern, alphabet, number of symbols. Base 64 has either + and / or - and _, so 64 symbols of these 66.
ENCODINGS = (
    ("[0-9]", DIGITS, 10), ("[0-9a-f]", DIGITS + LOWER[:6], 16), ("[0-9A-F]", DIGITS + UPPER[:6], 16), ("[a-z]", LOWER, 26), ("[A-Z]", UPPER, 26),
    ("[A-Z2-7]", UPPER + DIGITS[2:8], 32), ("[a-z2-7]", LOWER + DIGITS[2:8], 32), ("[A-Z0-9]", UPPER + DIGITS, 36), ("[a-z0-9]", LOWER + DIGITS, 36),
    ("[A-Za-z]", UPPER + LOWER, 52), ("[A-Za-z0-9]", UPPER + LOWER + DIGITS, 62), ("[A-Za-z0-9+/_-]", UPPER + LOWER + DIGITS + SIGNS, 64),
)

ALPHA = 0.01
#: How classes follow each other in text and identifiers: from upper, lower, digit and sign to the same.
FOLLOWS = ((0.45, 0.45, 0.05, 0.05), (0.05, 0.85, 0.05, 0.05), (0.05, 0.05, 0.85, 0.05), (0.3, 0.3, 0.3, 0.1))
#: Letters in 1000, about the mean of English, German, French and Spanish.
LETTERS = (84, 16, 32, 45, 140, 14, 19, 30, 68, 4, 6, 45, 28, 76, 62, 19, 6, 66, 74, 68, 40, 12, 11, 2, 8, 5)
FALSE_DISCOVERIES = 0.01
#: Bins of -log10(p); all below 10 ** -(BINS / PER_DECADE) share the last one.
PER_DECADE, BINS = 8, 1600

SPAN, MATCH = "array<struct<start: int, rank: int, end: int>>", "array<struct<start: int, end: int, s: string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each item ``out`` (an array of ``kind``) of what ``step`` has accumulated before it and of the item.

    The items are taken in chunks, as an array that grows is copied each time: with n of them in chunks of the cube
    root of 2 n, about n to the power 4/3 items are copied.
    """

    def each(chunk: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("acc"), F.array().cast(kind).alias("out"))
        return F.aggregate(chunk, start, lambda a, x: F.struct(step(a["acc"], x).alias("acc"), F.concat(a["out"], F.array(out(a["acc"], x))).alias("out")), lambda a: a["out"])

    def whole(chunks: Column) -> Column:
        start = F.struct(zero.alias("acc"), F.array(zero).alias("begins"))

        def on(a: Column, chunk: Column) -> Column:
            return _let(F.aggregate(chunk, a["acc"], step), lambda after: F.struct(after.alias("acc"), F.concat(a["begins"], F.array(after)).alias("begins")))

        begins = F.aggregate(chunks, start, on, lambda a: a["begins"])
        return F.flatten(F.zip_with(chunks, F.slice(begins, F.lit(1), F.size(chunks)), each))

    def cut(all_items: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.cbrt(2 * F.size(all_items)))).cast("int")
        last = F.greatest(F.lit(0), F.ceil(F.size(all_items) / size).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_items, k * size + 1, size))

    return _let(items, lambda all_items: _let(cut(all_items), whole))


def _matches(text: Column, pattern: str) -> Column:
    """The matches, leftmost and non-overlapping, as (start, end, s): the pieces between them give their places."""

    def placed(whole: Column) -> Column:
        zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("before"), whole.alias("s"))
        step = lambda at, x: at + F.length(x["before"]) + F.length(x["s"])
        out = lambda at, x: F.struct((at + F.length(x["before"])).alias("start"), step(at, x).alias("end"), x["s"].alias("s"))
        return running(zipped, F.lit(0), step, out, MATCH)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _spans(text: Column, there: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """The matches of one kind as (start, rank, end)."""
    measured = lambda x: F.length(F.regexp_extract(x["s"], pattern, group) if group else x["s"])
    found = F.filter(_matches(text, pattern), lambda x: measured(x) >= least)
    found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    return F.when(text.rlike(there), found).otherwise(F.array().cast(SPAN))


#: The class of a symbol c: 1 upper, 2 lower, 3 digit, 4 sign.
KIND = "CASE WHEN c BETWEEN 'A' AND 'Z' THEN 1 WHEN c BETWEEN 'a' AND 'z' THEN 2 WHEN c BETWEEN '0' AND '9' THEN 3 ELSE 4 END"


def _text_costs() -> tuple[list[float], list[float]]:
    """-ln of the share of each of the 66 symbols in its class, and of each step of classes by encoding: 16 of each."""
    letters = [-math.log(x / sum(LETTERS)) for x in LETTERS]
    steps = []
    for _, alphabet, _ in ENCODINGS:
        there = [bool(set(c) & set(alphabet)) for c in (UPPER, LOWER, DIGITS, SIGNS)]
        for row in FOLLOWS:
            total = sum(x for x, t in zip(row, there) if t)
            steps += [-math.log(x / total) for x in row]
    return [*letters, *letters, *[math.log(10)] * 10, *[math.log(4)] * 4], steps


def _normal_tail(z: str) -> str:
    """The upper tail of the normal distribution, to about 1e-4."""
    return f"(1 / (1 + exp(least(700D, 1.5976D * ({z}) + 0.07056D * pow({z}, 3)))))"


def _tested(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_tests``: (start, end, octave, level, bin) of each run, the bins of -log10 of the battery's p-value and of that under text."""
    df = df.withColumn("_r0", F.when(text.rlike(RUN), _matches(text, RUN)).otherwise(F.array().cast(MATCH)))
    symbols = f"locate(c, '{UPPER + LOWER + DIGITS + SIGNS}')"
    own, steps = (f"array({', '.join(f'{x:.6f}D' for x in costs)})" for costs in _text_costs())
    names = " ".join(f"WHEN x.s RLIKE '^{pattern}+$' THEN {k}" for k, (pattern, _, _) in enumerate(ENCODINGS, 1))
    alphabets, sizes = "array({})".format(", ".join(f"'{a}'" for _, a, _ in ENCODINGS)), "array({})".format(", ".join(str(k) for _, _, k in ENCODINGS))
    stages = [
        f"""transform({{}}, x -> struct(x.start AS start, x.end AS end, x.s AS s, length(x.s) AS n, CASE {names} END AS code))""",
        f"""transform({{}}, x -> struct(x.start AS start, x.end AS end, x.n AS n, x.code AS code, element_at({sizes}, x.code) AS k, x.s AS s, element_at({alphabets}, x.code) AS alphabet))""",
        f"""transform({{}}, x -> struct(x.start AS start, x.end AS end, x.n AS n, x.k AS k,
             aggregate(array_distinct(split(x.s, '')), 0D, (a, c) -> a + pow(x.n - length(replace(x.s, c, '')), 2)) AS squares,
             aggregate(split(x.s, ''),
               struct(0D AS prev, 0D AS sx, 0D AS sxx, 0D AS sxy, 0D AS hi, 0D AS runs, 0D AS cost, 0 AS kind),
               (a, c) -> struct(
                 CAST(locate(c, x.alphabet) AS DOUBLE) AS prev,
                 a.sx + locate(c, x.alphabet) AS sx,
                 a.sxx + pow(locate(c, x.alphabet), 2) AS sxx,
                 a.sxy + a.prev * locate(c, x.alphabet) AS sxy,
                 a.hi + IF(locate(c, x.alphabet) > x.k / 2, 1D, 0D) AS hi,
                 a.runs + IF(a.prev = 0 OR (a.prev > x.k / 2) <> (locate(c, x.alphabet) > x.k / 2), 1D, 0D) AS runs,
                 a.cost + element_at({own}, {symbols}) + IF(a.kind = 0, 0D, element_at({steps}, 16 * (x.code - 1) + 4 * (a.kind - 1) + {KIND})) AS cost,
                 {KIND} AS kind)) AS t))""",
        """transform({}, x -> struct(x.start AS start, x.end AS end, x.n AS n, x.k - 1D AS df, x.t.cost - x.n * ln(x.k) AS ratio,
             greatest(1e-9D, x.k * x.squares / x.n - x.n) AS chi2,
             1 + 2 * x.t.hi * (x.n - x.t.hi) / x.n AS runs_mean, x.t.runs AS runs,
             (x.n * x.t.sxy - x.t.sx * x.t.sx) / greatest(1e-9D, x.n * x.t.sxx - x.t.sx * x.t.sx) * sqrt(x.n) AS serial))""",
        """transform({}, x -> struct(x.start AS start, x.end AS end, x.n AS n, x.ratio AS ratio,
             (pow(x.chi2 / x.df, 1 / 3D) - (1 - 2 / (9 * x.df))) / sqrt(2 / (9 * x.df)) AS z1,
             abs(x.runs - x.runs_mean) / sqrt(greatest(1e-9D, (x.runs_mean - 1) * (x.runs_mean - 2) / (x.n - 1))) AS z2,
             abs(x.serial) AS z3))""",
        f"""transform({{}}, x -> struct(x.start AS start, x.end AS end, CAST(floor(log2(x.n)) AS INT) AS octave,
             CAST(least({BINS}, floor(-{PER_DECADE} * log10(least(1D, greatest(1e-300D, 3 * least({_normal_tail("x.z1")}, 2 * {_normal_tail("x.z2")}, 2 * {_normal_tail("x.z3")})))))) AS INT) AS level,
             CAST(greatest(-1, least({BINS}, floor({PER_DECADE} / ln(10D) * x.ratio))) AS INT) AS bin))""",
    ]
    expr = "_r0"
    for s in stages:
        expr = s.format(expr)
    return df.withColumn("_tests", F.expr(expr)).drop("_r0")


def passing_bins(tests: DataFrame, which: str, rate: float) -> dict[int, int]:
    """Per octave of length the least bin that passes the Benjamini-Hochberg rule. The table that is collected has at most 32 x BINS rows."""
    hist = tests.groupBy("octave", which).count()
    by: dict[int, dict[int, int]] = {}
    for octave, b, n in hist.collect():
        by.setdefault(octave, {})[b] = n
    out = {}
    for octave, bins in by.items():
        m, seen, least = sum(bins.values()), 0, BINS + 1
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            seen += bins[b]
            if math.pow(10, -b / PER_DECADE) <= rate * seen / m:  # the largest p-value of the bin
                least = b
        out[octave] = least
    return out


def _limit(bins: dict[int, int], octave: Column) -> Column:
    """The limit of a run's octave."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in bins.items() for v in kv])[octave], F.lit(BINS + 1)) if bins else F.lit(BINS + 1)


def _apart(base: Column, runs: Column) -> Column:
    """The runs that overlap no base span; both are sorted."""
    mark = lambda rank: lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))
    is_base = lambda x: x["rank"] == 0

    def flagged(both: Column) -> Column:
        covered = running(both, F.lit(0), lambda end, x: F.when(is_base(x), F.greatest(end, x["end"])).otherwise(end), lambda end, x: end > x["start"], "array<boolean>")
        far = F.lit((1 << 31) - 1)
        nearest = running(F.reverse(both), far, lambda at, x: F.when(is_base(x), x["start"]).otherwise(at), lambda at, x: at < x["end"], "array<boolean>")
        clear = F.zip_with(covered, F.reverse(nearest), lambda a, b: ~a & ~b)
        kept = F.filter(F.arrays_zip(both.alias("x"), clear.alias("clear")), lambda p: p["clear"] & ~is_base(p["x"]))
        return F.transform(kept, lambda p: F.struct(p["x"]["start"].alias("start"), F.lit(len(BASE)).alias("rank"), p["x"]["end"].alias("end")))

    alone = F.transform(runs, mark(len(BASE)))
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), alone).otherwise(_let(F.array_sort(F.concat(F.transform(base, mark(0)), F.transform(runs, mark(1)))), flagged))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``_base`` and ``_added``: arrays of (start, rank, end), sorted; rank 3 is the battery's."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(packed(docs.drop(text, "_base", "_added")) if len(docs.columns) > 1 else F.lit(0).alias("_row"), F.col(f"`{text}`").alias("_text"))
    base = F.concat(*[_spans(whole, there, pattern, group, least, rank) for rank, (_, there, pattern, group, least) in enumerate(BASE)])
    narrow = staged(_tested(rows.withColumn("_base", F.array_sort(base)), whole).select("_row", "_base", "_tests"), "secrets")
    runs = narrow.select(F.explode("_tests").alias("t")).select("t.*")
    rejected = passing_bins(runs, "level", ALPHA)
    judged = lambda x: F.when(x["level"] >= _limit(rejected, x["octave"]), -1).otherwise(x["bin"])
    runs = runs.withColumn("bin", F.when(F.col("level") >= _limit(rejected, F.col("octave")), -1).otherwise(F.col("bin")))
    least = passing_bins(runs, "bin", FALSE_DISCOVERIES)
    found = F.filter("_tests", lambda x: judged(x) >= _limit(least, x["octave"]))
    out = narrow.withColumn("_added", _apart(F.col("_base"), found))
    return out.select("_row.*" if len(docs.columns) > 1 else F.lit(0), "_base", "_added")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(kinds, s["rank"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("_base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *[count(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(BASE)],
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
    )
