"""URL filters: one trie over reversed host labels and path segments, broadcast.

A rule is a host and the beginning of a path. It fits its host and all
subdomains of it when the path of the url starts with the rule's. Of the rules
that fit, the longest (host and path together) wins; of two equally long ones the
longer host, then block. Urls that no rule fits get the default verdict.

Defined cases: null urls and urls without ``://`` have an empty host and path,
fit no rule and get the default; empty tables give empty results; repeated
rows are judged each on its own; all other columns pass through, whatever their
names, unless these are those of the result.
"""

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Characters of rules that one broadcast trie may hold; more rules are judged in several tries, one after another.
TRIE_CHARS = 8_000_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, int, bool]:
        return (len(self.name), len(self.host), self.verdict == "block")


#: The rules that the registered query applies.
RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

# A host node is [children by label, path node or None]; a path node is
# [children by whole segment, [(beginning of the next segment, rule)]].


def build_trie(rules: Sequence[Rule]) -> list:
    root: list = [{}, None]
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, []]
        at = node[1]
        *whole, last = rule.path.split("/")
        for segment in whole:
            at = at[0].setdefault(segment, [{}, []])
        at[1].append((last, rule))
    return root


def best_rule(trie: list, host: str, path: str) -> "Rule | None":
    best = None
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")) if host else ():
        node = node[0].get(label)
        if node is None:
            break
        at = node[1]
        for segment in segments:
            if at is None:
                break
            for beginning, rule in at[1]:
                if segment.startswith(beginning) and (best is None or rule.rank > best.rank):
                    best = rule
            at = at[0].get(segment)
    return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:stop]


def tries(rules: Sequence[Rule], most_chars: int = TRIE_CHARS) -> list[list]:
    """Tries of at most ``most_chars`` characters of rules each (a single longer rule has its own)."""
    groups: list[list[Rule]] = [[]]
    size = 0
    for rule in rules:
        if groups[-1] and size + len(rule.name) > most_chars:
            groups.append([])
            size = 0
        groups[-1].append(rule)
        size += len(rule.name)
    return [build_trie(g) for g in groups]


def _fitting(shared):
    kind = pa.struct([("verdict", pa.string()), ("host", pa.string()), ("path", pa.string())])

    @F.arrow_udf("struct<verdict: string, host: string, path: string>")
    def fit(urls: pa.Array) -> pa.Array:
        found = [best_rule(shared.value, *split_url(u)) for u in urls.to_pylist()]
        return pa.array([r._asdict() if r else None for r in found], kind)

    return fit


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", url: str = "url", most_chars: int = TRIE_CHARS) -> DataFrame:
    """``df`` with the columns host, path, rule (null where none fits) and verdict."""
    sc = df.sparkSession.sparkContext
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    # the caller's columns travel in a struct, so that no name can clash
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0)).alias("_row"), F.col(f"`{url}`").alias("_url"))
    n = 0
    for trie in tries(rules, most_chars):
        out = out.withColumn(f"_best{n}", _fitting(sc.broadcast(trie))(F.col("_url")))
        n += 1
    rank = lambda k: F.struct(
        F.length(f"_best{k}.host") + F.length(f"_best{k}.path"), F.length(f"_best{k}.host"), F.col(f"_best{k}.verdict") == "block", F.col(f"_best{k}").alias("best")
    )
    ranked = [F.when(F.col(f"_best{k}").isNotNull(), rank(k)) for k in range(n)]
    best = F.greatest(*ranked)["best"] if n > 1 else F.col("_best0")
    has = F.instr("_url", "://") > 0
    rest = F.when(has, F.regexp_replace("_url", "^(?s).*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in kept], host.alias("host"), path.alias("path"), F.concat(best["host"], best["path"]).alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), urls AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(v, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS (
  SELECT host, path, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v
  FROM (SELECT DISTINCT host, path FROM urls) u
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, u.host, u.path, rule, coalesce(v, 'allow') AS verdict
FROM urls u LEFT JOIN judged j ON u.host = j.host AND u.path = j.path
"""
