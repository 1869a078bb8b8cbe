"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is filed under one literal token that any URL it fits must contain:
the one that the fewest URLs of the table contain. A URL is cut into tokens,
each token fetches the rules filed under it, and only those are tried: a host
and path rule by comparing both, a pattern by its regular expression. Up to
``INLINE_RULES`` rules the index is a constant array of hash buckets inside the
expression, so the judgement is one scan with a projection, without a join or
a shuffle. Longer lists are a table that the distinct URLs' tokens are joined
with. Either way no Python runs on rows; counting the tokens is a scan before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Rules that the plan itself carries at most; more are joined as a table.
INLINE_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "struct<token:string,host:string,path:string,regex:string,name:string,action:string,tier:int,length:int>"


@dataclass(frozen=True)
class UrlRule:
    """``regex`` runs on host + path, else ``host`` and ``path`` are compared; ``tokens`` are whole tokens that every fitting URL has."""

    action: str
    name: str
    tokens: tuple[str, ...]
    regex: str | None = None
    host: str | None = None
    path: str | None = None
    tier: int = 0


def _whole_tokens(literal: str, open_start: bool, open_end: bool) -> list[str]:
    """Maximal [a-z0-9]+ runs, without those that a longer token of the URL may contain."""
    low = literal.translate(str.maketrans(_UPPER, _LOWER))
    return [
        m[0] for m in re.finditer("[a-z0-9]+", low)
        if not (open_start and m.start() == 0) and not (open_end and m.end() == len(low))
    ]


def host_path_rule(action: str, rule: str) -> UrlRule:
    """``host/path``: fits the host and all its subdomains where the URL's path starts with the path."""
    host, slash, path = rule.partition("/")
    host, path = host.translate(str.maketrans(_UPPER, _LOWER)), slash + path
    tokens = _whole_tokens(host, False, False) + _whole_tokens(path, False, True)
    return UrlRule(action, rule, tuple(tokens), host=host, path=path, tier=1)


def wildcard_rule(action: str, pattern: str) -> UrlRule:
    """``*`` stands for any text; the pattern has to fit the whole of host + path."""
    parts = pattern.split("*")
    tokens = [
        t for i, p in enumerate(parts)
        for t in _whole_tokens(p, open_start=i > 0, open_end=i < len(parts) - 1)
    ]
    return UrlRule(action, pattern, tuple(tokens), regex="(?s)^" + ".*".join(map(re.escape, parts)) + "$")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased. Path: then up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(subject, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def _bucket(token: str, n: int) -> int:
    return xxhash.xxh64_intdigest(token.encode(), seed=42) & (n - 1)


def token_counts(urls: DataFrame, rules: Sequence[UrlRule]) -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs; as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    wanted_col = F.from_json(F.lit(json.dumps(wanted)), "array<string>")
    rows = urls.select(F.explode(F.array_intersect("_tokens", wanted_col)).alias("t")).groupBy("t").count().collect()
    return dict.fromkeys(wanted, 0) | {r["t"]: r["count"] for r in rows}


def judge_urls(
    df: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to each row (only ``columns`` of the input are kept if given).

    Of the rules that fit, the higher tier wins, then the longer name, then
    ``block``, then the name. No rule: ``rule`` is null, the verdict
    ``default``. ``rule`` names only rules of tier 1 (host and path); a pattern
    of tier 0 gives the verdict alone and its name in ``pattern``. A null or
    malformed URL has an empty host and path. Repeated rows are judged one by
    one; an empty table gives an empty table. Input columns named like an
    output column are replaced.
    """
    kept = [c for c in (df.columns if columns is None else columns) if c not in ("host", "path", "rule", "pattern", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`"))
    base = df.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    counts = token_counts(base.select(_tokens(F.concat("host", "path")).alias("_tokens")), rules)
    filed = [(min(r.tokens, key=lambda t: (counts[t], t), default=None), r) for r in rules]
    entries = [{"token": t, "host": r.host, "path": r.path, "regex": r.regex, "name": r.name, "action": r.action, "tier": r.tier, "length": len(r.name)} for t, r in filed]
    (own,) = fresh(base, "_best")
    judged = base.withColumn(own, _indexed(entries)) if len(rules) <= INLINE_RULES else _looked_up(base, entries, own)
    best = lambda f: F.col(f"`{own}`.{f}")
    return judged.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path",
        F.when(best("tier") == 1, best("name")).alias("rule"),
        F.when(best("tier") == 0, best("name")).alias("pattern"),
        F.coalesce(best("action"), F.lit(default)).alias("verdict"),
    )


def _fits(get) -> Column:
    """Whether the rule whose fields ``get`` gives fits the row's host and path."""
    host, path = F.col("host"), F.col("path")
    named = ((host == get("host")) | host.endswith(F.concat(F.lit("."), get("host")))) & path.startswith(get("path"))
    return F.when(get("regex").isNull(), named).otherwise(F.regexp_like(F.concat("host", "path"), get("regex")))


def _rank(get) -> Column:
    return F.struct(get("tier").alias("tier"), get("length").alias("length"), (get("action") == "block").alias("block"), get("name").alias("name"), get("action").alias("action"))


def _indexed(entries: list[dict]) -> Column:
    """The best fitting rule, from a constant array of hash buckets."""
    size = 16
    while size < 2 * len(entries):
        size *= 2
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for e in entries:
        if e["token"] is not None:
            buckets[_bucket(e["token"], size)].append(e)
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_RULE}>>")
    fetched = F.flatten(F.transform(
        _tokens(F.concat("host", "path")),
        lambda t: F.filter(F.get(index, F.pmod(F.xxhash64(t), F.lit(size)).cast("int")), lambda r: r["token"] == t),
    ))
    if always := [e for e in entries if e["token"] is None]:
        fetched = F.concat(fetched, F.from_json(F.lit(json.dumps(always)), f"array<{_RULE}>"))
    return F.array_max(F.transform(F.filter(fetched, lambda r: _fits(lambda f: r[f])), lambda r: _rank(lambda f: r[f])))


def _looked_up(base: DataFrame, entries: list[dict], own: str) -> DataFrame:
    """The same by a join: tokens of the distinct URLs with the rules filed under them, the best rule of each URL joined back."""
    spark = base.sparkSession
    urls = base.select("host", "path").distinct()
    fields = F.struct(*[F.col(f"r.{f}") for f in ("host", "path", "regex", "name", "action", "tier", "length")]).alias("r")
    rules = spark.createDataFrame([json.dumps(e) for e in entries], "string").select(F.from_json("value", _RULE).alias("r")).select(F.col("r.token").alias("token"), fields)
    met = urls.select("host", "path", F.explode(_tokens(F.concat("host", "path"))).alias("token")).join(rules.where("token IS NOT NULL"), "token").drop("token")
    if always := [e for e in entries if e["token"] is None]:
        everywhere = F.from_json(F.lit(json.dumps(always)), f"array<{_RULE}>")
        met = met.unionByName(urls.select("host", "path", F.explode(F.transform(everywhere, lambda r: r.dropFields("token"))).alias("r")))
    get = lambda f: F.col(f"r.{f}")
    best = met.where(_fits(get)).groupBy("host", "path").agg(F.max(_rank(get)).alias(own))
    return base.join(best, ["host", "path"], "left")


#: The rules of the query; hosts and paths that no rule names fall to the patterns.
RULES = (
    host_path_rule("allow", "org/"),
    host_path_rule("block", "example.org/es/"),
    host_path_rule("block", "example.org/en/1"),
    host_path_rule("allow", "com/fr/"),
    host_path_rule("block", "com/de/"),
    wildcard_rule("block", "spam-farm.*"),
    wildcard_rule("block", "*.spam-farm.*"),
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, RULES, columns=["page_id"]).drop("pattern")


SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id,
        translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(rule, rhost, rpath, action) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
        ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
      FROM b JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT b.page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(host || path, '^spam-farm\.') OR regexp_matches(host || path, '\.spam-farm\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON b.page_id = m.page_id
"""
