"""URL filter: allow and block rules, then a weighted vocabulary counted with an Aho-Corasick automaton.

Defined results
---------------
* null url, or one without ``://``: host and path are empty, no rule fits, verdict ``allow``;
* a term counts only between boundaries (start, end, or a character outside ``[0-9a-z]``), once however often it occurs;
* a url is blocked when the weights of its distinct terms reach ``limit``: a strict term alone does, soft ones in company;
* repeated rows are judged alike and all returned; an empty table gives an empty result;
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One of these blocks a url.
STRICT = ("hardcore", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
#: Two different ones of these block a url.
SOFT = ("adult", "bet", "casino", "cheap", "crack", "dating", "escort", "free", "keygen", "loan", "pharmacy", "pills", "poker", "replica", "sexy", "torrent")
LIMIT = 2
#: (verdict, host, path); the longest fitting one wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def weights(strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, limit: int = LIMIT) -> dict[str, int]:
    return {t: 1 for t in soft} | {t: limit for t in strict}


def vocabulary_weight(terms: dict[str, int]):
    """A pandas UDF: the summed weight of the distinct terms of each lower-cased text."""

    @pandas_udf("int")
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t in terms:
            machine.add_word(t, t)
        machine.make_automaton()
        inner = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")

        def of(text: str | None) -> int:
            if not text:
                return 0
            found = set()
            for end, term in machine.iter(text):
                start = end - len(term)
                if (start < 0 or text[start] not in inner) and (end + 1 == len(text) or text[end + 1] not in inner):
                    found.add(term)
            return sum(terms[t] for t in found)

        for part in parts:
            yield part.map(of, na_action=None).astype("int32") if len(part) else pd.Series([], dtype="int32")

    return weigh


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, terms: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """(key, host, path, rule, verdict, weight) for each row of ``df``. One pass, no shuffle."""
    common.ready(df)
    terms = weights(limit=limit) if terms is None else terms
    at = F.locate("://", F.col("__url"))
    d = df.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"))
    d = d.withColumn("__rest", F.when(at > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit("")))
    d = d.withColumn("__rest", F.coalesce("__rest", F.lit("")))
    d = d.withColumn("__host", F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER))
    d = d.withColumn("__path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: reduce(lambda c, r: c.when(fits(F.col("__host"), F.col("__path"), r[1], r[2]), F.lit(value(r))), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    d = d.withColumn("__weight", vocabulary_weight(terms)(F.translate(F.coalesce("__url", F.lit("")), UPPER, LOWER)))
    return d.select(
        F.col("__key").alias(key),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        case(lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(case(lambda r: r[0]), F.when(F.col("__weight") >= limit, "block").otherwise("allow")).alias("verdict"),
        F.col("__weight").alias("weight"),
    )


def oracle(rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> str:
    """DuckDB SQL for :func:`filter_urls` over ``pages``; terms are single words, so a bounded hit is a word."""
    quote = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    when = lambda v: " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v(r, h, p)}'" for r, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
 list_distinct(regexp_split_to_array(translate(url, '{UPPER}', '{LOWER}'), '[^0-9a-z]+')) AS words FROM h),
v AS (SELECT *, CAST({limit} * len(list_intersect(words, {quote(strict)})) + len(list_intersect(words, {quote(soft)})) AS INTEGER) AS weight FROM p)
SELECT page_id, host, path, CASE {when(lambda r, h, p: h + p)} END AS rule,
 coalesce(CASE {when(lambda r, h, p: r)} END, CASE WHEN weight >= {limit} THEN 'block' ELSE 'allow' END) AS verdict, weight FROM v"""
