"""URL filter: host rules first, then a weighted vocabulary found by Aho-Corasick.

The automaton holds strict and soft terms. A hit counts when the characters on
both sides of it are not ASCII letters or digits. One strict hit, or
``soft_needed`` *distinct* soft terms, block a url.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRICT = tuple(
    "porn porno pornstar pornhd xxx xxxvideo nsfw hentai rule34 camgirl camgirls sexcam sexcams livesex escort escorts milf milfs blowjob "
    "creampie gangbang deepthroat cumshot upskirt voyeur bdsm fetish nudes naked onlyfansleak hardcore swingers hookups sextape "
    "warez keygen keygens cracked serialz nulled phishing malware botnet ddos carding cvv fullz ransomware scamlogin "
    "viagra cialis levitra xanax oxycontin tramadol steroids".split()
)
SOFT = tuple(
    "free bet bets betting casino casinos poker slots slot jackpot roulette blackjack bingo lottery lotto gamble gambling wager odds bookmaker sportsbook "
    "adult adults sex sexy hot babe babes girl girls nude amateur webcam dating singles flirt strip lingerie erotic "
    "win winner prize prizes reward giveaway bonus promo coupon discount cheap cheapest deal deals sale replica "
    "loan loans payday credit debt cash money earn rich forex crypto bitcoin invest trading mlm "
    "pills pill pharmacy meds drugs diet weightloss slim keto cbd vape "
    "torrent torrents crack cracks serial hack hacks cheats mod apk stream streaming download downloads mp3 movie movies "
    "ads ad click clicks popup tracker affiliate banner spam".split()
)


@dataclass(frozen=True)
class Vocabulary:
    """Terms are lower-case ASCII; ``soft_needed`` distinct soft hits block."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_needed: int = 2


def read_vocabulary(spark: SparkSession, path: str, soft_needed: int = 2, most: int = 200_000) -> Vocabulary:
    """A vocabulary from a text file of lines ``strict term`` or ``soft term`` (blank lines and those that start with # are comments).

    Terms are lower-cased; a term given twice counts once, in both lists as strict. The automaton is built once per task, so a
    file of more than ``most`` terms is refused.
    """
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("line")).where(F.col("line").rlike(r"^(strict|soft)\s+\S")).distinct().limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"{path} has more than {most} terms")
    given = sorted(tuple(r["line"].split(None, 1)) for r in lines)
    return Vocabulary(tuple(t for kind, t in given if kind == "strict"), tuple(t for kind, t in given if kind == "soft"), soft_needed)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one. Plain searches, so a url of any length costs one pass."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def _until(text: Column, *ends: str) -> Column:
    """Up to the first of ``ends``."""
    for end in ends:
        text = F.substring_index(text, end, 1)
    return text


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return _ascii_lower(_until(_rest(url), "/", "?", "#"))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = _rest(url)
    return _until(rest.substr(F.length(_until(rest, "/", "?", "#")) + 1, F.length(rest)), "?", "#")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule (a struct of rule and verdict), or null. Ties in length go to the rule that is first by text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def term_hits(vocabulary: Vocabulary = Vocabulary()):
    """A column function ``url -> struct<strict:int, soft:int>``: strict hits, and distinct soft terms hit."""

    @F.pandas_udf("struct<strict:int,soft:int>")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for weight, terms in ((1, vocabulary.soft), (2, vocabulary.strict)):  # a term in both lists is strict
            for term in terms:
                machine.add_word(term, (term, len(term), weight))
        machine.make_automaton()
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in urls:
            strict, soft = [], []
            for url in batch:
                n, seen = 0, set()
                if url is not None:
                    url = url.translate(lower)
                    for end, (term, size, weight) in machine.iter(url):
                        start = end - size + 1
                        if (start and url[start - 1] in word) or (end + 1 < len(url) and url[end + 1] in word):
                            continue
                        if weight == 2:
                            n += 1
                        else:
                            seen.add(term)
                strict.append(n)
                soft.append(len(seen))
            yield pd.DataFrame({"strict": pd.Series(strict, dtype="int32"), "soft": pd.Series(soft, dtype="int32")})

    return hits


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, strict_hits, soft_terms``.

    Narrow (no shuffle), so hot hosts and repeated rows cost nothing extra. A null or empty url, or one
    without ``://``, has empty host and path, fits no rule, and is judged by its terms alone (null: allow).
    Urls of any length and alphabet are split by plain searches and read once by the automaton. Other columns of ``pages`` are
    ignored; repeated rows are judged each; an empty table gives no rows.
    """
    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), term_hits(vocabulary)(url).alias("hits"))
    by_terms = F.when((F.col("hits.strict") >= 1) | (F.col("hits.soft") >= vocabulary.soft_needed), "block").otherwise("allow")
    ruled = split.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_terms).alias("verdict"), F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_terms"))


def oracle_sql(rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = Vocabulary()) -> str:
    """The same rows as DuckDB SQL (boundaries as regular expressions; a hit may share its boundary character)."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    edge = lambda t: f"regexp_matches(u, '(?s)(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    count = lambda t: f"len(list_filter(range(1, length(u) + 1), lambda i: substr(u, i, {len(t)}) = '{t}' AND (i = 1 OR NOT regexp_matches(substr(u, i - 1, 1), '[a-z0-9]')) AND NOT regexp_matches(substr(u, i + {len(t)}, 1), '[a-z0-9]')))"
    strict = " + ".join(f"CASE WHEN contains(u, '{t}') THEN {count(t)} ELSE 0 END" for t in vocabulary.strict) or "0"
    soft = " + ".join(f"CAST({edge(t)} AS INT)" for t in vocabulary.soft if t not in vocabulary.strict) or "0"
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text]), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered) + f" WHEN strict_hits >= 1 OR soft_terms >= {vocabulary.soft_needed} THEN 'block' ELSE 'allow' END"
    return f"""
    WITH lowered AS (SELECT page_id, url, {low} AS u FROM pages),
    split AS (SELECT page_id, u, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM lowered),
    parts AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
    hits AS (SELECT page_id, host, path, CAST({strict} AS INT) AS strict_hits, CAST({soft} AS INT) AS soft_terms FROM parts)
    SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, strict_hits, soft_terms FROM hits
    """
