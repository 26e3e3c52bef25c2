"""URL filters: allow and block rules, then logistic regression on hashed character n-grams.

Judging uses DataFrame functions only. The model is fitted on the driver, in plain
Python, from a small labelled table of URLs; its weights enter the plan as a literal.
"""

from __future__ import annotations

import hashlib
import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the feature hash and the lengths of n-grams.
BUCKETS, GRAMS = 16384, (3, 4)
#: Rows of the labelled table that fit() accepts; it runs on the driver.
MOST_LABELLED = 10_000

#: Words that name the business of unwanted sites, as the categories of public block lists have them (gambling, drugs, adult, advertising and tracking, fraud, piracy). Fixed values.
UNWANTED = """casino poker slots betting jackpot roulette lottery bingo viagra cialis pharmacy pills tablets steroid diet adult porn xxx nude sexy webcam escort dating
ads adserver banner popup click track tracker tracking affiliate promo spam phishing malware scam virus hack free cheap discount replica loan loans payday credit bonus prize
winner crypto bitcoin forex profit warez torrent crack keygen serial""".split()
#: Words that follow or precede them in such names. Fixed values.
AROUND = "now online best top deal deals zone hub farm club world 24 4u x shop store buy get win fast easy direct network media".split()
#: Words of ordinary names. Fixed values.
ORDINARY = """library news weather wiki museum research school recipes journal gardening history science travel music support city river mountain garden open green north south house
art book books kitchen health bank law sport data cloud code design photo film theatre radio forum blog studio lab institute university college hospital church market street harbour""".split()
_SUBDOMAINS = ("", "www.", "m.", "blog.", "en.", "shop.")
_ENDS = ("example.com", "example.net", "example.org", "com", "net", "org")
_PATHS = ("/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}", "/article/{}", "/docs/{}.html", "/about", "/")


def names(seed: int = 3) -> list[tuple[str, int]]:
    """(name, 1 if unwanted): unwanted words alone, joined and with a word around; ordinary words likewise, and pronounceable ones made of random syllables."""
    draw = random.Random(seed)
    join = lambda a, b: a + draw.choice(("-", "-", "")) + b
    bad = [w for w in UNWANTED if len(w) > 3]
    for w in UNWANTED:
        bad += [join(w, draw.choice(AROUND)), join(draw.choice(AROUND), w), join(w, draw.choice(UNWANTED)), join(w, draw.choice(AROUND))]
    good = list(ORDINARY)
    for w in ORDINARY:
        good += [join(w, draw.choice(ORDINARY)), join(draw.choice(ORDINARY), w)]
    syllable = lambda: draw.choice(("", "", "b", "c", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "tr", "v", "w", "wh")) + draw.choice("aeiou") + draw.choice(("", "", "l", "m", "n", "nd", "ng", "r", "s", "sh", "st", "t", "th"))
    good += ["".join(syllable() for _ in range(draw.randint(1, 4))) for _ in range(500)]
    good += [syllable() + syllable() + "-" + syllable() + syllable() for _ in range(60)]
    return sorted({(n, 1) for n in bad} | {(n, 0) for n in good if n not in bad})


def labelled_urls(chosen: list[tuple[str, int]] | None = None, seed: int = 5) -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted): the small training table, four URLs a name; subdomains, ends and paths tell nothing."""
    draw = random.Random(seed)
    rows = [(draw.choice(_SUBDOMAINS) + name + "." + draw.choice(_ENDS), draw.choice(_PATHS).format(draw.randrange(10_000)), y) for name, y in (names() if chosen is None else chosen) for _ in range(4)]
    draw.shuffle(rows)
    return rows


def grams(host: str, path: str) -> list[int]:
    """Bucket of every n-gram of host and path."""
    text = f"^{host}{path}$"
    return [int(hashlib.md5(text[k : k + n].encode()).hexdigest()[:4], 16) % BUCKETS for n in GRAMS for k in range(len(text) - n + 1)]


def fit(rows: list[tuple[str, str, int]] | None = None, epochs: int = 12, rate: float = 1.0, decay: float = 2e-5) -> list[float]:
    """Weights by bucket, and last the bias, of a logistic regression on mean n-gram counts. The rows' order is that of the steps."""
    return list(_fitted(None if rows is None else tuple(rows), epochs, rate, decay))


@lru_cache(maxsize=4)
def _fitted(rows: tuple[tuple[str, str, int], ...] | None, epochs: int, rate: float, decay: float) -> tuple[float, ...]:
    rows = labelled_urls() if rows is None else rows
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled URLs")
    seen = [(grams(h, p), y) for h, p, y in rows]
    weights, bias = [0.0] * BUCKETS, 0.0
    for epoch in range(epochs):
        step = rate / (1 + epoch / 4)
        for found, y in seen:
            n = max(1, len(found))
            z = bias + sum(weights[g] for g in found) / n * 8
            off = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += step * off * 0.05
            for g in found:
                weights[g] += step * (off * 8 / n - decay * weights[g])
    return tuple(round(w, 6) for w in [*weights, bias])


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. Null or without ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null. rules: (allow or block, host and path prefix)."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]))[::-1]:
        own, prefix = split_rule(rule)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
    return best


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The model's log-odds that a URL is unwanted."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))
    table = F.split(F.lit(",".join(map(str, weights[:-1]))), ",").cast("array<double>")
    total, count = F.lit(0.0), F.lit(0)
    for n in GRAMS:
        steps = F.length(text) - (n - 1)
        at = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        bucket = lambda k, n=n: F.conv(F.substring(F.md5(F.substring(text, k, n).cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS
        total = total + F.aggregate(F.transform(at, lambda k: F.element_at(table, bucket(k) + 1)), F.lit(0.0), lambda a, x: a + x)  # noqa: B023
        count = count + F.greatest(steps, F.lit(0))
    return F.lit(weights[-1]) + total / F.greatest(count, F.lit(1)) * 8


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], weights: list[float], id_column: str = "page_id") -> DataFrame:
    """(id, host, path, rule, score, verdict) for every row of ``pages``.

    The longest rule that fits the host or a parent domain and whose path is a prefix of
    the url's decides; without one, block if there is a host and the model's log-odds are
    above 0. A null url, one without ://, or one without a host has nothing to judge and is
    allowed. Urls may be of any length. Ids may be null or repeated; other columns are
    ignored; an empty table gives an empty result. Rules are part of the
    plan and meant to be few (up to about a thousand).
    """
    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", F.round(score(F.col("host"), F.col("path"), weights), 6))
    verdict = F.coalesce(F.col("ruled.verdict"), F.when((F.col("host") != "") & (F.col("score") > 0), "block").otherwise("allow"))
    return ruled.select(id_column, "host", "path", F.col("ruled.rule").alias("rule"), "score", verdict.alias("verdict"))
