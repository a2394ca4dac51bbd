"""URL filters: host and path rules, then pattern rules fetched by their rarest literal token.

A pattern is lower case; ``*`` stands for anything, ``^`` for one separator or the end, a leading ``||`` for
the start of a host or of one of its labels, a leading or trailing ``|`` for the start or end of the url. Its
tokens are the runs of ``[a-z0-9]`` that no ``*`` or open end can lengthen: any url that matches holds them as
whole tokens. Each rule is filed under the token that the fewest urls hold; a url's tokens fetch its
candidate rules, and only those run their regular expression.
"""

import re

from pyspark.sql import DataFrame, functions as F

#: (action, host, path): fits the host and its subdomains where the path starts so; the longest wins.
PLACES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: (action, pattern): an allowing match beats every blocking one; without any match a url is allowed.
PATTERNS = [
    ("block", "^utm_source="),
    ("block", "^utm_medium="),
    ("block", "^utm_campaign="),
    ("block", "^gclid="),
    ("block", "^fbclid="),
    ("block", "^sessionid="),
    ("block", "^page=*^ref="),
    ("block", "/wp-login."),
    ("block", "/cgi-bin/"),
    ("block", "/adserver/"),
    ("block", "/banner/*/click^"),
    ("block", "/track/*^pixel^"),
    ("block", "||ads."),
    ("block", "||doubleclick.net^"),
    ("block", "||casino*.example.org^"),
    ("block", "||m.*.example.org^*/fr/"),
    ("block", "://blog.*.example.org/*^top|"),
    ("block", "/xxx/"),
    ("block", "/print.html|"),
    ("block", ".exe|"),
    ("allow", "||docs."),
    ("allow", "/press/*^utm_source="),
    ("allow", "||example.org^"),
    ("allow", "||www.*.example.org^*^utm_source="),
]


def to_regex(pattern: str) -> str:
    """The regular expression of a pattern, for lower-cased urls."""
    head, tail = "", ""
    if pattern.startswith("||"):
        head, pattern = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        tail, pattern = "$", pattern[:-1]
    body = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
    return head + "".join(body.get(c, c if re.fullmatch("[a-z0-9_/=-]", c) else "\\" + c) for c in pattern) + tail


def tokens_of(pattern: str) -> list[str]:
    """Runs of letters and digits that a match cannot lengthen."""
    fixed_start, fixed_end = pattern.startswith("|"), pattern.endswith("|")
    body = pattern.strip("|")
    padded = ("^" if fixed_start else "*") + body + ("^" if fixed_end else "*")
    return [m[0] for m in re.finditer("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", padded)]


def split_url(url):
    """Host (A-Z lower-cased) and path of a url column; both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def place_rule(host, path, places):
    """``struct(rule, action)`` of the longest fitting host and path rule, else null."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, name, start in sorted(places, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def filed(urls: DataFrame, patterns) -> DataFrame:
    """Rules under their rarest token: ``token, action, regex``. ``urls`` has ``_tokens``.

    Rules are a parameter, at most a few thousand; only their tokens are counted.
    """
    spark = urls.sparkSession
    rows = [(i, a, to_regex(p), t) for i, (a, p) in enumerate(patterns) for t in set(tokens_of(p))]
    missing = {i for i in range(len(patterns))} - {r[0] for r in rows}
    if missing:
        raise ValueError(f"patterns without a literal token: {[patterns[i][1] for i in sorted(missing)]}")
    rules = spark.createDataFrame(rows, "rule int, action string, regex string, token string")
    held = (
        urls.select(F.explode("_tokens").alias("token"))
        .join(F.broadcast(rules.select("token").distinct()), "token")
        .groupBy("token").agg(F.count("*").alias("urls"))
    )
    rarest = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("best")
    return rules.join(held, "token", "left").groupBy("rule", "action", "regex").agg(rarest).select(
        "action", "regex", F.col("best.token").alias("token")
    )


def judge_urls(pages: DataFrame, places=PLACES, patterns=PATTERNS) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every row of ``pages(page_id, url)``.

    Null urls, urls without ``://`` and urls that nothing matches are allowed. Repeated rows stay, each with its
    verdict. Only the longest fitting place rule counts; patterns judge the urls that no place rule fits. Matches
    are worked out once for each distinct url, so a url on a third of the rows costs one row.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    split = split.withColumn("_place", place_rule(F.col("host"), F.col("path"), places))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    small = F.translate("url", letters, letters.lower())
    urls = split.where("_place is null and url is not null").select("url").distinct()
    urls = urls.withColumn("_small", small).withColumn(
        "_tokens", F.array_distinct(F.regexp_extract_all("_small", F.lit("[a-z0-9]+"), 0))
    )
    # a rule list is a parameter, so its size is bounded by the caller
    rules = F.broadcast(filed(urls, patterns))
    fetched = urls.select("url", "_small", F.explode("_tokens").alias("token")).join(rules, "token")
    hits = fetched.where(F.expr("_small rlike regex")).groupBy("url").agg(
        F.max(F.col("action") == "allow").alias("_allowed")
    )
    verdict = F.coalesce(F.col("_place.action"), F.when(~F.col("_allowed"), "block"), F.lit("allow"))
    return split.join(hits, "url", "left").select(
        "page_id", "url", "host", "path", F.col("_place.rule").alias("rule"), verdict.alias("verdict")
    )


def oracle(places=PLACES, patterns=PATTERNS) -> str:
    """The same in SQL: every pattern against every url."""
    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    order = sorted(places, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in order]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, order))
    act = " ".join(f"WHEN {f} THEN '{a}'" for f, (a, _, _) in zip(fits, order))

    def any_of(action):
        return " OR ".join(f"regexp_matches(small, '{to_regex(p)}')" for a, p in patterns if a == action)

    return f"""
        WITH r AS (SELECT page_id, coalesce(translate(url, '{letters}', '{letters.lower()}'), '') small,
            coalesce({rest}, '') rest FROM pages),
        s AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{letters}', '{letters.lower()}') host,
            regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path FROM r)
        SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
            CASE {act} WHEN {any_of("allow")} THEN 'allow' WHEN {any_of("block")} THEN 'block' ELSE 'allow' END AS verdict
        FROM s"""
