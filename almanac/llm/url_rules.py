"""URL filter: pattern rules indexed by their rarest literal token.

Each pattern rule is filed under one of its literal tokens, the one fewest
rules share (the longer, then the smaller of equals).  A URL's tokens look up
the rules filed under them, and only those rules run their regular expression
on it.  A literal that may be a part of a token only (``porn`` of
``pornvideos``) is filed under one of its runs of ``GRAM`` characters, which
the URL's tokens look up too.  Rules for hosts and paths are filed the same way and answered by
string comparison instead.

Everything is built-in expressions: the lookup is one join on the token, and
each different URL is judged once.
"""

from __future__ import annotations

import re
from collections import Counter
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_TYPE = "rule string, kind string, verdict string, host string, path string, regex string, token string"
#: Host and path rules (verdict, host, path).
SITE_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
              ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Pattern rules (name, verdict, regular expression, its literal tokens).
PATTERN_RULES = [
    ("casino-pages", "block", r"[./-](?:casino)s?[./-]", ["casino"]),
    ("adult-pages", "block", r"[./-]porn[a-z0-9]*[./-]", ["porn"]),
    ("torrent-files", "block", r"\.torrent(?:[?#]|$)", ["torrent"]),
    ("login-forms", "block", r"/(?:wp-)?login(?:\.php)?(?:[/?#]|$)", ["login"]),
    ("cart-pages", "block", r"/cart/(?:add|checkout)", ["cart"]),
    ("session-ids", "block", r"[?&;]phpsessid=[0-9a-f]+", ["phpsessid"]),
    ("feed-copies", "block", r"[?&]utm_source=feed(?:[&#]|$)", ["utm", "source", "feed"]),
    ("paged-lists", "block", r"[?&]page=[0-9]+&ref=", ["page", "ref"]),
]
#: A token is a run of letters and digits.
TOKEN = "[^a-z0-9]+"
_TOKEN_CODES = frozenset(map(ord, "abcdefghijklmnopqrstuvwxyz0123456789"))
#: Length of the pieces under which parts of tokens are filed, and the mark
#: that tells them from tokens.
GRAM, GRAM_MARK = 3, "~"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _flat(items) -> list:
    """The items of a parsed expression, plain groups opened."""
    out = []
    for op, arg in items:
        out += _flat(arg[3]) if op is C.SUBPATTERN and not arg[1] and not arg[2] else [(op, arg)]
    return out


def _outside(items: list, rest: list) -> bool:
    """Whether what ``items`` and then ``rest`` match surely begins with a
    character of no token, or is the end of the text.  What is not known to is
    taken not to."""
    for at, (op, arg) in enumerate(items):
        after = [*items[at + 1:], *rest]
        if op is C.LITERAL:
            return arg not in _TOKEN_CODES
        if op is C.IN:
            if not all(o is C.LITERAL or o is C.RANGE for o, _ in arg):
                return False
            spans = [(a, a) if o is C.LITERAL else a for o, a in arg]
            return not any(lo <= c <= hi for lo, hi in spans for c in _TOKEN_CODES)
        if op is C.AT:
            return arg in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING)
        if op is C.BRANCH:
            return all(_outside(_turned(b, items), after) for b in arg[1])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            return _outside(_turned(arg[2], items), after) and (arg[0] > 0 or _outside(after, []))
        return False
    return _outside(rest, []) if rest else False


class _Leftward(list):
    """Items read from right to left."""


def _turned(items, like: list) -> list:
    return _Leftward(_flat(items)[::-1]) if isinstance(like, _Leftward) else _flat(items)


def required_literals(regex: str) -> list[tuple[str, bool]]:
    """(literal, whole): the runs of token characters that stand in all that
    ``regex`` matches, and whether each is surely a whole token there."""
    items, out, at = _flat(_parser.parse(regex)), [], 0
    is_letter = lambda x: x[0] is C.LITERAL and x[1] in _TOKEN_CODES
    while at < len(items):
        end = at
        while end < len(items) and is_letter(items[end]):
            end += 1
        if end > at:
            out.append(("".join(chr(c) for _, c in items[at:end]),
                        _outside(_Leftward(items[:at][::-1]), _Leftward()) and _outside(items[end:], [])))
        at = end + 1
    return out


def filing_keys(name: str, regex: str, literals: list[str]) -> list[str]:
    """The keys under any one of which the rule can be filed: every URL that
    ``regex`` fits looks all of them up.  Raises ValueError if there is none."""
    runs = required_literals(regex)
    for t in literals:
        if not any(t in run for run, _ in runs):
            raise ValueError(f"rule {name}: {t!r} is not in all that {regex!r} matches")
    whole = [t for t in literals if (t, True) in runs]
    grams = sorted({GRAM_MARK + t[i:i + GRAM] for t in literals for i in range(len(t) - GRAM + 1)})
    if not whole and not grams:
        raise ValueError(f"rule {name}: no literal is a whole token or has {GRAM} characters")
    return whole or grams


def rule_table(spark: SparkSession, site_rules=None, pattern_rules=None) -> DataFrame:
    """The rules with the key each is filed under: a token, or a piece of one.
    Raises ValueError for a pattern rule that no key would surely fetch."""
    site_rules = SITE_RULES if site_rules is None else site_rules
    pattern_rules = PATTERN_RULES if pattern_rules is None else pattern_rules
    site_tokens = [[t for t in re.split(TOKEN, host.lower()) if t] for _, host, _ in site_rules]
    pattern_keys = [filing_keys(name, regex, literals) for name, _, regex, literals in pattern_rules]
    shared = Counter(t for tokens in [*site_tokens, *pattern_keys] for t in set(tokens))
    rarest = lambda tokens: min(tokens, key=lambda t: (shared[t], -len(t), t))
    rows = [(host + path, "site", verdict, host, path, None, rarest(tokens))
            for (verdict, host, path), tokens in zip(site_rules, site_tokens, strict=True)]
    rows += [(name, "pattern", verdict, None, None, regex, rarest(keys))
             for (name, verdict, regex, _), keys in zip(pattern_rules, pattern_keys, strict=True)]
    return spark.createDataFrame(rows, RULE_TYPE)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: DataFrame | None = None,
               default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, patterns), one row for each row of
    ``pages``.

    The longest fitting site rule decides (the smaller of equals); without
    one, any fitting pattern rule that blocks, else one that allows, else
    ``default``.  ``patterns`` names the pattern rules that fit, in order.

    A null URL and one without ``://`` have an empty host and path and meet no
    site rule; pattern rules still see the text.  Rows are judged by URL, so
    repeated rows and null ids get the same answer each.  An empty table gives
    an empty result; other columns are not looked at.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"))
    after = F.coalesce(F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    urls = (rows.groupBy("url").agg(F.count("*").alias("copies")).withColumn("after", after)
                .withColumn("whole", F.regexp_extract("after", "^[^/?#]*", 0))
                .select("url", ascii_lower(F.col("whole")).alias("host"),
                        F.regexp_extract(F.expr("substring(after, length(whole) + 1)"), "^[^?#]*", 0).alias("path"))
                .withColumn("lower", ascii_lower(F.col("url"))))
    grams = F.regexp_extract_all("lower", F.lit(f"(?=([a-z0-9]{{{GRAM}}}))"), F.lit(1))  # they overlap
    keys = F.concat(F.array_distinct(F.split("lower", TOKEN)),
                    F.transform(F.array_distinct(grams), lambda g: F.concat(F.lit(GRAM_MARK), g)))
    tokens = urls.select("url", "host", "path", "lower", F.explode(keys).alias("token"))
    found = tokens.join(rules.withColumnsRenamed({"host": "r_host", "path": "r_path"}), "token")
    under = (F.col("host") == F.col("r_host")) | F.endswith("host", F.concat(F.lit("."), "r_host"))
    site = (F.col("kind") == "site") & under & F.startswith("path", "r_path")
    pattern = (F.col("kind") == "pattern") & F.expr("lower RLIKE regex")
    fit = found.filter(F.when(F.col("kind") == "site", site).otherwise(pattern))
    best = (fit.groupBy("url").agg(
        F.min(F.when(F.col("kind") == "site", F.struct((-F.length("rule")).alias("l"), "rule", "verdict"))).alias("site"),
        F.max(F.when(F.col("kind") == "pattern", F.struct((F.col("verdict") == "block").alias("b"), "verdict"))).alias("pat"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "pattern", F.col("rule")))), ",").alias("patterns")))
    judged = urls.join(best, "url", "left")
    return (rows.join(judged, "url", "left")
                .select(F.col("id").alias(id_col), "host", "path", F.col("site.rule").alias("rule"),
                        F.coalesce("site.verdict", "pat.verdict", F.lit(default)).alias("verdict"),
                        F.coalesce("patterns", F.lit("")).alias("patterns")))
