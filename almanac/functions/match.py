"""Keyword matching (J2) as built-in Column expressions.

Occurrence spans are code-point offsets (Spark ``length``/``substring`` count
code points; ``regexp_instr`` would give UTF-16 offsets, so it is not used).
For a keyword pattern ``p`` the text splits into pieces around the matches;
the start of match ``k`` is the summed length of the pieces and matches
before it.  All per-keyword occurrence arrays are concatenated and sorted by
(start, keyword rank), which gives both the start order and the tie rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import fixed
from . import text as T

OCC_TYPE = "array<struct<start:int,rank:int,end:int,keyword:string>>"
MATCH_TYPE = "struct<institution:string,status:string,matched_text:string>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quote(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def normalize_keyword(k: str) -> str:
    return " ".join(k.split())


def keyword_pattern(keyword: str) -> str:
    """F8: literal keyword, inner whitespace -> \\s+, not preceded or followed
    by a word character; case-insensitive, Unicode classes."""
    parts = normalize_keyword(keyword).split(" ")
    body = r"\s+".join(_quote(p) for p in parts)
    return r"(?iU)(?<!\w)" + body + r"(?!\w)"


def any_keyword_pattern(keywords) -> str:
    parts = [keyword_pattern(k)[len("(?iU)"):] for k in fixed.longest_first(keywords)]
    return "(?iU)(?:" + "|".join(parts) + ")"


def _with_running_ends(df: DataFrame, steps: str, out: str) -> DataFrame:
    """Inclusive running sums of an int array column, by blocks of about
    sqrt(n): block totals, a running offset per block, then running sums
    inside each block, each stage computed once per row.  O(n * sqrt(n))
    element steps instead of the O(n^2) of appending to a growing array."""
    s = F.col(steps)
    n = F.size(s)
    b = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))
    nb = ((n + b - 1) / b).cast("int")
    blocks = F.sequence(F.lit(0), F.greatest(nb - 1, F.lit(0)))
    df = df.withColumn("_re_tot", F.transform(
        blocks, lambda k: F.aggregate(F.slice(s, k * b + 1, b), F.lit(0), lambda a, x: a + x)))
    df = df.withColumn("_re_off", F.aggregate(
        F.col("_re_tot"), F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("a")),
        lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.array_append(acc["a"], acc["t"]).alias("a")),
        lambda acc: acc["a"]))
    offsets = F.col("_re_off")

    def block_ends(k):
        init = F.struct(F.element_at(offsets, k + 1).alias("p"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(F.slice(s, k * b + 1, b), init,
                           lambda acc, x: F.struct((acc["p"] + x).alias("p"),
                                                   F.array_append(acc["a"], acc["p"] + x).alias("a")),
                           lambda acc: acc["a"])

    df = df.withColumn(out, F.when(n > 0, F.flatten(F.transform(blocks, block_ends)))
                       .otherwise(F.array().cast("array<int>")))
    return df.drop("_re_tot", "_re_off")


def with_occurrences(df: DataFrame, text, keywords, out: str) -> DataFrame:
    """M1 as staged columns: adds ``out`` = every match of every distinct
    keyword as ``{start, rank, end, keyword}`` (half-open, code points),
    ordered by start then keyword rank (longest keyword first, then
    alphabetical).

    For keyword ``j`` the text splits into pieces around its matches; match
    ``m`` ends at the running sum of ``len(piece) + len(match)``.  All
    keywords' step arrays are concatenated and summed once
    (:func:`_with_running_ends`), then cut back into per-keyword spans.

    To flatten the result use ``posexplode_outer`` and filter the generated
    column: a plain ``explode`` makes Catalyst infer a filter on the array
    and push it down through (inlining) the staged columns."""
    kws = fixed.longest_first(keywords)
    t = "_oc_t"
    df = df.withColumn(t, _col(text))
    if not kws:
        return df.withColumn(out, F.array().cast(OCC_TYPE)).drop(t)
    tmp = [t]
    for j, k in enumerate(kws):
        pat = keyword_pattern(k)
        m, st = f"_oc_m{j}", f"_oc_s{j}"
        df = df.withColumn(m, F.regexp_extract_all(F.col(t), F.lit(pat), 0))
        df = df.withColumn(st, F.zip_with(F.slice(F.split(F.col(t), pat, -1), 1, F.size(m)), F.col(m),
                                          lambda p, x: F.length(p) + F.length(x)))
        tmp += [m, st]
    steps = F.concat(*[F.col(f"_oc_s{j}") for j in range(len(kws))]) if len(kws) > 1 else F.col("_oc_s0")
    df = _with_running_ends(df.withColumn("_oc_steps", steps), "_oc_steps", "_oc_ends")
    tmp += ["_oc_steps", "_oc_ends"]
    ends = F.col("_oc_ends")
    parts, offset = [], F.lit(0)
    for j, k in enumerate(kws):
        m = F.col(f"_oc_m{j}")
        base = F.when(offset > 0, F.element_at(ends, offset)).otherwise(F.lit(0))
        parts.append(_spans(m, ends, offset, base, j, k))
        offset = offset + F.size(m)
    allocc = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.withColumn(out, F.array_sort(allocc).cast(OCC_TYPE)).drop(*tmp)


def _spans(matches, ends, offset, base, rank: int, keyword: str):
    """Occurrence structs of one keyword from the running end offsets."""
    def occ(x, i):
        e = F.element_at(ends, offset + i + 1) - base
        return F.struct((e - F.length(x)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"),
                        F.lit(keyword).alias("keyword"))
    return F.transform(matches, occ)


def with_proximity_match(df: DataFrame, text, out: str = "match", institutions=None,
                         statuses=None, window: int = fixed.DEFAULT_MATCH_WINDOW,
                         padding: int = fixed.EXCERPT_PADDING) -> DataFrame:
    """M1+M2+M3 on F7-normalised text: adds ``out`` = the first (institution
    occurrence, status occurrence) pair, in institution order then status
    order, whose gap ``max(0, max(starts) - min(ends))`` is at most
    ``window``, as a nullable STRUCT<institution, status, matched_text>.

    Staged as separate columns so each expensive array is computed once per
    row (Catalyst keeps projections apart when a collapse would repeat
    them), and a cheap ``rlike`` on both keyword sets guards span building,
    so only documents that can match pay for it."""
    institutions = list(fixed.DEFAULT_INSTITUTION_KEYWORDS if institutions is None else institutions)
    statuses = list(fixed.DEFAULT_STATUS_KEYWORDS if statuses is None else statuses)
    window = max(1, int(window))
    if not fixed.longest_first(institutions) or not fixed.longest_first(statuses):
        return df.withColumn(out, F.lit(None).cast(MATCH_TYPE))  # nothing to match
    t, inst, stat, pair = "_pm_t", "_pm_inst", "_pm_stat", "_pm_pair"
    df = df.withColumn(t, T.collapse_ws(text))
    maybe = F.col(t).rlike(any_keyword_pattern(institutions)) & F.col(t).rlike(any_keyword_pattern(statuses))
    df = df.withColumn("_pm_maybe", maybe)
    df = with_occurrences(df, F.when(F.col("_pm_maybe"), F.col(t)), institutions, inst)
    df = df.withColumn("_pm_any", F.coalesce(F.size(inst) > 0, F.lit(False)))
    df = with_occurrences(df, F.when(F.col("_pm_any"), F.col(t)), statuses, stat)

    elem = OCC_TYPE[len("array<"):-1]

    def near(i, s):
        return F.greatest(F.lit(0), F.greatest(i["start"], s["start"]) - F.least(i["end"], s["end"])) <= window

    def first_status(i):
        # first status (in start order) within the window of occurrence i
        return F.aggregate(F.col(stat), F.lit(None).cast(elem),
                           lambda a, s: F.when(a.isNotNull(), a).when(near(i, s), s),
                           lambda r: F.when(r.isNotNull(), F.struct(i.alias("i"), r.alias("s"))))

    # institutions in order; once a pair is found the rest skip their scan
    pair_type = f"struct<i:{elem},s:{elem}>"
    df = df.withColumn(pair, F.when(F.size(stat) > 0, F.aggregate(
        F.col(inst), F.lit(None).cast(pair_type),
        lambda acc, i: F.when(acc.isNotNull(), acc).otherwise(first_status(i)))))
    p = F.col(pair)
    lo = F.least(p["i"]["start"], p["s"]["start"])
    hi = F.greatest(p["i"]["end"], p["s"]["end"])
    ex_start = F.greatest(F.lit(0), lo - padding)
    ex_end = F.least(F.length(t), hi + padding)
    df = df.withColumn(out, F.when(p.isNotNull(), F.struct(
        p["i"]["keyword"].alias("institution"),
        p["s"]["keyword"].alias("status"),
        F.trim(F.substring(F.col(t), ex_start + 1, ex_end - ex_start)).alias("matched_text"),
    )))
    return df.drop(t, inst, stat, pair, "_pm_maybe", "_pm_any")


def with_simple_match(df: DataFrame, text, out: str = "match", keywords=None) -> DataFrame:
    """M4: adds ``out`` = the longest keyword contained in the text
    (case-insensitive substring, no word boundary), status 'simple_keyword'."""
    kws = fixed.longest_first(fixed.DEFAULT_SEARCH_KEYWORDS if keywords is None else keywords)
    if not kws:
        return df.withColumn(out, F.lit(None).cast(MATCH_TYPE))
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    df = df.withColumn("_sm_hit", F.coalesce(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in kws]))
    hit = F.col("_sm_hit")
    df = df.withColumn(out, F.when(hit.isNotNull(), F.struct(
        hit.alias("institution"), F.lit(fixed.SIMPLE_STATUS).alias("status"),
        hit.alias("matched_text"))))
    return df.drop("_sm_hit")


def with_alumni_match(df: DataFrame, text, out: str = "match",
                      mode: str = fixed.MATCH_MODE_PROXIMITY, institutions=None,
                      statuses=None, keywords=None,
                      window: int = fixed.DEFAULT_MATCH_WINDOW) -> DataFrame:
    """M5: mode dispatch ('simple' or 'proximity'; anything else -> proximity)."""
    mode = (mode or "").strip().lower()
    if mode == fixed.MATCH_MODE_SIMPLE:
        return with_simple_match(df, text, out, keywords)
    return with_proximity_match(df, text, out, institutions, statuses, window)


def matching_keyword(match: Column) -> Column:
    """M6: institution of the match, or NULL."""
    return match["institution"]


def is_match(match: Column) -> Column:
    """M6: a match exists."""
    return match.isNotNull()
