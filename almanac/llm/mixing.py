"""Mixing sources to target weights by iterative proportional fitting.

The token counts of the documents are added up to cells (source, language,
topic).  Raking multiplies the cells by factors until the weights of sources,
of languages and of topics meet their targets: each step sets the factors of
one margin to target over present weight.  A document is then sampled with the
probability of its cell, by a hash of its own columns.

The cells stay a table of Spark's, one row a source with its cells of
languages and topics.  A round is one aggregation: given the factors of
languages and topics, a source's own factor follows from its row, and the sums
by language and topic return to the driver, which rakes that small table to
its two margins and sends the new factors.  Languages and topics are closed
lists; their pairs are checked to be at most ``MOST_PAIRS``.  Sources, which
grow with the corpus, never meet in one place.  Probabilities return to the
documents by a join that Spark broadcasts only if the cells are few.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

MARGINS = ("source", "lang", "topic")
#: Target weights are a margin's token shares to this power: below one, small
#: sources, languages and topics gain.
TEMPER = 0.7
#: Share of all tokens to sample.
BUDGET = 0.5
TOLERANCE, ROUNDS = 1e-3, 25
MOST_PAIRS = 100_000
SEED = 17
#: Forms of text by plain patterns, the first that fits.
TOPICS = (("license", r"(?m)^(?:Licensed under|Released under|Copyright)"), ("code", r"[{};]\n"),
          ("shouting", r"[A-Z]!! [A-Z]"), ("list", r"[|][^|\n]*[|][^|\n]*[|]"), ("symbols", r"[#$%&*]{3} [^ ]+[#$%&*]{3}"))


def topic_of(text: Column) -> Column:
    """The first form whose pattern stands in the text, else ``short`` below
    400 characters and ``prose`` from there on; ``empty`` for none."""
    text = F.coalesce(text, F.lit(""))
    out = F.when(F.trim(text) == "", "empty")
    for name, pattern in TOPICS:
        out = out.when(F.regexp_like(text, F.lit(pattern)), name)
    return out.when(F.length(text) < 400, "short").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words without ASCII white space, at least one, so that empty documents
    can be sampled too."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return F.greatest(words, F.lit(1)).cast("long")


def _values(df: DataFrame, key: str) -> dict[str, float]:
    return {r[0]: float(r[1]) for r in df.select(key, "target").limit(MOST_PAIRS + 1).collect()}


def default_targets(cells: DataFrame, temper: float = TEMPER) -> dict[str, DataFrame]:
    """margin -> (value, target): tempered token shares."""
    out = {}
    for m in MARGINS:
        sums = staged(cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("t")), f"target-{m}")
        total = sums.agg(F.sum("t")).first()[0] or 1.0
        out[m] = sums.select(m, (F.col("t") / F.lit(total)).alias("target"))
    return out


def _rake_pairs(sums: dict[tuple[str, str], float], langs: dict[str, float], topics: dict[str, float],
                factors: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """New factors of languages and topics, for ``sums`` made with ``factors``:
    alternate fitting of the two margins of a small table."""
    rows, columns = sorted({p[0] for p in sums}), sorted({p[1] for p in sums})
    table = np.zeros((len(rows), len(columns)))
    for (lang, topic), w in sums.items():
        table[rows.index(lang), columns.index(topic)] = w
    to_rows, to_columns = (np.array([t.get(x, 0.0) for x in xs]) for t, xs in ((langs, rows), (topics, columns)))
    a, b = np.ones(len(rows)), np.ones(len(columns))
    for _ in range(500):
        by_row = table @ b
        a_next = np.divide(to_rows, by_row, out=np.zeros_like(a), where=by_row > 0)
        by_column = a_next @ table
        b_next = np.divide(to_columns, by_column, out=np.zeros_like(b), where=by_column > 0)
        done = np.allclose(a, a_next, rtol=1e-9) and np.allclose(b, b_next, rtol=1e-9)
        a, b = a_next, b_next
        if done:
            break
    return {(x, y): factors.get((x, y), 1.0) * a[rows.index(x)] * b[columns.index(y)] for x, y in sums}


def _factor_map(factors: dict[tuple[str, str], float]) -> Column:
    """Factors as a map column; the pairs are bounded by MOST_PAIRS."""
    return F.from_json(F.lit(json.dumps({f"{x}\x1f{y}": v for (x, y), v in factors.items()})), "map<string,double>")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, summing to one,
    whose margins are the targets'.  Values without a target weigh nothing.
    Where targets and empty cells contradict each other, fitting stops after
    ``rounds`` at the nearest it came."""
    pair = F.concat_ws("\x1f", "lang", "topic")
    by_source = staged(cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "tokens", pair.alias("pair"))).alias("own"))
                            .join(targets["source"], "source", "left").fillna(0.0, ["target"]), "sources")
    langs, topics = _values(targets["lang"], "lang"), _values(targets["topic"], "topic")
    if max(len(langs), len(topics)) > MOST_PAIRS or len(langs) * len(topics) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic; use a coarser topic")
    factors: dict[tuple[str, str], float] = {(x, y): 1.0 for x in langs for y in topics}
    weighted = None
    for _ in range(rounds + 1):
        f = _factor_map(factors)
        inside = F.aggregate("own", F.lit(0.0), lambda acc, c: acc + c["tokens"] * F.coalesce(F.element_at("f", c["pair"]), F.lit(0.0)))
        weighted = (by_source.withColumn("f", f).withColumn("inside", inside)
                    .withColumn("a", F.when(F.col("inside") > 0, F.col("target") / F.col("inside")).otherwise(0.0))
                    .select("source", "a", "f", F.explode("own").alias("c"))
                    .select("source", "c.lang", "c.topic", "c.tokens",
                            (F.col("a") * F.col("c.tokens") * F.coalesce(F.element_at("f", F.col("c.pair")), F.lit(0.0))).alias("weight")))
        sums = {(r[0], r[1]): float(r[2]) for r in weighted.groupBy("lang", "topic").agg(F.sum("weight")).collect()}
        off = [abs(sum(w for p, w in sums.items() if p[i] == v) - t) / t for i, ts in ((0, langs), (1, topics)) for v, t in ts.items() if t > 0]
        if max(off, default=0.0) <= tolerance:
            break
        factors = _rake_pairs(sums, langs, topics, factors)
    return weighted


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with ``probability``: the cell's weight over its tokens, scaled
    so that ``budget`` of all tokens is expected, and at most one.  What the
    bound takes is dealt to the others by a larger scale; each step tries a
    grid of scales in one pass."""
    ratio = F.col("weight") / F.col("tokens")
    wanted = float(raked.agg(F.sum("tokens")).first()[0] or 0) * budget
    low, high = wanted, wanted * 2.0**40
    for _ in range(4):
        grid = [low * (high / low) ** (k / 31) for k in range(32)] if wanted else [0.0] * 32
        got = raked.agg(*[F.sum(F.least(F.lit(1.0), ratio * s) * F.col("tokens")) for s in grid]).first()
        at = next((k for k, g in enumerate(got) if (g or 0.0) >= wanted), 31)
        low, high = grid[max(0, at - 1)], grid[at]
        if high <= low * (1 + 1e-6):
            break
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio * high))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None,
          topic: Column | None = None, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """The sampled rows of ``docs`` (source, lang, id, text and others) with
    topic, tokens, probability and weight (1 / probability) added; columns of
    ``docs`` with these names are replaced.

    A null source or language is a value of its own, ''.  Null and blank texts
    count one token.  Rows that are equal in id, source, language and length
    are sampled together, whatever order they come in; null ids are sampled by
    the rest.  An empty table gives an empty result.
    """
    added = ("topic", "tokens", "probability", "weight")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    text = F.col(f"`{text_col}`").cast("string")
    named = docs.withColumns({
        "_mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "_mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "topic": topic_of(text) if topic is None else topic, "tokens": tokens_of(text)})
    cells = staged(named.groupBy(F.col("_mix_source").alias("source"), F.col("_mix_lang").alias("lang"), "topic")
                        .agg(F.sum("tokens").alias("tokens")), "cells")
    targets = default_targets(cells) if targets is None else targets
    cells = probabilities(staged(rake(cells, targets), "raked"), budget)
    chance = staged(cells.select(F.col("source").alias("_mix_source"), F.col("lang").alias("_mix_lang"),
                                 F.col("topic").alias("_mix_topic"), "probability"), "probabilities")
    joined = named.join(chance, (F.col("topic") == F.col("_mix_topic")) & (named["_mix_source"] == chance["_mix_source"])
                        & (named["_mix_lang"] == chance["_mix_lang"]))
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), named["_mix_source"], named["_mix_lang"], F.length(text), F.lit(seed)),
                  F.lit(1 << 52)) / float(1 << 52)
    kept = joined.filter(draw < F.col("probability"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], "topic", "tokens", "probability",
                       (1 / F.col("probability")).alias("weight"))
