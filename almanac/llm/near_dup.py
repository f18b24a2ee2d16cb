"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents are posted under each (coordinate, value) of their signature.  Two
documents collide as often as they stand in the same posting list, and a pair
is retained from ``matches`` collisions of ``coords``.  Counting them is the
T-occurrence problem, which is solved with two known short cuts:

* prefix: under one global order of the lists, shortest first, a pair with
  ``matches`` collisions shares one of the first ``coords - matches + 1``
  lists of both.  Only those lists are joined.  Lists of one document come
  first in that order and are never shuffled again;
* skip: the other lists are not merged; a pair found in a prefix looks up the
  two signatures and counts there, and pairs whose set sizes rule out the
  similarity are skipped before that.

Pairs above the match threshold are confirmed on the full shingle sets.

Equal sets are one class from the start.  Inside a list, members are first
compared with the list's smallest member only; a list whose members then are
one component is settled.  Of the other lists, members outside the list's
largest component, its hub, are compared with all others: links inside a
component cannot change it, so nothing is lost, and of a large group of copies
only those that its smallest member did not reach are compared with more than
one.  Where these are many, they are compared in blocks of bounded size, first
by their signatures, which mark the members that collide often enough with one
of another component, then these by their full sets; only a spanning forest of
the links found leaves a block, so that pairs never become rows.  There is no
cap on lists, members or partners.

A pair at the limit 0.8 shares 32 of 64 coordinates but for one case in about
10^8 (binomial tail); pairs closer than that are surer still.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_long, list_array, sifted, small_batches, staged, window_hashes
from .graph import components

COORDS = 64
MATCHES = 32
#: Members, and their shingles, on either side of a comparison of two blocks;
#: the pairs from which on a list's open members are compared in blocks, not as
#: rows.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
FEW = 20_000
#: Signatures on either side of a comparison of two blocks of them.
SIGNATURES = 8192


def shingles(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles; A-Z are
    lower-cased, words are runs without ASCII white space, and a text with
    fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(cache.array(words), min(width, len(words)), width))


def _coefficients(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    draw = lambda: rng.integers(0, 2**63, coords, np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def signature(hashes: np.ndarray, mul: np.ndarray, xor: np.ndarray) -> np.ndarray:
    """Coordinate i in the upper 32 bits, its least hash value in the lower."""
    least = np.empty(len(mul), np.uint64)
    for at in range(0, len(hashes), 4096):
        part = ((hashes[at:at + 4096, None] ^ xor) * mul).min(axis=0)
        least = part if at == 0 else np.minimum(least, part)
    return (np.arange(len(mul), dtype=np.uint64) << np.uint64(32)) | (least >> np.uint64(32))


def _signed(width: int, coords: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (mul, xor) = WordHashes(), _coefficients(coords)
        for batch in small_batches(batches):
            sizes, marks, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width, cache)
                sizes.append(len(found))
                marks.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                sigs.append(as_long(signature(found, mul, xor)) if len(found) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.string()),
                 list_array(sigs, pa.int64())], names=["id", "n", "mark", "sig"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in small_batches(batches):
            reps, sets = [], []
            for rep, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = shingles(text, width, cache)
                if xxhash.xxh3_128_hexdigest(found.tobytes()) == mark:
                    reps.append(rep)
                    sets.append(as_long(found))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), list_array(sets, pa.int64())],
                                             names=["rep", "members"])
    return run


def _sizes_allow(x: str, y: str, percent: int):
    """Two sets of these sizes can be as similar as asked for."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _prefixes(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """(key, rep, n): every class under its ``coords - matches + 1`` shortest
    lists, as far as those lists hold a second class."""
    posts = classes.select("rep", "n", F.explode("sig").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    shared = posts.join(lists, "key").groupBy("rep", "n").agg(F.collect_list(F.struct("c", "key")).alias("posts"))
    alone = F.lit(coords) - F.size("posts")
    return (shared.withColumn("take", F.lit(coords - matches + 1) - alone).filter("take > 0")
                  .select("rep", "n", F.explode(F.slice(F.array_sort("posts"), F.lit(1), F.col("take"))).alias("p"))
                  .select(F.col("p.key").alias("key"), "rep", "n"))


def _full_sets(wanted: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(rep, members): the whole shingle sets of the classes in ``wanted``."""
    named = staged(wanted.distinct().join(classes.select("rep", "id", "mark"), "rep"), "wanted")
    return staged(sifted(texts, named, "id").join(named, "id").select("rep", "mark", "text")
                  .mapInArrow(_sets(width), "rep long, members array<long>").dropDuplicates(["rep"]), "sets")


def _colliding(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that collide in ``matches`` coordinates."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    return staged(pairs.join(side("a"), "a").join(side("b"), "b")
                  .filter(F.size(F.array_intersect("sig_a", "sig_b")) >= matches)
                  .select("a", "b", "n_a", "n_b"), "colliding")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that hold on full sets."""
    both = (near.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("m_a")), "a")
                .join(sets.select(F.col("rep").alias("b"), F.col("members").alias("m_b")), "b")
                .withColumn("s", F.size(F.array_intersect("m_a", "m_b")).cast("long")))
    return both.filter(F.col("s") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("s")) * percent).select("a", "b")


def _led(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of each list's smallest member with its others."""
    lead = posts.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("l"))
    return (posts.join(lead, "key").filter("rep > l.rep").filter(_sizes_allow("n", "l.n", percent))
                 .select(F.col("l.rep").alias("a"), F.col("rep").alias("b")).distinct())


def _open(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, rep, n, label, outside): for each list with members of two components,
    its members, filed under the largest component; ``outside`` are those that
    are not of it."""
    named = staged(posts.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                        .withColumn("label", F.coalesce("label", "rep")), "named")
    parts = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    unsettled = (parts.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("c", "label")).alias("top"))
                      .filter("k > 1").select("key", F.col("top.label").alias("hub")))
    return (named.join(unsettled, "key")
                 .select("hub", "rep", "n", "label", (F.col("label") != F.col("hub")).alias("outside")).distinct())


def _spanning(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of a block's links, which hang together as
    the links do and are as many as the block has members."""
    out, row_seen, column_seen = [], np.zeros(len(rows), bool), np.zeros(len(columns), bool)
    for start in range(len(rows)):
        if row_seen[start]:
            continue
        row_seen[start], frontier = True, np.array([start])
        while len(frontier):
            to = np.flatnonzero(links[frontier].any(axis=0) & ~column_seen)
            column_seen[to] = True
            frontier = np.flatnonzero(links[:, to].any(axis=1) & ~row_seen)
            row_seen[frontier] = True
            out.extend((rows[start], x) for x in (*columns[to], *rows[frontier]) if x != rows[start])
    return out


def _block_links(percent: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            flat = [np.concatenate(side.members.to_numpy()) for side in (left, right)]
            owner = [np.repeat(np.arange(len(side)), side.members.map(len)) for side in (left, right)]
            shared = np.intersect1d(*map(np.unique, flat))
            counts = np.zeros((len(left), len(right)), np.float32)
            for at in range(0, len(shared), 4096):
                part, held = shared[at:at + 4096], []
                for values, of, side in zip(flat, owner, (left, right), strict=True):
                    column = np.minimum(np.searchsorted(part, values), len(part) - 1)
                    inside = part[column] == values
                    bits = np.zeros((len(side), len(part)), np.float32)
                    bits[of[inside], column[inside]] = 1
                    held.append(bits)
                counts += held[0] @ held[1].T
            # common * 100 >= (n + n' - common) * percent, in whole numbers.
            common = counts.astype(np.int64)
            least = (left.n.to_numpy()[:, None] + right.n.to_numpy()[None]) * percent
            out = _spanning((common * (100 + percent) >= least) & (common > 0), left.rep.to_numpy(), right.rep.to_numpy())
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _in_blocks(crowds: DataFrame, held: DataFrame, rows, columns, name: str):
    """Every hub's members, dealt into ``rows`` parts, cogrouped with those
    outside of it, dealt into ``columns`` parts; ``held`` goes along by rep."""
    size = crowds.groupBy("hub").agg(F.ceil(rows).alias("rows"), F.ceil(columns).alias("columns"))
    full = staged(crowds.join(size, "hub").join(held, "rep"), name)
    number = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = full.withColumn("i", number("rows", 1)).withColumn("j", all_of("columns"))
    right = full.filter("outside").withColumn("j", number("columns", 2)).withColumn("i", all_of("rows"))
    keep = ["hub", "i", "j", "rep", "n", "label", *(c for c in held.columns if c != "rep")]
    return left.select(keep).groupBy("hub", "i", "j").cogroup(right.select(keep).groupBy("hub", "i", "j"))


def _block_partners(matches: int, percent: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(len(side), bool) for side in (left, right)]
        if len(left) and len(right):
            sigs = [np.ascontiguousarray(np.stack(side.sig.to_numpy()).T) for side in (left, right)]
            (n, label), (m, other) = ((side.n.to_numpy(), side.label.to_numpy()) for side in (left, right))
            for at in range(0, len(left), 512):
                part = slice(at, at + 512)
                hits = np.zeros((len(n[part]), len(m)), np.uint16)
                for x, y in zip(sigs[0][:, part], sigs[1], strict=True):
                    hits += x[:, None] == y
                near = hits >= matches
                near &= label[part, None] != other
                near &= np.minimum(n[part, None], m) * 100 >= np.maximum(n[part, None], m) * percent
                found[0][part] = near.any(axis=1)
                found[1] |= near.any(axis=0)
        reps = np.concatenate([side.rep.to_numpy()[f] for side, f in zip((left, right), found, strict=True)])
        return pd.DataFrame({"hub": np.full(len(reps), key[0], np.int64), "rep": reps.astype(np.int64)})
    return run


def _partnered(crowds: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """The rows of ``crowds`` that collide in ``matches`` coordinates with one
    of another component and of a size that allows a link."""
    low = F.transform("sig", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    marked = (_in_blocks(crowds, classes.select("rep", low.alias("sig")), F.count("*") / SIGNATURES,
                         F.count_if("outside") / SIGNATURES, "marked")
              .applyInPandas(_block_partners(matches, percent), "hub long, rep long"))
    return staged(crowds.join(marked.distinct(), ["hub", "rep"], "left_semi"), "partnered")


def _linked_in_blocks(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the members outside a hub with all its members, in groups of
    ``BLOCK`` by ``BLOCK``; only links are rows, never pairs."""
    n_outside = F.when(F.col("outside"), F.col("n"))
    return (_in_blocks(crowds, sets, F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES),
                       F.greatest(F.count_if("outside") / BLOCK, F.sum(n_outside) / BLOCK_SHINGLES), "crowds")
            .applyInPandas(_block_links(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Two documents are linked if ``100 * intersection >= percent * union`` of
    their shingle sets.  ``component_id`` is the smallest id that can be
    reached, the document's own included; ``kept`` is whether that is its own.

    A null or blank text has no shingles and is linked with nothing.  A row
    without an id is linked with nothing, has no component and is kept.  Rows
    that share an id are one document: whatever one of them is linked with,
    all are.  An empty table gives an empty result; other columns of ``docs``
    are not looked at.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = staged(texts.mapInArrow(_signed(shingle_words, coords),
                                     "id long, n long, mark string, sig array<long>"), "signatures")
    linkable = signed.filter("id IS NOT NULL AND n > 0")
    classes = staged(linkable.groupBy("mark", "n").agg(F.min(F.struct("id", "sig")).alias("m"))
                     .select(F.monotonically_increasing_id().alias("rep"), "m.id", "m.sig", "mark", "n"), "classes")
    posts = staged(_prefixes(classes, coords, matches), "prefixes")

    near = _colliding(_led(posts, percent), classes, matches)
    links = staged(_confirmed(near, _full_sets(_ends(near), classes, texts, shingle_words), percent), "links")
    labels = components(links, "a", "b")

    opened = staged(_open(posts, labels), "open")
    many = opened.groupBy("hub").agg((F.count_if("outside") * F.count("*")).alias("work")).filter(F.col("work") > FEW).select("hub")
    few = opened.join(many, "hub", "left_anti")
    outside = few.filter("outside").select("hub", F.col("rep").alias("o_rep"), F.col("n").alias("o_n"),
                                           F.col("label").alias("o_label"))
    pairs = (few.join(outside, "hub").filter("label <> o_label").filter(_sizes_allow("n", "o_n", percent))
                .select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct())
    near = _colliding(pairs, classes, matches)
    crowds = _partnered(staged(opened.join(many, "hub"), "crowded"), classes, matches, percent)
    sets = _full_sets(_ends(near).unionByName(crowds.select("rep")), classes, texts, shingle_words)
    more = _confirmed(near, sets, percent).unionByName(_linked_in_blocks(crowds, sets, percent))

    placed = linkable.select("id", "mark").join(classes.select("rep", "mark"), "mark").select("id", "rep")
    spread = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    same_id = placed.join(spread, "id").filter("rep > a").select("a", F.col("rep").alias("b"))
    rest = more.unionByName(same_id)
    at = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    joined = components(rest.join(at("a"), "a", "left").join(at("b"), "b", "left")
                        .select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")), "a", "b")

    final = (classes.select("rep", "id", "mark")
                    .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                    .withColumn("first", F.coalesce("label", "rep")).drop("label")
                    .join(joined.withColumnRenamed("node", "first"), "first", "left")
                    .select("mark", "id", F.coalesce("label", "first").alias("root")))
    least = final.groupBy("root").agg(F.min("id").alias("component"))
    named = final.join(least, "root").select("mark", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return (signed.select("id", "n", "mark").join(named, "mark", "left")
                  .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                          F.when(F.col("id").isNotNull(), component).alias("component_id"))
                  .withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col))))
