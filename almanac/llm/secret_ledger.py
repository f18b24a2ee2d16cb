"""Secret scan with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content (its
blob).  A blob is scanned once however many paths and versions hold it, and
only for the rules that the ledger has not yet recorded for it in their present
version.  The ledger is a folder with two tables, the scanned pairs and what
was found; a run appends to both, and the findings of all runs, those of the
rules' present versions, are joined back to all paths.

Spans are found by built-in expressions: the matches of a rule and the pieces
between them come from the regular expression functions, and a running sum of
their lengths within the blob gives code-point offsets, end exclusive.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: Of a match, this group must have so many characters at least; shorter
    #: matches are used up but not reported.
    group: int = 0
    least: int = 0


class Ledger(NamedTuple):
    #: (blob, kind, version) that have been scanned.
    scanned: DataFrame
    #: (blob, kind, version, start, end, value) of what those scans found; a
    #: row may be there more than once.
    findings: DataFrame


SCANNED = "blob string, kind string, version int"
FINDINGS = f"{SCANNED}, start long, end long, value string"


def either_case(word: str) -> str:
    """A-Z and a-z alike, other letters not (no Unicode case folding)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The base kinds, then those added to them, in the order that breaks ties.
RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
    Rule("github", 1, "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")


def addressed(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob, text) of every version; a null text is empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return versions.select(F.col(f"`{path_col}`").alias("path"), text.alias("text")).withColumn("blob", F.sha2("text", 256))


def _matches(rule: Rule) -> Column:
    """The rule's matches with the length of the piece before each."""
    bound = F.transform(F.array(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))), lambda found: F.when(
        F.size(found) > 0, F.filter(
            F.zip_with(F.split("text", rule.pattern, -1), found, lambda piece, match: F.struct(
                F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
                F.length(piece).alias("gap"), match.alias("match"))),
            lambda x: x["match"].isNotNull())))
    return F.transform(F.coalesce(F.element_at(bound, 1), F.array()), lambda x, i: F.struct(
        x["kind"].alias("kind"), x["version"].alias("version"), i.alias("pos"), x["gap"].alias("gap"), x["match"].alias("match")))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(scanned, findings) for ``versions`` as :func:`addressed` gives them.

    ``scanned`` (blob, kind, version) are the pairs that the ledger did not
    hold and that are now scanned: append them to it.  ``findings`` (blob,
    kind, version, start, end, value) are what those scans found.
    """
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    known = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        pending = blobs.withColumn("pending", known)
    else:
        pairs = versions.select("blob").distinct().withColumn("r", F.explode(known)).select("blob", "r.kind", "r.version")
        unseen = pairs.join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
        wanted = unseen.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("pending"))
        pending = blobs.join(wanted, "blob")
    found = pending.select("blob", F.explode(F.concat(*[
        F.when(F.array_contains(F.transform("pending", lambda p: p["kind"]), r.kind), _matches(r)).otherwise(F.array()) for r in rules
    ])).alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "kind").orderBy("pos")
    spans = (found.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
                  .withColumn("start", F.col("end") - F.length("match")))
    for r in rules:
        if r.least:
            spans = spans.filter((F.col("kind") != r.kind) | (F.length(F.regexp_extract("match", r.pattern, r.group)) >= r.least))
    findings = spans.select("blob", "kind", "version", "start", "end", F.col("match").alias("value"))
    scanned = pending.select("blob", F.explode("pending").alias("p")).select("blob", "p.kind", "p.version")
    return scanned, findings


def read_ledger(spark: SparkSession, folder: str) -> Ledger:
    """The ledger in ``folder``, which is made if it is not there."""
    def table(name: str, schema: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return spark.read.schema(schema).parquet(path)

    return Ledger(table("scanned", SCANNED), table("findings", FINDINGS))


def extend_ledger(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, new: bool = False) -> Ledger:
    """Scan what the ledger in ``folder`` does not hold of ``versions``,
    append it, and return the ledger.  One run at a time may extend a folder.
    ``new``: the folder is known not to be there yet.

    The findings are written first: a run that dies in between leaves pairs
    that are scanned again, and findings that are there twice.
    """
    spark = versions.sparkSession
    scanned, findings = scan_unseen(versions, None if new else read_ledger(spark, folder).scanned, rules)
    findings.write.mode("append").parquet(f"{folder.rstrip('/')}/findings")
    scanned.write.mode("append").parquet(f"{folder.rstrip('/')}/scanned")
    return read_ledger(spark, folder)


def present_findings(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of the rules in their present versions."""
    present = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return ledger.findings.filter(F.array_contains(present, F.struct("kind", "version")))


def spans_by_path(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans): each version's findings in order, an array of
    {start, rank, end, kind, value}; empty for a version without any."""
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    per_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_set(
        F.struct("start", rank.alias("rank"), "end", "kind", "value"))).alias("spans"))
    return versions.select("path", "blob").join(per_blob, "blob", "left")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans), one row for each
    row of ``docs``.

    ``ledger``: the folder of a ledger; what it holds is not scanned again,
    and it is extended by what is.  Without one, a ledger is begun in the
    shared folder.

    Null and empty texts have no spans (the digest is that of an empty
    string).  Rows with equal texts, the same id or not, and rows without an
    id get the same answer each.  An empty table gives an empty result; other
    columns of ``docs`` are not looked at.
    """
    versions = addressed(docs, id_col, text_col)
    folder = ledger or shared_path(docs.sparkSession, f"llm-secret-ledger-{uuid.uuid4().hex}")
    found = spans_by_path(versions, present_findings(extend_ledger(versions, folder, rules, new=not ledger), rules), rules)
    spans = F.coalesce("spans", F.array())
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    written = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("path").alias(id_col), *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))
