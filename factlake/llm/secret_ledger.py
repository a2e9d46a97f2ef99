"""Secret scan with a ledger of blobs: every content is scanned once per rule version.

A history is a table of versions, each with a path and a text. Versions are
addressed by the SHA-256 of their text. The ledger lists which (blob, rule
version) pairs were scanned and what was found; a scan anti-joins the history's
distinct blobs with it, reads the text of one version per unseen blob, appends
to the ledger, and joins findings back to every version by blob.

Texts that are null count as empty. Repeated rows, ids and texts all keep their
row; their blob is scanned once. A null path keeps its row too. Columns other
than the ones named are ignored, so they may have any name. An empty history
gives an empty result. Spans are given in code points, end exclusive.

Built-in functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.native import joined, labelled, matches, spans, without_spans
from factlake.session import fresh_path, materialize

RULES_VERSION = "3"

# The base rules' patterns. What one keeps is in _base_spans.
ASSIGN = (
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
)
ASSIGN_HEAD = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
# A private key with its mark, up to the END line that follows before any other mark. Without one: the key's
# headers, then whole lines of base64, runs of 16 or more and padded ends, whatever quotes or line feeds they
# have between them, also spelled ones. All loops are possessive, so that long keys need no deep stack.
_LABEL = r"[A-Z0-9\x20]{0,40}?PRIVATE\x20KEY(?:\x20BLOCK)?-----"
_GAP = r"""(?:\\[nrt]|[\s"'`>#*|,;\\])"""
PEM = (
    r"-----BEGIN\x20" + _LABEL + r"(?:[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END\x20" + _LABEL + r"|(?:"
    + _GAP + r"*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+)*+(?:"
    + _GAP + r"*+(?:[A-Za-z0-9+/]{16,}+={0,2}+|[A-Za-z0-9+/]++={1,2}+"
    r"|(?<=\n[\x20\t>#*|\"']{0,16})[A-Za-z0-9+/]++(?=[\x20\t\"',;\\]*+(?:[\r\n]|\z))))*+)"
)
# Further rules of the method: name, pattern, a literal that each match holds.
FURTHER = (
    ("pem", PEM, "PRIVATE KEY"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", "eyJ"),
    ("url", r"[a-z]{3,10}://[^/\s:@]{1,64}:[^/\s:@]{3,64}@", "://"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", "xox"),
)
BASE = ("assign", "access", "hex")
FOUND = "array<struct<rank:int,kind:string,start:int,end:int>>"


def _any_case(text: str, pattern: str) -> Column:
    return F.col(text).rlike(pattern)


def blob_findings(blobs: DataFrame) -> DataFrame:
    """``blob, found``: the spans of all rules in each blob's ``text``."""
    rules = [
        # A run of the class is one match; short runs are dropped by the count in the pattern.
        ("access", ACCESS, F.contains("text", F.lit("AKIA"))),
        ("hex", HEX, _any_case("text", HEX)),
        *((name, pattern, F.contains("text", F.lit(part))) for name, pattern, part in FURTHER),
    ]
    # The match of a short value is consumed, so the length is tested after matching.
    listed = blobs.select("blob", "text", matches("text", ASSIGN, _any_case("text", ASSIGN)).alias("m_assign"), *(
        matches("text", pattern, possible).alias(f"m_{name}") for name, pattern, possible in rules
    ))
    long = F.filter(spans("text", ASSIGN, "m_assign"), lambda s: F.length(
        F.regexp_replace(s["value"], ASSIGN_HEAD, "")
    ) >= 8)
    found = [labelled(long, "assign", 0)] + [
        labelled(spans("text", pattern, f"m_{name}"), name, rank)
        for rank, (name, pattern, _) in enumerate(rules, 1)
    ]
    some = " + ".join(f"size(m_{name})" for name in ("assign", *(r[0] for r in rules)))
    return (
        listed.filter(f"{some} > 0")
        .select("blob", F.concat(*found).alias("found"))
        .filter(F.size("found") > 0)
    )


def scan_history(
    history: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text",
    version: str = RULES_VERSION,
) -> DataFrame:
    """``path, blob, found``: each version of the history with what its blob holds.

    ``ledger`` is a folder that scans share; without one, nothing was seen yet.
    """
    spark = history.sparkSession
    ledger = (ledger or fresh_path(spark, "ledger")).rstrip("/")
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    versions = history.select(
        F.col(path).alias("path"), content.alias("text"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("blob")
    ).withColumn("row", F.xxhash64("path", "blob"))
    paths = materialize(versions.drop("text"), "paths")
    # One version of each unseen blob; the smallest hash of its path and blob is chosen.
    unseen = _unseen(paths.groupBy("blob").agg(F.min("row").alias("row")), ledger, version)
    unseen = materialize(unseen, "unseen")
    # Hot blobs do not meet here: every version but one has no partner.
    to_scan = versions.select("row", "blob", "text").join(unseen, ["row", "blob"], "left_semi")
    found = blob_findings(to_scan).groupBy("blob").agg(F.first("found").alias("found"))
    found.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{ledger}/findings")
    # Last, so that a scan that broke off is done again.
    unseen.select("blob", F.lit(version).alias("version")).write.mode("append").parquet(f"{ledger}/scanned")
    known = (
        spark.read.schema(f"blob binary, found {FOUND}, version string").parquet(f"{ledger}/findings")
        .filter(F.col("version") == version).groupBy("blob").agg(F.first("found").alias("found"))
    )
    return paths.drop("row").join(known, "blob", "left").select(
        "path", "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")
    )


def _unseen(blobs: DataFrame, ledger: str, version: str) -> DataFrame:
    spark = blobs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/scanned")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return blobs
    scanned = spark.read.schema("blob binary, version string").parquet(f"{ledger}/scanned")
    return blobs.join(scanned.filter(F.col("version") == version), "blob", "left_anti")


def _by_start(found: Column) -> Column:
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["end"]))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns, from the spans of ``scan_history``."""
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        F.col("path").alias("doc_id"), *(of(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(_by_start(base)).cast("binary"), 256).alias("base_sha256"),
        joined(_by_start(F.col("found"))).alias("spans"),
    )


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the union of the found spans replaced by ``mark``; null and empty texts stay."""
    return without_spans(text, found, mark)


def redact_history(history: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``history`` with every span that a rule found replaced in ``text``."""
    scanned = scan_history(history, ledger, path, text)
    secrets = materialize(
        scanned.filter(F.size("found") > 0).groupBy("blob").agg(F.first("found").alias("found"))
        .select(F.col("blob").alias("secret_blob"), F.col("found").alias("secret_spans")), "secrets"
    )
    blob = F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
    joined_ = history.join(secrets, blob == secrets["secret_blob"], "left")
    clean = F.when(
        secrets["secret_spans"].isNotNull(), redacted(history[text], secrets["secret_spans"])
    ).otherwise(history[text])
    return joined_.select(*(clean.alias(c) if c == text else history[c] for c in history.columns))
