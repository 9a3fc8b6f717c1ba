"""Secret scans over every version of a history, by a ledger of scanned blobs.

Texts are addressed by content (SHA-256), so a text that stands at many paths or in
many versions is one blob. Every rule has a version of its own. The ledger tells which
(blob, rule version) pairs were scanned and what was found; a blob is read again only for
rules whose pair is missing, so changing one rule scans with that rule alone. Findings
are joined back to every path.

Rules are searched in whole texts, each leftmost and without overlaps of its own
kind; matches that fail their test are dropped, not tried again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.base import modest_batches, save, strings

#: Kind, what a text must contain (one of these, in lower case) to be searched, pattern,
#: the group that is measured and its least length. The first three are the base rules.
RULES = (
    ("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", ("akia",), r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", (), r"[0-9a-f]{32,}", 0, 32),
    ("private_key", ("private key-----",), r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("hosting", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[opusr]_[A-Za-z0-9]+", 0, 40),
    ("chat", ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), r"xox[baprs]-[A-Za-z0-9-]+", 0, 20),
    ("signed", ("eyj",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BASE = 3
_COMPILED = [(words, re.compile(pattern, re.ASCII), group, least) for _, words, pattern, group, least in RULES]
#: A rule's version changes whenever the rule does.
VERSIONS = [hashlib.sha256(repr(rule).encode()).hexdigest()[:16] for rule in RULES]
LEDGER = "blob string, rules array<string>, spans array<string>"


def find_rule(text: str, low: str, number: int) -> list[tuple[int, int]]:
    """(start, end) of a rule's findings, in order."""
    words, pattern, group, least = _COMPILED[number]
    if words and not any(w in low for w in words):
        return []
    return [(m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every finding, in order."""
    low = text.lower()
    return sorted((a, number, b) for number in range(len(RULES)) for a, b in find_rule(text, low, number))


def described(spans: list[tuple[int, int, int]], kinds: int) -> str:
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans if k < kinds)


def blob(text: str = "text"):
    """The address of a text; null counts as ''."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: list[str] | None = None) -> DataFrame:
    """(blob, text, missing): each blob once, with the rule versions for which the ledger has no row of it."""
    wanted = F.array(*map(F.lit, VERSIONS if rules is None else rules))
    blobs = versions.select(blob().alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs.withColumn("missing", wanted)
    known = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    told = blobs.join(known, "blob", "left")
    missing = F.when(F.col("known").isNull(), wanted).otherwise(F.array_except(wanted, "known"))
    return told.select("blob", "text", missing.alias("missing")).where(F.size("missing") > 0)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows of (blob, text, missing): what each missing rule finds. Unknown versions find nothing."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {version: k for k, version in enumerate(VERSIONS)}
        for batch in batches:
            found = []
            for text, missing in zip(strings(batch, "text"), batch.column(2).to_pylist()):
                low = text.lower()
                found.append([",".join(f"{a}:{b}" for a, b in find_rule(text, low, number[x])) if x in number else "" for x in missing])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.string()))], ["blob", "rules", "spans"])

    return blobs.select("blob", "text", "missing").mapInArrow(scan, LEDGER)


def findings(ledger: DataFrame) -> DataFrame:
    """Counts, checksum and spans of each blob from its ledger rows, of which a blob has one."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {version: k for k, version in enumerate(VERSIONS)}
        for batch in batches:
            found = []
            for rules, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                places = {(number[r], *map(int, x.split(":"))) for r, all_ in zip(rules, spans) if r in number for x in all_.split(",") if x}
                found.append(sorted((a, k, b) for k, a, b in places))
            counts = [pa.array([sum(k == n for _, k, _ in spans) for spans in found], pa.int64()) for n in range(BASE)]
            base = [hashlib.sha256(described(x, BASE).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base, pa.string()), pa.array([described(x, len(RULES)) for x in found], pa.string())],
                ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return ledger.select("blob", "rules", "spans").mapInArrow(tell, "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def scan_history(versions: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; returns (versions with findings, new ledger rows).

    ``versions`` has a ``text`` and any columns that name its paths; columns called
    like a finding are replaced. A null text is ''. Every row gets its findings,
    repeated rows too; no rows give no rows. Append the new rows to the ledger; rows that
    were appended twice, or of rules that are no more, change nothing.
    """
    modest_batches(versions.sparkSession)
    new = save(scan_blobs(unseen_blobs(versions, ledger)))
    known = new
    if ledger is not None:
        pairs = ledger.select("blob", F.explode(F.arrays_zip("rules", "spans")).alias("x")).unionByName(new.select("blob", F.explode(F.arrays_zip("rules", "spans")).alias("x")))
        pairs = pairs.where(F.col("x.rules").isin(VERSIONS)).groupBy("blob").agg(F.collect_set("x").alias("x"))  # a blob has few rules
        known = pairs.select("blob", F.col("x.rules").alias("rules"), F.col("x.spans").alias("spans"))
    told = findings(known)
    paths = [x for x in versions.columns if x != "text" and x not in told.columns]
    found = versions.select(*paths, blob().alias("blob")).join(told, "blob").drop("blob")
    return found, new
