"""Secrets in every version of every document, by an incremental blob ledger.

* Every version of a text is addressed by its SHA-256: a blob. Copies and unchanged versions
  are one blob, however many paths have it.
* The ledger has one row per (blob, rule, version of the rule) with the spans found. Only
  pairs that are not in it are scanned; a new rule, or a rule's new version, is run over all
  blobs, a known one only over new blobs.
* Findings are joined back to all paths by blob.

Everything is DataFrame functions: regular expressions cut a text into matches and what lies
between them, and the lengths of these, in code points, give the positions.

Null texts count as empty and have no spans. Repeated rows get the same result each; a null
id stays null. Spans of different rules may overlap; those of one rule never do. Other columns
are kept by `redact` and not read otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Leftmost matches in turn; those whose group has fewer than `least` characters are dropped."""

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# Runs that are too short may be left out by the pattern itself where no other match could
# begin in them; a short assigned value still uses up its text, so it is dropped afterwards.
BASE = (
    Rule("assign", 1, "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
)
RULES = (
    *BASE,
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", 1, "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("forge_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
)
SPANS = "array<struct<start:bigint,end:bigint>>"


def matches(text: Column, rule: Rule) -> Column:
    """Code points [start, end) of a rule's matches."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)

    def add(state: Column, i: Column) -> Column:
        start = state["at"] + F.char_length(F.get(between, i))
        end = start + F.char_length(F.get(hits, i))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), first, add, lambda s: s["out"])
    if rule.least:
        # A match taken alone matches again in the same way.
        kept = F.transform(hits, lambda h: F.char_length(F.regexp_extract(h, rule.pattern, rule.group)) >= rule.least)
        walked = F.filter(walked, lambda s, i: F.get(kept, i))
    return F.when(F.size(hits) > 0, walked).otherwise(F.array().cast(SPANS))


def blob_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """blob, text and one column of spans per rule key, for each distinct blob of the versions.

    A rule's spans come from the ledger (blob, rule, version, spans) where it has the pair,
    and from the text otherwise.
    """
    blobs = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs.select("blob", "text", *[matches(F.col("text"), r).alias(r.key) for r in rules])
    known = F.collect_list(F.struct(F.concat_ws("@", "rule", "version"), "spans"))
    pairs = ledger.select("blob", "rule", "version", F.col("spans").cast(SPANS).alias("spans")).dropDuplicates(["blob", "rule", "version"])
    seen = pairs.groupBy("blob").agg(F.map_from_entries(known).alias("seen"))
    both = blobs.join(seen, "blob", "left")
    return both.select("blob", "text", *[F.coalesce(F.try_element_at("seen", F.lit(r.key)), matches(F.col("text"), r)).alias(r.key) for r in rules])


def ledger_rows(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after a scan: blob, rule, version, spans."""
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.col(f"`{r.key}`").alias("spans")) for r in rules])
    return scanned.select("blob", F.inline(pairs))


def _all_spans(rules: tuple[Rule, ...]) -> Column:
    """Spans of several rules by start, then in the rules' order."""

    def of_kind(rule: Rule, kind: int) -> Column:
        return F.transform(F.col(f"`{rule.key}`"), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*[of_kind(r, k) for k, r in enumerate(rules)]))


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, counts of the base rules, base_sha256 and all spans."""
    scanned = scan(docs, ledger, rules, text).drop("text")
    spans = _all_spans(rules)
    names = [r.name for r in BASE]
    base = F.filter(spans, lambda s: s["kind"].isin([k for k, r in enumerate(rules) if r.name in names]))
    counts = [F.size(f"`{r.key}`").cast("long").alias(f"n_{r.name}") for r in rules if r.name in names]
    found = scanned.select("blob", *counts, F.sha2(_written(base, rules).cast("binary"), 256).alias("base_sha256"), _written(spans, rules).alias("spans"))
    return docs.select(F.col(id_column), blob_of(text).alias("blob")).join(found, "blob").drop("blob")


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span of every rule replaced by a mask; null texts stay null."""
    scanned = scan(docs, ledger, rules, text)

    def add(state: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        # A span that begins inside the last one only makes it longer.
        piece = F.when(s["start"] >= state["at"], F.concat(between, F.lit(mask))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = F.aggregate("spans", first, add, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.char_length("text"))))
    masked = scanned.withColumn("spans", _all_spans(rules)).select("blob", F.when(F.size("spans") > 0, rest).otherwise(F.col("text")).alias("masked"))
    had = [F.col(text).isNotNull().alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    joined = docs.select(*had, blob_of(text).alias("__blob")).join(masked.withColumnRenamed("blob", "__blob").withColumnRenamed("masked", "__masked"), "__blob")
    return joined.select(*[F.when(F.col(c), F.col("__masked")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return findings(spark.read.parquet(f"{folder}/documents.parquet"))
