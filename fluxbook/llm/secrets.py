"""Operator 3: secret scans with an incremental ledger of blobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fluxbook.llm.staging import shared_path


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind of secret. A match counts if its ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The base rules in the order in which spans of the same start are listed. In the runs of one
#: class, a match of the base pattern that is too short contains no longer one, so the lower
#: bound can stand in the pattern itself; after a keyword it can't, as the match may hold another.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: Added spans: headers of private keys.
RULES = (*BASE_RULES, Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1))

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"
MASK = "[SECRET]"


def _matches(text: Column, rule: Rule) -> Column:
    """All matches of a rule in a text with the lengths in front of them; what is no match is only skipped over."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    groups = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length) if rule.group else sizes
    listed = F.transform(
        F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), groups.alias("long")),
        lambda m, i: F.struct(i.alias("place"), m["gap"].alias("gap"), m["size"].alias("size"), (m["long"] >= rule.least).alias("counts")),
    )
    return F.when(F.regexp_like(text, pattern), F.slice(listed, F.lit(1), F.size(sizes)))


def find_spans(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Spans (code points, end exclusive) of each blob for its due kinds, from rows of ``blob``, ``text``, ``due``.

    Rows that repeat a blob find the same matches; each counts once, as offsets add up along them.
    """
    found = blobs.select(
        "blob",
        F.explode(F.array(*[
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                     F.when(F.array_contains("due", r.kind), _matches(F.col("text"), r)).alias("found"))
            for r in rules
        ])).alias("r"),
    ).select("blob", "r.kind", "r.version", F.explode("r.found").alias("m")).dropDuplicates(["blob", "kind", "version", "m"])
    upto = Window.partitionBy("blob", "kind").orderBy("m.place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("int")
    return (
        found.select("blob", "kind", "version", "m.counts", (end - F.col("m.size")).alias("start"), end.alias("end"))
        .filter("counts")
        .groupBy("blob", "kind", "version")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )


def update_ledger(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger has not seen and return the ledger's findings for these rules.

    ``versions`` holds ``path`` and ``text``, one row per historical version. A blob is the
    SHA-256 of a text. For every blob one version stands in; texts of others are not read again.
    Every (blob, rule version) pair that is scanned gets a ledger row, with or without spans, so
    a later call scans only new blobs, and all blobs only for rules whose version has changed.
    """
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    seen = spark.read.schema(LEDGER).parquet(ledger)
    addressed = versions.select("path", F.col("text"), blob_of(F.col("text")).alias("blob"))
    stand_in = addressed.groupBy("blob").agg(F.min("path").alias("in"))
    pairs = stand_in.select("blob", "in", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r"))
    due = (
        pairs.select("blob", "in", "r.kind", "r.version")
        .join(seen.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        .groupBy("blob").agg(F.first("in").alias("in"), F.collect_set("kind").alias("due"))
        .withColumnRenamed("blob", "of")
    )
    texts = (
        addressed.join(due, (addressed["blob"] == due["of"]) & addressed["path"].eqNullSafe(due["in"]))
        .select("blob", F.coalesce("text", F.lit("")).alias("text"), "due")
    )
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    # the due pairs come from the slim side again, so that the texts pass through one scan only
    asked = due.select(F.col("of").alias("blob"), F.explode("due").alias("kind")).withColumn("version", version[F.col("kind")])
    spans = find_spans(texts, rules).groupBy("blob", "kind", "version").agg(F.first("spans").alias("spans"))
    asked.join(spans, ["blob", "kind", "version"], "left").select(
        "blob", "kind", "version", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")
    ).write.mode("append").parquet(ledger)
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    return spark.read.schema(LEDGER).parquet(ledger).join(F.broadcast(current), ["kind", "version"])


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def blob_findings(docs: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule], ledger: str | None) -> DataFrame:
    """``blob`` and ``found``, an array of (start, rank, end, kind), of every blob with findings."""
    versions = docs.select(F.col(id_col).alias("path"), F.col(text_col).alias("text"))
    rows = update_ledger(versions, ledger or shared_path(docs.sparkSession, "ledger"), rules)
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    return (
        rows.filter(F.size("spans") > 0)
        .select("blob", "kind", F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), rank[F.col("kind")].alias("rank"), F.col("s.end").alias("end"), F.col("kind").alias("kind")))).alias("found"))
    )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, ledger: str | None = None,
) -> DataFrame:
    """Findings of every document: the id, its blob and ``found``, an array of (start, rank, end, kind).

    Each blob's findings, from the ledger (a fresh one in the shared folder unless given), are
    joined back to all documents that hold it. NULL and empty texts are the empty blob and have
    no findings; a NULL id is a path like any other; repeated rows stay rows of their own; an
    empty table gives no rows. Other columns are left aside.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return (
        docs.select(F.col(id_col).alias(id_col), blob_of(F.col(text_col)).alias("blob"))
        .join(blob_findings(docs, id_col, text_col, rules, ledger), "blob", "left")
        .select(id_col, "blob", F.coalesce("found", none).alias("found"))
    )


def redact_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, ledger: str | None = None,
) -> DataFrame:
    """``docs`` with a mask in place of every secret; rows, columns and other texts stay as they are."""
    found = blob_findings(docs, id_col, text_col, rules, ledger)
    joined = docs.select(F.struct("*").alias("doc"), blob_of(F.col(text_col)).alias("blob")).join(found, "blob", "left")
    own = F.col("doc")[text_col]
    text = F.when(F.col("found").isNull(), own).otherwise(redact(own, F.col("found")))
    return joined.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])


def redact(text: Column, found: Column) -> Column:
    """``text`` with every found span replaced by a mask; overlapping and touching spans become one mask.

    A span is open from its start to its end; the text between the furthest end so far and the
    next start is kept.
    """
    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,upto:int>>").alias("kept"))
    kept = F.aggregate(
        found, first,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            F.when((s["start"] > acc["end"]) | (F.size(acc["kept"]) == 0),
                   F.concat(acc["kept"], F.array(F.struct(acc["end"].alias("from"), s["start"].alias("upto"))))).otherwise(acc["kept"]).alias("kept"),
        ),
        lambda acc: F.concat(acc["kept"], F.array(F.struct(acc["end"].alias("from"), F.char_length(text).alias("upto")))),
    )
    pieces = F.transform(kept, lambda k: F.substring(text, k["from"] + 1, k["upto"] - k["from"]))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, MASK))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{folder}/documents.parquet"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
    )


def _spans_sql(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_row, {rank} AS rank, '{rule.kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS start,
    len(found[i]) AS size, len(groups[i]) AS long
  FROM (SELECT doc_row, gaps, found, groups, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT doc_row, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found,
      regexp_extract_all(text, '{pattern}', {rule.group}) AS groups
    FROM rows WHERE regexp_matches(text, '{pattern}')))
  WHERE len(groups[i]) >= {rule.least}"""


OP3_SQL = (
    "WITH rows AS (SELECT row_number() OVER () AS doc_row, doc_id, coalesce(text, '') AS text FROM documents), spans AS ("
    + "\n  UNION ALL".join(_spans_sql(i, r) for i, r in enumerate(RULES))
    + """), listed AS (
  SELECT doc_row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN listed USING (doc_row)
"""
)
