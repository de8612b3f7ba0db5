"""Secret scans over a ledger of blobs: DataFrame functions only.

A version of a file is a blob, addressed by the sha256 of its text. The ledger
has three tables in one folder: versions (path, blob), scans (blob, rules
version) and findings (blob, rules version, kind, start, end). A run takes the
versions it is given, scans the blobs whose pair with the current rules version
isn't in the ledger, each once however many paths hold it, and joins the
findings back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, ids_fit, shared_dir, table, unused, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of the group that counts.

    A match whose group is shorter is dropped, and its text isn't looked at
    again. quick, if given, is cheaper and holds wherever a match counts.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    quick: str = ""


_VALUE = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""
#: The base kinds, in the order in which they are listed. Runs of
#: one class are maximal, so a least length can stand in the pattern itself.
BASE = (
    Rule("assign", _VALUE + "+)", 2, 12, _VALUE + "{12})"),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Further kinds, of formats that their issuers publish.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("prefixed", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|npm_)[A-Za-z0-9_-]{16,}"),
)
RULES = BASE + MORE
VERSION = "1"

VERSIONS = T.StructType().add("path", "long").add("blob", "string")
SCANS = T.StructType().add("blob", "string").add("rules", "string")
FINDINGS = T.StructType().add("blob", "string").add("rules", "string").add("rank", "integer").add("kind", "string").add("start", "integer").add("end", "integer")


#: Blobs up to which new ones, or those with findings, are broadcast: about 100 bytes each.
MOST_BLOBS = 20_000


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's leftmost non-overlapping matches: rank, gap (code points since the last one), own (its length), n (length of the group that counts); the last entry has only the gap after all."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    lengths = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("own"), F.transform(counted, F.length).alias("n"))
    return F.transform(lengths, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("nth"), x["gap"].alias("gap"), x["own"].alias("own"), x["n"].alias("n")))


def findings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rank, kind, start, end of each finding in texts (blob, text; a row for each blob).

    Places are running sums over one blob's matches, so that the time grows with the text's length.
    """
    none = F.array().cast("array<struct<rank:int,nth:int,gap:int,own:int,n:int>>")
    maybe = [F.col("text").rlike(r.quick or r.pattern) for r in rules]
    rows = texts.select("blob", "text", *(m.alias(f"m{i}") for i, m in enumerate(maybe)))
    rows = rows.filter(" or ".join(f"m{i}" for i in range(len(rules))))
    found = F.concat(*(F.when(F.col(f"m{i}"), matches(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)))
    rows = rows.select("blob", F.explode(found).alias("f")).select("blob", "f.*").filter("own is not null")
    before = Window.partitionBy("blob", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("own")).over(before).cast("int"))
    least = F.array(*(F.lit(r.least) for r in rules))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return rows.filter(F.col("n") >= F.get(least, F.col("rank"))).select("blob", "rank", F.get(kinds, F.col("rank")).alias("kind"), (F.col("end") - F.col("own")).alias("start"), "end")


def blob_of(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256)


def _ledger(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of the ledger, empty if no run has written it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _scanned(versions: DataFrame, ledger: str, rules: tuple[Rule, ...], rules_version: str) -> tuple[DataFrame, DataFrame]:
    """Scan what is new among versions; the run's own versions (path, blob), and the ledger's findings by these rules."""
    spark = versions.sparkSession
    run = f"{ledger}/versions/run={uuid.uuid4().hex}"
    versions.select(F.col("path").cast("long").alias("path"), blob_of(F.col("text")).alias("blob")).write.parquet(run)
    seen = spark.read.schema(VERSIONS).parquet(run)
    done = _ledger(spark, ledger, "scans", SCANS).filter(F.col("rules") == rules_version)
    # any one path stands for its blob; where no path has a name, a null does
    new = written(seen.groupBy("blob").agg(F.min("path").alias("path")).join(done, "blob", "left_anti"), "secret-new")
    held = versions.select(F.col("path").cast("long").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # few new blobs are picked out where the texts are read; else texts meet them by path, each once
    texts = held.join(ids_fit(new.filter("path is not null"), MOST_BLOBS), "path").filter(blob_of(F.col("text")) == F.col("blob")).select("blob", "text")
    nameless = held.filter("path is null").select(blob_of(F.col("text")).alias("blob"), "text").join(new.filter("path is null").select("blob"), "blob", "left_semi").dropDuplicates(["blob"])
    # written, so that no filter of the scan reaches texts that are known already
    texts = written(texts.unionByName(nameless).dropDuplicates(["blob"]) if _repeated(seen) else texts.unionByName(nameless), "secret-texts")
    found = findings(texts, rules)
    found.select("blob", F.lit(rules_version).alias("rules"), "rank", "kind", "start", "end").write.mode("append").parquet(f"{ledger}/findings")
    new.select("blob", F.lit(rules_version).alias("rules")).write.mode("append").parquet(f"{ledger}/scans")
    discard(texts)
    discard(new)
    return seen, _ledger(spark, ledger, "findings", FINDINGS).filter(F.col("rules") == rules_version).drop("rules").distinct()


def _repeated(versions: DataFrame) -> bool:
    """Whether a path has the same blob twice."""
    return bool(versions.filter("path is not null").groupBy("path", "blob").count().filter("count > 1").limit(1).count())


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, rules_version: str = VERSION) -> DataFrame:
    """Scan the new blobs of versions (path, text), add to the ledger, and return path, blob, rank, kind, start, end of all findings.

    A pair of blob and rules version is marked as scanned after its findings
    are written, so a run that breaks off is made good by the next one: findings
    are read distinct. Null text is an empty blob. Every path of the ledger is returned, of
    earlier runs as well, with nulls where its blob has no findings.
    """
    _, known = _scanned(versions, ledger, rules, rules_version)
    return _ledger(versions.sparkSession, ledger, "versions", VERSIONS).join(known, "blob", "left")


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame, ledger: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each given row, by way of the ledger.

    Rows of earlier runs are not among them, though their blobs aren't scanned again. Null text is
    an empty one and has no findings; repeated rows and null ids each get a row; an empty table gives none; other columns are not read.
    """
    rows, known = _scanned(docs.select(F.col("doc_id").alias("path"), "text"), ledger, RULES, VERSION)
    # the findings of one blob: at most as many as its text has places
    known = known.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"))
    rows = rows.join(known, "blob", "left")
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
    base = F.filter(found, lambda x: x["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("path").alias("doc_id"), *(count(r.kind) for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(found).alias("spans"))


def redacted(docs: DataFrame, ledger: str) -> DataFrame:
    """docs with each secret replaced by [REDACTED], overlapping ones by a single mark; n_chars, if there, follows.

    All rows and all other columns stay as they are; null and empty texts and those without
    findings do too; rows that share an id get each their own text's marks; an empty table gives no rows.
    """
    _, known = _scanned(docs.select(F.col("doc_id").alias("path"), "text"), ledger, RULES, VERSION)
    blob, found = unused(docs, "blob"), unused(docs, "found")
    known = known.groupBy(F.col("blob").alias(blob)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(found))
    known = ids_fit(written(known, "secret-found"), MOST_BLOBS)
    rows = docs.join(known, blob_of(F.col("text")) == F.col(blob), "left")
    acc = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= a["at"], F.concat(F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit("[REDACTED]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))

    clean = F.aggregate(found, acc, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    rows = rows.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), shared_dir(spark, "secret-ledger"))
