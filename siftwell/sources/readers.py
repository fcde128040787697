"""Line-addressed JSON, importers for labelled corpora and reputation lists, checksums and manifests."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RECORD = "id string, text string, context string, spam boolean, slop boolean"
FIELDS = ("id", "text", "context", "spam", "slop")
CONTEXTS = ("comment", "review", "forum", "other")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines numbered from 1 in each file, blank ones too.

    Works on splits: lines are numbered within the split that Spark read, then moved by the lines of the
    splits before it, so no file needs to fit in one row or task.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    at = Window.partitionBy("file", "block").orderBy("_id")
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = blocks.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    return raw.withColumn("_n", F.row_number().over(at)).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("_n")).alias("line"), "value")


def parsed_records(lines: DataFrame) -> DataFrame:
    """(line, id, text, context, spam, slop, error) of JSON lines (line, value); blank lines are left out.

    error names the first fault: json (syntax, a wrong type, an unknown field or context), then empty_id, empty_text,
    no_labels, then duplicate_id for a repeated id of a sound record.
    """
    own = lines.where(F.trim(F.col("value")) != "")
    r = own.withColumn("r", F.from_json("value", RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    extra = F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, FIELDS)))) > 0
    context = F.coalesce(F.col("r.context"), F.lit("other"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull() | F.coalesce(extra, F.lit(True)) | F.col("r.id").isNull() | F.col("r.text").isNull() | ~context.isin(*CONTEXTS)
    blank = lambda c: F.regexp_replace(F.col(c), r"(?U)\s+", "") == ""
    error = F.when(bad, "json").when(blank("r.id"), "empty_id").when(blank("r.text"), "empty_text").when(F.col("r.spam").isNull() & F.col("r.slop").isNull(), "no_labels")
    out = r.select("line", "r.id", "r.text", context.alias("context"), "r.spam", "r.slop", error.alias("error"))
    nth = F.row_number().over(Window.partitionBy("id", F.col("error").isNull()).orderBy("line"))
    return out.withColumn("error", F.coalesce("error", F.when(nth > 1, "duplicate_id")))


def first_error(records: DataFrame) -> DataFrame:
    """(line, error) of the lowest faulty line; no row if there is none."""
    return records.where("error IS NOT NULL").agg(F.min("line").alias("line"), F.min_by("error", "line").alias("error")).where("line IS NOT NULL")


def labelled_tsv(lines: DataFrame, source: str) -> DataFrame:
    """(id, text, context, spam, error) of lines (line, value) "label<TAB>text", split at the first tab; empty lines are left out."""
    own = lines.where("value <> ''")
    label = F.substring_index("value", "\t", 1)
    text = F.substring(F.col("value"), F.instr("value", "\t") + 1, F.length("value"))
    tab = F.contains(F.col("value"), F.lit("\t"))
    return own.select(F.concat(F.lit(source + ":"), F.col("line")).alias("id"), F.when(tab, text).alias("text"), F.lit("other").alias("context"), F.when(label == "spam", True).when(label == "ham", False).alias("spam"), F.when(~tab | ~label.isin("spam", "ham"), "bad_line").alias("error"))


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(member, line, value): the lines, from 1 on, of the members of zip files whose names match; members stream by lines."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as whole:
                    for name in sorted(n for n in whole.namelist() if re.fullmatch(pattern, n.rsplit("/", 1)[-1])):
                        with whole.open(name) as raw:
                            lines = enumerate(io.TextIOWrapper(raw, "utf-8-sig", newline="\n"), 1)
                            while some := [(name, k, x.rstrip("\n").removesuffix("\r")) for k, x in islice(lines, 4096)]:
                                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["member", "line", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, line long, value string")


def labelled_tsv_zip(spark: SparkSession, path: str, source: str, member: str = "SMSSpamCollection") -> DataFrame:
    """``labelled_tsv`` of a member of a zip file."""
    return labelled_tsv(zip_members(spark, path, re.escape(member)), source)


def comment_zip(spark: SparkSession, path: str, source: str, pattern: str = r"Youtube.*\.csv") -> DataFrame:
    """``comment_csv`` of all matching members of zip files, in which quoted fields may hold line breaks."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as whole:
                    for name in sorted(n for n in whole.namelist() if re.fullmatch(pattern, n.rsplit("/", 1)[-1])):
                        with whole.open(name) as raw:
                            rows = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                            missing = {"COMMENT_ID", "CONTENT", "CLASS"} - set(rows.fieldnames or [])
                            if missing:
                                raise ValueError(f"missing columns in {name}: {sorted(missing)}")
                            stem = name.rsplit("/", 1)[-1].removesuffix(".csv")
                            while some := list(islice(rows, 1024)):
                                for r in some:
                                    if r["CLASS"] not in ("0", "1"):
                                        raise ValueError(f"bad class in {name}: {r['CLASS']}")
                                columns = ([f"{source}:{stem}:{r['COMMENT_ID']}" for r in some], [r["CONTENT"] for r in some], ["comment"] * len(some), [r["CLASS"] == "1" for r in some])
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "text", "context", "spam"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id string, text string, context string, spam boolean")


def comment_csv(spark: SparkSession, paths: str | list[str], source: str) -> DataFrame:
    """(id, text, context, spam) of CSV files with COMMENT_ID, CONTENT and CLASS (0 or 1), quoted line breaks allowed."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths).withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    missing = {"COMMENT_ID", "CONTENT", "CLASS"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    spam = F.when(F.col("CLASS") == "1", True).when(F.col("CLASS") == "0", False).otherwise(F.raise_error(F.concat(F.lit("bad class: "), F.coalesce("CLASS", F.lit("null")))).cast("boolean"))
    return raw.select(F.concat_ws(":", F.lit(source), "stem", "COMMENT_ID").alias("id"), F.col("CONTENT").alias("text"), F.lit("comment").alias("context"), spam.alias("spam"))


def deduplicated(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without exact repeats, ids whose repeats differ)."""
    distinct = records.distinct()
    return distinct, distinct.groupBy("id").count().where("count > 1").select("id")


LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?")


@F.pandas_udf(StringType())
def normal_domain(values: pd.Series) -> pd.Series:
    """A domain in lower-case ASCII (international names encoded), null if it isn't one of two labels or more."""

    def one(value: str | None) -> str | None:
        name = (value or "").strip().rstrip(".").lower()
        try:
            name = name.encode("idna").decode("ascii") if name else ""
        except UnicodeError:
            return None
        labels = name.split(".")
        return name if 2 <= len(labels) and len(name) <= 253 and all(LABEL.fullmatch(x) for x in labels) else None

    return values.map(one)


def domain_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sorted distinct domains, invalid lines) of lines (line, value); blank lines and comments are left out."""
    own = lines.withColumn("value", F.trim("value")).where("value <> '' AND NOT startswith(value, '#')").withColumn("domain", normal_domain("value"))
    return own.where("domain IS NOT NULL").select("domain").distinct().orderBy("domain"), own.where("domain IS NULL").select("line", "value")


def ip_ranges(lines: DataFrame) -> DataFrame:
    """(key, score) of lines "a.b.c score"; comments and malformed lines are left out."""
    parts = F.filter(F.split("value", r"(?U)\s+"), lambda p: p != "")
    octets = F.split(F.get(parts, F.lit(0)), r"\.")
    number = F.transform(octets, lambda o: F.when(o.rlike(r"^\+?[0-9]+$"), o.try_cast("int")))
    score = F.get(parts, F.lit(1)).try_cast("double")
    ok = (F.size(octets) == 3) & F.forall(number, lambda n: n.isNotNull() & n.between(0, 255)) & score.isNotNull()
    return lines.where(~F.startswith(F.trim("value"), F.lit("#"))).select(ok.alias("ok"), F.array_join(number.cast("array<string>"), ".").alias("key"), score.alias("score")).where("ok").select("key", "score")


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """(path, length, sha256, matches) of files against an expected digest, in either case."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return found.withColumn("matches", F.col("sha256") == sha256.lower())


def gate(df: DataFrame, least: int, most: int) -> DataFrame:
    """(records, ok): whether the number of rows lies within the gate."""
    if not 0 <= least <= most:
        raise ValueError("the gate must be 0 <= least <= most")
    return df.agg(F.count("*").alias("records")).withColumn("ok", F.col("records").between(least, most))


def selected_sources(manifest: DataFrame, wanted: list[str]) -> DataFrame:
    """(pos, id) of the manifest's sources (pos, id): all in order without a wish, else the wished ones by id.

    Raises on an id the manifest lacks.
    """
    if not wanted:
        return manifest.select("pos", "id").orderBy("pos")
    spark = manifest.sparkSession
    ask = spark.createDataFrame([(w,) for w in sorted(set(wanted))], "id string")
    unknown = [r[0] for r in ask.join(manifest, "id", "left_anti").orderBy("id").collect()]
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return manifest.join(ask, "id", "left_semi").select("pos", "id").orderBy("id")


def check_manifest(entries: list[dict]) -> None:
    """Raises on repeated ids or outputs, an output outside the root, a licence without https, or a bad gate."""
    for field in ("id", "output"):
        values = [e[field] for e in entries]
        if len(values) != len(set(values)):
            raise ValueError(f"repeated {field}")
    for e in entries:
        parts = e["output"].split("/")
        if e["output"].startswith("/") or ".." in parts or e["output"] in ("", "."):
            raise ValueError(f"output outside the root: {e['output']}")
        if not str(e.get("license_url", "")).startswith("https://"):
            raise ValueError(f"licence of {e['id']} needs an https address")
        if not 0 <= e.get("minimum_records", 0) <= e.get("maximum_records", 1 << 62):
            raise ValueError(f"bad gate of {e['id']}")


def decoded_requests(lines: DataFrame) -> DataFrame:
    """Request columns of JSON (value): unknown fields are allowed, context defaults to other, a bad ip is an error."""
    r = lines.withColumn("r", F.from_json("value", "text string, author_ip string, author_email string, author_name string, context string"))
    context = F.coalesce(F.col("r.context"), F.lit("other"))
    good_ip = F.col("r.author_ip").isNull() | is_ip(F.col("r.author_ip"))
    ok = F.col("r.text").isNotNull() & context.isin(*CONTEXTS) & good_ip
    return r.select(*(c for c in lines.columns if c != "value"), "r.text", "r.author_ip", "r.author_email", "r.author_name", context.alias("context"), ok.alias("ok"))


def is_ip(ip: Column) -> Column:
    from siftwell.functions.fingerprint import ip_key

    return ip_key(ip).isNotNull()
