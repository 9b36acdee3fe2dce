"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingflow.functions.text import parse_local


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Markdown, HTML and CSV files below a folder, without hidden paths: path, name, kind, size, body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kind = F.when(suffix == "md", "md").when(suffix.isin("html", "htm"), "html").when(suffix == "csv", "csv")
    rows = files.withColumn("name", name).withColumn("kind", kind).where("kind is not null").where(~F.replace(F.col("path"), F.lit(root), F.lit("")).rlike(r"/\."))
    return rows.select("path", "name", "kind", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "utf-8").alias("body"))


DAILY_INDEX = "days array<struct<d:string,f:string,detail:string,n:bigint,findings:bigint>>, tickers map<string,array<array<string>>>, users map<string,array<array<string>>>"


def read_daily_index(spark: SparkSession, path: str, part: str = "tickers") -> DataFrame:
    """Rows (key, date, file, values) of a daily index: entries name their day by number; entries that are too short or name no day go."""
    j = spark.read.schema(DAILY_INDEX).json(path, multiLine=True)
    days = j.select(F.posexplode("days").alias("idx", "d")).select("idx", F.to_date("d.d").alias("date"), F.col("d.f").alias("file"))
    rows = j.select(F.explode(part).alias("key", "rows")).select(F.lower("key").alias("key") if part == "users" else F.col("key"), F.explode("rows").alias("values")).where(F.size("values") >= 2)
    return rows.withColumn("idx", F.get("values", 0).try_cast("int")).join(F.broadcast(days), "idx").drop("idx").orderBy("date", "key")


def read_disclosures(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a disclosure index with at least seven fields and a known day."""
    return read_daily_index(spark, path).where(F.size("values") >= 7)


OWNERSHIP = "months array<struct<p:string>>, names array<string>, classes array<string>, companies array<struct<t:string,n:string,k:array<struct<tp:double,h:array<array<double>>,i:array<string>>>>>"


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (entity, period, party, class, local, pct, shares) of an ownership file with dictionaries of names and classes; periods
    without any list don't come."""
    j = spark.read.schema(OWNERSHIP).json(path, multiLine=True)
    c = j.select("months", "names", "classes", F.explode("companies").alias("c")).select("months", "names", "classes", F.col("c.t").alias("entity"), F.posexplode("c.k").alias("m", "k"))
    h = c.where("k is not null").select("entity", F.to_date(F.concat(F.get("months", F.col("m"))["p"], F.lit("-01"))).alias("period"), "names", "classes", F.explode("k.h").alias("h"))
    at = lambda k: F.get("h", F.lit(k))
    return h.select("entity", "period", F.get("names", at(1).cast("int")).alias("party"), F.get("classes", at(2).cast("int")).alias("class"), (at(3) == 1).alias("local"), at(4).alias("pct"), at(5).cast("bigint").alias("shares"))


def resolve_backrefs(reports: DataFrame) -> DataFrame:
    """reports (entity, idx, ref, holders): a row with ref has the list of the row numbered ref."""
    own = reports.where("ref is null").select("entity", F.col("idx").alias("ref"), F.col("holders").alias("_from"))
    return reports.join(own, ["entity", "ref"], "left").select("entity", "idx", F.coalesce("holders", "_from").alias("holders"))


def compress_repeats(reports: DataFrame) -> DataFrame:
    """The inverse of resolve_backrefs: reports (entity, idx, holders) as (entity, idx, ref, holders). A list equal to the last one that
    was stored, which is the last one that differs from the list before it, becomes that one's number; rows without a list between don't
    matter and stay without."""
    w = Window.partitionBy("entity").orderBy("idx")
    digest = F.when(F.col("holders").isNotNull(), F.sha2(F.to_json("holders"), 256))
    before = F.last("_digest", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = reports.withColumn("_digest", digest).withColumn("_same", F.coalesce(before == F.col("_digest"), F.lit(False)))
    stored = F.last(F.when(F.col("holders").isNotNull() & ~F.col("_same"), F.col("idx")), ignorenulls=True).over(w)
    return r.select("entity", "idx", F.when(F.col("_same"), stored).alias("ref"), F.when(~F.col("_same"), F.col("holders")).alias("holders"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Rows (code, date, close) of price files, named by code; values that are no numbers or not above zero go."""
    r = spark.read.option("header", "true").csv(path)
    return r.select(F.regexp_extract(F.input_file_name(), r"([A-Z0-9]{4,})[^/]*\.csv$", 1).alias("code"), F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.col("`Close 1D`").try_cast("double").alias("close")).where("close > 0 and date is not null")


def detect_delimiter(texts: DataFrame, text_col: str) -> DataFrame:
    """The sign among comma, semicolon and tab that the first line has most of; comma if none."""
    head = F.regexp_extract(F.col(text_col), r"^([^\r\n]*)", 1)
    n = {s: F.length(head) - F.length(F.replace(head, F.lit(s), F.lit(""))) for s in (",", ";", "\t")}
    most = F.greatest(*n.values())
    return texts.withColumn("delimiter", F.when(n[","] == most, ",").when(n[";"] == most, ";").otherwise("\t"))


def infer_numeric(df: DataFrame, cells: int = 200, share: float = 0.8) -> DataFrame:
    """Rows (column, numeric): whether enough of the first non-empty cells read as numbers. The sample is the feature: a look at the
    head of a table."""
    parts = []
    for c in df.columns:
        s = df.where(F.trim(F.col(c).cast("string")) != "").select(F.col(c).cast("string").alias("v")).limit(cells)
        parts.append(s.agg(F.avg(parse_local("v").isNotNull().cast("double")).alias("ok")).select(F.lit(c).alias("column"), F.coalesce(F.col("ok") >= share, F.lit(False)).alias("numeric")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ledger_summary(holdings: DataFrame, files: DataFrame, filings: DataFrame, backfill: DataFrame) -> DataFrame:
    """Per active file's entity: distinct holding rows, filings and their last date, and first and last month loaded."""
    h = holdings.join(files.where("active").select("file_id"), "file_id", "left_semi").select("entity").distinct()
    f = filings.groupBy("entity").agg(F.count("*").alias("filings"), F.max("date").alias("last_filing"))
    b = backfill.groupBy("entity").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    return h.join(f, "entity", "left").join(b, "entity", "left").fillna(0, ["filings"])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that are broken or no objects are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def content_hash(df: DataFrame) -> Column:
    """An aggregate that is equal for equal rows in any order."""
    return F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.pmod(F.xxhash64(F.lit(1), *df.columns), F.lit(1 << 31))))


def write_versioned(df: DataFrame, path: str) -> tuple[str, bool]:
    """Writes a table under its content's version if the version isn't there yet; gives the version and whether it was written."""
    version = df.agg(content_hash(df).alias("v")).first().v
    target = f"{path.rstrip('/')}/version={version}"
    try:
        df.write.mode("errorifexists").parquet(target)
    except Exception as e:  # noqa: BLE001
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        return version, False
    return version, True


def split_bytes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Pieces of at most n bytes that end between signs; together they are the text."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for key, text in frame.itertuples(index=False):
                raw, at, k = (text or "").encode("utf-8"), 0, 0
                while at < len(raw):
                    end = min(len(raw), at + n)
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    out.append((key, k, raw[at:end].decode("utf-8")))
                    at, k = end, k + 1
            yield pd.DataFrame(out, columns=["id", "piece", "content"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_col).mapInPandas(pieces, "id bigint, piece bigint, content string")


def entity_codes(positions: DataFrame, docs: DataFrame) -> DataFrame:
    """Codes of holdings and codes found in documents (codes: array) together."""
    return positions.select(F.col("entity").alias("code")).union(docs.select(F.explode("codes"))).distinct()
