"""Audit of generated text: citations, numbers, counts, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITATION = r"\[\s*\d+(?:\s*(?:[-–,;]|dan|and)\s*\d+)*\s*\]"
NUMBER = r"(?<![\w.,])\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?(?![\w])|(?<![\w.,])\d+(?:[.,]\d+)?(?![\w])"
SCALES = {"ribu": 1e3, "thousand": 1e3, "juta": 1e6, "million": 1e6, "miliar": 1e9, "billion": 1e9, "triliun": 1e12, "trillion": 1e12}


def citations(answers: DataFrame, id_col: str, text_col: str, most: int = 31) -> DataFrame:
    """Rows (id, source): numbers in brackets, lists and ranges; a range of more than `most` ids names its ends only."""
    group = answers.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(CITATION), F.lit(0))).alias("place", "g"))
    part = group.select(id_col, "place", F.explode(F.regexp_extract_all("g", F.lit(r"\d+(?:\s*[-–]\s*\d+)?"), F.lit(0))).alias("p"))
    a, b = F.regexp_extract("p", r"^(\d+)", 1).try_cast("bigint"), F.nullif(F.regexp_extract("p", r"[-–]\s*(\d+)$", 1), F.lit("")).try_cast("bigint")
    ids = F.when(b.isNull(), F.array(a)).when((b >= a) & (b - a < most), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))
    return part.select(id_col, "place", F.explode(ids).alias("source")).where("source is not null")


def invalid_citations(cited: DataFrame, allowed: DataFrame, id_col: str) -> DataFrame:
    return cited.select(id_col, "source").distinct().join(allowed, [id_col, "source"], "left_anti")


def number_sources(cited: DataFrame, kinds: DataFrame, id_col: str) -> DataFrame:
    """Distinct sources numbered in order of first use, each kind by itself. kinds (source, kind)."""
    first = cited.groupBy(id_col, "source").agg(F.min("place").alias("place")).join(kinds, "source")
    return first.withColumn("number", F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("place", "source"))).drop("place")


def readings(number: Column) -> Column:
    """Values that a written number may have: separators of thousands dropped, the last one taken as decimal sign, or both."""
    digits = F.translate(number, ".,", "")
    last = F.regexp_replace(F.translate(F.regexp_replace(number, r"[.,](?=.*[.,])", ""), ",", "."), r"[^0-9.]", "")
    return F.array_distinct(F.array_compact(F.array(digits.try_cast("double"), last.try_cast("double"))))


def extract_numbers(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, written, value, unit, approximate): every reading of each number, times a scale word after it; unit: one of the last
    written digit."""
    scale = "|".join(SCALES)
    found = texts.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(rf"(?i)(?:sekitar |about |approximately |~)?(?:{NUMBER})(?:\s+(?:{scale})\b)?"), F.lit(0))).alias("place", "s"))
    n = found.withColumn("written", F.regexp_extract("s", r"([\d.,]*\d)", 1)).withColumn("scale", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), F.lower(F.regexp_extract("s", rf"(?i)({scale})\b", 1))), F.lit(1.0)))
    v = n.withColumn("reading", F.explode(readings(F.col("written"))))
    decimals = F.when(F.col("reading") == F.floor("reading"), 0).otherwise(F.length(F.regexp_extract("written", r"[.,](\d+)$", 1)))
    return v.select(id_col, "place", "written", (F.col("reading") * F.col("scale")).alias("value"), (F.pow(F.lit(10.0), -decimals) * F.col("scale")).alias("unit"), F.col("s").rlike(r"(?i)^(sekitar|about|approx|~)").alias("approximate"))


def unsupported_numbers(answers: DataFrame, sources: DataFrame, id_col: str) -> DataFrame:
    """Numbers of which no reading has a source value within one unit of its last digit (5 % if approximate). Values meet in bins of
    their magnitude (quarter powers of two), neighbours included, so the band join is an equi-join."""
    bin_of = lambda v: F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-9))) * 4)
    reach = lambda c: F.greatest(F.col("unit"), F.when(F.col("approximate"), F.abs("value") * 0.05).otherwise(0.0))
    a = answers.withColumn("reach", reach(None))
    low, high = bin_of(F.greatest(F.col("value") - F.col("reach"), F.lit(0.0))), bin_of(F.col("value") + F.col("reach"))
    # A small number's reach spans many bins down to zero; below 64 every source value is in one bin.
    small = lambda b: F.greatest(b, F.lit(24))
    spread = a.withColumn("bin", F.explode(F.sequence(small(low), small(high))))
    s = sources.select(id_col, F.col("value").alias("source"), small(bin_of(F.col("value"))).alias("bin")).distinct()
    ok = spread.join(s, [id_col, "bin"]).where(F.abs(F.col("source") - F.col("value")) <= F.col("reach")).select(id_col, "place").distinct()
    return a.select(id_col, "place", "written").distinct().join(ok, [id_col, "place"], "left_anti")


def unsupported_counts(answers: DataFrame, sources: DataFrame, id_col: str, text_col: str, nouns: str) -> DataFrame:
    """Counts ('18 emiten') that don't stand in the sources; groups of thousands are equal to plain digits."""
    def counts(df: DataFrame) -> DataFrame:
        m = df.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rf"(?i)\b(\d[\d.,]*)\s+(?:{nouns})\b"), F.lit(0))).alias("s"))
        return m.select(id_col, F.regexp_replace(F.regexp_extract("s", r"^(\d[\d.,]*)", 1), "[.,]", "").alias("n"), F.lower(F.regexp_extract("s", r"(\p{L}+)$", 1)).alias("noun")).distinct()

    return counts(answers).join(counts(sources), [id_col, "n", "noun"], "left_anti")


def wrong_names(pairs: DataFrame, names: DataFrame, share: float = 0.6) -> DataFrame:
    """pairs (code, name) as written, names (code, official): names that neither contain the other nor share so many of their words."""
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " ")), " "))
    j = pairs.join(names, "code").withColumn("a", words("name")).withColumn("b", words("official"))
    common = F.size(F.array_intersect("a", "b"))
    fits = (common == F.least(F.size("a"), F.size("b"))) | (common >= share * F.size(F.array_union("a", "b")))
    return j.groupBy("code", "name").agg(F.bool_or(fits).alias("fits")).where("not fits").select("code", "name")


def contradictions(statements: DataFrame, flags: DataFrame, key: str, text_col: str, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Statements that fit a pattern while the filed flag has the other value. rules: (flag, pattern, value that it claims)."""
    j = statements.join(flags, key)
    hits = F.array_compact(F.array(*(F.when(F.col(text_col).rlike(p) & (F.col(flag) != F.lit(value)), F.lit(flag)) for flag, p, value in rules)))
    return j.withColumn("flag", F.explode(hits)).select(key, text_col, "flag")


def fix_kind(parties: DataFrame) -> DataFrame:
    """INDIVIDUAL becomes COMPANY where the name is a company's."""
    from filingflow.functions.names import is_company

    return parties.withColumn("kind", F.when((F.col("kind") == "INDIVIDUAL") & is_company("name"), "COMPANY").otherwise(F.col("kind")))
