"""Mentions of other issuers in the sections of an issuer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingflow.functions.text import clip, squash
from filingflow.operators import rules
from filingflow.operators.sections import line_owners

MARK = "\ufdd0"
TOKEN = rf"{MARK}?[A-Za-z0-9]+"


def relation_of(sentence: Column) -> Column:
    """The first relation class whose words stand in a sentence; a share deal only beside the word for shares."""
    out = None
    for name, pattern in rules.RELATION_PATTERNS:
        fits = sentence.rlike(pattern) & (sentence.rlike(rules.SHARE_WORD) if name == "transaksi_saham" else F.lit(True))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("lain")


def prose(line: Column) -> Column:
    """A line without link targets, addresses, names_with_underscores and handles."""
    out = F.regexp_replace(line, r"\]\([^)]*\)", "]")
    out = F.regexp_replace(out, r"https?://\S+", " ")
    out = F.regexp_replace(out, r"(?U)\w*_\w*", " ")
    return F.regexp_replace(out, r"(?U)(?<![\w@])@\w+", " ")


def core_words(name: Column) -> Column:
    """The words of an official name in lower case, without legal forms."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "(?U)" + rules.LEGAL_WORDS, " ")), r"\s+"), lambda w: w != "")


def scan_mentions(docs: DataFrame, codes: DataFrame, names: DataFrame, plain_words: DataFrame | None = None, official: str = r"^bei-", categories: list[str] = rules.MENTION_CATEGORIES) -> DataFrame:
    """Other codes that a line of an issuer's section names: one row a (code, document, line) with the relation class and the text of the
    sentence. docs (doc, cat, date, text): Markdown; codes (code); names (code, name): official names; plain_words (word): words that are
    no codes in lower case, besides rules.CODE_WORDS.

    A code is named in brackets after a capitalised word; in lower case beside a cue word; in capitals where an official document's
    sentence has a relation; or by its official name of two words and eight signs at least. Of the names that begin at one word the
    longest counts, and the owner's own longer name hides the shorter one in it. Where several forms name a code, the first of brackets,
    codes and names gives the sentence, then the first in the line. Headings, appendix lines and file names are no prose. Documents of
    other categories, null texts and lines without an owner give no row; repeated documents repeat their rows once.

    Names meet texts by an equi-join on their first two words; no dictionary is broadcast by hint."""
    lines = line_owners(docs.where(F.col("cat").isin(categories)).select("doc", "cat", "date", "text").distinct(), "doc", "text", codes, keep=["cat", "date"])
    lines = lines.where(F.col("owner").isNotNull() & ~F.col("content").rlike(r"^\s*#") & F.col("content").rlike(r"\S") & ~F.col("content").rlike(r"(?i)^\s*(?:[-*]\s*)?lampiran\b|\.pdf\b"))
    marked = F.regexp_replace(prose(F.col("content")), r"(?U)([A-Z][\w.]*\s*\()([A-Za-z]{4}\))", f"$1{MARK}$2")
    sentences = F.split(marked, r"(?<=[.;!?])\s+")
    # Tokens of a line with the sentence of each: a sentence ends in white space, so no token lies in two.
    lines = lines.withColumn("sentences", sentences).withColumn("tokens", F.flatten(F.transform("sentences", lambda s: F.regexp_extract_all(s, F.lit(f"({TOKEN})"), F.lit(1)))))
    lines = lines.withColumn("of", F.flatten(F.transform("sentences", lambda s, k: F.array_repeat(k, F.size(F.regexp_extract_all(s, F.lit(f"({TOKEN})"), F.lit(1)))))))
    lines = lines.withColumn("words", F.transform("tokens", lambda t: F.lower(F.replace(t, F.lit(MARK), F.lit("")))))
    each = lines.select("doc", "date", "cat", "owner", "line", F.posexplode("tokens").alias("at", "token"), "sentences", "of", "words")
    each = each.withColumn("sentence", F.trim(F.replace(F.get("sentences", F.get("of", F.col("at"))), F.lit(MARK), F.lit(""))))
    word, beside = F.get("words", F.col("at")), [F.get("words", F.col("at") - 1), F.get("words", F.col("at") + 1)]
    bare = F.replace("token", F.lit(MARK), F.lit(""))
    keep = ["doc", "date", "owner", "line", "at", "sentence"]

    coded = each.withColumn("code", F.upper(bare)).where(F.col("code") != F.col("owner"))
    in_brackets = F.col("token").startswith(MARK)
    lower = (bare == F.lower(bare)) & bare.rlike("[a-z]") & (F.length(bare) == 4) & ~bare.isin(rules.CODE_WORDS)
    cued = lower & F.coalesce(beside[0].isin(rules.CUES) | beside[1].isin(rules.CUES), beside[0].isin(rules.CUES), beside[1].isin(rules.CUES), F.lit(False))
    capital = (bare == F.upper(bare)) & bare.rlike("[A-Z]") & F.col("cat").rlike(official)
    named = coded.where(in_brackets | cued | capital).withColumn("capital", capital & ~in_brackets & (relation_of(F.col("sentence")) != "lain")).withColumn("lower", cued & ~in_brackets).withColumn("brackets", in_brackets).withColumn("word", word)
    if plain_words is not None:
        named = named.join(plain_words.select(F.lower("word").alias("word"), F.lit(True).alias("plain")).distinct(), "word", "left").withColumn("lower", F.col("lower") & F.col("plain").isNull())
    named = named.where("brackets OR lower OR capital").join(codes.select("code").distinct(), "code", "left_semi")
    found = named.select(*keep, "code", F.when(F.col("brackets"), 0).otherwise(1).alias("form"))

    official_names = names.select("code", core_words(F.col("name")).alias("name")).where((F.size("name") >= 2) & (F.length(F.array_join("name", " ")) >= 8)).distinct()
    keyed = official_names.select("code", "name", F.get("name", F.lit(0)).alias("w0"), F.get("name", F.lit(1)).alias("w1"))
    begun = each.select(*keep, "words", word.alias("w0"), beside[1].alias("w1")).join(keyed, ["w0", "w1"]).where(F.slice("words", F.col("at") + 1, F.size("name")) == F.col("name"))
    longest = begun.groupBy("doc", "line", "at").agg(F.min_by(F.struct("date", "owner", "sentence", "code"), F.struct(-F.size("name"), "code")).alias("x"))
    longest = longest.select("doc", "x.date", "x.owner", "line", "at", "x.sentence", "x.code", F.lit(2).alias("form")).where(F.col("code") != F.col("owner"))
    found = found.unionByName(longest)

    first = found.groupBy("code", "doc", "line").agg(F.min_by(F.struct("date", "owner", "sentence"), F.struct("form", "at")).alias("x"))
    sentence = F.col("x.sentence")
    return first.select("code", F.col("x.date").alias("date"), F.col("x.owner").alias("filer"), "doc", "line", relation_of(sentence).alias("relation"), clip(squash(F.regexp_replace(sentence, r"^[-* |]+", "")), 240).alias("snippet"))
