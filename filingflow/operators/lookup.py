"""Names of persons, firms and groups that a text asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingflow.operators.claims import spelling_variants
from filingflow.operators.search import WORD


def name_tokens(entities: DataFrame, name_col: str = "name", least: int = 4) -> DataFrame:
    """Rows (token, name): the words of each name, in lower case."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(name_col), F.lit(WORD), F.lit(0)))
    return entities.select(F.explode(F.filter(words, lambda w: F.length(w) >= least)).alias("token"), F.col(name_col).alias("name")).distinct()


def lookup_entities(texts: DataFrame, id_col: str, text_col: str, tokens: DataFrame, vocabulary: DataFrame, namelike: DataFrame, skip: DataFrame, issuer_words: DataFrame, most: int = 60, rare: int = 5, strange: int = 10) -> DataFrame:
    """Rows (id, word, token, fuzzy, names) of the names that each text asks for.

    tokens (token, name); vocabulary (term, docs): in how many documents a word stands; namelike (token): words mostly written with a
    capital; skip (token): common words and codes; issuer_words (token): words of issuers' official names, which name nobody here.

    A word of four letters or more names somebody if it is a token of at most `most` names, stands in at most `most` documents and looks
    like a name: by namelike, or by a capital that isn't the text's first word. A word of five letters or more that no document holds
    may stand for a name-like token one edit away; of several, the first in order. A text gives nothing at all if a capitalised word of 1
    to `strange` documents, which names nobody, stands next to a matched one: the full name is unknown. Beside a token of at most `rare`
    names, tokens of more names are ordinary words."""
    seq = texts.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("place", "said")).withColumn("word", F.lower("said"))
    own = seq.where(F.length("said") >= 4).where(~F.col("word").rlike(r"^\d+$")).groupBy("id", "word").agg(F.max_by("said", "place").alias("said"))
    first = seq.where("place = 0").select("id", F.col("said").alias("first"))
    counted = tokens.groupBy("token").agg(F.countDistinct("name").alias("n"))
    flag = lambda df, name: df.select(F.col("token").alias("word"), F.lit(True).alias(name)).distinct()
    w = own.join(skip.select(F.lower("token").alias("word")).distinct(), "word", "left_anti").join(first, "id")
    w = w.join(counted.withColumnRenamed("token", "word"), "word", "left").join(vocabulary.select(F.col("term").alias("word"), "docs"), "word", "left")
    w = w.join(flag(namelike, "like"), "word", "left").join(flag(issuer_words, "issuer"), "word", "left").fillna(False, ["like", "issuer"])
    capital = F.col("said").rlike(r"^\p{Lu}")
    w = w.withColumn("capital", capital).withColumn("nameish", F.col("like") | (capital & (F.col("said") != F.col("first"))))
    w = w.withColumn("exact", ~F.col("issuer") & F.coalesce(F.col("n") <= most, F.lit(False)) & (F.coalesce("docs", F.lit(0)) <= most) & F.col("nameish"))

    unheard = w.where("not issuer and n is null and docs is null").select("word").distinct()
    near = counted.where(F.col("n") <= most).join(namelike.select("token").distinct(), "token", "left_semi").select(F.col("token").alias("word"))
    variants = spelling_variants(unheard.withColumnRenamed("word", "token"), near).groupBy(F.col("token").alias("word")).agg(F.min("word").alias("variant"))
    w = w.join(variants, "word", "left").withColumn("matched", F.col("exact") | F.col("variant").isNotNull())
    w = w.withColumn("unknown", ~F.col("matched") & F.col("capital") & F.coalesce(F.col("docs").between(1, strange), F.lit(False)))

    by_place = Window.partitionBy("id").orderBy("place")
    placed = seq.select("id", "place", "word").join(w.select("id", "word", "matched", "unknown"), ["id", "word"], "left").fillna(False, ["matched", "unknown"])
    beside = F.coalesce(F.lag("matched").over(by_place), F.lit(False)) | F.coalesce(F.lead("matched").over(by_place), F.lit(False))
    doubtful = placed.withColumn("beside", beside).where("unknown and beside").select("id").distinct()

    hit = w.where("matched").select("id", "word", F.coalesce("variant", "word").alias("token"), F.col("variant").isNotNull().alias("fuzzy"))
    hit = hit.join(counted, "token").join(doubtful, "id", "left_anti").withColumn("rarest", F.min("n").over(Window.partitionBy("id")))
    hit = hit.where((F.col("rarest") > rare) | (F.col("n") <= rare))
    # Tokens that are kept have at most `most` names.
    names = tokens.join(hit.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return hit.join(names, "token").select(F.col("id").alias(id_col), "word", "token", "fuzzy", "names")
