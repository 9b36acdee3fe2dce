"""Search over documents and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions.text import affirmed
from filingflow.operators.relational import first_per

WORD = r"[\p{L}\p{N}]+"


def words(col: str) -> Column:
    """Words in lower case; digits of seven and more are no words."""
    return F.filter(F.regexp_extract_all(F.lower(F.col(col)), F.lit(WORD), F.lit(0)), lambda w: ~w.rlike(r"^[0-9]{7,}$"))


def words_of(terms: list[str]) -> list[str]:
    return sorted({w for t in terms for w in t.lower().split()})


def build_postings(docs: DataFrame, id_col: str, text_col: str, only: list[str] | None = None) -> DataFrame:
    """Rows (term, doc_id, tf), perhaps of some terms only, which are picked before anything is shuffled; Spark counts what a task
    reads before it sends it."""
    own = words(text_col) if only is None else F.filter(words(text_col), lambda w: w.isin(only))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(own).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """docs, one row a document: rows (word, docs), each word with the number of documents that hold it. A document gives each of its
    words once, so tasks count before they send: what is shuffled grows with the words of a task, not with postings. Null has no words."""
    return docs.select(F.explode(F.array_distinct(words(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


def quoted(term: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in term)


def search(docs: DataFrame, postings: DataFrame, id_col: str, text_col: str, terms: list[str], codes: list[str] = (), order: str | None = None) -> DataFrame:
    """Documents that hold one of the terms (all words by the postings, then the phrase with word borders) or one of the codes, in
    capitals."""
    wanted = [(k, w) for k, t in enumerate(terms) for w in t.lower().split()]
    table = docs.sparkSession.createDataFrame(wanted or [(None, None)], "k int, term string").where("k is not null")
    sizes = {k: len(set(t.lower().split())) for k, t in enumerate(terms)}
    need = F.try_element_at(F.create_map(*[F.lit(x) for kv in (sizes or {-1: 0}).items() for x in kv]), F.col("k"))
    short = postings.join(F.broadcast(table.distinct()), "term").groupBy("k", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") == need).select("doc_id").distinct()
    phrase = "|".join(rf"(?<![\p{{L}}\p{{N}}]){quoted(t)}(?![\p{{L}}\p{{N}}])" for t in terms)
    out = docs.join(short, docs[id_col] == short["doc_id"], "left_semi").where(F.col(text_col).rlike(f"(?iu){phrase}")) if terms else docs.limit(0)
    if codes:
        by_code = docs.where(F.col(text_col).rlike(r"(?<![A-Za-z0-9])(" + "|".join(map(quoted, codes)) + r")(?![A-Za-z0-9])"))
        out = out.unionByName(by_code).dropDuplicates([id_col])
    return out.orderBy(F.desc(order)) if order else out


def count_hits(docs: DataFrame, id_col: str, text_col: str, term: str, most: int = 999) -> DataFrame:
    """How often the term stands in each document; the number shown ends at `most`."""
    n = F.regexp_count(F.lower(F.col(text_col)), F.lit(quoted(term.lower())))
    return docs.select(id_col, F.least(n, F.lit(most)).alias("hits")).where("hits > 0")


def select_records(records: DataFrame, id_col: str, pattern: str, code: str | None = None) -> DataFrame:
    """Records with the code or an affirmed term; prose brings its neighbours of the same context, an item the record before its list."""
    w = Window.partitionBy(id_col).orderBy("ordinal")
    hit = affirmed("content", pattern)
    if code:
        hit = hit | F.col("content").rlike(rf"\b{code}\b")
    r = records.withColumn("hit", hit).withColumn("prose", F.col("hit") & (F.col("kind") == "text"))
    near = (F.lag("prose").over(w) & F.lag("context").over(w).eqNullSafe(F.col("context"))) | (F.lead("prose").over(w) & F.lead("context").over(w).eqNullSafe(F.col("context")))
    # The last record before a run of items stands for the list's opening.
    r = r.withColumn("run", F.sum((F.col("kind") != "item").cast("int")).over(w))
    opens = F.max((F.col("hit") & (F.col("kind") == "item")).cast("int")).over(Window.partitionBy(id_col, "run")) == 1
    why = F.when(F.col("hit"), "hit").when(F.coalesce(near, F.lit(False)), "neighbour").when(opens & (F.col("kind") != "item"), "opening")
    return r.withColumn("why", why).where("why is not null").drop("hit", "prose", "run")


def expand_links(records: DataFrame, selected: DataFrame, id_col: str) -> DataFrame:
    """Records with an id that selected records of the document link to."""
    refs = selected.select(id_col, F.explode(F.regexp_extract_all("content", F.lit(r'href="#([^"]+)"'), F.lit(1))).alias("anchor")).distinct()
    anchors = records.select(id_col, "ordinal", F.explode(F.regexp_extract_all("content", F.lit(r'\bid="([^"]+)"'), F.lit(1))).alias("anchor"))
    return anchors.join(refs, [id_col, "anchor"]).select(id_col, "ordinal").distinct()


def prune_comentions(lines: DataFrame, code: str, signs: int = 60) -> DataFrame:
    """lines (doc_id, line, code, content): finding lines in other sections that name the code and are not in its own section."""
    norm = F.substring(F.trim(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", " ")), 1, signs)
    l = lines.withColumn("norm", norm)  # noqa: E741
    own = l.where(F.col("code") == code).select("norm").distinct()
    return l.where((F.col("code") != code) & F.col("content").rlike(rf"\b{code}\b")).join(own, "norm", "left_anti").drop("norm")


def thematic_passages(records: DataFrame, id_col: str, places: str, relations: str) -> DataFrame:
    """Records that hold a place and a relation cue, with their neighbours marked."""
    w = Window.partitionBy(id_col).orderBy("ordinal")
    hit = F.col("content").rlike(places) & F.col("content").rlike(relations)
    r = records.withColumn("hit", hit)
    return r.withColumn("near", F.coalesce(F.lag("hit").over(w), F.lit(False)) | F.coalesce(F.lead("hit").over(w), F.lit(False))).where("hit or near").select(id_col, "ordinal", "hit")


def nearest_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """terms (term), vocabulary (word, docs): for each term the word of one initial within 30 % of its length in edits; more than one
    edit only if one word's letters stand in order in the other. Fewest edits, then most documents, then the word.

    They meet by initial and length. Words within one edit differ in at most two letters of their sets, and letters that stand in
    order in another word are a subset of its letters: sets as 64 bits leave few pairs to compare, whatever the vocabulary's size."""
    letters = lambda c: F.expr(f"aggregate(split({c}, ''), 0L, (bits, c) -> bits | shiftleft(1L, ascii(c) % 64))")
    off = F.floor(F.length("term") * 3 / 10).cast("int")
    t = terms.withColumn("initial", F.substring("term", 1, 1)).withColumn("own", letters("term")).withColumn("size", F.explode(F.sequence(F.length("term") - off, F.length("term") + off)))
    v = vocabulary.withColumn("initial", F.substring("word", 1, 1)).withColumn("size", F.length("word")).withColumn("other", letters("word"))
    both = F.col("own").bitwiseAND(F.col("other"))
    alike = (F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= 2) | (both == F.col("own")) | (both == F.col("other"))
    d = F.levenshtein("term", "word")
    j = t.join(v, ["initial", "size"]).where(alike).withColumn("edits", d).where((F.col("edits") * 10 <= F.length("term") * 3) & (F.col("edits") > 0))
    ok = (F.col("edits") <= 1) | F.expr("regexp_like(term, regexp_replace(word, '(.)', '$1.*'))") | F.expr("regexp_like(word, regexp_replace(term, '(.)', '$1.*'))")
    return first_per(j.where(ok), ["term"], [F.asc("edits"), F.desc("docs"), F.asc("word")]).select("term", "word", "edits")


def longest_known_phrase(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, most: int = 6) -> DataFrame:
    """phrases (phrase), in lower case: the longest of at most so many words that stands in each text.

    Words by themselves count once a text. A longer phrase can only stand where its first two words do: each place gives one run of words,
    and only a run whose first two words begin some phrase is cut to all lengths and looked up."""
    w = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0))
    t = texts.select(id_col, w.alias("w"))
    p = phrases.select("phrase").distinct().withColumn("n", F.size(F.split("phrase", " ")))
    single = t.select(id_col, F.explode(F.array_distinct("w")).alias("phrase")).join(p.where("n = 1"), "phrase")
    runs = t.where(F.size("w") >= 2).select(id_col, F.explode(F.expr(f"transform(sequence(1, size(w) - 1), i -> array_join(slice(w, i, {most}), ' '))")).alias("run"))
    begins = p.where(F.col("n").between(2, most)).select(F.substring_index("phrase", " ", 2).alias("begin")).distinct()
    near = runs.withColumn("begin", F.substring_index("run", " ", 2)).join(begins, "begin", "left_semi")
    cut = near.select(id_col, F.explode(F.expr(f"transform(sequence(2, {max(2, most)}), n -> substring_index(run, ' ', n))")).alias("phrase"))
    hit = single.unionByName(cut.join(p.where(F.col("n").between(2, most)), "phrase")) if most >= 2 else single
    return hit.groupBy(id_col).agg(F.max_by("phrase", F.struct("n", "phrase")).alias("phrase"))


def detect_codes(texts: DataFrame, id_col: str, text_col: str, codes: DataFrame, cues: list[str]) -> DataFrame:
    """codes (code, wordlike): codes in capitals, and lower-case ones if they are no words or follow a cue."""
    tokens = texts.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("place", "token"))
    w = Window.partitionBy(id_col).orderBy("place")
    t = tokens.withColumn("before", F.lower(F.lag("token").over(w))).withColumn("code", F.upper("token"))
    j = t.join(F.broadcast(codes), "code").where((F.col("token") == F.col("code")) | ~F.col("wordlike") | F.col("before").isin(cues))
    return j.select(id_col, "code").distinct()


def infer_handles(texts: DataFrame, text_col: str, common: list[str] = ()) -> DataFrame:
    """Names written with @ at least half of the times that they stand."""
    token = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"@?[a-z0-9_]{3,}"), F.lit(0))).alias("t"))
    g = token.groupBy(F.regexp_replace("t", "^@", "").alias("handle")).agg(F.sum(F.col("t").startswith("@").cast("bigint")).alias("marked"), F.count("*").alias("n"))
    return g.where((F.col("marked") > 0) & (2 * F.col("marked") >= F.col("n")) & ~F.col("handle").isin(list(common)))


def codes_by_handle(records: DataFrame, id_col: str, k: int = 12) -> DataFrame:
    """records (id, handle, codes): the codes that a handle's records name, with records and documents; the first k."""
    g = records.select("handle", id_col, "ordinal", F.explode(F.array_distinct("codes")).alias("code")).groupBy("handle", "code").agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("docs"))
    return first_per(g, ["handle"], [F.desc("n"), F.desc("docs"), F.asc("code")], k)


def top_passages(records: DataFrame, id_col: str, terms: list[str], per_doc: int = 3, docs: int = 8) -> DataFrame:
    """Records by the number of words hit: the best few of each of the best few documents."""
    score = sum((F.lower("content").contains(t.lower()).cast("int") for t in terms), F.lit(0))
    hit = records.withColumn("score", score).where("score > 0")
    best = first_per(hit, [id_col], [F.desc("score"), F.asc("ordinal")], per_doc)
    chosen = hit.groupBy(id_col).agg(F.max("score").alias("most")).orderBy(F.desc("most"), id_col).limit(docs)
    return best.join(F.broadcast(chosen.select(id_col)), id_col, "left_semi").select(id_col, "ordinal", "score")


def overview(records: DataFrame, id_col: str, date: str) -> DataFrame:
    """Codes with the number of documents that mention them and the last date."""
    g = records.select(id_col, date, F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.countDistinct(id_col).alias("docs"), F.max(date).alias("last"))
    return g.orderBy(F.desc("docs"), F.desc("last"), "code")


def detect_handles(texts: DataFrame, id_col: str, text_col: str, handles: DataFrame, k: int = 4) -> DataFrame:
    """handles (handle): those in a text, with @ or as a bare word; the first k by place."""
    t = texts.select(id_col, F.posexplode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"@?[a-z0-9_]{3,}"), F.lit(0))).alias("place", "t")).withColumn("handle", F.regexp_replace("t", "^@", ""))
    g = t.join(handles.select("handle").distinct(), "handle").groupBy(id_col, "handle").agg(F.min("place").alias("place"))
    return first_per(g, [id_col], [F.asc("place")], k)


def rare_terms(queries: DataFrame, id_col: str, text_col: str, postings: DataFrame, most: int = 10) -> DataFrame:
    """Capitalised words of a query that stand in 1 to `most` documents."""
    w = queries.select(id_col, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"\b(\p{Lu}[\p{L}\p{N}]*)"), F.lit(1)), F.lower))).alias("term"))
    df = postings.join(w.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("docs")).where(F.col("docs") <= most)
    return w.join(df, "term").select(id_col, "term", "docs")


def negated_only(records: DataFrame, id_col: str, pattern: str) -> DataFrame:
    """Documents whose only hits are denied."""
    hits = records.where(F.col("content").rlike(pattern)).withColumn("ok", affirmed("content", pattern))
    return hits.groupBy(id_col).agg(F.count("*").alias("hits"), F.bool_or("ok").alias("ok")).where("not ok").select(id_col, "hits")
