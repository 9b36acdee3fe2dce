"""Events, claims, mentions, entities and their checks (N, C, L, E). Language-specific patterns are parameters; the defaults are the
rule tables below, which a user may replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingflow.functions.text import affirms, clauses, norm_text, squash
from filingflow.operators.records import lines, with_headings
from filingflow.operators.relational import first_per, fold_duplicates, nearest_join
from filingflow.operators.rules import ACTION_PATTERNS, FIRM, GROUP_PATTERNS, NAME_STOP, PARTY_AFTER, PARTY_ROLE, PERSON_ROLE, QUESTION_PATTERNS, RIGHTS_ALONE, SERVICE_ROLE, TITLE

ACTIONS = ACTION_PATTERNS
# Ranks of verdicts, official kinds, the line of a claim.
VERDICT_RANK = {"supported": 0, "contradicted": 1, "recorded": 2, "not_checkable": 3, "other_topic": 4, "no_basis": 5}
OFFICIAL = ["digest", "ki", "bei"]
CLAIM = r"^\s*-\s*\[([A-Z])\]\s*(.*?)\s*—\s*@(\S+)\s+(\d{1,2}[:.]\d{2})(.*?)\((F\d+)\)"


def classify_actions(df: DataFrame, text_col: str, rules: list[tuple[str, str]] = ACTIONS) -> DataFrame:
    """Types that some clause of a text affirms, as an array in the rules' order. What names a placement without rights is no rights issue
    unless a rights issue is named in other words too. A text is cut into clauses once."""
    each = lambda c: F.array_compact(F.array(*(F.when(affirms(c, p), F.lit(name)) for name, p in rules)))
    found = F.array_intersect(F.array(*(F.lit(name) for name, _ in rules)), F.flatten(F.transform(clauses(F.coalesce(text_col, F.lit(""))), each)))
    placed = lambda x: F.array_contains(x, "private_placement") & ~F.col(text_col).rlike(RIGHTS_ALONE)
    # What was found has a name of its own here, so that it is not computed again for each use.
    return df.withColumn("types", F.get(F.transform(F.array(found), lambda x: F.when(placed(x), F.array_except(x, F.array(F.lit("rights_issue")))).otherwise(x)), 0))


def typed(df: DataFrame, text_col: str, rules: list[tuple[str, str]] = ACTIONS) -> DataFrame:
    """One row for each type of a text (type); texts without types have none. The types are exploded with an empty row that is dropped
    then: a filter on the array would have Spark compute them once more for each place that it is pushed to."""
    return classify_actions(df, text_col, rules).select("*", F.explode_outer("types").alias("type")).drop("types").where("type is not null")


def digest_events(docs: DataFrame, id_col: str, text_col: str, factual: str, rules: list[tuple[str, str]] = ACTIONS) -> DataFrame:
    """Bullets under factual headings of a '## CODE' section, with their types; the section's own code doesn't count as a term."""
    h = with_headings(lines(docs, id_col, text_col), id_col)
    w = Window.partitionBy(id_col).orderBy("line")
    code = F.last(F.when(F.col("level") == 2, F.regexp_extract("title", r"^([A-Z]{4})\b", 1)), ignorenulls=True).over(w)
    b = h.withColumn("code", F.nullif(code, F.lit(""))).where(F.col("content").rlike(r"^\s*[-*]\s") & F.col("section").rlike(factual)).where("code is not null")
    b = b.withColumn("text", squash(F.regexp_replace("content", r"^\s*[-*]\s+", "")))
    bare = F.replace(F.col("text"), F.col("code"), F.lit(" "))
    return typed(b.select(id_col, "line", "code", "text", bare.alias("bare")), "bare", rules).select(id_col, "line", "code", "text", "type")


def text_events(records: DataFrame, id_col: str, codes: DataFrame, rules: list[tuple[str, str]] = ACTIONS) -> DataFrame:
    """Sentences of records with types: one row a named code, else the code of the heading, and a type. Names 'Tbk (CODE)' are the
    owner's and name no other."""
    s = records.select(id_col, "ordinal", F.col("code").alias("owner"), F.posexplode(F.split("content", r"(?<=[.!?])\s+|\n")).alias("place", "text")).where(~F.col("text").rlike(r"^\s*\[\^"))
    masked = F.regexp_replace("text", r"Tbk\.?\s*\(([A-Z]{4})\)", "Tbk")
    named = typed(s, "text", rules).withColumn("named", F.explode_outer(F.array_distinct(F.regexp_extract_all(masked, F.lit(r"\b([A-Z]{4})\b"), F.lit(1)))))
    known = named.join(F.broadcast(codes.select(F.col("code").alias("named"), F.col("code").alias("known")).distinct()), "named", "left")
    # A sentence and type is read once; codes that are not known are null here, which a set leaves out.
    g = known.groupBy(id_col, "ordinal", "place", "owner", "text", "type").agg(F.collect_set("known").alias("codes"))
    own = F.when(F.size("codes") > 0, F.col("codes")).when(F.col("owner").isNotNull(), F.array("owner"))
    return g.select(id_col, "ordinal", "place", F.explode(own).alias("code"), "text", "type")


def dedupe_events(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_per(events, keys, order)


def entity_names(docs: DataFrame, text_col: str) -> DataFrame:
    """Names 'PT … Tbk (CODE)' with counts; the most frequent is the entity's name (ties: the first in order), the others aliases."""
    name = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"PT [A-Z][\w .&'-]{1,80}? Tbk\.? \([A-Z]{4}\)"), F.lit(0))).alias("s")
    n = docs.select(name).select(F.regexp_extract("s", r"\(([A-Z]{4})\)$", 1).alias("code"), squash(F.regexp_replace("s", r"\s*\([A-Z]{4}\)$", "")).alias("name")).groupBy("code", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("code").orderBy(F.desc("n"), "name")
    return n.withColumn("primary", F.row_number().over(w) == 1)


def ambiguous_codes(codes: DataFrame, rules: list[tuple[str, str]] = ACTIONS) -> DataFrame:
    """Codes that are themselves terms of an action."""
    return codes.where(F.greatest(*(F.col("code").rlike(p).cast("int") for _, p in rules)) == 1)


def screen(events: DataFrame, types: list[str], start: str | None = None, end: str | None = None, k: int = 3) -> DataFrame:
    """Entities with events of the types in the interval: their types, kinds, last date and distinct texts; official sources first."""
    e = events.where(F.col("type").isin(types))
    if start:
        e = e.where(F.col("date").between(start, end))
    e = e.withColumn("official", F.col("kind").isin(OFFICIAL).cast("int"))
    items = first_per(first_per(e, ["entity", "text"], [F.desc("official"), F.desc("date"), F.asc("kind")]), ["entity"], [F.desc("official"), F.desc("date"), F.asc("text")], k)
    shown = items.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("text")), "|").alias("items"))
    g = e.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max("date").alias("last"), F.max("official").alias("official"), F.count("*").alias("n"))
    return g.join(shown, "entity").orderBy(F.desc("official"), F.desc("last"), "entity")


def query_types(queries: DataFrame, id_col: str, text_col: str, rules: list[tuple[str, str]] = ACTIONS, more: dict[str, str] = QUESTION_PATTERNS) -> DataFrame:
    """Types that a question names, denied or not; questions have patterns of their own besides."""
    named = lambda n, p: F.col(text_col).rlike(p) | F.col(text_col).rlike(more[n]) if n in more else F.col(text_col).rlike(p)
    return queries.select(id_col, F.explode(F.array_compact(F.array(*(F.when(named(n, p), F.lit(n)) for n, p in rules)))).alias("type"))


def parse_claims(docs: DataFrame, id_col: str, text_col: str, date_col: str, cross: str = r"(?i)^lintas emiten") -> DataFrame:
    """Lines '- [kind] text — @handle HH:MM … (Fid)' under '## CODE', or under the cross-entity heading with 'A, B: text', which gives
    a row a code. accounts: 1 + N, or 'dari N akun'; rows without entity are dropped."""
    h = with_headings(lines(docs.select(id_col, text_col), id_col, text_col), id_col).where(F.col("content").rlike(CLAIM))
    g = lambda k: F.regexp_extract("content", CLAIM, k)
    rest = g(5)
    plus, many = F.regexp_extract(rest, r"\+\s*(\d+)", 1).try_cast("int"), F.regexp_extract(rest, r"dari (\d+) akun", 1).try_cast("int")
    c = h.select(id_col, "line", "section", g(6).alias("fid"), g(1).alias("kind"), squash(g(2)).alias("text"), F.lower(g(3)).alias("handle"), F.replace(g(4), F.lit("."), F.lit(":")).alias("time"), F.coalesce(many, 1 + plus, F.lit(1)).alias("accounts"), rest.contains("gap").alias("gap"), F.coalesce(F.regexp_extract(rest, r"(\d+) balasan", 1).try_cast("int"), F.lit(0)).alias("replies"))
    own = F.nullif(F.regexp_extract("section", r"^([A-Z]{4})\b", 1), F.lit(""))
    prefix = F.regexp_extract("text", r"^([A-Z]{4}(?:\s*,\s*[A-Z]{4})*)\s*:\s*", 1)
    several = F.when(F.col("section").rlike(cross) & (prefix != ""), F.split(prefix, r"\s*,\s*"))
    codes = F.coalesce(several, F.when(own.isNotNull(), F.array(own)))
    out = c.withColumn("codes", codes).where("codes is not null").withColumn("code", F.explode("codes"))
    text = F.when(F.col("section").rlike(cross), squash(F.regexp_replace("text", r"^[A-Z]{4}(?:\s*,\s*[A-Z]{4})*\s*:\s*", ""))).otherwise(F.col("text"))
    return out.withColumn("text", text).join(docs.select(id_col, F.col(date_col).alias("date")), id_col).drop("codes", "section")


def fold_claims(claims: DataFrame) -> DataFrame:
    """Claims of a code with equal normalised text as one; ids of the later ones in dups."""
    return fold_duplicates(claims.withColumn("norm", norm_text("text")), ["code", "norm"], [F.asc("date"), F.asc("fid")], "fid").drop("norm")


def name_keys(names: DataFrame) -> DataFrame:
    """names (code, name): core words without legal forms; two words and eight signs at least, else no key."""
    core = F.filter(F.split(norm_text("name"), " "), lambda w: ~w.isin("pt", "tbk", "persero", "cv"))
    return names.withColumn("key", F.array_join(core, " ")).where((F.size(core) >= 2) & (F.length("key") >= 8))


def _pairs(text: Column, pattern: str) -> Column:
    """All matches of a pattern with two groups, as (first, second)."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("first"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("second"))


def clean_name(name: Column) -> Column:
    """A name without its title, marks at the end, and words at the end that are no names."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"[.,;]+$", ""), TITLE, "")
    return F.regexp_replace(bare, r"(?:(?:^|\s+)(?:" + "|".join(NAME_STOP) + r"))+$", "")


def role_mentions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, role, name, kind) of sentences that name a role. Persons have two words at least, none of them a legal form or a word that
    is no name; parties too, beside PT, and may stand before or after their role; services (registrars BAE, auditors KAP) are firms. Each
    row once; null texts have none."""
    text, stop = F.coalesce(F.col(text_col), F.lit("")), F.array(*map(F.lit, NAME_STOP))
    forms = [("person", PERSON_ROLE, 1), ("party", PARTY_ROLE, 1), ("party", PARTY_AFTER, 2), ("service", SERVICE_ROLE, 1)]
    told = lambda kind, k: lambda x: F.struct(F.lit(kind).alias("form"), x["first" if k == 1 else "second"].alias("role"), x["second" if k == 1 else "first"].alias("name"))
    found = F.concat(*(F.transform(_pairs(text, p), told(kind, k)) for kind, p, k in forms))
    r = texts.select(id_col, F.explode(found).alias("x")).select(id_col, "x.form", "x.role", clean_name(F.col("x.name")).alias("name"))
    words = F.split("name", r"\s+")
    bare = F.filter(words, lambda w: ~w.isin("PT", "PT."))
    person = (F.size(words) >= 2) & (F.size(F.array_intersect(words, F.concat(stop, F.array(F.lit("PT"), F.lit("PT."))))) == 0)
    party = (F.size(bare) >= 2) & ~F.array_contains(stop, F.get(bare, F.lit(0)))
    service = (F.col("name") != "") & ~F.array_contains(stop, F.get(words, F.lit(0)))
    ok = F.when(F.col("form") == "person", person).when(F.col("form") == "party", party).otherwise(service)
    role = F.when(F.col("form") == "service", F.when(F.col("role").isin("BAE", "Biro Administrasi Efek"), "BAE").otherwise("KAP")).otherwise(F.regexp_replace(F.lower("role"), r" \d$", ""))
    kind = F.when(F.col("form") == "person", "person").when((F.col("form") == "service") | F.col("name").rlike(FIRM), "firm").otherwise("person")
    return r.where(ok).select(id_col, role.alias("role"), "name", kind.alias("kind")).distinct()


def group_aliases(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, kind, group, name) of texts that say who belongs to a group, or who owns it. Names of two signs are none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = lambda g, kind: lambda x: F.struct(F.lit(kind).alias("kind"), x["first" if g == 1 else "second"].alias("group"), clean_name(x["second" if g == 1 else "first"]).alias("name"))
    found = F.concat(*(F.transform(_pairs(text, p), told(g, kind)) for p, g, kind in GROUP_PATTERNS))
    r = texts.select(id_col, F.explode(found).alias("x")).select(id_col, "x.kind", "x.group", "x.name")
    return r.where(~F.col("group").isin(NAME_STOP) & (F.length("name") >= 3)).distinct()


def build_entities(positions: DataFrame, roles: DataFrame, k: int = 8) -> DataFrame:
    """positions (name, code, period), roles (name, code, role, date): roles of names in codes; holders by first and last period."""
    holders = positions.groupBy("name", "code").agg(F.min("period").alias("first"), F.max("period").alias("date")).select("name", "code", F.lit("holder").alias("role"), "date")
    both = holders.unionByName(roles.select("name", "code", "role", "date")).dropDuplicates(["name", "code", "role", "date"])
    return first_per(both, ["name", "code"], [F.desc("date"), F.asc("role")], k)


def entity_degree(entities: DataFrame, service_roles: list[str]) -> DataFrame:
    """Distinct codes of a name; with more than five and a service role it is a service."""
    g = entities.groupBy("name").agg(F.countDistinct("code").alias("degree"), F.bool_or(F.col("role").isin(service_roles)).alias("serves"))
    return g.withColumn("kind", F.when((F.col("degree") > 5) & F.col("serves"), "service").otherwise("party")).drop("serves")


def spelling_variants(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tokens (token), vocabulary (word): pairs of one initial, five letters and more, one edit apart. Words meet under their forms
    with one letter deleted, so only near words are compared."""
    def forms(df: DataFrame, col: str) -> DataFrame:
        deleted = F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.concat(F.substring(F.col(col), F.lit(1), i - 1), F.substring(F.col(col), i + 1, F.length(col))))
        return df.where(F.length(col) >= 5).select(col, F.explode(F.array_distinct(F.concat(F.array(col), deleted))).alias("form"))

    j = forms(tokens.select("token").distinct(), "token").join(forms(vocabulary.select("word").distinct(), "word"), "form")
    same = F.substring("token", 1, 1) == F.substring("word", 1, 1)
    return j.where(same & (F.col("token") != F.col("word")) & (F.levenshtein("token", "word") <= 1)).select("token", "word").distinct()


def name_like(texts: DataFrame, text_col: str) -> DataFrame:
    """Words that stand with a capital twice at least, and at least as often as without."""
    t = texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?U)\b\p{L}{2,}\b"), F.lit(0))).alias("t"))
    capital = F.col("t").rlike(r"^\p{Lu}").cast("bigint")
    g = t.groupBy(F.lower("t").alias("token")).agg(F.sum(capital).alias("capital"), F.sum(1 - capital).alias("lower"))
    return g.where((F.col("capital") >= 2) & (F.col("capital") >= F.col("lower")))


def official_names(*sources: DataFrame) -> DataFrame:
    """Names of each code from several sources (code, name), the first source first, each name once."""
    out = None
    for k, s in enumerate(sources):
        r = s.select("code", "name", F.lit(k).alias("source"))
        out = r if out is None else out.unionByName(r)
    first = out.groupBy("code", "name").agg(F.min("source").alias("source"))
    return first.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "name"))), lambda x: x["name"]).alias("names"))


def eligible_claims(claims: DataFrame, codes: DataFrame) -> DataFrame:
    """Kinds R, M and H, and K with topics, whose first known code, if any, is their own."""
    c = claims.where(F.col("kind").isin("R", "M", "H") | ((F.col("kind") == "K") & (F.col("topics") != 0)))
    named = c.select("fid", "code", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{4})\b"), F.lit(1))).alias("place", "named"))
    first = named.join(F.broadcast(codes.select(F.col("code").alias("named"))), "named").groupBy("fid", "code").agg(F.min_by("named", "place").alias("first"))
    return c.join(first, ["fid", "code"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("code"))).drop("first")


def nearest_support(claims: DataFrame, disclosures: DataFrame, days: int = 45) -> DataFrame:
    """The nearest disclosure of the same entity and topic within so many days. claims (fid, entity, topic, date), disclosures
    (entity, topic, disclosed, ref)."""
    return nearest_join(claims, disclosures, ["entity", "topic"], "fid", "date", "disclosed", days, "ref")


def trend(observations: DataFrame, keys: list[str], period: str, value: str, k: int = 3) -> DataFrame:
    """Direction over the last k observations of each key."""
    last = first_per(observations, keys, [F.desc(period)], k)
    g = last.groupBy(*keys).agg(F.min_by(value, period).alias("from"), F.max_by(value, period).alias("to"), F.max(period).alias("observed"))
    return g.withColumn("direction", F.when(F.col("to") > F.col("from"), "up").when(F.col("to") < F.col("from"), "down").otherwise("flat"))


def fallback_verdicts(claims: DataFrame, supported: DataFrame, any_topic: DataFrame, last_covered: str) -> DataFrame:
    """Claims without support: 'other_topic' if the entity disclosed something else near, 'not_checkable' after the covered time,
    else 'no_basis'."""
    rest = claims.join(supported.select("fid"), "fid", "left_anti").join(any_topic.select("fid", F.lit(True).alias("near")), "fid", "left")
    return rest.withColumn("verdict", F.when(F.col("near"), "other_topic").when(F.col("date") > F.lit(last_covered).cast("date"), "not_checkable").otherwise("no_basis")).drop("near")


def best_verdict(checks: DataFrame, key: str = "fid") -> DataFrame:
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in VERDICT_RANK.items() for x in kv]), F.col("verdict"))
    return checks.groupBy(key).agg(F.min_by("verdict", rank).alias("verdict"), F.count("*").alias("checks"))


def mentions_topk(mentions: DataFrame, k: int = 8) -> DataFrame:
    """Mentions of each code, share deals first, then the newest; one a filer and beginning of text."""
    m = first_per(mentions.withColumn("head", F.substring("snippet", 1, 80)), ["code", "filer", "head"], [F.desc("date"), F.asc("ref")])
    return first_per(m, ["code"], [F.desc((F.col("relation") == "transaksi_saham").cast("int")), F.desc("date"), F.asc("ref")], k).drop("head")


def relation_pairs(roles: DataFrame, k: int = 14) -> DataFrame:
    """roles (party, entity, role): pairs of entities that share a party: strong if in one role class, weak if a service, else medium."""
    a, b = roles.select("party", F.col("entity").alias("a"), F.col("role").alias("role_a")), roles.select("party", F.col("entity").alias("b"), F.col("role").alias("role_b"))
    j = a.join(b, "party").where("a < b").withColumn("tier", F.when((F.col("role_a") == "service") | (F.col("role_b") == "service"), 0).when(F.col("role_a") == F.col("role_b"), 2).otherwise(1))
    best = j.groupBy("a", "b", "party").agg(F.max("tier").alias("tier"))
    return first_per(best, ["a", "b"], [F.desc("tier"), F.asc("party")], k)


def cascade_search(passages: DataFrame, id_col: str, text_col: str, words: list[str], content: list[str]) -> DataFrame:
    """Passages at the strictest level that any reaches: all words and content, all words, any word."""
    has = lambda w: F.lower(F.col(text_col)).contains(w.lower())
    all_words, any_word = F.lit(True), F.lit(False)
    for w in words:
        all_words, any_word = all_words & has(w), any_word | has(w)
    any_content = F.lit(False)
    for w in content:
        any_content = any_content | has(w)
    p = passages.withColumn("level", F.when(all_words & any_content, 1).when(all_words, 2).when(any_word, 3)).where("level is not null")
    least = p.agg(F.min("level").alias("least"))
    return p.join(F.broadcast(least), F.col("level") == F.col("least")).select(id_col, "level")


def rare_claims(claims: DataFrame, accounts: int = 3, days: int = 2, limit: int = 60) -> DataFrame:
    """claims (entity, handle, extra, day, fid): of entities with few accounts and days, one claim each first, then the rest."""
    few = claims.groupBy("entity").agg((F.countDistinct("handle") + F.coalesce(F.sum("extra"), F.lit(0))).alias("accounts"), F.countDistinct("day").alias("days")).where((F.col("accounts") <= accounts) & (F.col("days") <= days))
    w = Window.partitionBy("entity").orderBy(F.desc("day"), "fid")
    return claims.join(few.select("entity"), "entity", "left_semi").withColumn("turn", F.row_number().over(w)).orderBy(F.when(F.col("turn") == 1, 0).otherwise(1), F.desc("day"), "fid").limit(limit)


def handle_profile(claims: DataFrame) -> DataFrame:
    """claims (handle, kind, topics, day, fid, entity): posts, findings, days, entities, kinds, and how often each topic bit is set."""
    bits = [F.sum(F.shiftright("topics", i).bitwiseAND(1)).alias(f"topic_{i}") for i in range(4)]
    return claims.groupBy("handle").agg(F.count("*").alias("posts"), F.countDistinct("fid").alias("findings"), F.countDistinct("day").alias("days"), F.countDistinct("entity").alias("entities"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), *bits)


def uncovered(claims: DataFrame, text_col: str, answers: DataFrame, key: str, answer_col: str, share: float = 0.6) -> DataFrame:
    """Claims of which the answer of the same key holds less than a share of the words of four letters and more."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"\p{L}{4,}"), F.lit(0)))
    j = claims.join(answers, key, "left").withColumn("own", tokens(text_col)).withColumn("said", tokens(answer_col))
    return j.where((F.size("own") > 0) & (F.size(F.array_intersect("own", "said")) < share * F.size("own"))).drop("own", "said", answer_col)


def daily_rollup(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Totals of each key and day, of each key, and of all."""
    g = rows.rollup(*keys).agg(*(F.sum(c).alias(c) for c in sums), F.count("*").alias("rows"), F.grouping_id().alias("level"))
    return g

