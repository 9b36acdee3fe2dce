"""Column functions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squash(col: Column | str) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def clip(col: Column | str, n: int) -> Column:
    """At most n signs; a longer text ends with an ellipsis in the last place."""
    return F.when(F.length(_c(col)) <= n, _c(col)).otherwise(F.concat(F.rtrim(F.substring(_c(col), 1, n - 1)), F.lit("…")))


def clip_words(col: Column | str, n: int) -> Column:
    """At most n signs, cut at the last blank before; a first word that is longer is cut as it is."""
    short = F.substring(_c(col), 1, n)
    return F.when(F.length(_c(col)) <= n, _c(col)).otherwise(F.when(short.contains(" "), F.regexp_replace(short, r" [^ ]*$", "")).otherwise(short))


def norm_text(col: Column | str) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\p{N}]+", " "))


def slug(col: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(col)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def plain_markdown(col: Column | str) -> Column:
    """Without emphasis, code marks, heading signs and link targets."""
    out = F.regexp_replace(_c(col), r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")
    return squash(F.regexp_replace(out, r"[*_`]+", ""))


def strip_refs(col: Column | str, id_pattern: str = r"\s*\((?:F\d+(?:,\s*)?)+\)") -> Column:
    """Without link targets, addresses, cross-references and ids in brackets."""
    out = F.regexp_replace(_c(col), r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"https?://[^\s)]+", "")
    return squash(F.regexp_replace(out, id_pattern, ""))


def html_to_text(col: Column | str) -> Column:
    """Markup dropped with the contents of scripts and styles, a few character references resolved, white space squashed."""
    out = F.regexp_replace(_c(col), r"(?is)<!--.*?-->|<(script|style|template|svg)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return squash(out)


def script_strings(col: Column | str) -> Column:
    """String literals of at least 20 signs in scripts, which often hold a page's data."""
    scripts = F.array_join(F.regexp_extract_all(_c(col), F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    return F.regexp_extract_all(scripts, F.lit(r'"((?:[^"\\]|\\.){20,})"'), F.lit(1))


def masked(col: Column | str) -> Column:
    """Mobile numbers, pass codes and passwords in addresses replaced."""
    out = F.regexp_replace(_c(col), r"(?<![0-9])(?:\+62|62|0)8[0-9](?:[ -]?[0-9]){6,10}(?![0-9])", "[phone]")
    out = F.regexp_replace(out, r"(?i)\b(passcode|kode akses|pin)(\s*[:=]\s*)\S+", "$1$2[code]")
    return F.regexp_replace(out, r"(?i)([?&]pwd=)[^&\s]+", "$1[code]")


def format_local(col: Column | str, digits: int) -> Column:
    """Points between thousands and a comma before decimals."""
    return F.translate(F.format_number(_c(col), digits), ",.", ".,")


def parse_local(col: Column | str) -> Column:
    """1234, -1.5, 12,5, 1,234.5, 1.234,5 and 12%: a sign that is last, or that no three digits follow, is the decimal one."""
    x = F.regexp_replace(F.trim(_c(col)), r"%$", "")
    thousands_by_comma = F.replace(x, F.lit(","), F.lit(""))
    thousands_by_point = F.translate(F.replace(x, F.lit("."), F.lit("")), ",", ".")
    return (
        F.when(x.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), thousands_by_comma.try_cast("double"))
        .when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), x.try_cast("double"))
        .when(x.rlike(r"^-?[0-9]+,[0-9]+$"), F.translate(x, ",", ".").try_cast("double"))
        .when(x.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$"), thousands_by_point.try_cast("double"))
    )


# Fixed value: phrases that deny what follows them in a clause.
NEGATION = r"(?i)\b(tidak ada|tidak terdapat|belum ada|tanpa adanya|tidak mengindikasikan|tidak menunjukkan|tidak mengungkapkan|tidak disebutkan|tidak dilaporkan|tidak diumumkan|belum merencanakan|tidak merencanakan|tidak berencana|belum berencana|none)\b"


def clauses(col: Column | str) -> Column:
    """Parts of a text: a clause ends at ; : or . before white space."""
    return F.split(_c(col), r"[;:.]\s")


def affirms(clause: Column, pattern: str, negation: str = NEGATION) -> Column:
    """Whether a clause holds the pattern with no negation before it."""
    return clause.rlike(pattern) & ~F.regexp_extract(clause, f"(?is)^(.*?)(?:{pattern})", 1).rlike(negation)


def affirmed(col: Column | str, pattern: str, negation: str = NEGATION) -> Column:
    """Whether some clause of a text affirms the pattern; a null text affirms nothing."""
    return F.coalesce(F.exists(clauses(col), lambda c: affirms(c, pattern, negation)), F.lit(False))


def topic_bits(col: Column | str, topics: list[str]) -> Column:
    """Bit i says whether the text holds pattern i."""
    out = F.lit(0).cast("bigint")
    for i, pattern in enumerate(topics):
        out = out + F.when(_c(col).rlike(pattern), F.lit(1 << i)).otherwise(F.lit(0))
    return out.cast("bigint")


def codes(col: Column | str, digits: bool = False) -> Column:
    """Distinct four-sign codes in capitals, in order of appearance."""
    kind = "[A-Z0-9]" if digits else "[A-Z]"
    return F.array_distinct(F.regexp_extract_all(_c(col), F.lit(rf"\b([A-Z]{kind}{{3}})\b"), F.lit(1)))
