"""Column functions on names of parties and companies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that don't tell parties apart, classes of institutions, words and names of accounts held for others, words
# that mark companies.
LEGAL_FORMS = ["PT", "TBK", "PERSEROAN TERBATAS", "THE", "LTD", "LIMITED", "INC", "CORP", "CORPORATION", "PTE", "CO", "LLC", "SA", "AG", "BV", "NV", "PERSERO"]
INSTITUTIONS = ["Mutual Funds", "Insurance", "Bank", "Securities Company", "Investment Manager", "Trustee Bank", "Financial Institution", "Financial Institutional", "Private Bank", "Pension Fund", "State Owned Enterprises", "Hedge Fund", "Investment Advisors"]
NOMINEE = r"\b(A/C|S/A|PLEDGED?|CLIENTS?|NOMINEES?|CUSTOD(?:Y|IAN)|FOR THE ACCOUNT|OMNIBUS)\b|\bQQ\b"
CUSTODIANS = ["PANIN", "DBS", "LGT", "UBS", "CITIBANK", "HSBC", "STANDARD CHARTERED", "DEUTSCHE", "BNY", "STATE STREET", "JPMORGAN", "JP MORGAN", "BANK OF NEW YORK", "NORTHERN TRUST", "BNP PARIBAS", "SOCIETE GENERALE", "CREDIT SUISSE", "MORGAN STANLEY", "GOLDMAN", "CGS", "KGI", "MAYBANK", "UOB", "OCBC", "NOMURA", "CLEARSTREAM", "EUROCLEAR"]
COMPANY_WORDS = r"(?i)\b(pt|tbk|cv|ltd|limited|pte|inc|corp|corporation|llc|plc|gmbh|bank|capital|holdings?|investama|sekuritas|securities|asset|fund|investments?|group|international|persero|koperasi|yayasan)\b"


def party_key(col: Column | str) -> Column:
    """Upper case, without punctuation and legal forms, words in order: the same for spellings that differ in these only."""
    plain = F.regexp_replace(F.upper(col), "[^A-Z0-9 ]", " ")
    kept = F.split(F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(" + "|".join(LEGAL_FORMS) + r")\b", " "), r"\s+", " ")), " ")
    return F.array_join(F.array_sort(kept), " ")


def is_pooled(name: Column | str, kind: Column | str, pooled_kinds: list[str] = INSTITUTIONS) -> Column:
    """Holdings of many behind one name: an institution's class, or a name that says so, or a custodian's."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    name = F.upper(F.col(name) if isinstance(name, str) else name)
    told = name.rlike(NOMINEE) | name.rlike(r"\b(" + "|".join(CUSTODIANS) + r")\b")
    return F.coalesce(kind.isin(pooled_kinds), F.lit(False)) | F.coalesce(told, F.lit(False))


def is_company(name: Column | str) -> Column:
    """A legal form or business word, or at least two words that look like names."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(name.rlike(COMPANY_WORDS), F.lit(False)) | (F.coalesce(F.regexp_count(name, F.lit(r"\b\p{Lu}[\p{L}&.-]+")), F.lit(0)) >= 4)
