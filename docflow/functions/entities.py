"""Entity extraction as array-valued column expressions.

Each kind has patterns in order: at most `each` matches of a pattern, the first `total` distinct ones, sorted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.text import words

# The patterns of each kind of entity.
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = [
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    rf"\b{MONTH}[a-z]*\.?\s+\d{{1,2}},?\s+\d{{2,4}}\b",
    rf"\b\d{{1,2}}\s+{MONTH}[a-z]*\.?\s+\d{{2,4}}\b",
    r"\bQ[1-4]\s+\d{4}\b",
    r"\b\d{4}\b",
]
TIME_PERIODS = [
    r"\b(?:Q[1-4]|first quarter|second quarter|third quarter|fourth quarter|quarter)\b",
    r"\b(?:fiscal year|FY|financial year)\s*\d{2,4}\b",
    r"\byear ended?\s*(?:December|March|June|September)\s*\d{1,2},?\s*\d{2,4}\b",
    r"\b(?:annually|quarterly|monthly|weekly|daily)\b",
    r"\b(?:year-over-year|YoY|year-to-date|YTD)\b",
]
METRICS = [
    r"\$[\d,]+(?:\.\d{2})?(?:\s*(?:million|billion|trillion|M|B|T))?\b",
    r"\b\d+(?:\.\d+)?%\b",
    r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:million|billion|trillion|thousand|M|B|T|K)\b",
    r"\b(?:revenue|income|profit|loss|earnings|sales|costs|expenses|assets|liabilities|equity)\b",
    r"\b(?:EBITDA|ROI|ROE|ROA|EPS|P/E)\b",
    r"\b(?:growth|increase|decrease|decline|improvement|deterioration)\b",
]
REGIONS = [
    r"\b(?:United States|US|USA|America|North America)\b",
    r"\b(?:Europe|European Union|EU)\b",
    r"\b(?:Asia|Asia-Pacific|APAC)\b",
    r"\b(?:China|Japan|Korea|India|Australia)\b",
    r"\b(?:Canada|Mexico|Brazil|Argentina)\b",
    r"\b(?:UK|United Kingdom|Germany|France|Italy|Spain)\b",
    r"\b(?:Middle East|Africa|Latin America)\b",
]
ORG_SUFFIXES = [
    "Inc", "Corp", "Corporation", "Company", "Co", "LLC", "Ltd", "Limited", "Partners", "LP", "LLP", "Group", "Holdings", "Enterprises", "Solutions",
    "Services", "Systems", "Technologies", "Tech", "Consulting", "Associates",
]
PERSON_TITLES = [
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Professor", "CEO", "CFO", "CTO", "COO", "CMO", "CRO", "President", "Vice President", "VP", "SVP", "EVP",
    "Director", "Managing Director", "Executive Director", "Manager", "Senior Manager", "General Manager", "Chairman", "Chair", "Chairwoman", "Chairperson",
]
NOT_NAMES = [
    "The", "This", "That", "These", "Those", "A", "An", "And", "Or", "But", "In", "On", "At", "To", "For", "Of", "With", "By", "From", "As",
    "Company", "Corporation", "Inc", "LLC", "Ltd",
]
PRODUCT_SIGNS = [
    "iphone", "ipad", "macbook", "imac", "airpods", "apple watch", "windows", "office", "excel", "word", "powerpoint", "teams", "azure",
    "chrome", "gmail", "maps", "youtube", "android", "aws", "ec2", "s3", "lambda", "prime", "model s", "model 3", "model x", "model y", "cybertruck",
    "elasticsearch", "kibana", "logstash",
]
VERSION_SIGNS = [" pro", " plus", " premium", " enterprise", " 365", " 11", " 15"]
COMPANY_SIGNS = [" inc", " corp", " ltd", " llc", " company", " co."]
SKIPPED_PREFIXES = ("the ", "and ", "page ", "item ", "form ")
KNOWN_ORGS = {"elastic": "Elastic N.V."}
YEARS = (1900, 2030)


def matches(text: Column, patterns: list[str], each: int | None, total: int, keep=None) -> Column:
    parts = []
    for p in patterns:
        found = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        found = F.slice(found, 1, each) if each else found
        parts.append(F.filter(found, keep) if keep else F.array_remove(found, ""))
    return F.array_sort(F.slice(F.array_distinct(F.concat(*parts)), 1, total))


def valid_date(x: Column) -> Column:
    """Four characters are a year, which must be in range."""
    year = F.try_to_number(x, F.lit("9999"))
    return F.when(F.length(x) == 4, year.between(*YEARS)).otherwise(F.length(x) > 0)


def dates(text: Column) -> Column:
    """E1."""
    return matches(text, DATES, None, 10, valid_date)


def time_periods(text: Column) -> Column:
    """E2."""
    return matches(F.lower(text), TIME_PERIODS, 5, 8)


def metrics(text: Column) -> Column:
    """E3."""
    return matches(text, METRICS, 8, 10)


def regions(text: Column) -> Column:
    """E4."""
    return matches(F.lower(text), REGIONS, 3, 5)


def bare_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.regexp_replace(w, r"[.,;:]+$", ""))


def likely_name(w: Column) -> Column:
    return F.coalesce((F.length(w) >= 2) & w.rlike(r"^\p{Lu}\p{L}+$") & ~w.isin(NOT_NAMES), F.lit(False))


def people(text: Column, total: int | None = 8) -> Column:
    """E5 (E7 with total None): a title and one or two names, or two names in a row; the first `total` distinct."""

    def at(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            second, third = F.get(w, i + 1), F.get(w, i + 2)
            titled = F.when(likely_name(second), F.concat_ws(" ", x, second, F.when(likely_name(third), third)))
            return F.when(x.isin(PERSON_TITLES), titled).when(likely_name(x) & likely_name(second), F.concat_ws(" ", x, second))

        found = F.array_distinct(F.array_compact(F.transform(w, one)))
        return F.array_sort(F.slice(found, 1, total) if total else found)

    return F.transform(F.array(bare_words(text)), at)[0]


def organizations(text: Column, total: int | None = 6, look_back: int = 3) -> Column:
    """E6 (E7 with total None and look_back 4): up to look_back capitalised words before a company suffix."""
    capital = lambda w: F.coalesce(w.rlike(r"^\p{Lu}\p{L}*$"), F.lit(False))

    def at(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            out, run = F.lit(None).cast("string"), F.lit(True)
            choices = []
            for k in range(1, look_back + 1):
                before = F.when(i >= k, F.get(w, i - k))
                run = run & capital(before)
                choices.append((run, k))
            for run_k, k in choices:
                out = F.when(run_k, F.array_join(F.slice(w, i + 1 - k, k + 1), " ")).otherwise(out)
            return F.when(x.isin(ORG_SUFFIXES), out)

        found = F.array_distinct(F.array_compact(F.transform(w, one)))
        return F.array_sort(F.slice(found, 1, total) if total else found)

    return F.transform(F.array(bare_words(text)), at)[0]


def time_context(found: Column) -> Column:
    """From the first four digits in range of each date, the fiscal year around them; null without one."""

    def year(d: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d) - 3, F.lit(1))), lambda i: F.substring(d, i, F.lit(4)))
        return F.get(F.filter(windows, lambda w: w.rlike(r"^\d{4}$") & F.try_to_number(w, F.lit("9999")).between(*YEARS)), 0).cast("int")

    years = F.array_compact(F.transform(found, year))
    return F.when(
        F.size(years) > 0,
        F.struct(
            F.concat((F.array_min(years) - 1).cast("string"), F.lit("-05-01")).alias("start"),
            F.concat(F.array_max(years).cast("string"), F.lit("-04-30")).alias("end"), F.lit("fiscal_year").alias("granularity"),
        ),
    )


def any_of(text: Column, signs: list[str]) -> Column:
    hit = F.lit(False)
    for s in signs:
        hit = hit | F.contains(text, F.lit(s))
    return hit


def is_product(org: Column) -> Column:
    """E12."""
    low = F.lower(org)
    return any_of(low, PRODUCT_SIGNS) | (any_of(low, VERSION_SIGNS) & ~any_of(low, COMPANY_SIGNS))


def usable_entity(x: Column) -> Column:
    """F11."""
    low, skip = F.lower(x), F.lit(False)
    for p in SKIPPED_PREFIXES:
        skip = skip | low.startswith(p)
    return (F.length(F.trim(x)) >= 2) & ~skip


def document_orgs(doc_id: Column, text: Column, names: dict[str, str] = KNOWN_ORGS) -> Column:
    """Names whose key is in the id or the text; else "The Company" where the text has both company and inc."""
    low = F.lower(text)
    found = [F.when(F.lower(doc_id).contains(k) | low.contains(k), F.lit(v)) for k, v in names.items()]
    company = F.when(low.contains("company") & low.contains("inc"), F.lit("The Company"))
    named = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(company)))
