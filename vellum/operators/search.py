"""Search in texts, and personal data in them. Patterns are compiled by Spark's own regex functions; no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.derived import token_keys

CONTEXT_WORDS, HIT_CAP = 8, 500
#: A word's ends: letters, digits, marks and underscores on neither side, nor an apostrophe that joins letters.
BEFORE, AFTER = r"(?<![\p{L}\p{N}\p{M}_])(?<![\p{L}\p{N}]['’])", r"(?![\p{L}\p{N}\p{M}_])(?!['’][\p{L}\p{N}])"
#: The patterns of personal data.
PII = {
    "ssn": r"\b\d{3}[- ]\d{2}[- ]\d{4}\b",
    "phone": r"(?<![\d-])(?:\+?1[-. ]?)?(?:\(\d{3}\)\s?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\d-])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "card": r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",
    "date": r"\b(?:\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})|\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.? \d{1,2},? \d{4}|\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]* \d{4})\b",
}


#: A text without this has no match.
NEEDS = {"email": "@"}


def quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " and ord(c) < 128 else c for c in text)


def pattern(term: str, case: bool = False, whole: bool = False, regex: bool = False) -> str:
    body = term if regex else quoted(term)
    return ("" if case else "(?iu)") + (f"{BEFORE}(?:{body}){AFTER}" if whole else f"(?:{body})")


def offsets(text: Column, rule: str) -> Column:
    """array<struct<at, found>> of all matches that do not overlap; empty ones are left out."""
    found = F.regexp_extract_all(text, F.lit(f"({rule})"), F.lit(1))
    gaps = F.split(text, rule, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,found:string>>").alias("hits"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        return F.struct((at + F.length(pair["found"])).alias("at"), F.concat(acc["hits"], F.array(F.struct(at.alias("at"), pair["found"].alias("found")))).alias("hits"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))
    return F.filter(F.aggregate(pairs, zero, step)["hits"], lambda h: h["found"] != "")


def search(units: DataFrame, term: str, text_col: str = "text", **options: bool) -> DataFrame:
    """units with a row per hit: hit_no, at (code points), found, snippet (CONTEXT_WORDS on each side)."""
    rule = pattern(term, **options)
    text = F.col(text_col)
    rows = units.where(text.rlike(rule)).select(*units.columns, F.posexplode(offsets(text, rule)).alias("hit_no", "hit")).select(*units.columns, "hit_no", "hit.at", "hit.found")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    before = words(F.substr(text, F.lit(1), F.col("at")))
    after = words(F.substr(text, F.col("at") + F.length("found") + 1))
    near = F.concat_ws(" ", F.array_join(F.slice(before, F.greatest(F.size(before) - CONTEXT_WORDS, F.lit(0)) + 1, F.lit(CONTEXT_WORDS)), " "), F.col("found"), F.array_join(F.slice(after, 1, CONTEXT_WORDS), " "))
    return rows.withColumn("snippet", F.trim(near))


def capped(hits: DataFrame, order: list[str], cap: int = HIT_CAP) -> DataFrame:
    """The first cap hits in order; a top-k, so that no task sees all hits."""
    return hits.orderBy(*order).limit(cap)


def search_page(hits: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """Keyset paging: up to limit hits after the cursor, each with complete (no further hit follows)."""
    limit = max(1, min(limit, 1000))
    if after is not None:
        hits = hits.where(F.struct(*order) > F.struct(*(F.lit(v).cast(hits.schema[c].dataType) for c, v in zip(order, after, strict=True))))
    page = hits.orderBy(*order).limit(limit + 1)
    numbered = page.withColumns({"_n": F.row_number().over(Window.orderBy(*order)), "_all": F.count("*").over(Window.partitionBy())})
    return numbered.where(F.col("_n") <= limit).withColumn("complete", F.col("_all") <= limit).drop("_n", "_all")


def proximity_search(pages: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, page, start, stop of each hit of the first term with every other term within that many words.

    pages: doc_id, page, text. All lies within one page's row: around each hit of the first term a slice of the page's words
    is searched for the first occurrence of every other one; nothing is shuffled. Pages without all terms are not split.
    """
    first, rest = terms[0], sorted(set(terms[1:]))
    may = pages
    for t in (first, *rest):
        may = may.where(F.lower("text").contains(t))
    keys = may.select("doc_id", "page", token_keys(F.col("text")).alias("keys"))
    at = F.filter(F.transform("keys", lambda k, i: F.when(k == first, i)), lambda p: p.isNotNull())

    def hit(p: Column) -> Column:
        begin = F.greatest(p - within, F.lit(0))
        near = F.slice("keys", begin + 1, p + within - begin + 1)
        return F.struct(p.alias("pos"), F.array(*(F.when(F.array_contains(near, t), (begin + F.array_position(near, t) - 1).cast("int")) for t in rest)).alias("others"))

    rows = keys.select("doc_id", "page", F.explode(F.transform(at, hit)).alias("h")).where(F.forall("h.others", lambda p: p.isNotNull()))
    ends = F.concat(F.array("h.pos"), F.col("h.others"))
    return rows.select("doc_id", "page", F.array_min(ends).alias("start"), F.array_max(ends).alias("stop"))


def stem_search(tokens: DataFrame, term: str, lemmas: DataFrame) -> DataFrame:
    """Tokens that share a lemma with the term; lemmas (form, lemma) is a table of any size."""
    wanted = lemmas.where(F.col("form") == term).select("lemma").unionByName(lemmas.sparkSession.range(1).select(F.lit(term).alias("lemma"))).distinct()
    forms = lemmas.join(wanted, "lemma", "left_semi").select("form").unionByName(wanted.select(F.col("lemma").alias("form"))).distinct()
    return tokens.join(forms, tokens["key"] == forms["form"], "left_semi")


def replace_text(units: DataFrame, find: str, put: str, text_col: str = "text", **options: bool) -> DataFrame:
    """units with text replaced and n_replaced."""
    rule = pattern(find, **options)
    return units.withColumns({"n_replaced": F.regexp_count(text_col, F.lit(rule)), text_col: F.regexp_replace(text_col, rule, put if options.get("regex") else put.replace("\\", "\\\\").replace("$", "\\$"))})


def luhn(text: Column) -> Column:
    """13 to 19 digits whose checksum holds."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def pii_hits(text: Column, kinds: tuple[str, ...] = tuple(PII)) -> Column:
    """array<struct<kind, found>> of a text; cards only where the checksum holds."""

    def of(kind: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(f"({PII[kind]})"), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))
        if kind == "card":
            found = F.filter(found, lambda h: luhn(h["found"]))
        return F.when(text.contains(NEEDS[kind]), found).otherwise(F.array().cast("array<struct<kind:string,found:string>>")) if kind in NEEDS else found

    return F.flatten(F.array(*map(of, kinds)))


def find_pii(units: DataFrame, kinds: tuple[str, ...] = tuple(PII), text_col: str = "text") -> DataFrame:
    """units' columns but the text, kind, found."""
    rest = [c for c in units.columns if c != text_col]
    return units.select(*rest, F.explode(pii_hits(F.col(text_col), kinds)).alias("hit")).select(*rest, "hit.kind", "hit.found")


def mask_pii(text: Column, kinds: tuple[str, ...] = tuple(PII), overlay: str = "█") -> Column:
    """text with every accepted match replaced; cards only where the checksum holds, and not inside longer digit runs."""
    for kind in kinds:
        if kind == "card":
            cards = F.filter(F.regexp_extract_all(text, F.lit(f"({PII[kind]})"), F.lit(1)), luhn)
            text = F.aggregate(cards, text, lambda t, c: F.regexp_replace(t, F.concat(F.lit(r"(?<!\d)\Q"), c, F.lit(r"\E(?!\d)")), F.lit(overlay)))
        else:
            masked = F.regexp_replace(text, PII[kind], overlay)
            text = F.when(text.contains(NEEDS[kind]), masked).otherwise(text) if kind in NEEDS else masked
    return text
