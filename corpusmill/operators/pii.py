"""Personal data in documents: five entities, validated matches, overlap resolution, redaction. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrays import higher, let, running_maxima
from corpusmill.functions.regex_spans import find_matches

# Entities in priority order, their tokens, and their counters.
TOKENS = {"EMAIL_ADDRESS": "[EMAIL]", "CN_ID_CARD": "[ID_CARD]", "CN_MOBILE_PHONE": "[PHONE]", "CREDIT_CARD": "[BANK_CARD]", "IPV4_ADDRESS": "[IPV4]"}
COUNTERS = {"EMAIL_ADDRESS": "email_redactions", "CN_ID_CARD": "id_card_redactions", "CN_MOBILE_PHONE": "phone_redactions", "CREDIT_CARD": "bank_card_redactions", "IPV4_ADDRESS": "ipv4_redactions"}
# The patterns, in Java's dialect with Unicode classes.
EMAIL = r"(?U)(?<!\w)[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}(?!\w)"
PHONE = r"(?U)(?<!\d)1[3-9](?:[ -]?\d){9}(?!\d)"
ID_CARD = r"(?U)(?<!\d)\d{17}[Xx\d](?!\d)"
BANK_CARD = r"(?U)(?<!\d)\d{12,19}(?!\d)"
IPV4 = r"(?U)(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)"
EMAIL_CANDIDATE = r"(?U)(?<![\w.+-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}(?![\w.+-])"
# Province codes, weights and check characters of GB 11643.
PROVINCES = "11 12 13 14 15 21 22 23 31 32 33 34 35 36 37 41 42 43 44 45 46 50 51 52 53 54 61 62 63 64 65 71 81 82".split()
WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CHECK_CHARS = "10X98765432"

SPAN = "struct<entity:string,start:int,end:int>"


def ascii_digits(text: Column) -> Column:
    """Full-width digits as ASCII ones, one for one, so that offsets stay."""
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def has_at(text: Column) -> Column:
    return F.contains(text, F.lit("@"))


def has_long_number(text: Column) -> Column:
    """Eleven digits in a row, single blanks and dashes between: whatever holds a phone, id or card number."""
    return text.rlike(r"(?U)(?:\d[ -]?){10}\d")


def has_dotted_number(text: Column) -> Column:
    return text.rlike(r"(?U)\d\.\d{1,3}\.\d")


def raw_matches(text: Column) -> dict[str, Column]:
    """Matches of each entity's pattern before validation, and of the e-mail candidates' own."""
    plain = F.when(text.rlike("[０-９]"), ascii_digits(text)).otherwise(text)
    return {
        "EMAIL_ADDRESS": find_matches(text, EMAIL, has_at(text)),
        "CN_ID_CARD": find_matches(plain, ID_CARD, has_long_number(plain)),
        "CN_MOBILE_PHONE": find_matches(plain, PHONE, has_long_number(plain)),
        "CREDIT_CARD": find_matches(plain, BANK_CARD, has_long_number(plain)),
        "IPV4_ADDRESS": find_matches(plain, IPV4, has_dotted_number(plain)),
        "EMAIL_CANDIDATE": find_matches(text, EMAIL_CANDIDATE, has_at(text)),
    }


def _only(matches: Column, valid) -> Column:
    return F.filter(matches, lambda m: F.coalesce(valid(m["value"]), F.lit(False)))


def valid_cn_id(value: Column) -> Column:
    """Province, county, date of birth and check character."""
    digits = F.transform(F.array(*(F.substring(value, i + 1, 1) for i in range(17))), lambda d: d.try_cast("int"))
    total = F.aggregate(F.zip_with(digits, F.array(*map(F.lit, WEIGHTS)), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    check = F.substring(F.lit(CHECK_CHARS), total % 11 + 1, F.lit(1))
    born = F.try_to_date(F.substring(value, 7, 8), "yyyyMMdd")
    return F.substring(value, 1, 2).isin(PROVINCES) & (F.substring(value, 3, 4) != "0000") & born.isNotNull() & (F.upper(F.substring(value, 18, 1)) == check)


VALID = {
    "EMAIL_ADDRESS": lambda v: F.lit(True),
    "CN_ID_CARD": valid_cn_id,
    "CN_MOBILE_PHONE": lambda v: F.regexp_replace(v, "[ -]", "").rlike(r"\A\d{11}\z"),
    "CREDIT_CARD": lambda v: F.call_function("luhn_check", v),
    "IPV4_ADDRESS": lambda v: F.forall(F.split(v, r"\."), lambda p: p.try_cast("int") <= 255),
}


def _finder(entity: str):
    return lambda text: _only(raw_matches(text)[entity], VALID[entity])


find_emails, find_cn_ids, find_cn_phones, find_bank_cards, find_ipv4 = map(_finder, VALID)


def validated(raw: dict[str, Column]) -> Column:
    """All validated matches, in entity order, each entity by start."""
    return F.concat(*(F.transform(_only(raw[entity], valid), _tag(entity)) for entity, valid in VALID.items()))


def candidates(text: Column) -> Column:
    return validated(raw_matches(text))


def _tag(entity: str):
    return lambda m: F.struct(F.lit(entity).alias("entity"), m["start"].alias("start"), m["end"].alias("end")).cast(SPAN)


def _is(entity: str):
    return lambda m: m["entity"] == entity


def clear_of(matches: Column, fixed: Column) -> Column:
    """The matches that overlap no span of ``fixed``, by start. One sweep over both in order: a match overlaps if a span
    that starts before it ends after its start, or one that starts later starts before its end."""
    part = lambda own, entity: f"x -> named_struct('start', x.start, 'end', x.end, 'own', {own}, 'entity', {entity})"
    fixed_only = lambda value: f"x -> if(x.own = 0, {value}, cast(-2147483648 AS int))"

    def swept(both):
        ends = running_maxima(higher("transform", both, fixed_only("x.end")))
        starts = F.reverse(running_maxima(F.reverse(higher("transform", both, fixed_only("-x.start")))))
        facts = F.arrays_zip(both.alias("x"), ends.alias("e"), starts.alias("s"))
        kept = higher("filter", facts, "f -> f.x.own = 1 AND f.e <= f.x.start AND -cast(f.s AS bigint) >= f.x.end")
        return higher("transform", kept, f"f -> cast(named_struct('entity', f.x.entity, 'start', f.x.start, 'end', f.x.end) AS {SPAN})")

    def cleared(two):
        mine, theirs = two["m"], two["f"]
        both = F.array_sort(F.concat(higher("transform", theirs, part(0, "''")), higher("transform", mine, part(1, "x.entity"))))
        return F.when((F.size(mine) == 0) | (F.size(theirs) == 0), mine).otherwise(let(both, swept))

    return let(F.struct(matches.alias("m"), fixed.alias("f")), cleared)


def exclude_protected(matches: Column, spans: Column) -> Column:
    """Without matches that touch a protected span; each entity's stay in order of start."""
    return let(clear_of(matches, spans), lambda m: F.concat(*(F.filter(m, _is(e)) for e in TOKENS)))


def resolve_overlaps(matches: Column) -> Column:
    """Entity by entity in priority order, matches that overlap none accepted before; the result by start."""

    def ordered(found: Column) -> Column:
        accepted = F.aggregate(F.array(*map(F.lit, TOKENS)), F.array().cast(f"array<{SPAN}>"), lambda taken, e: F.concat(taken, clear_of(F.filter(found, lambda m: m["entity"] == e), taken)))
        by_start = F.array_sort(F.transform(accepted, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["entity"].alias("entity"))))
        return F.transform(by_start, lambda m: F.struct(m["entity"].alias("entity"), m["start"].alias("start"), m["end"].alias("end")).cast(SPAN))

    return let(matches, lambda found: F.when(F.size(found) < 2, found).otherwise(ordered(found)))


def find_pii(text: Column, protected: Column | None = None) -> Column:
    found = candidates(text)
    return resolve_overlaps(found if protected is None else exclude_protected(found, protected))


def redact(text: Column, matches: Column) -> Column:
    """The text with each match replaced by its entity's token; ``matches`` disjoint, by start."""
    token = F.create_map(*(F.lit(x) for pair in TOKENS.items() for x in pair))

    def rebuild(found):
        end_before = lambda i: F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
        pieces = F.transform(found, lambda m, i: F.concat(F.substring(text, end_before(i) + 1, m["start"] - end_before(i)), token[m["entity"]]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(found, -1)["end"] + 1, F.char_length(text)))

    return let(matches, lambda found: F.when(F.size(found) == 0, text).otherwise(rebuild(found)))


def counts(matches: Column) -> list[Column]:
    return [F.size(F.filter(matches, _is(e))).alias(name) for e, name in COUNTERS.items()]


def pii_summary(docs: DataFrame, by: list[str]) -> DataFrame:
    """Counts per entity after overlap resolution, summed over ``by``."""
    per_doc = docs.select(F.struct(*by).alias("by"), find_pii(F.col("text")).alias("found")).select("by.*", *counts(F.col("found")))
    return per_doc.groupBy(*by).agg(*(F.sum(c).alias(c) for c in COUNTERS.values()), F.count("*").alias("documents"))


def count_outside(raw: dict[str, Column], protected: Column | None = None) -> Column:
    """Unvalidated candidates outside protected spans, over all entities, overlaps included."""
    found = F.concat(*(F.transform(raw[e], _tag(e)) for e in ("EMAIL_CANDIDATE", *list(TOKENS)[1:])))
    return F.size(found if protected is None else clear_of(found, protected))


def candidate_count(text: Column, protected: Column | None = None) -> Column:
    return count_outside(raw_matches(text), protected)


def too_many_candidates(text: Column, protected: Column | None = None, limit: int = 2000) -> Column:
    return candidate_count(text, protected) > limit
