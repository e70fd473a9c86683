"""Narration, merchant name and similarity expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: channel prefixes, country codes, places, format words ---
PREFIXES = """
card purchase authorisation, card purchase auth, card purchase, pos purchase, point of sale purchase, point of sale, purchase at, purchase,
payment to, payment from, pmt to, internet banking payment to, internet banking payment, internet pmt to, internet trf to, ib payment to,
ib payment, immediate payment to, immediate payment, real time clearing, rtc payment, external debit order, internal debit order,
unpaid debit order, debit order, magtape debit, magtape credit, stop order, acb debit, acb credit, eft debit, eft credit, eft to, eft,
app payment to, app payment, app transfer to, digital payment, scheduled payment to, recurring payment, online purchase, web purchase,
mobile payment, 3d secure, visa purchase, mastercard purchase, chq card purchase, cheque card purchase, fnb app payment to, fnb app payment from, capitec pay, send money, prepaid purchase
"""
COUNTRIES = "za, rsa, zaf, south africa, gb, gbr, us, usa, nl, ie, de, ae, sg, au, ca"
PLACES = """
johannesburg, jhb, sandton, randburg, rosebank, midrand, roodepoort, soweto, benoni, boksburg, kempton park, germiston, alberton, springs,
centurion, pretoria, pta, menlyn, hatfield, brooklyn, cape town, cpt, claremont, sea point, bellville, durbanville, stellenbosch,
somerset west, paarl, table view, century city, kenilworth, durban, dbn, umhlanga, ballito, pinetown, westville, hillcrest,
pietermaritzburg, pmb, richards bay, newcastle, port elizabeth, gqeberha, east london, bloemfontein, kimberley, polokwane, nelspruit,
mbombela, rustenburg, potchefstroom, welkom, george, knysna, mossel bay, worcester, vereeniging, vanderbijlpark, gauteng, western cape,
kwazulu natal, kwazulu-natal, kzn, mpumalanga, limpopo, north west, free state, eastern cape, northern cape
"""
FORMAT_WORDS = """
hyper, hypermarket, express, superstore, supermarket, liquorshop, foodco, food co, local, on nicol, value, family, mini, kwikspar,
superspar, sixty60, drive thru, drivethru, store, branch, ltd, pty, pty ltd, cc, inc, no1, no2
"""
CAPITALS = "KFC, SPAR, MTN, DSTV, BP, SA, ZA, TFG, PEP, ATM, UK, USA, VAT, SARS, PNP, TAB, GEMS, MRP, HIFI, H&M"
NOISE = (
    r"\b\d{2,6}[*x#.]{2,}\d{2,6}\b",  # masked cards
    r"\b(ref|reference|auth|authno|trn|txn|seq|batch|inv|id)[:#\s]*\w{2,}\b",
    r"\b(\d{1,2}[/\-.]\d{1,2}([/\-.]\d{2,4})?|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})\b",
    r"\b\d{1,2}\s?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b",
    r"\b\d{1,2}:\d{2}(:\d{2})?\b",
    r"\b\d{5,}\b",
)
# --- end of fixed values ---


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.replace("\n", " ").split(",") if w.strip()]


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def clean_description(text: Column) -> Column:
    """Who was paid, as written: a narration without card numbers, references,
    dates, times, long numbers, channel prefixes and a country at the end."""
    s = F.coalesce(text, F.lit(""))
    for pattern in NOISE:
        s = F.regexp_replace(s, F.lit("(?i)" + pattern), F.lit(" "))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[*#_]", " "), r"\s+", " "))
    s = F.regexp_replace(s, F.lit(rf"(?i)^(?:(?:{_any(_words(PREFIXES))})[ :,-]*+)++"), F.lit(""))
    s = F.regexp_replace(s, F.lit(rf"(?i)[\s,]+(?:{_any(_words(COUNTRIES))})\s*$"), F.lit(""))
    return F.regexp_replace(s, F.lit(r"^[ :,-]+|[ :,-]+$"), F.lit(""))


def merchant_name(cleaned: Column) -> Column:
    """A display name: no place at the end, no format words after the first
    word, at most five words, title case. Empty becomes Unknown."""
    places = _any(sorted(_words(PLACES), key=len, reverse=True))
    s = F.regexp_replace(F.trim(cleaned), F.lit(rf"(?i)(?<=[^ ,-])[ ,-]* (?:{places})$"), F.lit(""))
    words = F.filter(
        F.transform(F.split(s, r"[\s/]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != ""
    )
    fixed = F.array(*(F.lit(w) for w in _words(FORMAT_WORDS)))
    kept = F.filter(words, lambda w, i: (i == 0) | ~F.array_contains(fixed, F.lower(w)))
    capitals = F.array(*(F.lit(w) for w in _words(CAPITALS)))
    short = lambda w: (F.length(w) <= 3) & (w == F.upper(w)) & (w != F.lower(w))
    titled = F.transform(F.slice(kept, 1, 5), lambda w: F.when(F.array_contains(capitals, F.upper(w)) | short(w), F.upper(w)).otherwise(F.initcap(w)))
    name = F.array_join(titled, " ")
    return F.when(name == "", "Unknown").otherwise(name)


def canonical_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def identity_key(narration: Column) -> Column:
    """What tells two rows' narrations apart: the key of the merchant's name, so
    that another card mask or date in the text is the same row; the key of the
    text itself where the name has no letter or digit."""
    name = canonical_key(merchant_name(clean_description(narration)))
    return F.when(name != "", name).otherwise(canonical_key(narration))


def _trigrams(s: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 2)), lambda i: F.substr(s, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal, .85 if one holds the other, else by
    shared words of over two letters, else by shared trigrams."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    ka, kb, wa, wb = canonical_key(a), canonical_key(b), words(a), words(b)
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))
    j = share(wa, wb)
    return (
        F.when((ka == "") | (kb == ""), 0.0)
        .when(ka == kb, 1.0)
        .when(F.contains(ka, kb) | F.contains(kb, ka), 0.85)
        .when(j > 0, F.least(F.lit(0.8), 0.3 + 0.6 * j))
        .otherwise(F.least(F.lit(0.75), share(_trigrams(ka), _trigrams(kb))))
    )
