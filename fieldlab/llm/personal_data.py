"""Personal data in whole texts: patterns propose, checks confirm, context words score.

Kinds email, ip, card and phone are the base: a match that passes its check is
always reported. The method adds account numbers (iban, mod 97) and social
numbers (ssn) whose score, raised by context words close by, reaches
``least_score``. Built-in functions only.

Patterns start only where a longer run of their characters starts, or where the
last match ended, so a text of one endless word takes linear time; matches are
the same. A null text is empty. Every input row gives one row; a null id stays
null. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .spans import joined, matches, of_kind

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Score of a confirmed match, and what a context word near it adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {"email": "mail|contact|write to", "ip": "ip|address|server|host", "card": "card|visa|credit|payment",
           "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank", "ssn": "ssn|social security|taxpayer"}
CONTEXT_SCORE = 0.2
NEARBY = 40
LEAST_SCORE = 0.5
_SPAN = "array<struct<s:int,rank:int,e:int,kind:string,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total, i):
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 1, doubled).otherwise(x)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    def add(rest, i):
        c = F.substring(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), add) == 1


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return let(digits, lambda x: F.when(F.length(x).between(14, 19), luhn(x)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return let(F.regexp_replace(match, " ", ""), lambda x: F.when(F.length(x).between(15, 34), mod97(x)).otherwise(False))
    return F.lit(True)


def _found(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """Confirmed and scored matches of one kind; ``hint`` is cheap and true wherever the pattern can match."""
    rank = KINDS.index(kind)

    def scored(x):
        begin = F.greatest(x["s"] - NEARBY, F.lit(0))
        near = F.lower(F.concat(F.substring(text, begin + 1, x["s"] - begin), F.lit(" "),
                                F.substring(text, x["e"] + 1, F.lit(NEARBY))))
        score = SCORES[kind] + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})\b"), CONTEXT_SCORE).otherwise(0.0)
        return F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"),
                        score.alias("score"))
    kept = F.transform(F.filter(matches(text, pattern), lambda x: _passes(kind, x["m"])), scored)
    return F.when(hint, kept.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per input row: id, text and ``found``, an array of (s, rank, e, kind, score)."""
    text = F.col("text")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    number = text.rlike("[0-9]")
    columns = {"email": _found(text, "email", EMAIL, F.contains(text, F.lit("@"))),
               "ip": _found(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]")),
               "card": _found(text, "card", CARD, number),
               "phone": _found(text, "phone", PHONE, F.contains(text, F.lit("+"))),
               "iban": _found(text, "iban", IBAN, text.rlike("[A-Z]{2}[0-9]{2}")),
               "ssn": _found(text, "ssn", SSN, text.rlike("[0-9]-[0-9]{2}-[0-9]"))}
    d = d.select("id", "text", *[c.alias(k) for k, c in columns.items()])
    added = F.filter(F.concat("iban", "ssn"), lambda x: x["score"] >= least_score)
    return d.select(F.col("id").alias(id_col), "text",
                    F.sort_array(F.concat("email", "ip", "card", "phone")).alias("base"),
                    F.sort_array(F.concat("email", "ip", "card", "phone", added)).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, hash of the base spans, and all spans as text."""
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select(id_col, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))
