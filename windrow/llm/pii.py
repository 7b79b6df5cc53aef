"""Personal data in texts, with built-in SQL functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges for addresses and
social security numbers, a readable header for web tokens, variety of characters for secrets) and words near a span, on
either side and up to the next match of its kind, move its score. The base kinds (email, ip, card, phone) are
reported whenever their rule holds, with a score; the added kinds only from a score of `threshold` on.

Positions come from splitting a text at the matches: a match starts at the sum of all gaps and matches before it, added up
in runs of 256 so that time stays in proportion to the matches.
The expressions begin where a run begins (or where the last match ended) and use possessive quantifiers, so that they
take linear time and constant stack on any text, and match what their plain forms match.

Null and empty texts have no spans. Every row stands alone; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import fresh, read

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "mac", "jwt", "secret")
BASE = KINDS[:4]
SPAN = "struct<kind:string,start:int,end:int,score:double>"

_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "mac": r"(?<![A-Za-z0-9:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![A-Za-z0-9:-])",
    "jwt": r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+",
}
#: A cheap test before the expression is tried.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "mac": r"[0-9A-Fa-f][:-][0-9A-Fa-f]{2}[:-]", "jwt": r"eyJ", "secret": r"[A-Za-z0-9_+/-]{20}"}
#: Score before and after a context word; the words that count.
_SCORES = {"email": (0.95, 0.99), "ip": (0.7, 0.9), "card": (0.85, 0.99), "phone": (0.75, 0.95), "iban": (0.9, 0.99), "ssn": (0.4, 0.9), "mac": (0.8, 0.95), "jwt": (0.9, 0.99), "secret": (0.4, 0.9)}
_CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b", "ip": r"(?i)\b(?:ip|address|host|server|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b", "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b", "ssn": r"(?i)\b(?:ssn|social|security|tax|tin)\b",
    "mac": r"(?i)\b(?:mac|ethernet|device|hardware)\b", "jwt": r"(?i)\b(?:bearer|token|jwt|authorization)\b",
    "secret": r"(?i)(?:\b|_)(?:token|secret|password|passwd|pwd|credentials?|bearer|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth)\b",
}
_WINDOW = 48
_RUN = 256
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    def value(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """The ISO 7064 remainder of an IBAN without spaces; 1 if it is sound."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    return F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & luhn(digits)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(F.replace(hit, F.lit(" "), F.lit(""))) == 1
    if kind == "mac":  # one mark throughout; not the address of all or none
        return hit.rlike(r"^(?:[^-]*|[^:]*)$") & ~hit.rlike(r"^(?:[Ff:-]+|[0:-]+)$")
    if kind == "jwt":  # the first part is the Base64 of a JSON object that names its algorithm
        head = F.translate(F.substring_index(hit, ".", 1), "-_", "+/")
        padded = F.rpad(head, (F.ceil(F.char_length(head) / 4) * 4).cast("int"), "=")
        return F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string").rlike(r'^\{.*"alg"'), F.lit(False))
    if kind == "secret":  # digits and letters, and no few characters over and over
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(hit, ""))) >= 10)
    return ~hit.rlike(r"^(?:000|666|9)") & ~hit.rlike(r"-00-") & ~hit.rlike(r"-0000$")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of_kind(text: Column, kind: str, threshold: float) -> Column:
    """Array of SPAN, by start."""
    pattern = F.lit(_PATTERNS[kind])
    low, high = _SCORES[kind]
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        near = F.substring(x["gap"], -_WINDOW, _WINDOW).rlike(_CONTEXT[kind]) | F.substring(x["next"], 1, _WINDOW).rlike(_CONTEXT[kind])
        score = F.when(near, F.lit(high)).otherwise(F.lit(low))
        good = x["hit"].isNotNull() & _confirmed(kind, x["hit"])
        if kind not in BASE:
            good = good & (score >= threshold)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def pieces(gaps: Column) -> Column:
        both = F.zip_with(gaps, F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, h: F.struct(F.coalesce(g, F.lit("")).alias("gap"), h.alias("hit")))
        return F.zip_with(both, F.slice(gaps, 2, F.size(gaps)), lambda b, g: F.struct(b["gap"].alias("gap"), b["hit"].alias("hit"), F.coalesce(g, F.lit("")).alias("next")))

    def runs(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(parts), F.lit(_RUN))
        return F.transform(starts, lambda k: F.aggregate(F.slice(parts, k, F.lit(_RUN)), F.struct(F.lit(0).alias("at"), none.alias("found")), step))

    def joined(found: Column) -> Column:
        ends = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("from")), lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.array_append(acc["from"], acc["at"]).alias("from")), lambda acc: acc["from"])
        moved = F.zip_with(found, ends, lambda r, at: F.transform(r["found"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["score"].alias("score"))))
        return F.flatten(moved)

    found = _let(_let(_let(F.split(text, _PATTERNS[kind], -1), pieces), runs), joined)
    return F.when(text.rlike(_HINTS[kind]), found).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii", threshold: float = 0.6) -> DataFrame:
    """docs with a column of spans, by kind as in KINDS, then by start; offsets are code points, ends exclusive."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(out_col, F.concat(*(spans_of_kind(text, k, threshold) for k in KINDS)))


def mask_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """docs with every span replaced by its kind in square brackets; overlapping spans become one, named after the first."""
    span = "struct<kind:string,start:int,end:int>"
    pii, held = fresh("pii_spans", docs.columns), fresh("pii_merged", docs.columns)
    found = find_pii(docs, text_col, pii, threshold)
    ordered = F.array_sort(F.transform(pii, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.array_append(acc, F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        longer = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when((F.size(acc) == 0) | (s["start"] >= F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))), fresh).otherwise(longer)

    merged = F.aggregate(ordered, F.array().cast(f"array<{span}>"), join)
    text = F.col(text_col)
    pieces = F.transform(held, lambda s, i: F.concat(
        F.substring(text, F.coalesce(F.get(F.col(held), i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(F.col(held), i - 1)["end"], F.lit(0))),
        F.lit("["), F.upper(s["kind"]), F.lit("]"),
    ))
    rest = F.substring(text, F.element_at(held, -1)["end"] + 1, F.char_length(text))
    masked = F.when(F.size(pii) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return found.withColumn(held, F.when(F.size(pii) == 0, F.array().cast(f"array<{span}>")).otherwise(merged)).withColumn(text_col, masked).drop(pii, held)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")

    def of_kind(kind: str) -> Column:
        return F.filter("pii", lambda s: s["kind"] == kind)

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars, where there is one, follows the text."""
    masked = mask_pii(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)
