"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is DataFrame expressions.  Spans are counted in code points, end
exclusive.  A pattern's matches and the pieces between them (a split at the
same pattern) give the positions by a running sum of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their fixed order; the method's own kinds follow.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban",)
#: Added spans, and what is redacted, have at least this score; base spans are counted whatever theirs is.
MIN_SCORE = 0.5
#: What a word nearby adds to a score or takes from it.
NEARBY = 0.2
#: Code points before and after a span in which context words are looked for.
CONTEXT = 40

# Written so that no pattern backtracks over what it has taken: a run is tried
# from its first character only (or from the end of the last match), and
# repeated groups are possessive, which Java runs in a loop, not by recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to be run at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}
#: Score of a confirmed span, and the words nearby that raise or lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6}
RAISING = {
    "email": r"\b(?:e-?mail|contact|mailto|kontakt|correo|courriel)\b",
    "ip": r"\b(?:ip|address|host|server|adresse|servidor)\b",
    "card": r"\b(?:card|credit|debit|visa|mastercard|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|tel|call|fax|mobile|telefon|téléphone|teléfono)\b",
    "iban": r"\b(?:iban|bank|account|konto|banque|cuenta)\b",
}
LOWERING = {"email": r"\b(?:noreply|example only)\b", "ip": r"\b(?:version|release|v)\b", "card": r"\b(?:isbn|sku|order no)\b", "phone": r"\b(?:isbn|part no)\b", "iban": r"\b(?:isbn|sku)\b"}


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _mod97(t: Column) -> Column:
    """Remainder by 97 of an account number as ISO 7064 reads it: first four characters last, A as 10 to Z as 35."""
    s = F.replace(t, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    code = lambda c: F.ascii(c)
    step = lambda acc, c: F.when(code(c) < 58, (acc * 10 + code(c) - 48) % 97).otherwise((acc * 100 + code(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def confirmed(kind: str, t: Column) -> Column:
    """Whether a matched string passes its kind's validator."""
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(_digits(t)).between(16, 19) & F.call_function("luhn_check", _digits(t))
    if kind == "phone":
        return F.length(_digits(t)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(t, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(t) == 1)
    return F.lit(True)


def _score(kind: str, text: Column, start: Column, end: Column) -> Column:
    at = F.greatest(start - CONTEXT, F.lit(0))
    near = F.lower(F.concat(F.substring(text, at + 1, start - at), F.lit(" "), F.substring(text, end + 1, F.lit(CONTEXT))))
    up, down = near.rlike(RAISING[kind]), near.rlike(LOWERING[kind])
    return F.lit(SCORES[kind]) + F.when(up, F.lit(NEARBY)).otherwise(0.0) - F.when(down, F.lit(NEARBY)).otherwise(0.0)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(kind: str, text: Column) -> Column:
    """Array of confirmed ``(kind, start, end, score)`` of one kind, leftmost non-overlapping matches in order."""
    none = F.array().cast(_SPAN)
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)

    def place(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["t"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["t"].alias("t")))).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,t:string>>").alias("out"))
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda t, gap: F.struct(t.alias("t"), gap.alias("gap")))
    placed = F.aggregate(pairs, first, place, lambda acc: acc["out"])
    kept = F.transform(
        F.filter(placed, lambda x: confirmed(kind, x["t"])),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _score(kind, text, x["start"], x["end"]).alias("score")),
    )
    # the split is asked for only where one match at least passes
    return F.when(text.rlike(NEEDS[kind]) & F.exists(found, lambda t: confirmed(kind, t)), kept.cast(_SPAN)).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and one array of spans per kind for every row of ``docs(doc_id, text)``; a null text is empty.

    Repeated rows each give a row; a null doc_id stays null; other columns are
    not read; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.select("doc_id", "text", *[spans_of(k, F.col("text")).alias(k) for k in (*BASE, *EXTRA)])


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts, spans and their digest per document: one narrow pass.  Spans of the method's own kinds need a score of ``MIN_SCORE``."""
    found = find(docs)
    sure = [F.filter(k, lambda x: x["score"] >= MIN_SCORE) for k in EXTRA]
    base, every = F.concat(*BASE), F.concat(*BASE, *sure)
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(every).alias("spans"),
        F.array_join(F.transform(every, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with every span of at least ``min_score`` replaced by ``<KIND>``; ``n_chars``, if there, follows the new text.

    Overlapping spans of several kinds are replaced together under the first
    one's kind.  Null texts stay null; all columns and their order are kept.
    """
    own = "_marks_of_pii"
    text = F.col("text").cast("string")
    safe = F.coalesce(text, F.lit(""))
    marks = F.array_sort(
        F.transform(F.filter(F.concat(*[spans_of(k, safe) for k in (*BASE, *EXTRA)]), lambda x: x["score"] >= min_score), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind")))
    )

    def cut(acc: Column, x: Column) -> Column:
        end = -x["end"]
        fresh = F.concat(acc["out"], F.array(F.substring(safe, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(F.col(own), first, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(safe, acc["at"] + 1, F.length(safe))))
    out = docs.withColumn(own, marks).withColumn("text", F.when(F.size(own) > 0, clean).otherwise(text)).drop(own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(text.isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
