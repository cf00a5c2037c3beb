"""Reading replies, verdicts and payment notices as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import text as tx

MARK = "\ue000"


def clean_answer(answer: Column) -> Column:
    """Answer without mark-up, copied prompt words, lead-ins and filler sentences."""
    out = F.replace(F.replace(answer, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    out = F.regexp_replace(out, r"(?<!\*)\*(?!\*)", "")
    out = F.regexp_replace(out, r"(?md)^\[(.*?)\]$", "$1")
    out = F.regexp_replace(out, r"(?md)^\s*Nội dung:\s*", "")
    out = F.regexp_replace(out, r"(?md)^\s*NỘI DUNG:\s*", "")
    for phrase in lx.LEAD_IN_PHRASES:
        out = F.regexp_replace(out, phrase + r",?\s*", "")
    for pattern in lx.FILLER_SENTENCES:
        out = F.regexp_replace(out, pattern, "")
    return out


def answer_points(answer: Column) -> Column:
    """Bullet lines as ARRAY<STRUCT<title, content>>; a bullet without a colon has title ''."""
    lines = F.filter(F.transform(F.split(answer, r"\r\n|\r|\n"), tx.strip), lambda x: x.startswith("-"))
    pattern = r"^-\s*([^:]+):\s*(.+)"

    def point(line: Column) -> Column:
        parsed = line.rlike(pattern)
        title = F.when(parsed, tx.strip(F.regexp_extract(line, pattern, 1))).otherwise(F.lit(""))
        content = F.when(parsed, tx.strip(F.regexp_extract(line, pattern, 2))).otherwise(
            tx.strip(F.regexp_replace(line, "^[- ]+", "")))
        return F.struct(title.alias("title"), content.alias("content"))

    return F.coalesce(F.transform(lines, point), F.array().cast("array<struct<title:string,content:string>>"))


def enforce_points(answer: Column, required: Column) -> Column:
    """STRUCT(answer, n_blocks, short): surplus blocks cut, shortage flagged.

    A block is a bullet line with the lines after it; text before the first bullet is a block too.
    """
    lines = F.transform(F.split(answer, "\n"), lambda x: F.when(
        x.rlike(r"^\s*-\s+\S"), F.concat(F.lit(MARK), x)).otherwise(x))
    pieces = F.split(F.array_join(lines, "\n"), "\n?" + MARK)
    blocks = F.filter(pieces, lambda p, i: (i > 0) | (p != ""))

    def cut(bs: Column) -> Column:
        kept = tx.strip(F.array_join(F.slice(bs, 1, F.greatest(required, F.lit(1))), "\n"))
        return F.struct(
            F.when(required <= 0, answer).otherwise(kept).alias("answer"), F.size(bs).alias("n_blocks"),
            ((required > 0) & (F.size(bs) < required)).alias("short"))

    return tx.bind(blocks, cut)


def read_reply(raw: Column) -> Column:
    """STRUCT(bloom, question, answer) of a generated reply; NULL where a part is missing."""
    plain = F.regexp_replace(F.regexp_replace(tx.strip(raw), r"\*\*([A-Z]+:?)\*\*", "$1"), r"\*\*", "")

    def parts(t: Column) -> Column:
        group = lambda p: F.nullif(tx.strip(F.regexp_extract(t, p, 1)), F.lit(""))
        return F.struct(
            group(r"(?i)BLOOM:\s*(.+?)(?:\n|\z)").alias("bloom"),
            group(r"(?is)QUESTION:\s*(.+?)(?:\nANSWER:|\z)").alias("question"),
            F.coalesce(group(r"(?is)ANSWER:\s*\n(.+)"), group(r"(?is)ANSWER:\s*(-\s*.+)")).alias("answer"))

    return tx.bind(plain, parts)


def read_verdict(raw: Column) -> Column:
    """STRUCT(decision, reason, feedback); an unreadable verdict is a fail."""
    t = F.coalesce(tx.strip(raw), F.lit(""))
    decision = F.lower(F.regexp_extract(t, r"(?i)decision:\s*(pass|fail)", 1))
    return F.struct(
        F.coalesce(F.nullif(decision, F.lit("")), F.lit("fail")).alias("decision"),
        tx.strip(F.regexp_extract(t, r"(?is)reason:\s*(.+?)(?:\n\s*feedback:|\z)", 1)).alias("reason"),
        tx.strip(F.regexp_extract(t, r"(?is)feedback:\s*(.+)", 1)).alias("feedback"))


def read_level(raw: Column) -> Column:
    """Level of a classification reply: leading digit 1-6, else the first one anywhere, else NULL."""
    t = tx.strip(F.regexp_replace(raw, r"\*+", ""))
    return F.coalesce(tx.first_group(t, r"^([1-6])"), tx.first_group(t, r"([1-6])")).cast("int")


def order_code(text: Column) -> Column:
    return tx.first_group(F.upper(text), r"DH\s*(\d+)")


def read_notification(payload: Column) -> Column:
    """STRUCT(content, amount) of a transfer notice; a bad number counts as 0."""
    p = F.from_json(payload, "content STRING, description STRING, transferAmount STRING, amount STRING")
    blank, zero = F.lit(""), F.lit("0")
    content = F.coalesce(F.nullif(p["content"], blank), p["description"], blank)
    first = F.nullif(F.nullif(p["transferAmount"], blank), zero)
    amount = F.coalesce(first, p["amount"]).try_cast("double")
    return F.struct(content.alias("content"), F.coalesce(amount, F.lit(0.0)).alias("amount"))


def signed_text(params: Column) -> Column:
    """Key-sorted ``k=v`` pairs joined by ``&``, values encoded as in a query string."""
    entries = F.array_sort(F.map_entries(params))

    def pair(e: Column) -> Column:
        value = F.replace(F.replace(F.url_encode(e["value"]), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        return F.concat(e["key"], F.lit("="), value)

    return F.array_join(F.transform(entries, pair), "&")


def hmac_sha512(message: Column, secret: str) -> Column:
    """HMAC-SHA512 in hexadecimal, composed of two SHA-512 over the padded key."""
    import hashlib

    key = secret.encode()
    if len(key) > 128:
        key = hashlib.sha512(key).digest()
    key = key.ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))
    return F.sha2(F.concat(outer, digest), 512)
