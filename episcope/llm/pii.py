"""Personal data by pattern, checksum and context, in DataFrame functions only.

A pattern proposes spans; a validator (digit counts, Luhn, mod 97, number ranges) confirms them; words
near a span raise its score. Four kinds are reported on shape and validator alone (email, ip, card,
phone); iban and local_phone are added when their score reaches the threshold.

Places come from lengths: the matches of a pattern and the text between them alternate, so a match
starts at the sum of what lies before it. Sums are taken in chunks of 256 matches, so that a text with
very many matches stays near linear.

The patterns below accept what the plain forms accept. Start guards and possessive repeats only keep
the matcher from trying every start of a long run, or from going deep into one. The length of an account
number follows from its country, so a word or number behind it is not taken in.

Defined results: a null or empty text has no spans (count 0, the digest of an empty string); repeated
rows are rows; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import id_and_text

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an account number by country (the register of IBAN formats); other countries: up to the next blank or 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|CR|HR|LI|LV",
    22: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(IBAN_LENGTHS.values())
_BODIES = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_OTHER = rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?:\x20?[A-Z0-9]){{11,30}})"
IBAN = rf"(?<![A-Za-z0-9])(?:{_BODIES}|{_OTHER})(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

#: kind -> (pattern, a plain string or pattern that a text must hold, score of shape and checksum, context words)
KINDS = {
    "email": (EMAIL, "@", 0.9, "mail|contact|write to"),
    "ip": (IP, "[0-9]\\.[0-9]", 0.6, "ip|host|server|address"),
    "card": (CARD, "[0-9][\\x20-]?[0-9]", 0.8, "card|visa|credit|payment"),
    "phone": (PHONE, "\\+[0-9]", 0.7, "phone|call|tel|fax|mobile"),
    "iban": (IBAN, "[A-Z]{2}[0-9]{2}", 0.8, "iban|bank|account|transfer"),
    "local_phone": (LOCAL_PHONE, "[0-9]{3}[\\x20.-][0-9]{4}", 0.4, "phone|call|tel|fax|mobile"),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 40, 0.2, 0.6
_CHUNK = 256


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def mod97(account: Column) -> Column:
    """True if an account number without blanks leaves 1 modulo 97 (first four characters last)."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        char = F.substring(turned, i, F.lit(1))
        value = F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), char)
        return F.when(value > 0, rest * 100 + value + 9).otherwise(rest * 10 + char.cast("int")) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def valid(kind: str, match: Column) -> Column:
    digits = digits_of(match)
    count = F.length(digits)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(match, "\\."), small)
    if kind == "card":
        return F.when((count >= 12) & (count <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (count >= 9) & (count <= 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when((F.length(bare) >= 15) & (F.length(bare) <= 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def with_spans(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Add ``kind``: an array of (start, rank, kind, end, score), in order of start.

    A span is kept if its validator confirms it and, for kinds outside BASE, its score is enough.
    """
    pattern, needs, score, words = KINDS[kind]
    rank = list(KINDS).index(kind)
    none = F.array().cast("array<string>")
    has = F.contains(text, F.lit(needs)) if kind == "email" else F.rlike(text, F.lit(needs))
    m, g, n, b = (f"_{x}_{kind}" for x in "mgnb")
    df = df.withColumn(m, F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    lengths = F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(g, i))).cast("long"))
    df = df.withColumn(n, lengths)
    chunks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _CHUNK).cast("int"))
    sums = F.transform(chunks, lambda c: _total(F.slice(n, c * _CHUNK + 1, F.lit(_CHUNK))))
    df = df.withColumn(b, F.when(F.size(n) > 0, sums).otherwise(F.array().cast("array<long>")))
    bases = F.transform(b, lambda _, c: _total(F.slice(b, F.lit(1), c)))
    df = df.withColumn(b, bases)

    def span(x: Column, i: Column) -> Column:
        inside = i % _CHUNK
        before = F.get(b, F.floor(i / _CHUNK).cast("int")) + _total(F.slice(n, i - inside + 1, inside))
        start = before + F.length(F.get(g, i))
        near = F.concat_ws(
            " ", F.right(F.get(g, i), F.lit(CONTEXT_CHARS)), F.left(F.get(g, i + 1), F.lit(CONTEXT_CHARS))
        )
        close = F.rlike(near, F.lit(f"(?i)(?<![a-z])(?:{words})"))
        found = F.lit(score) + F.when(close, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        good = F.coalesce(valid(kind, x), F.lit(False))
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (start + F.length(x)).alias("end"), F.when(good, found).otherwise(F.lit(-1.0)).alias("score"),
        )

    least = 0.0 if kind in BASE else THRESHOLD
    kept = F.filter(F.transform(m, span), lambda s: s["score"] >= least)
    return df.withColumn(kind, kept).drop(m, g, n, b)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and one array of scored spans per kind in KINDS."""
    df = id_and_text(docs, id_col, text_col)
    for kind in KINDS:
        df = with_spans(df, kind)
    return df


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start and then by the order of KINDS, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    found = find_personal_data(docs, id_col, text_col)
    base = F.concat(*BASE)
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(*KINDS)).alias("spans"),
    )
