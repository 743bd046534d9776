"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; checksums (Luhn, mod 97) and ranges confirm
them; words close before a span raise its score. Four base kinds follow fixed
patterns and stay whatever their score; IBANs and social-security-like numbers
are added when confirmed, the latter only near a telling word.

The patterns are possessive and bound to the place where a leftmost match can
begin, so their time is in proportion to the text, and none recurses. A null
text counts as empty and has no spans. The positions of a text's matches are
running sums taken in two steps, CHUNK at a time, and the words before a match come
from the gaps between matches, so that many matches cost little more than few.
Repeated rows are searched row by row;
an empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm.common import table

BASE = ("email", "ip", "card", "phone")
#: Same matches as the plain patterns: a match begins at the start of a run or
#: where the last match ended, and what a plain quantifier takes it never gives back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
#: A text without this string has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write to",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|payment",
    "phone": r"(?i)phone|call|tel\b|mobile|fax",
    "iban": r"(?i)iban|account|bank",
    "ssn": r"(?i)\bssn\b|social security|tax",
}
#: Score of a confirmed span, what a word of its context adds, and the least score an added kind needs.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_GAIN, CONTEXT_WIDTH, LEAST_ADDED = 0.2, 40, 0.5
#: Numbers that are summed in one step.
CHUNK = 256


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it, also
    within functions of array elements."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column) -> Column:
    """array<int> of the sums of numbers up to and with each; numbers: a bound
    value. An accumulated array is copied at every step, hence chunks: sums within
    each, then what lies before it."""
    none = F.array().cast("array<int>")

    def sums(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))

        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def joined(chunks: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), sums(F.transform(chunks, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0)))))
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, b: F.transform(c, lambda x: x + b)))

    starts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(CHUNK))
    return let(F.transform(starts, lambda k: sums(F.slice(numbers, k, F.lit(CHUNK)))), joined)


def located(text: Column, kind: str) -> Column:
    """array<struct<start, end, found, before>> of a kind's matches, in code
    points; before: the CONTEXT_WIDTH characters before it."""

    def tail(x: Column) -> Column:
        return F.right(x, F.lit(CONTEXT_WIDTH))

    def item(tails: Column, x: Column, i: Column) -> Column:
        # a match has four characters or more, so ten of them and their gaps hold enough
        before = F.concat(F.array_join(F.slice(tails, F.greatest(F.lit(1), i - 9), F.least(i, F.lit(10))), ""), x["near"])
        return F.struct((x["end"] - F.length(x["found"])).alias("start"), x["end"].alias("end"), x["found"].alias("found"), tail(before).alias("before"))

    def spans(found: Column, gaps: Column) -> Column:
        sizes = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m))
        tails = F.zip_with(gaps, found, lambda g, m: tail(F.concat(tail(g), m)))
        parts = F.arrays_zip(found.alias("found"), let(sizes, running).alias("end"), F.transform(gaps, tail).alias("near"))
        return let(tails, lambda t: F.transform(parts, lambda x, i: item(t, x, i)))

    empty = F.array().cast("array<struct<start:int,end:int,found:string,before:string>>")
    # the gaps are looked for only where there are matches
    all_spans = let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(let(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found)), lambda gaps: spans(found, gaps))))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), all_spans).otherwise(empty) if kind in NEEDS else all_spans


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod_97(code: Column) -> Column:
    """Whether an IBAN without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(found, F.lit(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod_97(F.regexp_replace(found, " ", ""))
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of a kind's confirmed spans."""

    def scored(x: Column) -> Column:
        near = F.rlike(x["before"], F.lit(CONTEXT[kind]))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (F.lit(SCORES[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0)).alias("score"))

    out = F.transform(F.filter(located(text, kind), lambda x: confirmed(kind, x["found"])), scored)
    return out if kind in BASE else F.filter(out, lambda x: x["score"] >= LEAST_ADDED)


def personal_data(df: DataFrame, text_col: str = "text", into: str = "found") -> DataFrame:
    """df with an array of spans (kind, start, end, score), by kind, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn(into, F.concat(*[spans_of(text, k) for k in PATTERNS]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _kind_sql(kind: str, plain: str, check: str) -> str:
    """A DuckDB list of a kind's kept spans, from the plain pattern."""
    found = f"regexp_extract_all(t, '{plain}')"
    return rf"""list_transform(list_filter(list_transform(range(1, len({found}) + 1), lambda i: {{'s': CAST(list_sum(list_transform(string_split_regex(t, '{plain}')[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: len(x))), 0) AS BIGINT), 'm': {found}[i]}}),
    lambda y: {check}), lambda y: '{kind}:' || y.s || ':' || (y.s + len(y.m)))"""


_DIGITS = "regexp_replace(y.m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 0 THEN (2 * CAST(substr(reverse({_DIGITS}), k, 1) AS INT)) % 10 + (2 * CAST(substr(reverse({_DIGITS}), k, 1) AS INT)) // 10 ELSE CAST(substr(reverse({_DIGITS}), k, 1) AS INT) END)) % 10 = 0"
_CODE = "replace(y.m, ' ', '')"
_MOD97 = f"list_reduce(list_concat([0], list_transform(range(1, len({_CODE}) + 1), lambda k: CAST(ascii(substr(substr({_CODE}, 5) || substr({_CODE}, 1, 4), k, 1)) AS INT))), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id,
  {_kind_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true")} AS email,
  {_kind_sql("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(y.m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0")} AS ip,
  {_kind_sql("card", r"[0-9]([\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")} AS card,
  {_kind_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 8 AND 15")} AS phone,
  {_kind_sql("iban", PATTERNS["iban"], _MOD97)} AS iban,
  {_kind_sql("ssn", PATTERNS["ssn"], f"regexp_matches(substr(t, greatest(0, y.s - {CONTEXT_WIDTH}) + 1, y.s - greatest(0, y.s - {CONTEXT_WIDTH})), '{CONTEXT['ssn']}')")} AS ssn FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip, CAST(len(card) AS BIGINT) AS n_card, CAST(len(phone) AS BIGINT) AS n_phone,
  sha256(array_to_string(email || ip || card || phone, ',')) AS base_sha256, array_to_string(email || ip || card || phone || iban || ssn, ',') AS spans FROM k
"""
