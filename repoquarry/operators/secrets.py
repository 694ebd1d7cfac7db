"""Sensitive tokens that patterns alone do not tell: random strings by entropy, card and account numbers by their check digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.rows import unfold
from repoquarry.operators.skew import spread

CANDIDATES = {
    "random_hex": r"\b[0-9a-f]{32,}\b",
    "random_text": r"[0-9A-Za-z+/_-]{24,}",
    "card_number": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b",
    "bank_account": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
}
HEX_BITS, TEXT_BITS = 3.0, 4.2
"""Least entropy of a character of random strings."""


def entropy(token: Column) -> Column:
    """Shannon entropy in bits of the characters of a token."""
    size = F.length(token).cast("double")

    def part(c: Column) -> Column:
        return F.transform(F.array((F.length(token) - F.length(F.replace(token, c, F.lit("")))) / size), lambda share: -share * F.log2(share))[0]

    return F.aggregate(F.array_distinct(F.filter(F.split(token, ""), lambda c: c != "")), F.lit(0.0), lambda total, c: total + part(c))


def luhn(token: Column) -> Column:
    """Whether the digits of a number of 13 to 19 digits end with the right check digit."""
    def weighted(digits: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when((F.length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    def right(digits: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda t, i: t + weighted(digits, i))
        # Numbers of other lengths are not added up.
        return F.length(digits).between(13, 19) & ~digits.rlike("^0+$") & (total % 10 == 0)

    # A one-element array binds the digits, so they are found once.
    return F.transform(F.array(F.regexp_replace(token, "[^0-9]", "")), right)[0]


def account_check(token: Column) -> Column:
    """Whether an international account number leaves 1 when divided by 97."""
    bare = F.replace(token, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substring(bare, 5, 100), F.left(bare, F.lit(4))), ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.length(bare).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def _passes(kind: str, token: Column) -> Column:
    if kind == "random_hex":
        return entropy(token) >= HEX_BITS
    if kind == "random_text":
        mixed = token.rlike("[0-9]") & token.rlike("[A-Z]") & token.rlike("[a-z]")
        return mixed & (entropy(token) >= TEXT_BITS)
    return luhn(token) if kind == "card_number" else account_check(token)


def _placed(value: Column, regex: str) -> Column:
    """Array of (token, position) of the matches; positions count characters from 1."""
    # What lies between matches, and the matches, take turns.
    pair = F.zip_with(F.split(value, regex), F.concat(F.regexp_extract_all(value, F.lit(regex), F.lit(0)), F.array(F.lit(""))), lambda gap, token: F.struct(gap.alias("gap"), token.alias("token")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<token: string, position: int>>").alias("found"))

    def step(state: Column, p: Column) -> Column:
        at = state["at"] + F.length(p["gap"])
        found = F.when(p["token"] != "", F.array_append(state["found"], F.struct(p["token"].alias("token"), at.alias("position")))).otherwise(state["found"])
        return F.struct((at + F.length(p["token"])).alias("at"), found.alias("found"))

    return F.aggregate(pair, start, step, lambda state: state["found"])


def secret_tokens(files: DataFrame) -> DataFrame:
    """`(repo_id, path, kind, position, token)`: tokens of a text that pass the test of their kind.

    Random hexadecimal and mixed strings have the entropy of keys; card numbers pass the Luhn test, international account numbers the
    remainder of 97. A token may be of several kinds. Texts without a candidate are not folded. A null text has none. The texts with one are
    dealt to all tasks, as the tests cost far more than reading them.
    """
    none = F.array().cast("array<struct<token: string, position: int>>")
    value = F.col("content")
    parts = [_of_kind(kind, F.when(value.rlike(regex), _placed(value, regex)).otherwise(none)) for kind, regex in CANDIDATES.items()]
    candidate = "|".join(f"(?:{regex})" for regex in CANDIDATES.values())
    texts = spread(files.select("repo_id", "path", "content").filter(value.rlike(candidate)))
    rows = unfold(texts, ["repo_id", "path"], F.concat(*parts), "found")
    return rows.select("repo_id", "path", "found.kind", F.col("found.position").cast("bigint").alias("position"), "found.token")


def _of_kind(kind: str, placed: Column) -> Column:
    passing = F.filter(placed, lambda t: _passes(kind, t["token"]))
    return F.transform(passing, lambda t: F.struct(F.lit(kind).alias("kind"), t["position"].alias("position"), t["token"].alias("token")))
