"""Personal data: format-preserving Feistel pseudonyms, in SQL expressions only.

Validated numbers and dates are permuted within their own format under a key, so a value has the same
pseudonym in every document, and different values of a format keep different pseudonyms. Formats with
a validity rule are walked through the permutation until a valid value comes up (cycle walking), or are mapped to
an exact range of integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.util import free_name

ROUNDS = 6
#: An invalid value comes up in about one of eight steps, so so many steps fail with odds under 1e-50.
WALK = 64

#: The formats, and what surrounds them.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "phone": PHONE, "ip": IPV4, "date": DATE, "ssn": SSN, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every format has one of these; texts without are left as they are without further search.
HINT = "[@0-9]"


def _hash_int(key: str, name: str, r: Column, half: Column) -> Column:
    """15 hex digits of sha2(key, format, round, other half) as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(name), r.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel_chars(value: Column, key: str, name: str) -> Column:
    """Feistel over the characters: digits move among digits, letters among letters of their case, others stay."""
    n = F.length(value)
    half = F.floor(n / 2).cast("int")

    def shifted(c: Column, by: Column) -> Column:
        code = F.ascii(c)
        turn = lambda base, size: F.char(F.lit(base) + F.pmod(code - F.lit(base) + by, F.lit(size)))
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("A", "Z"), turn(65, 26)).when(c.between("a", "z"), turn(97, 26)).otherwise(c)

    def step(acc: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(name), r.cast("string"), acc["b"]), 256)
        at = lambda i: F.conv(F.substr(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = F.transform(F.split(acc["a"], ""), lambda c, i: F.when(c == "", c).otherwise(shifted(c, at(i))))
        return F.struct(acc["b"].alias("a"), F.array_join(moved, "").alias("b"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1, n - half).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def feistel_range(value: Column, first: int, second: int, key: str, name: str) -> Column:
    """A permutation of the integers below first * second: both mixed digits are shifted by turns."""

    def step(acc: Column, r: Column) -> Column:
        a = F.pmod(acc["a"] + _hash_int(key, name, r, acc["b"]), F.lit(first))
        b = F.pmod(acc["b"] + _hash_int(key, name + "'", r, a), F.lit(second))
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.floor(value / F.lit(second)).cast("long").alias("a"), F.pmod(value, F.lit(second)).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda acc: acc["a"] * second + acc["b"])


def walked(value: Column, key: str, name: str, valid) -> Column:
    start = feistel_chars(value, key, name)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda x, _: F.when(valid(x), x).otherwise(feistel_chars(x, key, name)))


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn's sum; positions from the right with parity doubled_from are doubled."""
    back = F.split(F.reverse(digits), "")

    def add(acc: Column, x: Column) -> Column:
        d = F.coalesce(F.try_to_number(x["c"], F.lit("9")).cast("int"), F.lit(0))
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(F.pmod(x["i"], F.lit(2)) == doubled_from, twice).otherwise(d)

    return F.aggregate(F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return F.pmod(luhn_sum(digits, 1), F.lit(10)) == 0


def ssn_valid(digits: Column) -> Column:
    return digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("long"))


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    card = F.concat(F.substring(digits, 1, 1), feistel_chars(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(card, 0), F.lit(10)), F.lit(10)).cast("string")
    gap = F.regexp_extract(value, "[ -]", 0)
    grouped = F.when(gap == "", F.concat(card, check)).otherwise(F.regexp_replace(F.concat(card, check), r"([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), gap)))
    phone = feistel_chars(F.substring(digits, 2, 10), key, "phone")
    ssn = walked(digits, key, "ssn", ssn_valid)
    ip = feistel_range(F.aggregate(_octets(value), F.lit(0).cast("long"), lambda a, x: a * 256 + x), 65536, 65536, key, "ip")
    # 400 years have 146097 = 189 * 773 days; a date stays within its own 400 years.
    days = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit("1600-01-01").cast("date")).cast("long")
    era = F.floor(days / 146097).cast("long") * 146097
    date = F.date_format(F.date_add(F.lit("1600-01-01").cast("date"), (era + feistel_range(days - era, 189, 773, key, "date")).cast("int")), "yyyy-MM-dd")
    return (
        F.when(kind == "card", grouped)
        .when(kind == "phone", F.concat(F.lit("+1 ("), F.substring(phone, 1, 3), F.lit(") "), F.substring(phone, 4, 3), F.lit("-"), F.substring(phone, 7, 4)))
        .when(kind == "ssn", F.concat_ws("-", F.substring(ssn, 1, 3), F.substring(ssn, 4, 2), F.substring(ssn, 6, 4)))
        .when(kind == "ip", F.concat_ws(".", *[F.pmod(F.shiftright(ip, 8 * i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)]))
        .when(kind == "date", date)
        .when(kind == "email", F.concat(feistel_chars(F.substring_index(value, "@", 1), key, "email"), F.lit("@"), F.substring_index(value, "@", -1)))
        .otherwise(value)
    )


def kind_of(value: Column) -> Column:
    """The format of a match, null where its number, date or octets aren't valid."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.startswith("+1 ("), F.lit("phone"))
        .when(value.contains("."), F.when(~F.exists(_octets(value), lambda x: x > 255), F.lit("ip")))
        .when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(F.try_to_date(value, "yyyy-MM-dd") >= F.lit("1600-01-01").cast("date"), F.lit("date")))
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(ssn_valid(digits), F.lit("ssn")))
        .when(luhn_valid(digits), F.lit("card"))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and n_email, n_phone, n_ip, n_date, n_ssn, n_card, n_pii (longs).

    Formats: e-mail addresses (the local part is permuted), North American phone numbers, IPv4 addresses, ISO dates
    from 1600 on, social security numbers, payment cards of 13 to 19 digits with a valid check digit (first digit, length and
    grouping stay). What fails its format's check stays as it is, and so does every other character. A null text stays
    null with counts 0; empty texts and tables, repeated rows and other columns pass through; columns named as the
    counts are replaced.
    """
    found_name, kinds_name, named_name = (free_name(docs, x) for x in ("pii_found", "pii_kinds", "pii_named"))
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    pairs = F.transform(F.col(found_name), lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")))
    named = F.transform(F.col(kinds_name), lambda p: F.when(p["kind"].isNull(), p["value"]).otherwise(pseudonym(p["kind"], p["value"], key)))
    between = F.split(F.col(text), ANY, -1)
    rebuilt = F.array_join(F.zip_with(between, F.col(named_name), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    count = lambda kind: F.coalesce(F.size(F.filter(kinds_name, lambda p: p["kind"] == kind)), F.lit(0)).cast("long")
    counts = {f"n_{k}": F.when(F.col(kinds_name).isNull(), F.lit(0).cast("long")).otherwise(count(k)) for k in KINDS}
    out = docs.drop(*counts, "n_pii").withColumn(found_name, found).withColumn(kinds_name, pairs).withColumn(named_name, named)
    out = out.withColumn(text, F.when(F.exists(kinds_name, lambda p: p["kind"].isNotNull()), rebuilt).otherwise(F.col(text)))
    out = out.withColumns(counts).withColumn("n_pii", sum((F.col(c) for c in counts), F.lit(0).cast("long")))
    return out.drop(found_name, kinds_name, named_name)
