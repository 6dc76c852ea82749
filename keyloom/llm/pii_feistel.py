"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted by a keyed Feistel network within their own format, so a value has the same
pseudonym in every document and two values never share one:

  card numbers  13 to 19 digits with a valid check digit -> the same length, a valid check digit, separators kept;
                beside other short numbers the longest run of whole groups that is valid
  phone numbers +c (aaa) eee-nnnn and alike -> the last ten digits permuted, the rest kept
  social security numbers ddd-dd-dddd -> nine digits permuted
  IPv4 addresses -> a valid address
  dates yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy from 1900-01-01, 73000 days on -> a date of that span in the same notation

What has no number format gets a keyed hash in its own alphabet: the name part of e-mail addresses, and the value of
passwords, API keys and tokens written as name = value or name: value (with a digit, unless in the forms password= and token = ""), and AKIA keys. What looks like a number but isn't valid stays.

All is built-in functions: a text is split at the matches, the matches are transformed, and both are put together again.
Round functions are SHA-256 of key, kind, round and half.

Defined cases: null text stays null, empty stays empty; texts without matches stay as they are; repeated rows change
alike; other columns stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Span of dates, as two factors, so that the network permutes it without leaving it.
SPAN = (250, 292)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What is looked for; the first that fits wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "secret": r"(?:password=|token = \")[0-9A-Za-z]{8,128}+|(?i:password|passwd|api[_-]?key|secret|token)\s?[=:]\s?[\"']?(?=[A-Za-z]*\d)[0-9A-Za-z]{8,128}+|(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])",
    "phone": r"(?:\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?|\(\d{3}\) ?|(?<![\d.-])\d{3}[.-])\d{3}[ .-]?\d{4}(?![\d-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _prf(key: str, kind: str, i: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """struct(l, r): a permutation of the pairs below the sizes. Halves take turns, so sizes may differ."""

    def turn(s, i):
        l = F.when(i % 2 == 0, F.pmod(s["l"] + _prf(key, kind, i, s["r"]), left_size)).otherwise(s["l"])
        r = F.when(i % 2 == 1, F.pmod(s["r"] + _prf(key, kind, i, s["l"]), right_size)).otherwise(s["r"])
        return F.struct(l.alias("l"), r.alias("r"))

    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (2 to 18)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    kind_n = feistel(F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, v).cast("long"), _power(u), _power(v), key, kind)
    return F.aggregate(F.array(kind_n), F.lit(""), lambda _, s: F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), v, "0")))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, those at places of the given parity (0: the last) doubled and cast out nines."""
    def add(total, i):
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _into(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in turn."""
    def put(s, c):
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(digit, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), put, lambda s: s["out"])


def _card_within(m: Column) -> Column:
    """struct(at, run): the longest run of whole groups of digits with 13 to 19 digits and a valid check digit, ties to
    the first; null if there is none."""
    groups = F.split(m, "[ -]")
    wide = lambda i, n: F.length(F.array_join(F.slice(groups, i + 1, n), " "))

    def runs(i):
        at = F.when(i > 0, wide(F.lit(0), i) + 1).otherwise(F.lit(0))
        return F.transform(F.sequence(F.lit(1), F.size(groups) - i), lambda n: F.struct((-wide(i, n)).alias("short"), at.alias("at"), F.substring(m, at + 1, wide(i, n)).alias("run")))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), runs))
    sized = F.filter(every, lambda x: F.length(_only_digits(x["run"])).between(13, 19))
    return F.array_min(F.filter(sized, lambda x: luhn_sum(_only_digits(x["run"]), 1) % 10 == 0))


def _card(m: Column, key: str) -> Column:
    def put(_, x):
        digits = _only_digits(x["run"])
        body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        whole = F.aggregate(F.array(body), F.lit(""), lambda _, b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))
        return F.concat(F.substring(m, F.lit(1), x["at"]), _into(x["run"], whole), F.substring(m, x["at"] + F.length(x["run"]) + 1, F.length(m)))

    found = F.filter(F.array(_card_within(m)), lambda x: x.isNotNull())
    return F.aggregate(found, m, put)


def _phone(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    n = F.length(digits)
    return _into(m, F.concat(F.substring(digits, F.lit(1), n - 10), permute_digits(F.substring(digits, n - 9, F.lit(10)), key, "phone")))


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    size = F.lit(65536).cast("long")
    got = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], size, size, key, "ip")
    octet = lambda x: x.cast("string")
    return F.aggregate(F.array(got), F.lit(""), lambda _, s: F.concat_ws(".", octet(F.floor(s["l"] / 256)), octet(s["l"] % 256), octet(F.floor(s["r"] / 256)), octet(s["r"] % 256)))


def _date(m: Column, key: str) -> Column:
    def within(form: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        number = F.datediff(day, F.lit("1900-01-01").cast("date"))
        u, v = SPAN
        got = feistel(F.floor(number / v), number % v, F.lit(u).cast("long"), F.lit(v).cast("long"), key, "date")
        new = F.aggregate(F.array(got), F.lit(0), lambda _, s: (s["l"] * v + s["r"]).cast("int"))
        return F.when(number.between(0, u * v - 1), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), new), form)).otherwise(m)

    return F.when(m.contains("-"), within("yyyy-MM-dd")).when(m.contains("."), within("dd.MM.yyyy")).otherwise(within("dd/MM/yyyy"))


def _hashed(value: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), value), 512)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_hashed(F.lower(m), key, "email"), 1, 15), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^((?i:password|passwd|api[_-]?key|secret|token)\s?[=:]\s?[\"']?|AKIA)", 1)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    new = F.substring(_hashed(value, key, "secret"), F.lit(1), F.length(value))
    return F.concat(name, F.when(name == "AKIA", F.upper(new)).otherwise(new))


def pseudonym(m: Column, key: str) -> Column:
    """What takes the place of one match."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    out = F.when(whole("email"), _email(m, key)).when(whole("secret"), _secret(m, key)).when(whole("phone"), _phone(m, key)).when(whole("ip"), _ip(m, key))
    out = out.when(whole("date"), _date(m, key)).when(whole("ssn"), _into(m, permute_digits(_only_digits(m), key, "ssn")))
    return out.otherwise(_card(m, key))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """The same rows with pseudonyms in their texts, and the number of values replaced."""
    # parted from the caller's columns, whose names are kept
    found_col, new_col = fresh(docs, "_found"), fresh(docs, "_new")
    found = docs.withColumn(found_col, F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0)))
    new = found.withColumn(new_col, F.when(F.size(found_col) > 0, F.transform(found_col, lambda m: pseudonym(m, key))))
    between = F.split(F.col(text_col), ANY, -1)
    joined = F.array_join(F.zip_with(between, F.concat(new_col, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    replaced = F.coalesce(F.size(F.filter(F.arrays_zip(F.col(found_col).alias("a"), F.col(new_col).alias("b")), lambda z: z["a"] != z["b"])), F.lit(0))
    counted = new.withColumn(count_col, F.when(F.size(found_col) > 0, replaced).otherwise(F.lit(0)).cast("long"))
    return counted.withColumn(text_col, F.when(F.col(count_col) > 0, joined).otherwise(F.col(text_col))).drop(found_col, new_col)
