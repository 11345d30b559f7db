"""Format-preserving pseudonyms for personal numbers, dates and mail names, in DataFrame functions.

Each validated value is permuted within its own format by a keyed Feistel
network over Z_a x Z_b with alternating modular additions, which is a
bijection, so equal values get equal pseudonyms in every document and unlike
values never share one.  Round values come from SHA-256 over the key.

- cards: 12 to 19 digits with a right Luhn digit; all but the last are permuted and the last is computed anew.
  In digit groups parted by single spaces or hyphens every stretch of whole groups is tried: usual groupings
  first, then the leftmost, then the longest, so that a number is found next to an expiry date or a code;
- dates: yyyy-mm-dd or dd/mm/yyyy of 1800 to 2199, permuted among the days of these 400 years (189 x 773);
- addresses a.b.c.d with parts of 0 to 255, permuted as 32-bit numbers;
- telephone numbers, permuted as digits: ten digits grouped 3-3-4 by spaces, dots, hyphens or brackets, with or
  without 1 or +1, which stays; others as + and 8 to 15 digits in groups, the first two digits stay;
- social security numbers ddd-dd-dddd with an area of 001 to 899 other than 666 and no part of zeros only, permuted
  among these numbers (898 areas x 99 groups of 9,999);
- mail names, permuted as base-36 numbers of up to 24 letters and digits; the domain stays.

Separators and lengths stay.  Values that fail validation stay as they are.

Defined results: null texts stay null with zero counts; texts without values are
unchanged; equal rows get equal results; overlapping values can't arise, as the
leftmost match wins; very long texts are read whole; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
_TEN = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_ABROAD = r"\+(?=[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![ .()-]{0,2}[0-9]))[0-9]{1,4}+(?:[ .-]?\([0-9]{1,4}\))?+(?:[ .-]?[0-9]{1,14}+)*+"
PHONE = rf"(?<![0-9+])(?:(?:\+?1[ .-]?)?{_TEN}|{_ABROAD}|\+1[0-9]{{10}})(?![0-9]|[.-][0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Groups of 12 digits or more in all; a group that begins another value or runs into letters isn't one of them.
CARD = rf"(?<![0-9a-zA-Z])(?=[0-9](?:[ -]?[0-9]){{11}})[0-9]++(?![a-zA-Z])(?:[ -](?!{DATE}|{PHONE}|{ADDRESS}|{SOCIAL}|{EMAIL})[0-9]++(?![a-zA-Z]))*+"
#: Sizes of groups in which cards are usually written.
USUAL = ("4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3", *map(str, range(12, 20)))
PATTERN = "|".join((EMAIL, DATE, PHONE, ADDRESS, SOCIAL, CARD))
ROUNDS = 8
KINDS = ("card", "date", "address", "phone", "social", "email")
#: Days from 1800-01-01 on: 400 years, 189 x 773.
FIRST_DAY, LEFT_DAYS, RIGHT_DAYS = "1800-01-01", 189, 773
#: Areas of social security numbers: 001 to 899 without 666.
AREAS = 898


def _round(key: str, kind: str, size: Column, r: Column, half: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), size, r, half), 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, size: Column, back: bool = False) -> Column:
    """struct(l, r): the keyed permutation of (left, right) in Z_a x Z_b, or its inverse."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if back else 1

    def step(s: Column, i: Column) -> Column:
        on_left = i % 2 == 0
        return F.struct(
            F.when(on_left, F.pmod(s["l"] + sign * F.pmod(_round(key, kind, size, i, s["r"]), a), a)).otherwise(s["l"]).alias("l"),
            F.when(on_left, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(_round(key, kind, size, i, s["l"]), b), b)).alias("r"),
        )

    return F.aggregate(rounds, F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def _power(base: int, n: Column) -> Column:
    """base ** n as a bigint, from a table."""
    top = {10: 10, 36: 12}[base]
    return F.element_at(F.array(*(F.lit(base**i).cast("bigint") for i in range(top + 1))), n + 1)


def permuted(text: Column, base: int, key: str, kind: str, back: bool = False) -> Column:
    """A string of up to 20 digits (24 of base 36) permuted among the strings of its length."""
    n = F.char_length(text)
    a = F.floor(n / 2).cast("int")
    read = lambda x: F.conv(F.concat(F.lit("0"), x), base, 10).cast("bigint")
    done = feistel(read(F.substr(text, F.lit(1), a)), read(F.substr(text, a + 1, n - a)), _power(base, a), _power(base, n - a), key, kind, n, back)
    show = lambda x, k: F.substr(F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), 20, "0"), F.lit(21) - k, k)
    return F.element_at(F.transform(F.array(done), lambda s: F.concat(show(s["l"], a), show(s["r"], n - a))), 1)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    n = F.char_length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substr(digits, i, F.lit(1)).cast("int").alias("d"), ((n - i) % 2).alias("odd")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x["odd"] == 1, x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"]))


def refilled(value: Column, letters: Column, is_letter: str) -> Column:
    """value with its characters of a class replaced in order by those of letters."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(is_letter)
        return F.struct(F.concat(s["out"], F.when(hit, F.substr(letters, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + hit.cast("int")).alias("at"))

    return F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])


def _new_card(digits: Column, key: str) -> Column:
    body = permuted(F.substr(digits, F.lit(1), F.char_length(digits) - 1), 10, key, "card")
    return F.element_at(F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))), 1)


def _card_places(groups: Column) -> Column:
    """Array of (i, j): cards made of the digit groups i to j, in order of preference and without overlap."""
    m = F.size(groups)

    def stretch(i: Column, j: Column) -> Column:
        part = F.slice(groups, i, j - i + 1)
        return F.struct(i.alias("i"), j.alias("j"), F.array_join(part, "").alias("digits"), F.array_join(F.transform(part, lambda g: F.char_length(g).cast("string")), "-").alias("sizes"))

    every = F.flatten(F.transform(F.sequence(F.lit(1), m), lambda i: F.transform(F.sequence(i, F.least(i + 18, m)), lambda j: stretch(i, j))))
    good = F.filter(every, lambda x: F.when(F.char_length(x["digits"]).between(12, 19), luhn_sum(x["digits"]) % 10 == 0).otherwise(False))
    ranked = F.array_sort(F.transform(good, lambda x: F.struct((~x["sizes"].isin(*USUAL)).alias("odd"), x["i"].alias("i"), (-x["j"]).alias("j"))))

    def take(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda y: (y["i"] <= -x["j"]) & (y["j"] >= x["i"]))
        return F.when(free, F.concat(acc, F.array(F.struct(x["i"].alias("i"), (-x["j"]).alias("j"))))).otherwise(acc)

    return F.aggregate(ranked, F.array().cast("array<struct<i:int,j:int>>"), take)


def _cards(x: Column, key: str) -> Column:
    """struct(out, n): digit groups with the n cards in them replaced; out is null where there is none."""

    def filled(s: Column) -> Column:
        def piece(k: Column) -> Column:
            own = F.filter(s["places"], lambda p: (p["i"] <= k) & (p["j"] >= k))
            digits = F.array_join(F.slice(s["groups"], own[0]["i"], own[0]["j"] - own[0]["i"] + 1), "")
            return F.when(F.size(own) == 0, F.element_at(s["groups"], k)).when(own[0]["i"] == k, _new_card(digits, key)).otherwise("")

        digits = F.array_join(F.transform(F.sequence(F.lit(1), F.size(s["groups"])), piece), "")
        return F.struct(F.when(F.size(s["places"]) > 0, F.element_at(F.transform(F.array(digits), lambda d: refilled(x, d, "[0-9]")), 1)).alias("out"), F.size(s["places"]).alias("n"))

    groups = F.split(x, "[ -]")
    return F.element_at(F.transform(F.transform(F.array(groups), lambda g: F.struct(g.alias("groups"), _card_places(g).alias("places"))), filled), 1)


def _date(x: Column, key: str) -> Column:
    iso = x.rlike("^[0-9]{4}-")
    day = F.when(iso, F.try_to_date(x, "yyyy-MM-dd")).otherwise(F.try_to_date(x, "dd/MM/yyyy"))
    number = F.datediff(day, F.to_date(F.lit(FIRST_DAY)))
    ok = (number >= 0) & (number < LEFT_DAYS * RIGHT_DAYS)
    done = feistel(F.floor(number / RIGHT_DAYS), number % RIGHT_DAYS, F.lit(LEFT_DAYS), F.lit(RIGHT_DAYS), key, "date", F.lit(0))
    other = F.element_at(F.transform(F.array(done), lambda s: F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["l"] * RIGHT_DAYS + s["r"]).cast("int"))), 1)
    return F.when(ok, F.element_at(F.transform(F.array(other), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))), 1))


def _address(x: Column, key: str) -> Column:
    part = F.transform(F.split(x, r"\."), lambda p: p.cast("bigint"))
    at = lambda i: F.element_at(part, i)
    ok = F.forall(part, lambda p: p <= 255)
    done = feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536), F.lit(65536), key, "address", F.lit(0))
    show = lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)
    return F.when(ok, F.element_at(F.transform(F.array(done), show), 1))


def _digits(x: Column, stay: Column, key: str, kind: str) -> Column:
    """Digits permuted but for the first few, which stay."""
    every = F.regexp_replace(x, "[^0-9]", "")
    digits = F.concat(F.substr(every, F.lit(1), stay), permuted(F.substr(every, stay + 1), 10, key, kind))
    return F.element_at(F.transform(F.array(digits), lambda d: refilled(x, d, "[0-9]")), 1)


def _phone(x: Column, key: str) -> Column:
    """Ten digits that are written with and without 1 or +1 get the same ten digits."""
    n = F.char_length(F.regexp_replace(x, "[^0-9]", ""))
    return _digits(x, F.when(x.rlike("^[+][^1]"), 2).otherwise(F.when((n == 10) & ~x.rlike("^[+]"), 0).otherwise(1)), key, "phone")


def _email(x: Column, key: str) -> Column:
    name, domain = F.lower(F.substring_index(x, "@", 1)), F.substring_index(x, "@", -1)
    plain = F.regexp_replace(name, "[^a-z0-9]", "")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.char_length(plain) - 1) / 24).cast("int")), lambda i: permuted(F.substr(plain, i * 24 + 1, F.lit(24)), 36, key, "email"))
    return F.when(plain != "", F.concat(F.element_at(F.transform(F.array(F.array_join(pieces, "")), lambda p: refilled(name, p, "[a-z0-9]")), 1), F.lit("@"), domain))


def _social(x: Column, key: str) -> Column:
    part = F.transform(F.split(x, "-"), lambda p: p.cast("bigint"))
    area, group, serial = (F.element_at(part, i) for i in (1, 2, 3))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    done = feistel(F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, F.lit(AREAS), F.lit(99 * 9999), key, "social", F.lit(0))
    show = lambda s: F.format_string("%03d-%02d-%04d", s["l"] + F.when(s["l"] < 665, 1).otherwise(2), F.floor(s["r"] / 9999) + 1, s["r"] % 9999 + 1)
    return F.when(ok, F.element_at(F.transform(F.array(done), show), 1))


def kind_of(x: Column) -> Column:
    return (
        F.when(F.contains(x, F.lit("@")), "email")
        .when(x.rlike(rf"^[+]|^(1[ .-]?)?{_TEN}$"), "phone")
        .when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|/"), "date")
        .when(F.contains(x, F.lit(".")), "address")
        .when(x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social")
        .otherwise("card")
    )


def pseudonym(x: Column, key: str) -> Column:
    """struct(kind, value, out, n) of a found value; out is null where validation fails, n counts the values replaced."""
    kind = kind_of(x)
    out = (
        F.when(kind == "email", _email(x, key)).when(kind == "phone", _phone(x, key)).when(kind == "date", _date(x, key))
        .when(kind == "address", _address(x, key)).when(kind == "social", _social(x, key))
    )
    done = F.when(kind == "card", _cards(x, key)).otherwise(F.struct(out.alias("out"), F.lit(1).alias("n")))
    return F.element_at(F.transform(F.array(done), lambda d: F.struct(kind.alias("kind"), x.alias("value"), d["out"].alias("out"), d["n"].alias("n"))), 1)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """key: a secret of the caller's; who knows it can undo the permutations.

    Per document: doc_id, the number of replaced values of each kind, and text with them replaced."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = F.col("text").rlike("[0-9]{3}|@|[0-9][. -][0-9]|[+][0-9]")
    found = rows.withColumn("found", F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    found = found.withColumn("found", F.when(F.size("found") > 0, F.col("found")))
    made = found.withColumn("made", F.transform("found", lambda x: pseudonym(x, key)))
    parts = F.when(F.col("made").isNotNull(), F.split("text", PATTERN, -1))
    put = F.zip_with(parts, "made", lambda p, m: F.concat(p, F.coalesce(m["out"], m["value"], F.lit(""))))
    kinds = F.coalesce(F.flatten(F.transform(F.filter("made", lambda m: m["out"].isNotNull()), lambda m: F.array_repeat(m["kind"], m["n"]))), F.array().cast("array<string>"))
    counts = [F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return made.withColumn("kinds", kinds).select("doc_id", *counts, F.coalesce(F.array_join(put, ""), F.col("text")).alias("text"))
