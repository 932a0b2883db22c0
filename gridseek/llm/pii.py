"""Format-preserving pseudonyms of personal data by keyed Feistel networks, in SQL expressions.

Found are card numbers (13 to 19 digits with a valid check digit), IBANs with valid check digits, social
security numbers (ddd-dd-dddd, less those that are never given out), North American and international
telephone numbers, IPv4 and IPv6 addresses, calendar dates, e-mail addresses, and what is assigned
to a name like token or password. Each is permuted within its own kind: separators, lengths, check digits, letter case and the
calendar stay valid. A permutation depends on the key and the kind only, so equal values get equal
pseudonyms in all documents and different values of one format get different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import fresh

ROUNDS = 8
#: Kinds in the order in which they are tried at a place of the text. Repeats of groups are possessive or bounded, so that no text exhausts the stack.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: All eight groups, or three at least around a double colon.
IPV6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}"
#: Area and exchange start with 2 to 9; after +1 or in brackets also with 0 or 1.
PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}|\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
#: Country codes of one, two and three digits.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
INTERNATIONAL = rf"\+(?:{COUNTRY})(?:[ .-]?[0-9]){{6,12}}"
SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
DATE = r"(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/.])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}|(?:0[1-9]|1[0-2])([-/.])(?:1[3-9]|2[0-9]|3[01])\3(?:19|20)[0-9]{2}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: The sign before and the length are looked at first: the names before would else be tried at each place.
SECRET = r"(?<=[:=\x22' ])(?=[A-Za-z0-9+/_-]{16})(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x22']{0,1} {0,1}[:=]{1,2} {0,1}[\x22']{0,1})[A-Za-z0-9+/_-]{16,128}+"
#: What may not stand next to a value.
BEFORE, AFTER = r"(?<![A-Za-z0-9._%+@-])", r"(?![A-Za-z0-9@]|[._-][A-Za-z0-9])"
#: The first characters decide which kinds are tried.
NUMBERS = rf"(?=[0-9+(])(?:{IPV4}|{DATE}|{PHONE}|{INTERNATIONAL}|{SSN}|{CARD})"
FOUND = rf"(?:{BEFORE}(?:{NUMBERS}|(?=[A-Za-z0-9._%+-]++@){EMAIL}|(?=[A-Z]{{2}}[0-9]){IBAN}|(?=[0-9A-Fa-f]{{1,4}}:)(?:{IPV6}))|{SECRET}){AFTER}"
#: Days of the calendar that dates are permuted in: 1900-01-01 to 2099-12-31 = 229 * 319.
FIRST_DAY, DAYS = "1900-01-01", (229, 319)


def _round(key: Column, kind: str, i: int, half: Column, modulus: Column) -> Column:
    """A keyed number below modulus from one half; 60 bits of SHA-256, so that its bias is negligible."""
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), F.lit(i), half.cast("string"), modulus.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def _rounds(key: Column, kind: str, left: Column, right: Column, a: Column, b: Column, inverse: bool = False) -> Column:
    """Feistel rounds on a pair of numbers below a and b, as struct(x, y). Each round changes one of the two by a sum."""
    state = F.struct(left.alias("x"), right.alias("y"), a.alias("a"), b.alias("b"))
    steps = F.array(*[F.lit(i) for i in (range(ROUNDS) if not inverse else reversed(range(ROUNDS)))])
    sign = -1 if inverse else 1

    def step(s: Column, i: Column) -> Column:
        new_x = F.pmod(s["x"] + sign * _round(key, kind, i, s["y"], s["a"]), s["a"])
        new_y = F.pmod(s["y"] + sign * _round(key, kind, i, s["x"], s["b"]), s["b"])
        even = i % 2 == 0
        return F.struct(F.when(even, new_x).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(new_y).alias("y"), s["a"].alias("a"), s["b"].alias("b"))

    return F.aggregate(steps, state, step)


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted_digits(digits: Column, key: Column, kind: str, inverse: bool = False) -> Column:
    """A permutation of the strings of as many digits (2 to 34)."""

    def of(d: Column) -> Column:
        n = F.length(d)
        half = (n / 2).cast("int")
        a, b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), n - half).cast("long")
        out = _rounds(key, kind, F.substr(d, F.lit(1), half).cast("long"), F.substr(d, half + 1).cast("long"), a, b, inverse)
        return _once(out, lambda s: F.concat(F.lpad(s["x"].cast("string"), half, "0"), F.lpad(s["y"].cast("string"), n - half, "0")))

    return _once(digits, of)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid(pattern: Column, digits: Column) -> Column:
    """pattern with its digits replaced, in order, by those of another string of as many."""
    marks = F.split(pattern, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(marks, start, step, lambda s: s["out"])


def _check_digit(payload: Column) -> Column:
    """The digit that makes the number valid."""
    reverse = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(reverse, F.lit(0), lambda x, y: x + y), F.lit(10)).cast("string")


def _card(value: Column, key: Column, inverse: bool) -> Column:
    def of(d: Column) -> Column:
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        new = permuted_digits(payload, key, "card", inverse)
        laid = _once(new, lambda p: _laid(value, F.concat(p, _check_digit(p))))
        return F.when(F.call_function("luhn_check", d), laid).otherwise(value)

    return _once(_digits(value), of)


def _ssn(value: Column, key: Column, inverse: bool) -> Column:
    """898 areas (001 to 899 without 666), 99 groups and 9,999 serials."""

    def of(d: Column) -> Column:
        area, group, serial = (F.substr(d, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (4, 2), (6, 4)))
        left = area - 1 - (area > 666).cast("long")
        out = _rounds(key, "ssn", left, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), inverse)
        new = _once(out, lambda s: F.concat(*[F.lpad(x.cast("long").cast("string"), n, "0") for x, n in ((s["x"] + 1 + (s["x"] >= 665).cast("long"), 3), (F.floor(s["y"] / 9999) + 1, 2), (s["y"] % 9999 + 1, 4))]))
        return _once(new, lambda n: _laid(value, n))

    return _once(_digits(value), of)


def _phone(value: Column, key: Column, inverse: bool) -> Column:
    """The first digits of area and exchange stay among 2 to 9, or among 0 and 1; the rest is free. A country code stays."""

    def of(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        area, exchange = F.substr(ten, F.lit(1), F.lit(1)).cast("long"), F.substr(ten, F.lit(4), F.lit(1)).cast("long")
        low_a, low_e = (F.when(x >= 2, F.lit(2)).otherwise(F.lit(0)).cast("long") for x in (area, exchange))
        size_a, size_e = (F.when(x >= 2, F.lit(8)).otherwise(F.lit(2)).cast("long") for x in (area, exchange))
        x = ((area - low_a) * 100 + F.substr(ten, F.lit(2), F.lit(2)).cast("long")) * size_e + exchange - low_e
        out = _rounds(key, "phone", x, F.substr(ten, F.lit(5)).cast("long"), size_a * size_e * 100, F.lit(1_000_000).cast("long"), inverse)
        new = _once(out, lambda s: F.concat(F.lpad((F.floor(s["x"] / size_e) + low_a * 100).cast("string"), 3, "0"), (s["x"] % size_e + low_e).cast("string"), F.lpad(s["y"].cast("string"), 6, "0")))
        return _once(new, lambda n: _laid(value, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), n)))

    return _once(_digits(value), of)


def _international(value: Column, key: Column, inverse: bool) -> Column:
    """All digits after the country code."""
    code = F.regexp_extract(value, rf"^\+({COUNTRY})", 1)
    return _once(F.substr(_digits(value), F.length(code) + 1), lambda d: _laid(value, F.concat(code, permuted_digits(d, key, "international", inverse))))


def _shifted(value: Column, key: Column, kind: str, inverse: bool, fixed: Column | int = 0) -> Column:
    """A permutation of the strings of the same make-up of up to 128 characters: digits, a-f, A-F (in hexadecimal values) or letters stay of their class, all else stays.

    A Feistel network on the two halves of the characters; each round adds numbers made from one half to the other, each
    within its character's class. The first `fixed` characters take no part.
    """
    chars = F.split(value, "")
    hexadecimal = ~F.substr(value, F.lit(fixed) + 1).rlike("[G-Zg-z]")
    code = F.transform(chars, lambda c, i: F.when(i < fixed, F.lit(None).cast("int")).otherwise(F.ascii(c)))
    # the first code of each character's class, the size of the class, and the number within it
    low = F.transform(code, lambda c: F.when(c.between(48, 57), 48).when(c.between(65, 90), 65).when(c.between(97, 122), 97))
    size = F.transform(code, lambda c: F.when(c.between(48, 57), 10).when(c.between(65, 90) | c.between(97, 122), F.when(hexadecimal, 6).otherwise(26)))
    number = F.zip_with(code, low, lambda c, x: F.coalesce(c - x, F.lit(0)))
    half = (F.length(value) / 2).cast("int")

    def of(start: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            even = r % 2 == 0
            other = F.array_join(F.when(even, F.slice(s, half + 1, F.length(value) - half)).otherwise(F.slice(s, F.lit(1), half)).cast("array<string>"), ",")
            # what stays fixed is part of the kind
            digest = F.sha2(F.concat_ws("|", key, F.lit(kind), r, F.array_join(F.transform(size, lambda n: F.coalesce(n, F.lit(0)).cast("string")), ","), other), 512)
            return _once(digest, lambda d: F.transform(s, lambda n, i: F.when((i < half) == even, F.coalesce(F.pmod(n + (-1 if inverse else 1) * F.conv(F.substr(d, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.element_at(size, i + 1)), n)).otherwise(n)))

        return F.aggregate(F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))]), start, step)

    new = _once(number, of)
    return _once(new, lambda n: F.array_join(F.transform(chars, lambda c, i: F.coalesce(F.char(F.element_at(low, i + 1) + F.element_at(n, i + 1)), c)), ""))


def _remainder(text: Column) -> Column:
    """The number that the digits, and the letters as 10 to 35, make, modulo 97."""

    def step(rest: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return (rest * F.when(n < 10, 10).otherwise(100) + n) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(value: Column, key: Column, inverse: bool) -> Column:
    """The country stays, the account is permuted, and the check digits follow."""

    def of(v: Column) -> Column:
        country, account = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5))
        new = _shifted(account, key, "iban", inverse)
        whole = _once(new, lambda a: F.concat(country, F.lpad((98 - _remainder(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(_remainder(F.concat(account, F.substr(v, F.lit(1), F.lit(4)))) == 1, _once(whole, lambda w: _filled(value, w))).otherwise(value)

    return _once(F.replace(value, F.lit(" ")), of)


def _filled(pattern: Column, signs: Column) -> Column:
    """pattern with its characters that are no spaces replaced, in order, by those of another string of as many."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        solid = c != " "
        return F.struct(F.concat(s["out"], F.when(solid, F.substr(signs, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + solid.cast("int")).alias("at"))

    return F.aggregate(F.split(pattern, ""), start, step, lambda s: s["out"])


def _ipv4(value: Column, key: Column, inverse: bool) -> Column:
    """The four numbers as two of 65,536; each is written without leading zeros."""
    part = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))

    def of(p: Column) -> Column:
        size = F.lit(65536).cast("long")
        out = _rounds(key, "ipv4", p[0] * 256 + p[1], p[2] * 256 + p[3], size, size, inverse)
        return _once(out, lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256)]))

    return _once(part, of)


def _date(value: Column, key: Column, inverse: bool) -> Column:
    """Days from 1900 to 2099; the order of the parts and the separator stay. What is no day of the calendar stays as it is.

    Month first is only read where the day is 13 or more, and such days are permuted among themselves: a day that lands below 13
    is permuted again.
    """
    year_first = value.rlike("^[0-9]{4}")
    d = F.regexp_replace(value, "[./]", "-")
    sign = F.when(year_first, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
    month_first = ~year_first & (F.substring(value, 4, 2).cast("int") > 12)
    day = F.when(year_first, F.try_to_date(d, "yyyy-MM-dd")).when(month_first, F.try_to_date(d, "MM-dd-yyyy")).otherwise(F.try_to_date(d, "dd-MM-yyyy"))

    def at(n: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def once(n: Column) -> Column:
        a, b = (F.lit(x).cast("long") for x in DAYS)
        out = _rounds(key, "date", F.floor(n / DAYS[1]).cast("long"), n % DAYS[1], a, b, inverse)
        return _once(out, lambda s: s["x"] * DAYS[1] + s["y"])

    def of(n: Column) -> Column:
        # of all days 61 in 100 are 13 or more: 64 more steps always end
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(n), lambda x, _: F.when(month_first & (F.dayofmonth(at(x)) < 13), once(x)).otherwise(x))
        laid = lambda x: F.when(year_first, F.date_format(x, "yyyy-MM-dd")).when(month_first, F.date_format(x, "MM-dd-yyyy")).otherwise(F.date_format(x, "dd-MM-yyyy"))
        return _once(F.when(month_first, walked).otherwise(once(n)), lambda x: F.replace(laid(at(x)), F.lit("-"), sign))

    return F.coalesce(_once(F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long"), of), value)


def _email(value: Column, key: Column) -> Column:
    """A keyed name of 12 letters and digits at a reserved domain: addresses have no fixed format to permute in."""
    digest = F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(value)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@example.invalid"))


def pseudonym(value: Column, key: Column, inverse: bool = False) -> Column:
    """The pseudonym of one found value, or with inverse the value of a pseudonym (e-mail addresses stay then)."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    email = value if inverse else _email(value, key)
    return (
        F.when(whole(EMAIL), email)
        .when(whole(IPV4), _ipv4(value, key, inverse))
        .when(whole(DATE), _date(value, key, inverse))
        .when(whole(PHONE), _phone(value, key, inverse))
        .when(whole(INTERNATIONAL), _international(value, key, inverse))
        .when(whole(SSN), _ssn(value, key, inverse))
        .when(whole(CARD), _card(value, key, inverse))
        .when(whole(IBAN), _iban(value, key, inverse))
        .when(whole(IPV6), _shifted(value, key, "ipv6", inverse))
        .otherwise(_shifted(value, key, "secret", inverse))
    )


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """docs with the text's personal data replaced, and n_found: how many values were replaced.

    A null text stays null with n_found 0. Texts are cut at the found values and put together again, so
    that all else stays byte by byte. All columns of docs stay; one named n_found gets the new value.
    Repeated rows give repeated results, and a value has one pseudonym wherever it stands. Secrets are found up to 128 characters.
    The key is the one value of a table of one row, so that plans and logs don't show it.
    """
    own = F.col("text")
    some = F.coalesce(own.rlike("[0-9@]|(?i:token|secret|passw|key)"), F.lit(False))  # other texts can't hold anything
    none = F.array().cast("array<string>")
    found_, new_, key_ = fresh(docs, "found", "new", "key")
    secret = docs.sparkSession.createDataFrame([(key,)], f"{key_} string")
    found = docs.withColumn(key_, secret.scalar()).withColumn(found_, F.when(some, F.regexp_extract_all(own, F.lit(FOUND), F.lit(0))).otherwise(none))
    held = F.size(found_) > 0
    new = found.withColumn(new_, F.when(held, F.transform(found_, lambda v: pseudonym(v, F.col(key_)))).otherwise(none))
    joined = F.array_join(F.zip_with(F.split(own, FOUND, -1), F.col(new_), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(found_, new_, lambda x, y: x != y), lambda x: x))
    return new.withColumns({"n_found": changed, "text": F.when(held, joined).otherwise(own)}).drop(found_, new_, key_)
