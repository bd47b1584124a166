"""Op 7: format-preserving pseudonyms for personal data, with DataFrame and SQL functions only.

Values are found by pattern and validated: card numbers by their check digit, addresses by the range of their parts, social
security numbers by their reserved ranges, IBANs by their remainder, dates by the calendar, phone numbers and e-mail
addresses by their form, secret keys as runs of 32 or more hexadecimal digits in either case. What is valid is put through a keyed Feistel
network over just the values of its format, so the result is valid in the same format (check digits are made anew),
different values stay different, and a value that occurs in many documents gets the same pseudonym in all of them.
Everything else in a text stays as it is, numbers that aren't valid included.

Null texts stay null, empty texts empty; neither has a replacement. Repeated rows get the same result. Dates are permuted
within the 400 years from 1800 on (others stay); a date with slashes is month first where that is valid, else day first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import fresh

ROUNDS = 8
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: What may be personal, in the order in which patterns are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,}" + _AFTER,
    "secret": _BEFORE + r"[0-9A-Fa-f]{32,}+" + _AFTER,
    "iban": _BEFORE + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + _AFTER,
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}" + _AFTER + r"|(?<![\p{L}\p{N}_.-])\+[0-9]{1,3}[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _AFTER + r"|(?<![\p{L}\p{N}_.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}" + _AFTER,
    "ssn": r"(?<![\p{L}\p{N}_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])",
    "date": r"(?<![\p{L}\p{N}_-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\p{N}_-])|(?<![\p{L}\p{N}_/.])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}" + _AFTER,
    "ip": r"(?<![\p{L}\p{N}_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[\p{L}\p{N}_])",
    "card": _BEFORE + r"[0-9](?:[ -]?[0-9]){12,18}" + _AFTER,
}
ANY = "|".join(PATTERNS.values())


def _round(key: Column, kind: str, r: Column, other: Column) -> Column:
    """Pseudo-random hexadecimal digits from the key, the format, the round and the other half."""
    return F.sha2(F.concat_ws(":", key, F.lit(kind), r.cast("string"), other.cast("string")), 256)


def _number(digits: Column) -> Column:
    """The first 15 hexadecimal digits as a number."""
    return F.conv(F.substring(digits, 1, 15), 16, 10).cast("bigint")


def feistel(key: Column, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Keyed permutation of pairs (left below a, right below b)."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(s, i):
        even = F.struct(F.pmod(s["l"] + F.pmod(_number(_round(key, kind, i, s["r"])), a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_number(_round(key, kind, i, s["l"])), b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def digits(key: Column, kind: str, s: Column) -> Column:
    """Keyed permutation of the digit strings of one length (2 to 36)."""
    n = F.length(s)
    h = F.floor(n / 2).cast("int")
    tweak = F.concat_ws("/", key, n.cast("string"))
    out = feistel(tweak, kind, F.substr(s, F.lit(1), h), F.substr(s, h + 1), _power(h), _power(n - h))
    return F.aggregate(F.array(out), F.lit(""), lambda acc, x: F.concat(acc, F.lpad(x["l"].cast("string"), h, "0"), F.lpad(x["r"].cast("string"), n - h, "0")))


def letters(key: Column, kind: str, s: Column, hexadecimal: bool = False, most: int = 26) -> Column:
    """Keyed permutation of strings that keeps the class of every character: digits, small and capital ASCII letters, the
    first `most` of the alphabet (or small hexadecimal digits); other characters stay."""
    h = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), h).alias("l"), F.substr(s, h + 1).alias("r"))

    def moved(text: Column, by: Column) -> Column:
        def one(c, i):
            k = F.conv(F.substr(by, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int")
            if hexadecimal:
                return F.substr(F.lit("0123456789abcdef"), F.pmod(F.instr(F.lit("0123456789abcdef"), c) - 1 + k, F.lit(16)) + 1, F.lit(1))
            code = F.ascii(c)
            of = lambda first, n: F.char(F.pmod(code - first + k, F.lit(n)) + first)
            return F.when(c.rlike("^[a-z]$"), of(97, most)).when(c.rlike("^[A-Z]$"), of(65, most)).when(c.rlike("^[0-9]$"), of(48, 10)).otherwise(c)

        return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))

    def step(x, i):
        even = F.struct(moved(x["l"], _round(key, kind, i, x["r"])).alias("l"), x["r"].alias("r"))
        odd = F.struct(x["l"].alias("l"), moved(x["r"], _round(key, kind, i, x["l"])).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["l"], x["r"]))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refilled(form: Column, new: Column) -> Column:
    """form with its digits replaced by those of new, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(x, c):
        return F.when(c.rlike("^[0-9]$"), F.struct(F.concat(x["s"], F.substr(new, x["i"], F.lit(1))).alias("s"), (x["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(x["s"], c).alias("s"), x["i"].alias("i")))

    return F.aggregate(F.split(form, ""), start, step, lambda x: x["s"])


def luhn(s: Column) -> Column:
    """Luhn sum modulo 10 of a digit string, its last digit counted once."""
    each = F.transform(F.split(F.reverse(s), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _card(key: Column, v: Column) -> Column:
    def made(d):
        body = digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1))
        return _let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))

    return _let(_only_digits(v), lambda d: F.when((luhn(d) == 0) & d.rlike("[1-9]"), _refilled(v, made(d))).otherwise(v))


def _phone(key: Column, v: Column) -> Column:
    return _let(_only_digits(v), lambda d: _refilled(v, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), digits(key, "phone", F.right(d, F.lit(10))))))


def _ip(key: Column, v: Column) -> Column:
    part = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))

    def made(p):
        out = feistel(key, "ip", p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536))
        return _let(out, lambda x: F.concat_ws(".", *[y.cast("string") for h in ("l", "r") for y in (F.floor(x[h] / 256), x[h] % 256)]))

    return _let(part, lambda p: F.when(F.forall(p, lambda x: x < 256), made(p)).otherwise(v))


def _ssn(key: Column, v: Column) -> Column:
    part = F.transform(F.split(v, "-"), lambda x: x.cast("int"))
    sound = lambda p: (p[0] > 0) & (p[0] != 666) & (p[0] < 900) & (p[1] > 0) & (p[2] > 0)

    def made(p):
        area = p[0] - 1 - F.when(p[0] > 666, 1).otherwise(0)
        out = feistel(key, "ssn", area * 99 + p[1] - 1, p[2] - 1, F.lit(898 * 99), F.lit(9999))

        def text(x):
            a = F.floor(x["l"] / 99) + 1
            return F.concat_ws("-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

        return _let(out, text)

    return _let(part, lambda p: F.when(sound(p), made(p)).otherwise(v))


def _date(key: Column, v: Column) -> Column:
    """400 years have 146097 days, 189 times 773."""
    first = F.lit("1800-01-01").cast("date")
    y, m, d = F.substr(v, F.lit(7), F.lit(4)), F.substr(v, F.lit(4), F.lit(2)), F.substr(v, F.lit(1), F.lit(2))
    day = lambda y, m, d: F.expr("try_cast(null as date)") if y is None else F.concat_ws("-", y, m, d).try_cast("date")
    iso, slash = v.contains("-"), v.contains("/")
    read = F.when(iso, v.try_cast("date")).when(slash, F.coalesce(day(y, d, m), day(y, m, d))).otherwise(day(y, m, d))
    form = F.when(iso, F.lit("yyyy-MM-dd")).when(slash & day(y, d, m).isNotNull(), F.lit("MM/dd/yyyy")).when(slash, F.lit("dd/MM/yyyy")).otherwise(F.lit("dd.MM.yyyy"))

    def made(n):
        out = feistel(key, "date", F.floor(n / 773), n % 773, F.lit(189), F.lit(773))
        return _let(out, lambda x: F.date_add(first, (x["l"] * 773 + x["r"]).cast("int")))

    shown = lambda t: F.when(form == "yyyy-MM-dd", F.date_format(t, "yyyy-MM-dd")).when(form == "MM/dd/yyyy", F.date_format(t, "MM/dd/yyyy")).when(form == "dd/MM/yyyy", F.date_format(t, "dd/MM/yyyy")).otherwise(F.date_format(t, "dd.MM.yyyy"))
    return _let(F.date_diff(read, first), lambda n: F.when(n.between(0, 146096), shown(made(n))).otherwise(v))


def remainder97(s: Column) -> Column:
    """Remainder of an IBAN, read with its first four characters last and letters as 10 to 35."""
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _iban(key: Column, v: Column) -> Column:
    land, account = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5))
    new = _let(_only_digits(account), lambda d: F.when(F.length(d) < 2, account).otherwise(_refilled(account, digits(key, "iban", d))))
    made = _let(new, lambda b: F.concat(land, F.lpad((98 - remainder97(F.concat(land, F.lit("00"), b))).cast("string"), 2, "0"), b))
    return F.when(remainder97(v) == 1, made).otherwise(v)


def _email(key: Column, v: Column) -> Column:
    at = F.instr(v, "@")
    return F.concat(letters(key, "email", F.substr(v, F.lit(1), at - 1)), F.substr(v, at))


def _secret(key: Column, v: Column) -> Column:
    """A key in capitals goes the way of the same key in small letters; one in both cases keeps the class of every digit."""
    small = lambda x: letters(key, "secret", x, hexadecimal=True)
    return F.when(v == F.lower(v), small(v)).when(v == F.upper(v), F.upper(small(F.lower(v)))).otherwise(letters(key, "secret", v, most=6))


def pseudonym(key: Column, v: Column) -> Column:
    """The pseudonym of a value that ANY matches; the value itself if it isn't valid."""
    whole = lambda kind: v.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(v.contains("@"), _email(key, v))
        .when(whole("secret"), _secret(key, v))
        .when(whole("iban"), _iban(key, v))
        .when(whole("phone"), _phone(key, v))
        .when(whole("ssn"), _ssn(key, v))
        .when(whole("date"), _date(key, v))
        .when(whole("ip"), _ip(key, v))
        .when(whole("card"), _card(key, v))
        .otherwise(v)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text column rewritten, and n_replaced: how many values changed. A column n_replaced of docs is replaced;
    other columns pass through, whatever their names."""
    text, any_ = F.col(text_col), F.lit(ANY)
    found = F.when(text.rlike("[0-9@]|[A-Fa-f]{32}"), F.regexp_extract_all(text, any_, F.lit(0))).otherwise(F.array().cast("array<string>"))
    old, new = fresh(docs, "found"), fresh(docs, "new")
    rows = docs.withColumn(old, F.coalesce(found, F.array().cast("array<string>")))
    rows = rows.withColumn(new, F.transform(old, lambda v: pseudonym(F.lit(key), v)))
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(new, i), F.lit("")))), "")
    changed = F.size(F.filter(F.arrays_zip(old, new), lambda x: x[old] != x[new]))
    rows = rows.withColumn("n_replaced", changed).withColumn(text_col, F.when(F.size(old) == 0, text).otherwise(joined))
    return rows.drop(old, new)
