"""Format-preserving pseudonyms of personal data, by keyed Feistel networks, in DataFrame functions alone.

Values are found by pattern and validated (check sums, calendar, number plans). Each is replaced by a keyed
permutation of the values of its own format: card numbers become card numbers with a right check digit, dates
become dates. Equal values get equal pseudonyms in every document, different values different ones, and who holds
the key can turn them back with reveal=True.

No shuffle and no state: a document is one row of one projection, whatever the corpus's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the networks; an even number, so that both halves are changed alike.
ROUNDS = 8

#: What is looked for, in order of precedence; a value must also pass its check in _pseudonym(). Starts are looked
#: for at the beginning of a run of the value's own characters only, so that long runs are passed once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "password": r"(?<![A-Za-z])(?i:password|passwd|pwd)(?-i) ?[=:] ?[^\s\"',;]{3,}[A-Za-z0-9]",
    "token": r"(?<![A-Za-z])(?i:token|secret|api_?key)(?-i) ?[=:] ?(?:\"[A-Za-z0-9+/_\-]{16,}+\"|'[A-Za-z0-9+/_\-]{16,}+'|(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?!(?!T[0-9]{2}:[0-9]{2})[0-9A-Za-z/\-]|\.[0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\- ])[0-9]{3}[.\- ][0-9]{4}(?![0-9A-Za-z]|[.\-][0-9])",
    "abroad": r"(?<![0-9A-Za-z+])\+[2-9][0-9]{0,2}(?:(?:[ .\-]?[0-9]{1,2}){5}|(?:[ .\-]?\(?[0-9]{1,4}\)?){2,3})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z]|-[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Any value holds one of these; documents without are passed over quickly.
HINT = r"[0-9][^A-Za-z]{0,3}[0-9]|@|AKIA|(?i:password|passwd|pwd|token|secret|api_?key) ?[=:]"
#: Days of the Gregorian calendar's cycle of 400 years, 189 x 773, from this date on.
CYCLE, FIRST_DAY = (189, 773), "1800-01-01"
#: The last day that may be a month too, and the most steps of a walk over days.
TWELVE, STEPS = 12, 100


def _mac(key: str, *parts: Column, bits: int = 256) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *(p.cast("string") for p in parts), F.lit(key)), bits)


def _number(hexadecimal: Column, at: Column | int, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, at, digits), 16, 10).cast("long")


def _rounds(reveal: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reveal else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def feistel(key: str, kind: str, left: Column, a: int, right: Column, b: int, reveal: bool) -> Column:
    """A keyed permutation of pairs (left below a, right below b): a struct l, r. A pair stands for one number of a
    range of a times b, so ranges of any such size are permuted exactly."""
    sign = -1 if reveal else 1

    def step(s: Column, i: Column) -> Column:
        new_l = F.pmod(s["l"] + sign * F.pmod(_number(_mac(key, F.lit(kind), i, s["r"]), 1, 14), F.lit(a)), F.lit(a))
        new_r = F.pmod(s["r"] + sign * F.pmod(_number(_mac(key, F.lit(kind), i, s["l"]), 1, 14), F.lit(b)), F.lit(b))
        return F.struct(F.when(i % 2 == 0, new_l).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, new_r).otherwise(s["r"]).alias("r"))

    return F.aggregate(_rounds(reveal), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def feistel_text(key: str, kind: str, text: Column, reveal: bool, letters: int = 26) -> Column:
    """A keyed permutation of the texts of one shape: a digit stays a digit, a small letter a small letter, a capital
    a capital, and all else stays as it is. With letters=6 those are the digits of hexadecimal numbers."""
    sign = -1 if reveal else 1
    half = F.floor(F.length(text) / 2).cast("int")

    def turned(part: Column, stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            code, by = F.ascii(c), sign * _number(stream, F.pmod(i, F.lit(32)) * 4 + 1, 4)
            turn = lambda first, n: F.char((F.pmod(code - first + by, F.lit(n)) + first).cast("long"))
            return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, letters)).when(c.between("A", "Z"), turn(65, letters)).otherwise(c)

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def step(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]  # noqa: E741
        return F.struct(F.when(i % 2 == 0, turned(l, _mac(key, F.lit(kind), i, r, bits=512))).otherwise(l).alias("l"), F.when(i % 2 == 1, turned(r, _mac(key, F.lit(kind), i, l, bits=512))).otherwise(r).alias("r"))

    state = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return F.transform(F.array(F.aggregate(_rounds(reveal), state, step)), lambda s: F.concat(s["l"], s["r"]))[0]


def _with(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def luhn_sum(digits: Column) -> Column:
    """Of a number whose last digit counts once."""
    n = F.length(digits)

    def one(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), one)


def _refilled(shape: Column, digits: Column) -> Column:
    """The shape with its digits, in order, replaced by others."""

    def one(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["text"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("text"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), one, lambda s: s["text"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _card(key: str, m: Column, reveal: bool) -> Column:
    def of(d: Column) -> Column:
        body = feistel_text(key, "card", F.substring(d, F.lit(1), F.length(d) - 1), reveal)
        closed = _with(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _refilled(m, closed)).otherwise(m)

    return _with(_digits(m), of)


def _phone(key: str, m: Column, reveal: bool) -> Column:
    """North American numbers: area and exchange begin with 2 to 9. 8 x 100 x 8 x 100 x 10,000 is 80,000 x 80,000."""

    def of(d: Column) -> Column:
        area, exchange, line = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
        joined = ((area - 200) * 800 + (exchange - 200)) * 10_000 + line
        pair = feistel(key, "phone", F.floor(joined / 80_000), 80_000, F.pmod(joined, F.lit(80_000)), 80_000, reveal)

        def back(p: Column) -> Column:
            n = p["l"] * 80_000 + p["r"]
            top = F.floor(n / 10_000).cast("long")
            return F.concat((F.floor(top / 800).cast("long") + 200).cast("string"), (F.pmod(top, F.lit(800)) + 200).cast("string"), _padded(F.pmod(n, F.lit(10_000)), 4))

        country = F.when(m.startswith("+1"), F.lit("1")).otherwise(F.lit(""))
        return F.when((area >= 200) & (exchange >= 200), _refilled(m, F.concat(country, _with(pair, back)))).otherwise(m)

    return _with(F.regexp_replace(_digits(m), "^1(?=[0-9]{10}$)", ""), of)


def _abroad(key: str, m: Column, reveal: bool) -> Column:
    """The country's code stays: the first two digits, more or less than it may have."""

    def of(d: Column) -> Column:
        new = F.concat(F.substring(d, 1, 2), feistel_text(key, "abroad", F.substring(d, F.lit(3), F.length(d)), reveal))
        return F.when(F.length(d).between(8, 15), _refilled(m, new)).otherwise(m)

    return _with(_digits(m), of)


def _ssn(key: str, m: Column, reveal: bool) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999: 898 x 99 by 9999."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(key, "ssn", (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, 898 * 99, serial - 1, 9999, reveal)

    def back(p: Column) -> Column:
        new = F.floor(p["l"] / 99).cast("long") + 1
        return F.concat_ws("-", _padded(new + F.when(new > 665, 1).otherwise(0), 3), _padded(F.pmod(p["l"], F.lit(99)) + 1, 2), _padded(p["r"] + 1, 4))

    return F.when(valid, _with(pair, back)).otherwise(m)


def _ip(key: str, m: Column, reveal: bool) -> Column:
    def of(o: Column) -> Column:
        valid = F.forall(o, lambda x: (x.cast("int") <= 255) & (x.cast("int").cast("string") == x))
        pair = feistel(key, "ip", o[0].cast("long") * 256 + o[1].cast("long"), 65_536, o[2].cast("long") * 256 + o[3].cast("long"), 65_536, reveal)
        back = lambda p: F.concat_ws(".", *(x.cast("string") for s in ("l", "r") for x in (F.shiftright(p[s], 8), F.pmod(p[s], F.lit(256)))))
        return F.when(valid, _with(pair, back)).otherwise(m)

    return _with(F.split(m, r"\."), of)


def _date(key: str, m: Column, reveal: bool) -> Column:
    """yyyy-mm-dd, dd.mm.yyyy, and with slashes month/day/year if that is a date, else day/month/year. Dates from 1800
    to 2199 are permuted among themselves, whatever their form, and written in the form found; others stay.

    So that day/month/year stays apart from month/day/year, days up to 12 of a month are permuted among those and
    later ones among later ones: the permutation of all days is applied again until one of the same class comes
    (at least two in five do, so that STEPS steps end every walk in practice)."""
    first = F.lit(FIRST_DAY).cast("date")
    late = lambda day: F.dayofmonth(F.date_add(first, day.cast("int"))) > TWELVE

    def once(day: Column) -> Column:
        pair = feistel(key, "date", F.floor(day / CYCLE[1]), CYCLE[0], F.pmod(day, F.lit(CYCLE[1])), CYCLE[1], reveal)
        return _with(pair, lambda p: p["l"] * CYCLE[1] + p["r"])

    def walked(day: Column) -> Column:
        start = F.struct(once(day).alias("at"), late(day).alias("late"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: F.struct(F.when(late(s["at"]) == s["late"], s["at"]).otherwise(once(s["at"])).alias("at"), s["late"].alias("late")), lambda s: s["at"])

    parsed = {form: F.try_to_date(m, form) for form in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")}
    form = F.when(F.substring(m, 5, 1) == "-", F.lit("yyyy-MM-dd")).when(F.substring(m, 3, 1) == ".", F.lit("dd.MM.yyyy")).when(parsed["MM/dd/yyyy"].isNotNull(), F.lit("MM/dd/yyyy")).otherwise(F.lit("dd/MM/yyyy"))
    found = F.when(F.substring(m, 5, 1) == "-", parsed["yyyy-MM-dd"]).when(F.substring(m, 3, 1) == ".", parsed["dd.MM.yyyy"]).otherwise(F.coalesce(parsed["MM/dd/yyyy"], parsed["dd/MM/yyyy"]))

    def moved(d: Column) -> Column:
        def shown(n: Column) -> Column:
            return F.coalesce(*(F.when(d["form"] == f, F.date_format(F.date_add(first, n.cast("int")), f)) for f in parsed))

        return F.when(d["day"].between(0, CYCLE[0] * CYCLE[1] - 1), _with(walked(d["day"].cast("long")), shown))

    return F.coalesce(_with(F.struct(F.datediff(found, first).alias("day"), form.alias("form")), moved), m)


def _mod97(text: Column) -> Column:
    def one(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), one)


def _iban(key: str, m: Column, reveal: bool) -> Column:
    """The country stays, the account is permuted within its shape and the check digits follow."""

    def of(c: Column) -> Column:
        country, account = F.substring(c, 1, 2), F.substring(c, F.lit(5), F.length(c))

        def closed(b: Column) -> Column:
            return F.concat(country, _padded(F.lit(98) - _mod97(F.concat(b, country, F.lit("00"))), 2), b)

        new = _with(feistel_text(key, "iban", account, reveal), closed)
        valid = (_mod97(F.concat(account, F.substring(c, 1, 4))) == 1) & F.substring(c, 3, 2).between("02", "98")
        spaced = F.when(m.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
        return F.when(valid & (F.regexp_replace(m, " ", "") == c), spaced).otherwise(m)

    return _with(F.regexp_replace(m, " ", ""), of)


def _email(key: str, m: Column, reveal: bool) -> Column:
    """The domain stays; the permutation is one for each domain."""
    at = F.instr(m, "@")
    return F.concat(feistel_text(key, "email", F.substring(m, F.lit(1), at - 1), reveal), F.substring(m, at, F.length(m)))


def _after(key: str, kind: str, m: Column, head: str, reveal: bool) -> Column:
    """What follows a name stays in its shape, hexadecimal numbers as such."""
    name = F.regexp_extract(m, head, 0)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    hexadecimal = value.rlike("^[0-9a-f]+[\"']?$")
    return F.concat(name, F.when(hexadecimal, feistel_text(key, kind + "16", value, reveal, 6)).otherwise(feistel_text(key, kind, value, reveal)))


def _pseudonym(key: str, m: Column, reveal: bool) -> Column:
    is_a = lambda kind: m.rlike("^(?:" + PATTERNS[kind] + ")$")
    return (
        F.when(is_a("email"), _email(key, m, reveal))
        .when(is_a("secret"), F.concat(F.lit("AKIA"), feistel_text(key, "secret", F.substring(m, 5, 16), reveal)))
        .when(is_a("password"), _after(key, "password", m, "^[A-Za-z]+ ?[=:] ?", reveal))
        .when(is_a("token"), _after(key, "token", m, "^[A-Za-z_]+ ?[=:] ?[\"']?", reveal))
        .when(is_a("iban"), _iban(key, m, reveal))
        .when(is_a("date"), _date(key, m, reveal))
        .when(is_a("ip"), _ip(key, m, reveal))
        .when(is_a("phone"), _phone(key, m, reveal))
        .when(is_a("abroad"), _abroad(key, m, reveal))
        .when(is_a("ssn"), _ssn(key, m, reveal))
        .otherwise(_card(key, m, reveal))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced", reveal: bool = False) -> DataFrame:
    """docs with text_col rewritten and, if count_col names one, a count of the values replaced.

    Null stays null (count 0) and empty empty. Values that only look like a number or date of their kind stay. With
    reveal the pseudonyms made with the same key become the values again. All other columns stay, whatever their
    names; a column of docs named count_col is refused (ValueError): name another, or None; rows, repeated ones too, stay as many as they are. The key is a literal of the plan: give it from a
    store of secrets, and redact plans (spark.redaction.string.regex) where they are logged.
    """
    if count_col in docs.columns:
        raise ValueError(f"docs has a column {count_col}: give another count_col")
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    new = F.transform(found, lambda m: _pseudonym(key, m, reveal))
    both = F.when(F.size(found) > 0, F.struct(found.alias("old"), new.alias("new"), F.split(text, ANY, -1).alias("between")))

    def joined(b: Column) -> Column:
        return F.array_join(F.zip_with(b["between"], F.concat(b["new"], F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")

    done = F.transform(F.array(both), lambda b: F.when(b.isNotNull(), F.struct(joined(b).alias("text"), F.size(F.filter(F.zip_with(b["old"], b["new"], lambda o, n: o != n), lambda x: x)).cast("long").alias("n"))))[0]
    result = "_brindle_pii" + "_" * max((len(c) for c in docs.columns), default=0)  # no column of docs has that name
    rows = docs.withColumn(result, done)
    columns = [F.coalesce(F.col(f"{result}.text"), text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, *([F.coalesce(F.col(f"{result}.n"), F.lit(0)).alias(count_col)] if count_col else []))
