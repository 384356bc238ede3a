"""Format-preserving pseudonyms: a keyed Feistel permutation of validated values inside texts.

Every kind of value is a vector of small numbers with a radix each (digits of a card, octets of an
address, two mixed-radix digits of a date's place in a 28-year cycle, ...); a part with radix 1 stays
as it is. The vector's halves are shifted in turn by a keyed hash of the other half, each part modulo
its radix. That is a permutation of all values of the format, so equal values get equal pseudonyms in
every document and different ones stay different. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
CYCLE_YEARS, FIRST_YEAR, CYCLES = 28, 1901, 7  # 28 years of 1901 to 2096 have 21 * 487 days
CYCLE_RADICES = (21, 487)

_ALONE = r"(?<![A-Za-z0-9_])(?<!\d[.,])"
_END = r"(?![A-Za-z0-9_])(?![.,]\d)"
#: What may be a value, most specific form first; whether it is one is decided by ``_KINDS``.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "address": rf"{_ALONE}\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![A-Za-z0-9_])(?!\.\d)",
    "phone": rf"(?<![A-Za-z0-9_+])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,4}}){{2,4}}{_END}"
    rf"|(?<![A-Za-z0-9_])\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}{_END}|{_ALONE}\d{{3}}([ .-])\d{{3}}\1\d{{4}}{_END}",
    "date": rf"{_ALONE}\d{{4}}-\d{{2}}-\d{{2}}(?!\d)(?!-\d)|{_ALONE}\d{{2}}/\d{{2}}/\d{{4}}{_END}|{_ALONE}\d{{2}}\.\d{{2}}\.\d{{4}}{_END}",
    "social": rf"{_ALONE}\d{{3}}-\d{{2}}-\d{{4}}{_END}",
    "card": rf"{_ALONE}\d{{4}}([ -])\d{{4}}\2\d{{4}}\2\d{{1,4}}{_END}|{_ALONE}\d{{4}}[ -]\d{{6}}[ -]\d{{5}}{_END}|{_ALONE}\d{{13,19}}{_END}",
    "secret": r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9_])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _feistel(values: Column, radices: Column, tag: Column, key: str) -> Column:
    """The permuted vector. ``values`` and ``radices``: array<int> of equal size."""

    def shifted(x: Column, r: Column, other: Column, k: Column, name: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), name, k.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)
        word = lambda d, j: F.conv(F.substr(d, 1 + 4 * (j % 32), F.lit(4)), 16, 10).cast("int")
        return _let(digest, lambda d: F.transform(x, lambda v, j: ((v + word(d, j)) % F.get(r, j)).cast("int")))

    def rounds(s: Column) -> Column:
        def one(state: Column, k: Column) -> Column:
            return F.when(
                k % 2 == 1, F.struct(shifted(state["a"], s["ra"], state["b"], k, s["tag"]).alias("a"), state["b"].alias("b"))
            ).otherwise(F.struct(state["a"].alias("a"), shifted(state["b"], s["rb"], state["a"], k, s["tag"]).alias("b")))

        start = F.struct(s["a"].alias("a"), s["b"].alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda state: F.concat(state["a"], state["b"]))

    def halves(s: Column) -> Column:
        half = F.ceil(F.size(s["v"]) / 2).cast("int")
        rest = F.size(s["v"]) - half
        cut = lambda x, name: [F.slice(x, F.lit(1), half).alias(name[0]), F.slice(x, half + 1, rest).alias(name[1])]
        return F.struct(*cut(s["v"], ("a", "b")), *cut(s["r"], ("ra", "rb")), s["tag"].alias("tag"))

    return _let(F.struct(values.alias("v"), radices.alias("r"), tag.alias("tag")), lambda s: _let(halves(s), rounds))


def _characters(value: Column, tag: str, key: str, letters: int, kept: Callable[[Column], Column], after: Column | None = None) -> Column:
    """Permute digits as digits and letters as letters of their case; ``kept`` places stay.

    ``after`` is text that follows the value, part of the hash only.
    """

    def place(i: Column) -> Column:
        return _let(F.substr(value, i, F.lit(1)), lambda c: F.struct(
            c.alias("c"),
            F.when(kept(i - 1), 1).when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), letters).otherwise(1).alias("r"),
            F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).otherwise(65).alias("first"),
        ))

    def permuted(p: Column) -> Column:
        radices = F.transform(p, lambda x: x["r"])
        values = F.transform(p, lambda x: F.when(x["r"] == 1, 0).otherwise(F.ascii(x["c"]) - x["first"]))
        # the places that stay, and so the format, are part of the hash
        form = F.concat(F.lit(tag), F.array_join(F.transform(p, lambda x: F.when(x["r"] == 1, x["c"]).otherwise(x["r"].cast("string"))), ""),
                        *([] if after is None else [after]))
        return F.array_join(
            F.zip_with(p, _feistel(values, radices, form, key), lambda x, v: F.when(x["r"] == 1, x["c"]).otherwise(F.char(v + x["first"]))), ""
        )

    return _let(F.transform(F.sequence(F.lit(1), F.length(value)), place), permuted)


def _mail(value: Column, key: str) -> Column:
    """The local part (64 characters at most) is permuted, the domain stays, however long it is."""
    local = lambda v: F.substring_index(v, "@", 1)
    domain = lambda v: F.substr(v, F.instr(v, "@"))
    none = lambda j: F.lit(False)
    return F.concat(_characters(local(value), "email", key, 26, none, domain(value)), domain(value))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; counted from the right, places with the parity ``doubled`` are doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == doubled, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    """All digits but the first and the check digit are permuted; the check digit is made anew."""
    moved = _characters(value, "card", key, 1, lambda j: (j == 0) | (j == F.length(value) - 1))
    check = lambda body: (10 - _let(_digits(body), lambda d: _luhn(d, 0)) % 10) % 10
    return _let(F.substr(moved, F.lit(1), F.length(value) - 1), lambda body: F.concat(body, check(body).cast("string")))


def _numbers(value: Column) -> Column:
    return F.transform(F.split(value, "[^0-9]+"), lambda p: p.cast("int"))


def _address(value: Column, key: str) -> Column:
    got = _feistel(_numbers(value), F.array(*[F.lit(256)] * 4), F.lit("address"), key)
    return F.array_join(got.cast("array<string>"), ".")


def _social(value: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group from 01, serial from 0001."""

    def vector(n: Column) -> Column:
        area = F.get(n, F.lit(0))
        return F.array(area - 1 - (area > 666).cast("int"), F.get(n, F.lit(1)) - 1, F.get(n, F.lit(2)) - 1)

    def written(got: Column) -> Column:
        new = F.get(got, F.lit(0)) + 1
        return F.format_string("%03d-%02d-%04d", new + (new > 665).cast("int"), F.get(got, F.lit(1)) + 1, F.get(got, F.lit(2)) + 1)

    return _let(_feistel(_let(_numbers(value), vector), F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("social"), key), written)


def _day(value: Column) -> Column:
    """Year, month, day and form of what looks like a date; with slashes the month comes first
    where that gives a month."""

    def parts(n: Column) -> Column:
        a, b, c = (F.get(n, F.lit(k)) for k in range(3))
        fields = lambda y, m, d, form: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), F.lit(form).alias("form"))
        return (
            F.when(value.substr(5, 1) == "-", fields(a, b, c, "yyyy-MM-dd")).when(value.substr(3, 1) == ".", fields(c, b, a, "dd.MM.yyyy"))
            .when(a > 12, fields(c, b, a, "dd/MM/yyyy")).otherwise(fields(c, a, b, "MM/dd/yyyy"))
        )

    return _let(_numbers(value), parts)


def _date(value: Column, key: str) -> Column:
    """A day of the same 28 years, written in the same form; one day has one pseudonym in all forms.
    Null where there is no such day."""
    low = CYCLE_RADICES[1]

    def there(t: Column) -> Column:
        first = t["y"].between(FIRST_YEAR, FIRST_YEAR + CYCLE_YEARS * CYCLES - 1) & t["m"].between(1, 12) & (t["d"] >= 1)
        last = F.when(first, F.dayofmonth(F.last_day(F.make_date(t["y"], t["m"], F.lit(1)))))
        begin = F.make_date(F.lit(FIRST_YEAR) + CYCLE_YEARS * F.floor((t["y"] - FIRST_YEAR) / CYCLE_YEARS).cast("int"), F.lit(1), F.lit(1))
        return F.when(
            F.coalesce(t["d"] <= last, F.lit(False)),
            F.struct(begin.alias("begin"), F.date_diff(F.make_date(t["y"], t["m"], t["d"]), begin).alias("place"), t["form"].alias("form")),
        )

    def moved(s: Column) -> Column:
        values = F.array(F.floor(s["place"] / low).cast("int"), (s["place"] % low).cast("int"))
        got = _feistel(values, F.array(*map(F.lit, CYCLE_RADICES)), F.concat(F.lit("date"), F.year(s["begin"]).cast("string")), key)
        day = _let(got, lambda g: F.date_add(s["begin"], F.get(g, F.lit(0)) * low + F.get(g, F.lit(1))))
        forms = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")
        written = lambda x: F.coalesce(*[F.when(s["form"] == f, F.date_format(x, f)) for f in forms], F.date_format(x, "MM/dd/yyyy"))
        return F.when(s.isNotNull(), _let(day, written))

    return _let(_let(_day(value), there), moved)


def _of_form(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{PATTERNS[kind].replace(chr(92) + '2', chr(92) + '1')})$")


def _replaced(value: Column, key: str) -> Column:
    """The pseudonym of a validated value; null for anything else."""
    none = lambda j: F.lit(False)
    octets = _numbers(value)
    social = _numbers(value)
    country = F.length(F.regexp_extract(value, r"^\+\d{1,3}", 0))
    return (
        F.when(_of_form(value, "email"), _mail(value, key))
        .when(_of_form(value, "address"), F.when(F.forall(octets, lambda o: o <= 255), _address(value, key)))
        .when(_of_form(value, "date"), _date(value, key))
        .when(
            _of_form(value, "social"),
            F.when(
                F.get(social, F.lit(0)).between(1, 899) & (F.get(social, F.lit(0)) != 666)
                & (F.get(social, F.lit(1)) > 0) & (F.get(social, F.lit(2)) > 0), _social(value, key),
            ),
        )
        .when(
            _of_form(value, "phone"),
            F.when(F.length(_digits(value)).between(7, 15), _characters(value, "phone", key, 1, lambda j: j < country)),
        )
        .when(_of_form(value, "card"), F.when(_luhn(_digits(value), 1) % 10 == 0, _card(value, key)))
        .when(_of_form(value, "secret"), F.when(value.rlike("[0-9]") & value.rlike("[A-Fa-f]"), _characters(value, "secret", key, 6, none)))
    )


def pseudonymise(documents: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """``documents`` with pseudonyms in ``text_column`` and two more columns, n_found and n_replaced.

    Validated: mail addresses (their local part), IPv4 addresses with octets up to 255, days of
    1901 to 2096, social security numbers of issued ranges, telephone numbers of 7 to 15 digits (the
    country code stays), card numbers with a right check digit (which the pseudonym has too),
    hexadecimal secrets of 32 to 128 digits. Anything else that looks alike is left as it is:
    ``n_found`` counts both, ``n_replaced`` the replaced ones. A null text stays null with counts 0;
    an empty one stays empty. Every row is handled by itself, so repeated rows, null ids and
    other columns do no harm (columns named n_found or n_replaced are replaced).
    """
    text = F.col(f"`{text_column}`")
    found = documents.withColumn("_found", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    swapped = found.withColumn(
        "_new", F.when(F.size("_found") > 0, F.transform("_found", lambda v: _replaced(v, key)))
    )
    after = F.concat(F.zip_with("_found", "_new", lambda old, new: F.coalesce(new, old)), F.array(F.lit("")))
    return swapped.withColumn(
        text_column,
        F.when(F.size("_found") > 0, F.array_join(F.zip_with(F.split(text, ANY, -1), after, lambda p, m: F.concat(p, m)), "")).otherwise(text),
    ).withColumn(
        "n_found", F.coalesce(F.size(F.coalesce("_found", F.array().cast("array<string>"))), F.lit(0)).cast("long")
    ).withColumn(
        "n_replaced", F.size(F.filter(F.coalesce("_new", F.array().cast("array<string>")), lambda v: v.isNotNull())).cast("long")
    ).drop("_found", "_new")
