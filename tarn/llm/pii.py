"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

Card numbers, phone numbers, IBANs, IP addresses, dates and e-mail addresses are found by patterns, validated, and
replaced by values of the same format: the parts of a value are small integers, each within its own range, and a
Feistel network permutes all of them together. A keyed permutation maps equal values to equal pseudonyms in every
document and different values to different ones, and whoever has the key can undo it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_YEAR, LAST_YEAR = 1900, 2099
KINDS = ["email", "iban", "date", "ip", "ssn", "phone", "card"]

# Each pattern starts at the start of a run of its characters, so that no run is tried twice.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,190}\.[A-Za-z]{2,24}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/\-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])(?:(?:\+1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|\+1\d{10})(?!\d)"
ABROAD = r"(?<![\d+])\+[2-9](?:[ .\-]?\d){7,14}(?![ .\-]?\d)"
#: Country codes: one digit, two digits, or else three.
COUNTRY = r"^(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Groups of digits with a blank or hyphen between, 13 digits or more; a group at which another kind starts ends the run.
RUN = rf"(?<!\d)(?=(?:[ \-]?\d){{13}})\d+(?:[ \-](?!{DATE}|{IP}|{SSN}|{PHONE})\d+)*"
#: How cards are written inside such a run, as whole groups: solid, or in groups of four, or as those of 15 and 14 digits are.
CARDS = (r"\d{13,19}", r"\d{4}([ \-])\d{4}\1\d{4}\1\d{4}\1\d{1,3}", r"\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}", r"\d{4}[ \-]\d{6}[ \-]\d{5}", r"\d{4}[ \-]\d{6}[ \-]\d{4}")
ALL = "|".join([EMAIL, IBAN, DATE, IP, SSN, PHONE, ABROAD, RUN])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10: 0 for a valid number."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return (total + F.when(i % 2 == 1, doubled).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def _mod97(s: Column) -> Column:
    """Value modulo 97 of letters (A is 10) and digits read as one number."""

    def add(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (total * 100 + code - 55) % 97).otherwise((total * 10 + code - 48) % 97).cast("int")

    return F.aggregate(F.split(s, ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(add(t, c)).cast("int"))


def _iban_checked(s: Column) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))
    return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)))


def _ymd(s: Column) -> Column:
    """year, month, day of a date in one of the accepted forms, as an array of integers."""
    d = _digits(s)
    first = F.substring(s, 5, 1).rlike("[-/]")
    part = lambda a, n: F.substring(d, a, n).cast("int")
    month_first = F.substring(s, 3, 1).eqNullSafe("/") & (part(1, 2) <= 12)
    return (
        F.when(first, F.array(part(1, 4), part(5, 2), part(7, 2)))
        .when(month_first, F.array(part(5, 4), part(1, 2), part(3, 2)))
        .otherwise(F.array(part(5, 4), part(3, 2), part(1, 2)))
    )


def _late_day(s: Column) -> Column:
    """dd/mm/yyyy: the day must stay above 12, or the month would be read first."""
    return F.substring(s, 3, 1).eqNullSafe("/") & (F.substring(s, 1, 2).cast("int") > 12)


def _late_starts(leap: Column) -> Column:
    """Places of the months' first days above 12 in the year's list of such days."""
    at = lambda x: F.array(*[F.lit(sum(n - 12 for n in ([31, 28 + x, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][:m]))) for m in range(12)])
    return F.when(leap, at(1)).otherwise(at(0))


def _leap(y: Column) -> Column:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


_YEARS = range(FIRST_YEAR, LAST_YEAR + 1)
_IS_LEAP = [y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) for y in _YEARS]


def _years(leap: bool) -> Column:
    return F.array(*[F.lit(y) for y, x in zip(_YEARS, _IS_LEAP, strict=True) if x == leap])


def _month_days(y: Column) -> Column:
    return F.array(*[F.lit(n) for n in (31,)], F.when(_leap(y), 29).otherwise(28), *[F.lit(n) for n in (31, 30, 31, 30, 31, 31, 30, 31, 30, 31)])


def _valid_date(s: Column) -> Column:
    def ok(p: Column) -> Column:
        y, m, d = p[0], p[1], p[2]
        return y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & (d >= 1) & (d <= F.get(_month_days(y), m - 1))

    return let(_ymd(s), ok)


def kind_of(s: Column) -> Column:
    """The kind of a match of ALL, or null if it isn't valid."""
    octets = F.forall(F.split(s, r"\."), lambda o: o.cast("int") <= 255)
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike("^[A-Z]"), F.when(_iban_checked(s) == 1, "iban"))
        .when(s.rlike(f"^(?:{DATE})$"), F.when(_valid_date(s), "date"))
        .when(s.rlike(f"^(?:{IP})$"), F.when(octets, "ip"))
        .when(s.rlike(f"^(?:{SSN})$"), F.when(~s.rlike(r"^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(s.rlike(f"^(?:{ABROAD})$"), "phone")
        .when(s.rlike(f"^(?:{PHONE})$") & ~s.rlike(r"^\d{3}[ -]\d{3}[ -]\d{4}[ -]"), "phone")
        .when(s.rlike(f"^(?:{RUN})$"), "card")
    )


def _part(v: Column, r: Column) -> Column:
    return F.struct(v.cast("int").alias("v"), r.cast("int").alias("r"))


def _char_part(c: Column, free: Column) -> Column:
    """A character as a number within its class; what isn't ``free`` has a range of one value."""
    code = F.ascii(c)
    one = _part(F.lit(0), F.lit(1))
    return (
        F.when(~free, one).when(c.rlike("^[0-9]$"), _part(code - 48, F.lit(10))).when(c.rlike("^[a-z]$"), _part(code - 97, F.lit(26))).when(c.rlike("^[A-Z]$"), _part(code - 65, F.lit(26))).otherwise(one)
    )


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _parts(kind: Column, s: Column) -> Column:
    local = F.instr(s, "@")
    n = F.length(_digits(s))

    abroad = s.rlike(r"^\+[2-9]")
    country = F.length(F.regexp_extract(_digits(s), COUNTRY, 0))

    def phone(c: Column, i: Column) -> Column:
        at = F.length(_digits(F.substring(s, F.lit(1), i + 1))) - 1  # which digit this is
        return F.when(abroad, phone_abroad(c, at)).otherwise(phone_at_home(c, at))

    def phone_abroad(c: Column, at: Column) -> Column:
        d = F.ascii(c) - 48
        fixed = ~c.rlike("^[0-9]$") | (at < country) | ((at == country) & (d == 0))
        return F.when(fixed, _part(F.lit(0), F.lit(1))).when(at == country, _part(d - 1, F.lit(9))).otherwise(_part(d, F.lit(10)))

    def ssn(area: Column) -> Column:
        rest = lambda a, k: F.substring(s, a, k).cast("int") - 1
        return F.array(_part(area - 1 - (area > 666).cast("int"), F.lit(898)), _part(rest(5, 2), F.lit(99)), _part(rest(8, 4), F.lit(9999)))

    def octet(o: Column) -> Column:
        # One with leading zeros keeps one, so that it is read in the same way again.
        zeros = o.rlike("^0[0-9]")
        return _part(o.cast("int"), F.when(zeros, F.pow(F.lit(10), F.length(o) - 1)).otherwise(256))

    def phone_at_home(c: Column, at: Column) -> Column:
        from_end = n - at
        leading = (from_end == 10) | (from_end == 7)
        d = F.ascii(c) - 48
        return (
            F.when(~c.rlike("^[0-9]$") | (from_end > 10), _part(F.lit(0), F.lit(1)))
            .when(leading & (d >= 2), _part(d - 2, F.lit(8)))
            .when(leading, _part(d, F.lit(2)))
            .otherwise(_part(d, F.lit(10)))
        )

    def card(c: Column, i: Column) -> Column:
        return _char_part(c, F.length(_digits(F.substring(s, F.lit(1), i + 1))) < n)

    def date(p: Column) -> Column:
        y = p[0]
        day = F.aggregate(F.slice(_month_days(y), F.lit(1), p[1] - 1), F.lit(0), lambda a, x: a + x) + p[2] - 1
        index = F.when(_leap(y), F.array_position(_years(True), y)).otherwise(F.array_position(_years(False), y)) - 1
        late = F.get(_late_starts(_leap(y)), p[1] - 1) + p[2] - 13
        days = F.when(_leap(y), 366).otherwise(365)
        return F.array(
            _part(index, F.when(_leap(y), sum(_IS_LEAP)).otherwise(len(_IS_LEAP) - sum(_IS_LEAP))),
            F.when(_late_day(s), _part(late, days - 144)).otherwise(_part(day, days)),
        )

    return (
        F.when(kind == "email", F.transform(_chars(s), lambda c, i: _char_part(c, i + 1 < local)))
        .when(kind == "iban", F.transform(_chars(s), lambda c, i: _char_part(c, i >= 4)))
        .when(kind == "date", let(_ymd(s), date))
        .when(kind == "ip", F.transform(F.split(s, r"\."), octet))
        .when(kind == "ssn", let(F.substring(s, 1, 3).cast("int"), ssn))
        .when(kind == "phone", F.transform(_chars(s), phone))
        .otherwise(F.transform(_chars(s), card))
    )


def _feistel(kind: Column, parts: Column, key: str, undo: bool) -> Column:
    """In round k, parts at places of k's parity move by amounts that hang on the key and on all other parts.

    Each part has digits of its own of the digests: one digest for every 16 parts.
    """
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    size = F.size(parts)

    def turn(a: Column, k: Column) -> Column:
        others = F.array_join(F.transform(a, lambda x, i: F.when((i + k) % 2 == 1, x["v"].cast("string")).otherwise(x["r"].cast("string"))), ",")
        one = lambda j: F.sha2(F.concat_ws("|", F.lit(key), kind, k.cast("string"), size.cast("string"), j.cast("string"), others), 256)
        digest = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 16).cast("int")), one), "")

        def moved(h: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                amount = F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
                new = F.pmod(x["v"] - amount if undo else x["v"] + amount, x["r"])
                return _part(F.when((i + k) % 2 == 0, new).otherwise(x["v"]), x["r"])

            return F.transform(a, one)

        return let(digest, moved)

    return F.aggregate(rounds, parts, turn)


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _free(parts: Column) -> Column:
    """Separators and other parts of one value are left out, so that spellings of one number have one pseudonym."""
    return F.filter(parts, lambda p: p["r"] > 1)


def _write(kind: Column, s: Column, before: Column, parts: Column) -> Column:
    """The value of these free parts in the format of ``s``, whose parts were ``before``."""

    def char(c: Column, i: Column) -> Column:
        v = F.get(parts, F.size(_free(F.slice(before, F.lit(1), i + 1))) - 1)["v"]
        r = F.get(before, i)["r"]
        base = F.when(c.rlike("^[0-9]$"), F.when(r == 8, 50).when(r == 9, 49).otherwise(48)).when(c.rlike("^[a-z]$"), 97).otherwise(65)
        return F.when(r == 1, c).otherwise(F.chr((base + v).cast("long")))

    spelled = F.array_join(F.transform(_chars(s), char), "")

    def card(new: Column) -> Column:
        # The check digit belongs to the others: the last digit, whatever separators the number has.
        zeroed = F.concat(F.substring(new, F.lit(1), F.length(new) - 1), F.lit("0"))
        return F.concat(F.substring(new, F.lit(1), F.length(new) - 1), ((10 - _luhn(_digits(zeroed))) % 10).cast("string"))

    def iban(new: Column) -> Column:
        blank = F.concat(F.substring(new, 1, 2), F.lit("00"), F.substring(new, F.lit(5), F.length(new)))
        return F.concat(F.substring(new, 1, 2), _pad(98 - _iban_checked(blank), 2), F.substring(new, F.lit(5), F.length(new)))

    def date() -> Column:
        leap = parts[1]["r"].isin(366, 366 - 144)
        year = F.when(leap, F.get(_years(True), parts[0]["v"])).otherwise(F.get(_years(False), parts[0]["v"]))
        day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), parts[1]["v"])
        starts = F.filter(_late_starts(leap), lambda x: x <= parts[1]["v"])
        late = F.concat_ws("/", _pad(parts[1]["v"] - F.array_max(starts) + 13, 2), _pad(F.size(starts), 2), year.cast("string"))
        dotted, slashed = s.contains("."), F.substring(s, 3, 1) == "/"
        return (
            F.when(_late_day(s), late)
            .when(slashed, F.date_format(day, "MM/dd/yyyy"))
            .when(dotted, F.date_format(day, "dd.MM.yyyy"))
            .when(s.contains("/"), F.date_format(day, "yyyy/MM/dd"))
            .otherwise(F.date_format(day, "yyyy-MM-dd"))
        )

    def octets() -> Column:
        return F.array_join(F.zip_with(parts, F.split(s, r"\."), lambda p, o: F.when(o.rlike("^0[0-9]"), F.lpad(p["v"].cast("string"), F.length(o), F.lit("0"))).otherwise(p["v"].cast("string"))), ".")

    def ssn() -> Column:
        area = parts[0]["v"] + 1
        return F.concat_ws("-", _pad(area + (area >= 666).cast("int"), 3), _pad(parts[1]["v"] + 1, 2), _pad(parts[2]["v"] + 1, 4))

    return (
        F.when(kind == "date", date())
        .when(kind == "ip", octets())
        .when(kind == "ssn", ssn())
        .when(kind == "card", let(spelled, card))
        .when(kind == "iban", let(spelled, iban))
        .otherwise(spelled)
    )


def _replaced(kind: Column, s: Column, key: str, undo: bool) -> Column:
    return let(_parts(kind, s), lambda p: let(_feistel(kind, _free(p), key, undo), lambda q: _write(kind, s, p, q)))


def _cards(run: Column, key: str, undo: bool) -> Column:
    """(kind, value, n) of a run of groups of digits: from left to right, the first way of CARDS in which whole groups are valid by Luhn's
    check is a card, and the walk goes on behind it. A run without any that is valid as a whole, of 13 to 19 digits, is one."""
    card = F.lit("card")
    groups = F.regexp_extract_all(run, F.lit(r"\d+[ \-]?"), F.lit(0))

    def walk(gs: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            rest = F.array_join(F.slice(gs, i + 1, F.lit(5)), "")
            ways = F.array(*[F.regexp_extract(rest, rf"^{way}(?!\d)", 0) for way in CARDS])
            valid = F.filter(ways, lambda w: (w != "") & (_luhn(_digits(w)) == 0))

            def taken(found: Column) -> Column:
                n = F.size(F.regexp_extract_all(found, F.lit(r"\d+"), F.lit(0)))
                behind = F.regexp_extract(F.get(gs, i + n - 1), r"[ \-]$", 0)
                return F.struct((n - 1).alias("skip"), F.concat(state["out"], _replaced(card, found, key, undo), behind).alias("out"), (state["n"] + 1).alias("n"))

            left = F.struct(F.lit(0).alias("skip"), F.concat(state["out"], F.get(gs, i)).alias("out"), state["n"].alias("n"))
            passed = F.struct((state["skip"] - 1).alias("skip"), state["out"].alias("out"), state["n"].alias("n"))
            return F.when(state["skip"] > 0, passed).otherwise(let(valid, lambda v: F.when(F.size(v) > 0, let(F.get(v, F.lit(0)), taken)).otherwise(left)))

        start = F.struct(F.lit(0).alias("skip"), F.lit("").alias("out"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(gs) - 1), start, step)

    whole = F.length(_digits(run)).between(13, 19) & (_luhn(_digits(run)) == 0)

    def told(w: Column) -> Column:
        one = F.struct(card.alias("kind"), _replaced(card, run, key, undo).alias("value"), F.lit(1).alias("n"))
        some = F.struct(F.when(w["n"] > 0, card).alias("kind"), w["out"].alias("value"), w["n"].alias("n"))
        return F.when((w["n"] == 0) & whole, one).otherwise(some)

    return let(let(groups, walk), told)


def pseudonym(s: Column, key: str, undo: bool = False) -> Column:
    """(kind, value, n) of one match: its kind or null, its pseudonym (or with ``undo`` the original) or itself if not valid, and how many
    values of that kind it holds."""

    def named(kind: Column) -> Column:
        new = F.struct(kind.alias("kind"), F.when(kind.isNull(), s).otherwise(_replaced(kind, s, key, undo)).alias("value"), kind.isNotNull().cast("int").alias("n"))
        return F.when(kind == "card", _cards(s, key, undo)).otherwise(new)

    return let(kind_of(s), named)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """One row per input row: (doc_id, text, n_email, n_iban, n_date, n_ip, n_ssn, n_phone, n_card).

    ``text`` has each valid value replaced by its pseudonym under ``key`` (or, with ``undo``, pseudonyms by the
    originals); counts are of values replaced. Card numbers keep their length and separators and stay valid by Luhn's
    check; IBANs keep country and check; phone numbers keep country code and valid leading digits; US social security
    numbers stay valid ones; IP addresses stay four octets, those with leading zeros with as many digits; dates from 1900 to
    2099 stay dates, leap years among themselves; of e-mail addresses the local part changes within its character classes.
    Matches that aren't valid stay as they are. Equal values have equal pseudonyms whatever separators they have, but for
    dates dd/mm/yyyy with a day above 12 (which stay so) and octets with leading zeros.

    Card numbers are looked for in runs of digit groups, so one beside an expiry date, an amount, another number or another card is found
    (`_cards`). Undoing looks for them in the same way; where five or more groups of four digits stand in a row, or a card of 17 to 19
    digits is written in groups of four, pseudonyms can by chance be valid in another way first, and then don't come back.

    Limits: dates are yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy, and dd/mm/yyyy where the day is above 12; dates with
    one-digit days or months such as 1/5/1999 and dates in words stay in clear. Phones are North American numbers of ten
    digits and numbers of 8 to 15 digits that start with + and a country code; national numbers of other countries such
    as 020 7946 0958 stay in clear, and so do IPv6 addresses such as 2001:db8::1.

    A null text stays null with counts 0. Repeated rows give repeated rows, whole texts of any length are treated, an
    empty table gives no rows, and other columns are not read. Nothing is shuffled.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    has = F.coalesce(F.col("text").rlike(ALL), F.lit(False))
    found = F.transform(F.regexp_extract_all("text", F.lit(ALL), F.lit(0)), lambda m: pseudonym(m, key, undo))
    rows = rows.withColumn("found", F.when(has, found))
    gaps = F.split("text", ALL, -1)
    put = F.array_join(F.zip_with(gaps, F.col("found"), lambda g, m: F.concat(g, F.coalesce(m["value"], F.lit("")))), "")
    count = lambda k: F.aggregate(F.filter("found", lambda m: m["kind"] == k), F.lit(0).cast("long"), lambda a, m: a + m["n"])
    counts = [F.when(F.col("found").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(put).alias("text"), *counts)
