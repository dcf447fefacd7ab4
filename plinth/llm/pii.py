"""Format-preserving Feistel pseudonyms for personal data.

A number or date that passes its own validation (checksum, ranges, calendar) becomes an index into the set of
valid values of its format. A keyed Feistel network over two mixed-radix halves permutes the indices, walking on
until the index is valid again, and the result is written back with the separators of the original. Equal values
get equal pseudonyms in every document whatever their separators, different ones get different ones, and holders
of the key can invert the map. It is all built of SQL expressions, with one network for all formats; only texts
with a digit or an @ are split. No pattern repeats a group without a bound, so no text can exhaust a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import let

#: The formats that are looked for, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z.+(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z.+(-])\+[0-9]{8,15}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+(-])(?:\+[0-9]{1,3}[ .-]?[0-9]{1,3}(?:[ .-][0-9]{2}){3,5}|0[0-9](?:[ .-][0-9]{2}){4})(?![0-9A-Za-z]|[.-][0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Characters of an IBAN, by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
ROUNDS, WALKS = 10, 16
#: Dates from 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = "1900-01-01", 73049
#: Account characters that become one index: 26^12 is below 10^18.
CHUNK = 12
SSNS, AMERICAN = 898 * 99 * 9999, 8 * 100 * 8 * 1_000_000


def _div(x: Column, y: Column | int) -> Column:
    return F.call_function("div", x, y if isinstance(y, Column) else F.lit(y).cast("long"))


def permuted(index: Column, domain: Column | int, key: str, kind: Column | str) -> Column:
    """Keyed permutation of the integers below ``domain`` (up to 10^18).

    The network works on a * b >= domain integers and is applied until the result is below ``domain``. For domains of
    10^4 and more less than one in a hundred results is not, so that 16 steps do not do about once in 10^32; that is an error.
    """
    domain = domain if isinstance(domain, Column) else F.lit(domain)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    a = F.floor(F.sqrt(domain.cast("double"))).cast("long") + 1
    of = F.struct(domain.cast("long").alias("n"), a.alias("a"), _div(domain.cast("long") + a - 1, a).alias("b"), F.concat_ws("|", F.lit(key), kind, domain.cast("string")).alias("tag"))

    def network(c: Column) -> Column:
        def mixed(r: Column, half: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", c["tag"], r.cast("string"), half.cast("string")), 256)
            return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

        def turn(acc: Column, r: Column) -> Column:
            moved = lambda own, other, size: (acc[own] + mixed(r, acc[other]) % size) % size
            return F.when(r % 2 == 0, F.struct(moved("l", "r", c["a"]).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), moved("r", "l", c["b"]).alias("r")))

        def once(x: Column) -> Column:
            start = F.struct(_div(x, c["b"]).alias("l"), (x % c["b"]).alias("r"))
            return F.aggregate(F.lit(list(range(ROUNDS))), start, turn, lambda acc: acc["l"] * c["b"] + acc["r"])

        walk = lambda y, step: F.when((step == 0) | (y >= c["n"]), once(y)).otherwise(y)
        checked = lambda y: F.when(y < c["n"], y).otherwise(F.raise_error(F.lit("a pseudonym did not come back into its format")).cast("long"))
        return F.aggregate(F.lit(list(range(WALKS))), index.cast("long"), walk, checked)

    return let(of, network)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(text: Column, chars: Column, letters: bool = False) -> Column:
    """``text`` with its digits (and capital ``letters``) replaced in turn by ``chars``, as far as these reach."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    goes = lambda c, at: (c.between("0", "9") | (c.between("A", "Z") if letters else F.lit(False))) & (at <= F.length(chars))

    def step(acc: Column, c: Column) -> Column:
        put = lambda new: F.struct(F.concat(acc["out"], F.when(new, F.substring(chars, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + new.cast("int")).alias("at"))
        return let(goes(c, acc["at"]), put)

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; counted from the right and from 0, the places of parity ``doubled`` are doubled."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == doubled, _div(c.cast("int") * 2, 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    return F.aggregate(F.filter(places, lambda v: v.isNotNull()), F.lit(0).cast("long"), lambda acc, v: acc + v)


def padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0") if isinstance(width, Column) else "0")


def ten_to(n: Column) -> Column:
    """10^n as a long, for n from 0 to 18."""
    return F.get(F.lit([10**i for i in range(19)]), n)


def chars_of(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def mod97(text: Column) -> Column:
    """Remainder of the IBAN's number; letters count as two digits."""
    value = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.cast("int"))
    return F.aggregate(chars_of(text), F.lit(0), lambda acc, c: (acc * F.when(c.between("A", "Z"), 100).otherwise(10) + value(c)) % 97)


def _part(x: Column, domain: Column | int) -> Column:
    return F.struct(x.cast("long").alias("x"), (domain if isinstance(domain, Column) else F.lit(domain)).cast("long").alias("domain"))


# Each format has a reader, giving its indices and their domains, or null for what is no valid value, and a writer, giving
# the text of new indices. ``m`` has the match, its digits and its date's parts.


def read_card(m: Column) -> Column:
    valid = F.length(m["digits"]).between(13, 19) & (luhn_sum(m["digits"], 1) % 10 == 0) & ~m["digits"].rlike("^0+$")
    n = F.length(m["digits"]) - 1
    return F.when(valid, F.array(_part(F.substring(m["digits"], F.lit(1), n), ten_to(n))))


def write_card(m: Column, x: Column) -> Column:
    """All digits but the last are permuted, the last is recomputed."""
    whole = let(padded(F.get(x, F.lit(0)), F.length(m["digits"]) - 1), lambda new: F.concat(new, ((10 - luhn_sum(new, 0) % 10) % 10).cast("string")))
    return refilled(m["text"], whole)


def iban_code(text: Column) -> Column:
    """The match without spaces, as far as its country's IBANs go."""
    place = F.call_function("locate", F.substring(text, 1, 2), F.lit(IBAN_LENGTHS))
    length = F.when(place > 0, F.substring(F.lit(IBAN_LENGTHS), place + 2, F.lit(2)).cast("int")).otherwise(34)
    return F.substring(F.replace(text, F.lit(" "), F.lit("")), F.lit(1), length)


def _radix(c: Column) -> Column:
    return F.when(c.between("A", "Z"), 26).otherwise(10).cast("long")


def read_iban(m: Column) -> Column:
    def of(code: Column) -> Column:
        valid = mod97(F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))) == 1
        chunks = F.transform(F.filter(F.lit([5, 17, 29]), lambda at: at <= F.length(code)), lambda at: chars_of(F.substring(code, at, F.lit(CHUNK))))
        value = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 65).otherwise(c.cast("int")).cast("long")
        start = _part(F.lit(0), F.lit(1))
        index = lambda chunk: F.aggregate(chunk, start, lambda acc, c: _part(acc["x"] * _radix(c) + value(c), acc["domain"] * _radix(c)))
        return F.when(valid, F.transform(chunks, index))

    return let(iban_code(m["text"]), of)


def write_iban(m: Column, x: Column) -> Column:
    """The country stays; the account's digits become digits and its letters letters; the check is new."""

    def of(code: Column) -> Column:
        def chunk(new: Column, i: Column) -> Column:
            start = F.struct(new.alias("rest"), F.lit("").alias("out"))
            char = lambda acc, c: F.when(c.between("A", "Z"), F.char(acc["rest"] % 26 + 65)).otherwise((acc["rest"] % 10).cast("string"))
            step = lambda acc, c: F.struct(_div(acc["rest"], _radix(c)).alias("rest"), F.concat(char(acc, c), acc["out"]).alias("out"))
            return F.aggregate(F.reverse(chars_of(F.substring(code, 5 + CHUNK * i, F.lit(CHUNK)))), start, step, lambda acc: acc["out"])

        country = F.substring(code, 1, 2)
        return let(F.array_join(F.transform(x, chunk), ""), lambda acc: F.concat(country, padded(98 - mod97(F.concat(acc, country, F.lit("00"))), 2), acc))

    return refilled(m["text"], let(iban_code(m["text"]), of), letters=True)


def read_ip(m: Column) -> Column:
    number = lambda octets: F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.cast("long"))
    return let(F.split(m["text"], r"\."), lambda octets: F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.array(_part(number(octets), 2**32))))


def write_ip(m: Column, x: Column) -> Column:
    return F.array_join(F.transform(F.lit([24, 16, 8, 0]), lambda s: (F.call_function("shiftright", F.get(x, F.lit(0)), s) % 256).cast("string")), ".")


def read_ssn(m: Column) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (F.substring(m["digits"], a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.array(_part(((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1, SSNS)))


def write_ssn(m: Column, x: Column) -> Column:
    def of(v: Column) -> Column:
        place = _div(v, 99 * 9999) + 1
        return F.concat(padded(place + F.when(place >= 666, 1).otherwise(0), 3), padded(_div(v, 9999) % 99 + 1, 2), padded(v % 9999 + 1, 4))

    return refilled(m["text"], let(F.get(x, F.lit(0)), of))


def _american(m: Column) -> Column:
    digits = m["digits"]
    return F.right(digits, F.lit(10)).rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") & ((F.length(digits) == 10) | ((F.length(digits) == 11) & digits.startswith("1") & m["text"].startswith("+")))


def _fixed_digits(m: Column) -> Column:
    """Leading digits that stay: four after a +, three of a national number with its 0."""
    return F.when(m["text"].startswith("+"), 4).otherwise(3)


def read_phone(m: Column) -> Column:
    """North American numbers, numbers after a + of 8 to 15 digits, national ones of 10 or 11 digits that begin with a 0."""
    digits, ten, n = m["digits"], F.right(m["digits"], F.lit(10)), F.length(m["digits"])
    part = lambda a, n: F.substring(ten, a, n).cast("long")
    index = (((part(1, 1) - 2) * 100 + part(2, 2)) * 8 + part(4, 1) - 2) * 1_000_000 + part(5, 6)
    other = (m["text"].startswith("+") & n.between(8, 15)) | (n.between(10, 11) & digits.rlike("^0[1-9]"))
    tail = F.array(_part(F.substring(digits, _fixed_digits(m) + 1, F.lit(15)), ten_to(n - _fixed_digits(m))))
    return F.when(_american(m), F.array(_part(index, AMERICAN))).when(other, tail)


def write_phone(m: Column, x: Column) -> Column:
    """North American numbers stay valid ones, with or without +1."""

    def american(v: Column) -> Column:
        high = _div(v, 1_000_000)
        return F.concat(F.when(F.length(m["digits"]) == 11, "1").otherwise(""), (_div(high, 800) + 2).cast("string"), padded(_div(high, 8) % 100, 2), (high % 8 + 2).cast("string"), padded(v % 1_000_000, 6))

    other = F.concat(F.substring(m["digits"], F.lit(1), _fixed_digits(m)), padded(F.get(x, F.lit(0)), F.length(m["digits"]) - _fixed_digits(m)))
    return refilled(m["text"], F.when(_american(m), let(F.get(x, F.lit(0)), american)).otherwise(other))


def _date_order(m: Column) -> tuple[Column, Column]:
    """(year first, day before month): with dots day-month-year; else month-day-year unless only the day can come first."""
    part = F.split(m["text"], "[./-]")
    return F.length(F.get(part, F.lit(0))) == 4, m["text"].contains(".") | (F.get(part, F.lit(0)).cast("int") > 12)


def read_date(m: Column) -> Column:
    def of(part: Column) -> Column:
        iso, day_first = _date_order(m)
        number = lambda i: F.get(part, F.lit(i)).cast("int")
        year = F.when(iso, number(0)).otherwise(number(2))
        month = F.when(iso | day_first, number(1)).otherwise(number(0))
        day = F.when(iso, number(2)).when(day_first, number(0)).otherwise(number(1))
        there = F.when(year.between(1900, 2099), F.try_to_date(F.concat_ws("-", padded(year, 4), padded(month, 2), padded(day, 2)), "yyyy-MM-dd"))
        return let(there, lambda d: F.when(d.isNotNull(), F.array(_part(F.datediff(d, F.lit(FIRST_DAY).cast("date")), DAYS))))

    return let(F.split(m["text"], "[./-]"), of)


def write_date(m: Column, x: Column) -> Column:
    """A date from 1900 to 2099, in the order, padding and separator of the original.

    An ambiguous order has to read the same way again, so the day leads only if it says so itself.
    """
    iso, day_first = _date_order(m)
    wide = ~F.exists(F.split(m["text"], "[./-]"), lambda p: F.length(p) == 1)
    two = lambda v: F.when(wide, padded(v, 2)).otherwise(v.cast("string"))

    def write(d: Column) -> Column:
        y, month, day = F.year(d).cast("string"), two(F.month(d)), two(F.dayofmonth(d))
        order = F.when(iso, F.array(y, month, day)).when(day_first, F.array(day, month, y)).otherwise(F.array(month, day, y))
        return F.call_function("array_join", order, F.regexp_extract(m["text"], "[./-]", 0))

    return let(F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(x, F.lit(0)).cast("int")), write)


def email(match: Column, key: str) -> Column:
    """Letters and digits of an address are replaced by keyed ones of the same kind; the top-level domain stays.

    Addresses are compared in lower case. This map is a keyed hash, not a permutation.
    """

    def of(lowered: Column) -> Column:
        body = F.regexp_extract(lowered, r"^(.*)\.[a-z]+$", 1)
        made = F.concat(*(F.sha2(F.concat_ws("|", F.lit(f"{key}|email|{i}"), lowered), 256) for i in range(4)))

        def swapped(digest: Column) -> Column:
            pick = lambda i, m: F.conv(F.substring(digest, i * 4 % 240 + 1, F.lit(4)), 16, 10).cast("int") % m
            swap = lambda c, i: F.when(c.between("a", "z"), F.char(pick(i, 26) + 97)).when(c.between("0", "9"), pick(i, 10).cast("string")).otherwise(c)
            return F.array_join(F.transform(F.split(body, ""), swap), "")

        return F.concat(let(made, swapped), F.substring(lowered, F.length(body) + 1, F.length(lowered)))

    return let(F.lower(match), of)


FORMATS = {"iban": (read_iban, write_iban), "date": (read_date, write_date), "ip": (read_ip, write_ip), "card": (read_card, write_card), "ssn": (read_ssn, write_ssn), "phone": (read_phone, write_phone)}


def pseudonym(match: Column, key: str) -> Column:
    """Struct (kind, text): the pseudonym of a match of ``ANY``; kind is null and text unchanged if it is no valid value."""
    result = lambda kind, text: F.struct(kind.cast("string").alias("kind"), text.alias("text"))

    def of(m: Column) -> Column:
        def read(kind: str) -> Column:
            named = lambda parts: F.when(parts.isNotNull(), F.struct(F.lit(kind).alias("kind"), parts.alias("parts")))
            return F.when(m["text"].rlike(f"^(?:{PATTERNS[kind]})$"), let(FORMATS[kind][0](m), named))

        def write(found: Column) -> Column:
            new = F.transform(found["parts"], lambda p: permuted(p["x"], p["domain"], key, found["kind"]))

            def written(x: Column) -> Column:
                text = F.lit(None).cast("string")
                for kind, (_, writer) in FORMATS.items():
                    text = F.when(found["kind"] == kind, writer(m, x)).otherwise(text)
                return result(found["kind"], text)

            return F.when(found.isNull(), result(F.lit(None), m["text"])).otherwise(let(new, written))

        return let(F.coalesce(*(read(kind) for kind in FORMATS)), write)

    number = let(F.struct(match.alias("text"), digits_of(match).alias("digits")), of)
    return F.when(match.contains("@"), result(F.lit("email"), email(match, key))).otherwise(number)


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", text_out: str = "text", counts_out: str = "pii_counts") -> DataFrame:
    """``docs`` with personal data in ``text_out`` replaced, and ``counts_out``: an array of (kind, n), sorted.

    Null texts stay null with no counts; texts without a digit or an @ pass unread; very long texts are worked
    on as a whole, in time that grows with their length; repeated rows give equal results; an empty table gives an
    empty one. What has more than 126 dots after its @ is no address, as no host name has so many, and stays. Other
    columns pass; a ``counts_out`` that exists already is an error.
    """
    if counts_out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {counts_out!r} exists already; give counts_out another name")
    text = F.col("_pl_text")
    matches = F.transform(F.regexp_extract_all(text, F.lit(f"({ANY})"), 1), lambda m: pseudonym(m, key))
    nothing = F.lit(None).cast("array<struct<kind:string,text:string>>")
    whole = docs.select(F.struct(*docs.columns).alias("_pl_row"), F.col(text_col).alias("_pl_text"))
    found = whole.withColumn("_pl_found", F.when(text.rlike("[0-9@]"), matches).otherwise(nothing))
    # Every piece but the last is followed by its match.
    pieces = F.transform(F.split(text, ANY), lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("_pl_found"), i)["text"], F.lit(""))))
    new = F.when(F.size("_pl_found") > 0, F.array_join(pieces, "")).otherwise(text)
    kinds = F.filter(F.transform(F.coalesce("_pl_found", F.array().cast("array<struct<kind:string,text:string>>")), lambda m: m["kind"]), lambda k: k.isNotNull())
    counts = let(kinds, lambda ks: F.transform(F.array_sort(F.array_distinct(ks)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(ks, lambda other: other == k)).alias("n"))))
    columns = [new.alias(text_out) if c == text_out else F.col("_pl_row")[c].alias(c) for c in docs.columns]
    columns += [] if text_out in docs.columns else [new.alias(text_out)]
    return found.select(*columns, counts.alias(counts_out))
