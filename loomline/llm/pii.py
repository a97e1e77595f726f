"""PII (6): format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions.

Values are found level by level, each level in what the ones before left: mail
addresses and secrets, complete North American phones, cards and IBANs, addresses,
dates and SSNs, other phones, phones in unusual groups. Patterns fit valid values
only (real dates, number plan of phones, ranges of SSN and IPv4) and end where a
value does; cards and IBANs are tried at every place with their check digits (Luhn,
97), so what is not valid takes nothing away from its neighbours. A valid value
is mapped to another valid value of its own format: its digits are read as a pair
of numbers (a, b) from fixed ranges, and a Feistel network on that pair, keyed by
SHA-256, permutes all pairs. So equal values stay equal in every document, unequal
ones stay unequal, and whoever has the key can undo it. Check digits are computed
anew, punctuation stays, dates stay in their century and layout, cards and phones
keep their first digit or country code. Addresses of mail and secrets have no
numeric format; they get keyed hashes in the same layout. What fails validation
is no PII of its kind and is left as it is.

A map over rows without user functions or shuffles. A text without a digit or
``@`` is passed on after one look. Defined results: null text stays null, empty
stays empty; very long texts are treated whole; repeated rows get equal results;
other columns pass, ``n_pii`` replaces an input column of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.common import let

ROUNDS = 8

# Where a value may begin.
BORDER = r"(?<![A-Za-z0-9.@+_-])"

# No group is repeated without bound but possessively: such a group would take stack for each turn.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"

# Days that exist, of 1900 to 2099: two digits (0) or one or two (0?) for day and month.
YEAR = "(?:19|20)[0-9]{2}"
LEAP_YEAR = "(?:(?:19|20)(?:0[48]|[2468][048]|[13579][26])|2000)"


def day_month(first: str, zero: str, cut: str) -> tuple[str, str]:
    """Patterns of a day and a month in either order, of any year and of leap years."""
    day = {29: f"(?:{zero}[1-9]|1[0-9]|2[0-8])", 30: f"(?:{zero}[1-9]|[12][0-9]|30)",
           31: f"(?:{zero}[1-9]|[12][0-9]|3[01])"}
    pairs = [(day[31], f"(?:{zero}[13578]|1[02])"), (day[30], f"(?:{zero}[469]|11)"), (day[29], f"{zero}2")]
    join = lambda d, m: d + cut + m if first == "day" else m + cut + d
    return "(?:" + "|".join(join(d, m) for d, m in pairs) + ")", join("29", f"{zero}2")


def dates_ymd() -> str:
    usual, leap = day_month("month", "0", "[-/.]")
    return f"(?:{YEAR}[-/.]{usual}|{LEAP_YEAR}[-/.]{leap})(?![A-Za-z0-9])"


def dates_dmy() -> str:
    (day, leap_day), (month, leap_month) = (day_month(f, "0?", "[/.-]") for f in ("day", "month"))
    return (f"(?:(?:{day}|{month})[/.-]{YEAR}|(?:{leap_day}|{leap_month})[/.-]{LEAP_YEAR})"
            "(?![A-Za-z0-9])")


# Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU"}


def ibans() -> list[str]:
    """Patterns of IBANs: of the length of the country; the longest of any country; and of
    other lengths, longest first, where the country has no known one."""
    def of(country: str, length: int) -> str:
        fours, rest = divmod(length - 4, 4)
        return f"{country}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")

    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    exact = "|".join(of("(?:" + c.replace(" ", "|") + ")", n) + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
    longest = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    return [exact, longest, *(of(f"(?!{known})[A-Z]{{2}}", n) for n in range(34, 14, -1))]


CARDS = ["[0-9]{13,19}", "[0-9]{4}(?:[ -][0-9]{4}){3}", "3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5}"]
#: Where a card or an IBAN may begin, and how much text one needs with what follows it.
NUMBER_PLACE = BORDER + (r"(?=[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}|[0-9]{13}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"
                         r"|3[0-9]{3}[ -][0-9]{6})")
NUMBER_CHARS, NUMBER_PIECES = 64, 16

END = "(?!-?[A-Za-z0-9])"  # of a phone
US_PHONE = rf"(?:1[ .-])?[2-9][0-9]{{2}}[ .-][2-9][0-9]{{2}}[ .-][0-9]{{4}}{END}"
TAIL = rf"[ .-](?!{US_PHONE})"


def groups(before: str, lengths: tuple[int, ...], tail: str = "") -> str:
    """``before`` with a country code or none, and two or three groups of digits, the first
    of them in brackets if there are three."""
    *first, a, b = lengths
    bracket = rf"\([0-9]{{{first[0]}}}\)[ .-]?" if first else ""
    return rf"{before}{bracket}[0-9]{{{a}}}[ .-][0-9]{{{b}}}" + (f"{TAIL}[0-9]{{{tail}}}" if tail else "")


def marked_phones() -> list[str]:
    """Forms with a plus or brackets, longest first: 8 to 15 digits in all, one more group
    only after fewer than ten digits without the country code."""
    plain = [(a, b) for a in (4, 3, 2) for b in (4, 3)]
    bracketed = [(p, *ab) for p in (4, 3, 2) for ab in plain]
    code = r"\+[0-9]{1,3}[ .-]?"
    more = [groups(f"(?:{code})?", g, "2,4" if sum(g) < 9 else "2,3") for g in bracketed if sum(g) < 10]
    more += [groups(code, g, "2,4") for g in plain]
    full = [groups(f"(?:{code})?" if sum(g) > 7 else code, g) for g in bracketed]
    full += [groups(rf"\+[0-9]{{{max(1, 8 - sum(g))},3}}[ .-]?", g) for g in plain]
    return [f"(?:{p}){END}" for p in more + full]


#: Complete North American forms with a plus or brackets.
FULL_PHONE = (rf"(?:\+1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})|(?<!\+[0-9]{{1,3}} )\([0-9]{{3}}\))"
              rf"[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}{END}")
#: Other forms with a plus or brackets, of 8 to 15 digits, and the usual one without.
OTHER_PHONE = "|".join([r"(?=[+(])(?:" + "|".join(marked_phones()) + ")", r"\+[0-9]{8,15}(?![A-Za-z0-9])", US_PHONE])
#: Ten digits, or eleven from 1, in unusual groups, and not inside a longer row of numbers.
LOOSE_PHONE = "(?<![0-9][ .-])(?:" + "|".join(
    rf"(?={'1[ .-]?' if sum(g) == 11 else ''}[2-9](?:[ .-]?[0-9]){{2}}[ .-]?[2-9])"
    + "[ .-]".join(f"[0-9]{{{n}}}" for n in g) + END
    for g in ((2, 4, 4), (3, 4, 3), (4, 3, 3), (4, 4, 2), (3, 4, 4), (4, 3, 4), (4, 4, 3))) + ")(?![ .-][0-9])"

# Kinds by level, each tried in what the levels before left. A pattern fits nothing but
# valid values; cards and IBANs have check digits, so they have a level of their own.
Kinds = tuple[tuple[str, str], ...]
NAMED: Kinds = (
    ("email", EMAIL),
    ("aws_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?[\"']?"
               rf"(?!{EMAIL})(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{{8,}}[\"']?"),
    ("hex_key", r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"),
)
FULL_PHONES: Kinds = (("phone", FULL_PHONE),)
SHORT: Kinds = (
    ("ipv4", rf"(?:{OCTET}\.){{3}}{OCTET}(?![A-Za-z0-9]|\.[0-9])"),
    ("date_ymd", dates_ymd()),
    ("date_dmy", dates_dmy()),
    ("ssn", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])"),
)
OTHER_PHONES: Kinds = (("phone", OTHER_PHONE),)
LOOSE_PHONES: Kinds = (("phone", LOOSE_PHONE),)

# A run of words with digits, or of few capitals, one space apart: no kind but the named
# ones goes beyond one.
RUN_CHARS = "A-Za-z0-9+()./@_-"
DIGIT_WORD = r"(?=[A-Za-z+()./@_-]*+[0-9])[" + RUN_CHARS + "]++"
SHORTEST = "(?:[0-9][^0-9]{0,3}){4}|[A-Z]{2}[0-9]{2}"
RUN = f"(?<![{RUN_CHARS}]){DIGIT_WORD}(?: (?:{DIGIT_WORD}|[A-Z]{{1,4}}(?![{RUN_CHARS}])))*+"


def alternation(kinds: Kinds) -> str:
    return BORDER + "(?:" + "|".join(f"(?:{p})" for _, p in kinds) + ")"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def keyed(key: str, *parts: Column) -> Column:
    """SHA-256 of key and parts, in hexadecimal."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)


def keyed_number(key: str, *parts: Column) -> Column:
    """A number below 2^60 from a keyed hash."""
    return F.conv(F.substring(keyed(key, *parts), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Permute the pairs ``(a, b)``, 0 <= a < size_a, 0 <= b < size_b: rounds add to one
    half a keyed function of the other, modulo its size; each round can be undone."""
    def step(s: Column, r: Column) -> Column:
        shift_a = keyed_number(key, F.lit(kind), r, s["b"])
        shift_b = keyed_number(key, F.lit(kind), r, s["a"])
        return F.when(r % 2 == 0, F.struct(
            ((s["a"] + shift_a % s["m"]) % s["m"]).alias("a"), s["b"].alias("b"),
            s["m"].alias("m"), s["n"].alias("n"))).otherwise(F.struct(
                s["a"].alias("a"), ((s["b"] + shift_b % s["n"]) % s["n"]).alias("b"),
                s["m"].alias("m"), s["n"].alias("n")))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"),
                     size_a.cast("long").alias("m"), size_b.cast("long").alias("n"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, step)


def power_of_ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10 ** i) for i in range(19)]), (n + 1).cast("int"))


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A digit string of up to 36 digits to another one of its length."""
    def of(d: Column) -> Column:
        left = (F.length(d) / 2).cast("int")
        right = F.length(d) - left
        halves = feistel(key, kind, F.coalesce(F.nullif(F.left(d, left), F.lit("")), F.lit("0")),
                         F.right(d, right), power_of_ten(left), power_of_ten(right))
        return let(halves, lambda s: F.concat(
            F.when(left == 0, F.lit("")).otherwise(F.lpad(s["a"].cast("string"), left, "0")),
            F.lpad(s["b"].cast("string"), right, "0")))

    # The kind of permutation depends on the length too, else halves of two lengths would agree.
    return F.when(F.length(digits) == 0, digits).otherwise(let(digits, of))


def refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by ``digits`` in order."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        F.split(template, ""), start,
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(
            (s["at"] + 1).alias("at"), F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out")))
        .otherwise(F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out"))),
        lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one is not doubled."""
    def term(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))), term),
                       F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """Remainder by 97 of an alphanumeric string, letters as 10 to 35."""
    def add(s: Column, c: Column) -> Column:
        number = F.conv(c, 36, 10).cast("int")
        return (s * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.regexp_extract_all(text, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), add)


def card(key: str, hit: Column) -> Column:
    def of(d: Column) -> Column:
        body = permute_digits(key, "card", F.substring(d, F.lit(2), F.length(d) - 2))
        return let(F.concat(F.left(d, F.lit(1)), body), lambda p: F.concat(p, (
            (10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))

    return let(digits_of(hit), lambda d: F.when(
        F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & ~d.rlike("^0"), refill(hit, of(d))))


def iban(key: str, hit: Column) -> Column:
    def of(v: Column) -> Column:
        body = F.substring(v, F.lit(5), F.length(v))
        moved = refill(body, permute_digits(key, "iban", digits_of(body)))
        return let(moved, lambda b: let(
            F.lpad((98 - mod97(F.concat(b, F.left(v, F.lit(2)), F.lit("00")))).cast("string"), 2, "0"),
            lambda check: relay(hit, F.concat(F.left(v, F.lit(2)), check, b))))

    plain = F.translate(hit, " ", "")
    return let(plain, lambda v: F.when(F.length(v).between(15, 34) & (
        mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.left(v, F.lit(4)))) == 1), of(v)))


def relay(template: Column, chars: Column) -> Column:
    """``chars`` with the spaces of ``template``."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        F.split(template, ""), start,
        lambda s, c: F.when(c == " ", F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out")))
        .otherwise(F.struct((s["at"] + 1).alias("at"),
                            F.concat(s["out"], F.substring(chars, s["at"], F.lit(1))).alias("out"))),
        lambda s: s["out"])


def ipv4(key: str, hit: Column) -> Column:
    def of(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i)).cast("int")
        halves = feistel(key, "ipv4", at(0) * 256 + at(1), at(2) * 256 + at(3),
                         F.lit(65536), F.lit(65536))
        return F.when(F.forall(p, lambda x: x.cast("int") <= 255), let(halves, lambda s: F.concat_ws(
            ".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"),
            F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string"))))

    return let(F.split(hit, r"\."), of)


# Days of two centuries as products of two numbers, 92 * 397 and 75 * 487.
CENTURIES = (("19", "1900-01-01", 92, 397), ("20", "2000-01-01", 75, 487))


def moved_day(key: str, day: Column) -> Column:
    """A date of 1900 to 2099 to another one of its century; else null."""
    out = F.lit(None).cast("date")
    for name, first, m, n in CENTURIES:
        number = F.datediff(day, F.lit(first).cast("date"))
        halves = feistel(key, "date" + name, F.floor(number / n), number % n, F.lit(m), F.lit(n))
        moved = F.date_add(F.lit(first).cast("date"), let(halves, lambda s: (
            s["a"] * F.lit(n) + s["b"]).cast("int")))  # noqa: B023  (called at once)
        out = F.when(number.between(0, m * n - 1), moved).otherwise(out)
    return out


def day_of(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def date_ymd(key: str, hit: Column) -> Column:
    day = day_of(F.left(hit, F.lit(4)), F.substring(hit, F.lit(6), F.lit(2)), F.substring(hit, F.lit(9), F.lit(2)))
    return let(moved_day(key, day), lambda d: refill(hit, F.date_format(d, "yyyyMMdd")))


def date_dmy(key: str, hit: Column) -> Column:
    """Day first, or month first where only that is a date; the layout is kept,
    two digits each where the value had one."""
    def of(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        european = day_of(at(2), at(1), at(0))
        american = day_of(at(2), at(0), at(1))
        mark = F.regexp_extract(hit, "[/.-]", 0)
        show = lambda d, first, second: F.concat(
            F.date_format(d, first), mark, F.date_format(d, second), mark, F.date_format(d, "yyyy"))
        return F.when(european.isNotNull(), let(moved_day(key, european), lambda d: show(d, "dd", "MM"))) \
            .otherwise(let(moved_day(key, american), lambda d: show(d, "MM", "dd")))

    return let(F.split(hit, "[/.-]"), of)


def ssn(key: str, hit: Column) -> Column:
    area, group, serial = (F.substring(hit, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    halves = feistel(key, "ssn", place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def show(s: Column) -> Column:
        p = F.floor(s["a"] / 99) + 1
        return F.concat_ws(
            "-", F.lpad((p + F.when(p > 665, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"),
            F.lpad((s["b"] + 1).cast("string"), 4, "0"))

    return F.when(valid, let(halves, show))


def phone(key: str, hit: Column) -> Column:
    """North American numbers keep their plan (area and exchange from 200); other
    international or bracketed ones keep all but their last seven digits."""
    def of(d: Column) -> Column:
        national = F.right(d, F.lit(10))
        american = d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")
        area = (F.left(national, F.lit(3)).cast("int") - 200) * 800 + F.substring(
            national, F.lit(4), F.lit(3)).cast("int") - 200
        halves = feistel(key, "phone", area, F.right(d, F.lit(4)), F.lit(640000), F.lit(10000))
        inside = let(halves, lambda s: F.concat(
            F.left(d, F.length(d) - 10), (F.floor(s["a"] / 800) + 200).cast("string"),
            (s["a"] % 800 + 200).cast("string"), F.lpad(s["b"].cast("string"), 4, "0")))
        tail = F.concat(F.left(d, F.length(d) - 7), permute_digits(key, "phone7", F.right(d, F.lit(7))))
        marked = hit.startswith("+") | hit.startswith("(")
        return F.when(american, refill(hit, inside)).when(
            marked & F.length(d).between(8, 15), refill(hit, tail))

    return let(digits_of(hit), of)


def email(key: str, hit: Column) -> Column:
    """Keyed letters before the at sign, a reserved domain after it."""
    return F.concat(F.lit("user-"), F.left(keyed(key, F.lit("email"), F.lower(hit)), F.lit(16)),
                    F.lit("@example.invalid"))


def aws_key(key: str, hit: Column) -> Column:
    return F.concat(F.left(hit, F.lit(4)), F.upper(F.left(keyed(key, F.lit("aws"), hit), F.lit(16))))


def hex_key(key: str, hit: Column) -> Column:
    mixed = hit.rlike("[0-9]") & hit.rlike("[a-f]")
    return F.when(mixed, F.left(keyed(key, F.lit("hex"), hit), F.length(hit)))


def secret(key: str, hit: Column) -> Column:
    """The value after the name; it must hold a digit, else it is a word of the text."""
    name = F.regexp_extract(hit, r"^[A-Za-z_-]+[ ]?[=:][ ]?[\"']?", 0)
    rest = F.substring(hit, F.length(name) + 1, F.length(hit))
    close = F.regexp_extract(rest, r"[\"'.]*$", 0)
    value = F.left(rest, F.length(rest) - F.length(close))
    return F.when(value.rlike("[0-9]"), F.concat(
        name, F.left(keyed(key, F.lit("secret"), value), F.least(F.length(value), F.lit(64))), close))


MAKERS = {"email": email, "aws_key": aws_key, "secret": secret, "hex_key": hex_key, "iban": iban,
          "ipv4": ipv4, "date_ymd": date_ymd, "date_dmy": date_dmy, "ssn": ssn, "phone": phone,
          "card": card}


def pseudonym(key: str, hit: Column, kinds: Kinds) -> Column:
    """The pseudonym of one candidate, or null if it is valid for no kind."""
    made = [F.when(hit.rlike("^(?:" + pattern + ")$"), MAKERS[kind](key, hit)) for kind, pattern in kinds]
    return F.coalesce(*made)


Replaced = Callable[[Column], Column]  # text to a struct of the text with pseudonyms and how many


def as_is(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))


def joined(parts: Column) -> Column:
    """One struct of an array of them."""
    return let(parts, lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda p: p["text"]), "").alias("text"),
        F.aggregate(ps, F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n")))


def by_pattern(text: Column, pattern: str, change: Replaced, rest: Replaced) -> Column:
    """``change`` of what fits the pattern, ``rest`` of what lies between."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    between = F.transform(F.split(text, pattern), rest)  # ``rest`` once, or levels would multiply
    return joined(F.flatten(F.zip_with(between, hits, lambda b, h: F.filter(F.array(b, h), F.isnotnull))))


def by_kinds(text: Column, key: str, kinds: Kinds, rest: Replaced) -> Column:
    def change(hit: Column) -> Column:
        return let(pseudonym(key, hit, kinds), lambda now: F.struct(
            F.coalesce(now, hit).alias("text"), now.isNotNull().cast("long").alias("n")))

    return by_pattern(text, alternation(kinds), change, rest)


def number_at(key: str, text: Column) -> Column:
    """The card or IBAN at the beginning of a text, as ``was`` and ``now``, or null."""
    tried = [F.regexp_extract(text, f"^(?:{p})(?![A-Za-z0-9])", 0) for p in (*CARDS, *ibans())]
    return F.get(F.filter(F.transform(
        F.filter(F.array(*tried), lambda was: was != ""),
        lambda was: F.struct(was.alias("was"), F.when(was.rlike("^[0-9]"), card(key, was))
                             .otherwise(iban(key, was)).alias("now"))),
        lambda hit: hit["now"].isNotNull()), F.lit(0))


def by_check_digits(text: Column, key: str, rest: Replaced) -> Column:
    """Cards and IBANs replaced, wherever one begins; ``rest`` of what lies between.

    The text is cut at each place where one may begin. A place whose candidates all fail
    takes nothing away from the places after it.
    """
    def ahead(pieces: Column, i: Column) -> Column:
        return F.left(F.array_join(F.transform(F.slice(pieces, i + 1, F.lit(NUMBER_PIECES)), lambda p: F.left(
            p, F.lit(NUMBER_CHARS))), ""), F.lit(NUMBER_CHARS))

    # plain: text since the last value; skip: characters of a value still to pass over.
    start = F.struct(
        F.lit(0).alias("skip"), F.lit("").alias("plain"),
        F.array().cast("array<struct<plain:string,now:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        hit = F.when(s["skip"] == 0, x["hit"])
        passed = F.when(hit.isNull(), s["skip"]).otherwise(F.length(hit["was"]))
        left_over = F.substring(x["piece"], passed + 1, F.length(x["piece"]))
        found = F.concat(s["found"], F.array(F.struct(s["plain"].alias("plain"), hit["now"].alias("now"))))
        return F.struct(
            F.greatest(passed - F.length(x["piece"]), F.lit(0)).alias("skip"),
            F.when(hit.isNull(), F.concat(s["plain"], left_over)).otherwise(left_over).alias("plain"),
            F.when(hit.isNull(), s["found"]).otherwise(found).alias("found"))

    def pieces_of(pieces: Column) -> Column:
        return F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), F.when(
            p.rlike("^[A-Z0-9]{4}"), let(ahead(pieces, i), lambda t: F.when(
                t.rlike("^" + NUMBER_PLACE), number_at(key, t)))).alias("hit")))

    def finish(s: Column) -> Column:
        last = F.struct(s["plain"].alias("plain"), F.lit(None).cast("string").alias("now"))
        return joined(F.transform(F.concat(s["found"], F.array(last)), lambda f: let(
            rest(f["plain"]), lambda r: F.struct(
                F.concat(r["text"], F.coalesce(f["now"], F.lit(""))).alias("text"),
                (r["n"] + f["now"].isNotNull().cast("long")).alias("n")))))

    return let(F.aggregate(let(F.split(text, NUMBER_PLACE), pieces_of), start, step), finish)


def replace_pii(text: Column, key: str) -> Column:
    """A struct of the text with pseudonyms and how many there are, for texts with candidates."""
    loose = lambda t: by_kinds(t, key, LOOSE_PHONES, as_is)
    other = lambda t: by_kinds(t, key, OTHER_PHONES, loose)
    short = lambda t: by_kinds(t, key, SHORT, other)
    checked = lambda t: by_check_digits(t, key, short)
    run = lambda t: F.when(t.rlike(SHORTEST), by_kinds(t, key, FULL_PHONES, checked)).otherwise(as_is(t))
    return by_kinds(text, key, NAMED, lambda t: by_pattern(t, RUN, run, as_is))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and ``n_pii``."""
    text = F.col(text_col).cast("string")
    done = F.when(text.rlike("[0-9@]"), replace_pii(text, key)).otherwise(as_is(text))
    carried = [c for c in docs.columns if c.lower() not in ("n_pii", "_done")]
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.explode(F.array(done)).alias("_done"))
    return rows.select(*[F.col("_done.text").alias(c) if c == text_col else F.col(f"`{c}`")
                         for c in carried], F.col("_done.n").alias("n_pii"))
