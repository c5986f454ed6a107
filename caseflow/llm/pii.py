"""Format-preserving pseudonyms for personal numbers, dates and addresses, as one SQL expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key of the permutations; use one of your own, and the same one for everything that shall stay linked.
KEY = "replace this key"
ROUNDS = 8
HEX = "0123456789abcdef"

# What is looked for; no alternative looks further than some dozen characters ahead.
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_MAIL_SIGN = "[A-Za-z0-9._%+-]"
EMAIL = rf"{_MAIL_SIGN}{{1,64}}+@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{1,8}}"
SECRET = r"[0-9a-f]{32,64}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
YEAR_FIRST = r"(?:19|20)[0-9]{2}([-/.])[0-9]{2}\1[0-9]{2}"
YEAR_LAST = r"[0-9]{2}([-/.])[0-9]{2}\1(?:19|20)[0-9]{2}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}"
_ABROAD_GROUP = r"(?:[ .-]?\(?[0-9]{2,4}\)?)"
PHONE_ABROAD = rf"\+[2-9][0-9]{{0,2}}{_ABROAD_GROUP}{{2,4}}"
CARD = r"[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{1,7}|(?:[0-9]{4}-){3}[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\1[0-9]{5}"

#: Lengths of the countries' IBANs; of other countries the longest candidate is tried.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban_of(n: int, countries: str) -> str:
    rest = f" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{n // 4 - 1}}}{rest}"


IBAN_OF_LENGTH = (f"(?:{'|'.join(_iban_of(n, c) for n, c in IBAN_COUNTRIES.items())}|"
                  f"(?!{'|'.join(' '.join(IBAN_COUNTRIES.values()).split())}){IBAN})")


def _any_separator(pattern: str) -> str:
    """The pattern with its back reference written out, so that it can stand among others."""
    separators = pattern[pattern.index("([") + 2:pattern.index("])")]
    if "\\1" not in pattern:
        return pattern
    return "|".join(pattern.replace(f"([{separators}])", s).replace("\\1", s)
                    for s in (f"[{c}]" for c in separators))


DATE = f"(?:{_any_separator(YEAR_FIRST)}|{_any_separator(YEAR_LAST)})(?:{_END}|(?=T[0-9]))"  # or a time of day
ANY_CARD = f"(?:{CARD.rsplit('|', 1)[0]}|{_any_separator(CARD.rsplit('|', 1)[1])}){_END}"
IPV4_END = r"(?![0-9A-Za-z]|\.[0-9])"

#: Where a value may begin: nothing is consumed, so that a candidate which turns out invalid hides no other one.
START = (f"(?=(?<!{_MAIL_SIGN}){EMAIL}|{_EDGE}(?:{SECRET}{_END}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{2}}|{DATE}|"
         rf"{SSN}{_END}|{PHONE}{_END}|{ANY_CARD})|(?<![0-9A-Za-z.]){IPV4}{IPV4_END}|"
         rf"(?<![0-9A-Za-z+])\+[2-9][0-9]{{0,2}}{_ABROAD_GROUP}{{2}})")
#: What is read from there: a mail address, else so many characters as no other value has.
AHEAD = 80
WINDOW = rf"{START}(?=({EMAIL}|(?s:.{{1,{AHEAD}}})))"

#: Dates are permuted among the days of 1900 to 2099; their number is 4297 * 17.
FIRST_DAY, DAYS = "1900-01-01", (4297, 17)
#: Steps of the walk through the days until one has the wanted order of day and month.
WALK = 64
#: Social security numbers: 898 areas of 99 groups, 9999 serials.
SSN_SIZE = (898 * 99, 9999)


def _noise(key: str, kind: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn, other), 512)


def _each(text: Column, one) -> Column:
    """The text with ``one(place, character)`` for every character."""
    places = F.sequence(F.lit(1), F.length(text))
    return F.when(F.length(text) == 0, "").otherwise(
        F.array_join(F.transform(places, lambda k: one(k, F.substr(text, k, F.lit(1)))), ""))


def _shift(text: Column, mask: Column, noise: Column) -> Column:
    """Every character moved on within its class: 9 digit, N digit from 2, a and A letters, h hex digit; others stay."""
    def one(k: Column, c: Column) -> Column:
        by = F.conv(F.substr(noise, 2 * k - 1, F.lit(2)), 16, 10).cast("int")
        kind = F.substr(mask, k, F.lit(1))
        turned = F.ascii(c) * 0
        for name, base, size in (("9", 48, 10), ("N", 50, 8), ("a", 97, 26), ("A", 65, 26)):
            turned = F.when(kind == name, F.pmod(F.ascii(c) - base + by, F.lit(size)) + base).otherwise(turned)
        as_hex = F.substr(F.lit(HEX), F.pmod(F.call_function("instr", F.lit(HEX), c) - 1 + by, F.lit(16)) + 1, F.lit(1))
        return F.when(kind == "h", as_hex).when(turned > 0, F.char(turned)).otherwise(c)
    return _each(text, one)


def permuted(text: Column, mask: Column, kind: str, key: str) -> Column:
    """Feistel permutation of the strings of a format: the halves shift each other in turn."""
    half = F.floor(F.length(text) / 2).cast("int")
    halves = lambda s: (F.substr(s, F.lit(1), half), F.substr(s, half + 1, F.length(s)))
    (left, right), (left_mask, right_mask) = halves(text), halves(mask)

    def turn(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        return F.when(i % 2 == 1, F.struct(_shift(l, left_mask, _noise(key, kind, i, r)).alias("l"), r.alias("r"))) \
            .otherwise(F.struct(l.alias("l"), _shift(r, right_mask, _noise(key, kind, i, l)).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), turn,
                       lambda acc: F.concat(acc["l"], acc["r"]))


def permuted_pair(left: Column, right: Column, size: tuple[int, int], kind: str, key: str) -> Column:
    """Feistel permutation of the pairs (l, r) with l < size[0] and r < size[1]."""
    def add(x: Column, other: Column, i: Column, n: int) -> Column:
        by = F.conv(F.substr(_noise(key, kind, i, other), F.lit(1), F.lit(14)), 16, 10).cast("long")
        return F.pmod(x + by, F.lit(n)).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        return F.when(i % 2 == 1, F.struct(add(l, r, i, size[0]).alias("l"), r.alias("r"))) \
            .otherwise(F.struct(l.alias("l"), add(r, l, i, size[1]).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)),
                       F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _dressed(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order, its signs left where they are."""
    nth = lambda k: F.length(_digits(F.substr(m, F.lit(1), k)))
    return _each(m, lambda k, c: F.when(c.between("0", "9"), F.substr(digits, nth(k), F.lit(1))).otherwise(c))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10; every second digit from the right is doubled."""
    n = F.length(digits)

    def step(acc: Column, k: Column) -> Column:
        d = F.substr(digits, k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - k) % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's letters and digits, a letter counting as two digits from 10."""
    def step(acc: Column, k: Column) -> Column:
        c = F.substr(text, k, F.lit(1))
        return (F.when(c.between("A", "Z"), acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48)) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _mask(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permuted(name, _mask(name), "email", key), F.substr(m, F.length(name) + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    real = m.rlike("[0-9]") & m.rlike("[a-f]")
    return F.when(real, permuted(m, F.regexp_replace(m, ".", "h"), "secret", key))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
    valid = _mod97(F.concat(account, F.substr(plain, F.lit(1), F.lit(4)))) == 1
    new = permuted(account, _mask(account), "iban", key)
    # the check digits follow from the rest; both parts stand in one array so that the permutation is written once
    made = F.transform(F.array(new), lambda a: F.concat(
        country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))[0]
    nth = lambda k: k - F.length(F.regexp_replace(F.substr(m, F.lit(1), k), "[^ ]", ""))
    dressed = F.transform(F.array(made), lambda a: _each(
        m, lambda k, c: F.when(c == " ", c).otherwise(F.substr(a, nth(k), F.lit(1)))))[0]
    return F.when(valid, dressed)


def _ipv4(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.")
    valid = F.forall(octets, lambda o: (o.cast("int") <= 255) & (o == o.cast("int").cast("string")))
    as_hex = F.array_join(F.transform(octets, lambda o: F.lower(F.lpad(F.hex(o.cast("long")), 2, "0"))), "")
    new = permuted(as_hex, F.lit("hhhhhhhh"), "ipv4", key)
    dotted = F.transform(F.array(new), lambda h: F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda k: F.conv(F.substr(h, k, F.lit(2)), 16, 10)), "."))[0]
    return F.when(valid, dotted)


def _date(m: Column, key: str) -> Column:
    """Day, month and year in their order; with the year last the month comes first if it can."""
    part = lambda a, n: F.substr(m, F.lit(a), F.lit(n))
    year_first = m.rlike("^[0-9]{4}")
    sign = F.when(year_first, part(5, 1)).otherwise(part(3, 1))
    first, second, year = part(1, 2), part(4, 2), part(7, 4)
    iso = lambda y, a, b: F.to_date(F.try_to_timestamp(F.concat_ws("-", y, a, b), F.lit("yyyy-MM-dd")))
    day_first = ~year_first & (first > "12")
    date = F.when(year_first, iso(part(1, 4), part(6, 2), part(9, 2))) \
        .when(day_first, iso(year, second, first)).otherwise(iso(year, first, second))
    start = F.lit(FIRST_DAY).cast("date")
    a, b = DAYS

    def step(acc: Column, i: Column) -> Column:
        # on with the walk while it is at the beginning or (day before month) at a day that could be a month
        day = F.dayofmonth(F.date_add(start, acc.cast("int")))
        goes_on = (i == 1) | (day_first & (day <= 12))
        moved = F.transform(F.array(permuted_pair(F.floor(acc / b), acc % b, DAYS, "date", key)),
                            lambda p: p["l"] * b + p["r"])[0]
        return F.when(goes_on, moved).otherwise(acc)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.datediff(date, start).cast("long"), step)

    def written(d: Column) -> Column:
        of = lambda *forms: F.call_function("concat_ws", sign, *(F.date_format(d, f) for f in forms))
        return F.when(year_first, of("yyyy", "MM", "dd")).when(day_first, of("dd", "MM", "yyyy")).otherwise(
            of("MM", "dd", "yyyy"))
    new = F.transform(F.array(F.date_add(start, walked.cast("int"))), written)[0]
    return F.when(date.isNotNull(), new)


def _ssn(m: Column, key: str) -> Column:
    part = lambda a, n: F.substr(m, F.lit(a), F.lit(n)).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")
    pair = permuted_pair(place * 99 + group - 1, serial - 1, SSN_SIZE, "ssn", key)

    def written(p: Column) -> Column:
        area = F.floor(p["l"] / 99) + 1
        area = area + (area >= 666).cast("int")
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((p["r"] + 1).cast("string"), 4, "0"))
    return F.when(valid, F.transform(F.array(pair), written)[0])


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    before = F.substr(digits, F.lit(1), F.length(digits) - 10)
    number = permuted(F.substr(digits, F.length(digits) - 9, F.lit(10)), F.lit("N99N999999"), "phone", key)
    return F.transform(F.array(F.concat(before, number)), lambda d: _dressed(m, d))[0]


def _phone_abroad(m: Column, key: str) -> Column:
    """The first two digits (country) stay."""
    digits = _digits(m)
    own = F.substr(digits, F.lit(3), F.length(digits))
    number = permuted(own, F.regexp_replace(own, ".", "9"), "phone abroad", key)
    new = F.transform(F.array(F.concat(F.substr(digits, F.lit(1), F.lit(2)), number)), lambda d: _dressed(m, d))[0]
    return F.when(F.length(digits).between(8, 15), new)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    own = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = permuted(own, F.regexp_replace(own, ".", "9"), "card", key)
    checked = F.transform(F.array(new), lambda p: F.concat(
        p, F.pmod(10 - _luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return F.when((_luhn(digits) == 0) & F.length(digits).between(13, 19),
                  F.transform(F.array(checked), lambda d: _dressed(m, d))[0])


def _made(found: Column, new) -> Column:
    """What was found and its pseudonym; null if nothing was found or it is not valid."""
    def both(m: Column) -> Column:
        return F.transform(F.array(new(m)), lambda n: F.when(n.isNotNull(), F.struct(m.alias("old"), n.alias("new"))))[0]
    return F.transform(F.array(found), lambda m: F.when(m != "", both(m)))[0]


def pseudonym(ahead: Column, before: Column, key: str) -> Column:
    """The first valid value at the beginning of ``ahead``, which stands behind the sign ``before``, and its pseudonym."""
    at = lambda p: F.regexp_extract(ahead, f"^(?:{p})", 0)
    of = lambda p, new: _made(at(p), lambda m: new(m, key))
    after = lambda signs, found: F.when(~before.rlike(signs), found)
    edge = lambda p, new: after("[0-9A-Za-z]", of(p, new))
    return F.coalesce(
        after(_MAIL_SIGN, F.when(ahead.contains("@"), of(EMAIL, _email))), edge(SECRET + _END, _secret),
        edge(IBAN_OF_LENGTH + _END, _iban),
        edge(DATE, _date), edge(SSN + _END, _ssn), edge(PHONE + _END, _phone), edge(ANY_CARD, _card),
        after("[0-9A-Za-z.]", of(IPV4 + IPV4_END, _ipv4)),
        *(after("[0-9A-Za-z+]", of(rf"\+[2-9][0-9]{{0,2}}{_ABROAD_GROUP}{{{n}}}{_END}", _phone_abroad)) for n in (4, 3, 2)))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Replace personal values in every whole text by pseudonyms of the same format.

    Returns doc_id, ``text`` and ``n_replaced``.  Found and validated are payment
    cards (Luhn), social security numbers (areas, groups and serials in use),
    North American (also without separators) and other phone numbers, IBANs (modulo 97), IPv4 addresses
    and dates of 1900 to 2099 (yyyy-mm-dd, mm/dd/yyyy, dd/mm/yyyy with ``-``,
    ``/`` or ``.``); names of mail addresses and hexadecimal secrets get the
    same treatment.  What does not validate is left alone; the characters of a
    candidate that does not are read again for others, from every place where one
    may begin, and of valid values that overlap the first is taken.

    Each value is mapped by a keyed Feistel network that permutes its format:
    lengths, signs and letter case stay, check digits are made anew, dates
    stay dates.  So the pseudonym is valid again, equal values get equal
    pseudonyms in all documents (numbers also across ways to write them), and
    different values of a format get different ones.  All is one expression over a
    row: no shuffle, nothing kept.

    Null text stays null; texts without a digit or ``@`` pass unread.  Rows that
    repeat an id are treated one by one; extra columns are ignored.
    """
    padded = F.concat(F.lit(" "), F.col("text"))  # so that no value stands at the very beginning
    ahead = F.regexp_extract_all(padded, F.lit(WINDOW), F.lit(1))
    read = docs.select("doc_id", "text", F.when(F.col("text").rlike("[0-9@]"), ahead).alias("ahead"))
    hit = F.size("ahead") > 0
    # the text between the places: what stands before the first, then one part from each place to the next
    cut = read.select("doc_id", "text", "ahead", F.when(hit, F.split(padded, START, -1)).alias("parts"))
    before = F.transform("parts", lambda p: F.substr(p, F.lit(-1), F.lit(1)))
    made = F.zip_with("ahead", F.slice(before, F.lit(1), F.size("ahead")), lambda w, c: pseudonym(w, c, key))
    rows = cut.select("doc_id", "text", F.col("parts")[0].alias("begin"),
                      F.arrays_zip(F.slice("parts", F.lit(2), F.size("parts")).alias("part"),
                                   F.when(hit, made).alias("made")).alias("places"))
    reach = lambda p: F.coalesce(F.length(p["made"]["old"]), F.lit(0))

    def go_on(acc: Column, p: Column) -> Column:
        taken = F.when(acc["over"] > 0, acc["over"]).otherwise(reach(p))
        return F.struct(F.greatest(taken - F.length(p["part"]), F.lit(0)).alias("over"),
                        F.concat(acc["overs"], F.array(acc["over"])).alias("overs"))
    # characters of each part that a value before it has taken; all zero if no value reaches into the next part
    none = F.transform("places", lambda p: F.lit(0))
    walked = F.aggregate("places", F.struct(F.lit(0).alias("over"), F.array().cast("array<int>").alias("overs")), go_on,
                         lambda acc: acc["overs"])
    overs = F.when(F.exists("places", lambda p: reach(p) > F.length(p["part"])), walked).otherwise(none)
    rows = rows.select("doc_id", "text", "begin", "places", overs.alias("overs"))

    def written(p: Column, over: Column) -> Column:
        new = F.when(over == 0, p["made"]["new"])
        gone = F.when(over == 0, reach(p)).otherwise(over)
        return F.concat(F.coalesce(new, F.lit("")), F.substr(p["part"], gone + 1, F.length(p["part"])))
    joined = F.concat(F.substr("begin", F.lit(2), F.length("begin")),
                      F.array_join(F.zip_with("places", "overs", written), ""))
    changed = F.size(F.filter(F.zip_with("places", "overs", lambda p, over: F.coalesce(
        (over == 0) & (p["made"]["old"] != p["made"]["new"]), F.lit(False))), lambda c: c))
    return rows.select("doc_id", F.when(F.size("places") > 0, joined).otherwise(F.col("text")).alias("text"),
                       F.when(F.size("places") > 0, changed).otherwise(0).cast("long").alias("n_replaced"))
