"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value is found by its format and validated (Luhn for cards, octets for addresses, the
calendar for dates, mod 97 for account numbers, number plans for phones and social security
numbers). A phone number behind +1 or with its area code in brackets may have any digits, a bare
one those of the plan; ten digits in a row, nine for social security, and numbers that start with
0 count only behind a word such as "phone" or "SSN". A date with slashes is month first where it
can be, else day first; account numbers stand in one piece or in groups of four, as long as their
country has them; secrets are hexadecimal behind a key's name, or start with a known prefix.

What passes is permuted within its format by a keyed Feistel network over mixed radices: each
round adds, to the elements of one half, numbers that a keyed SHA-256 draws from the other half,
modulo each element's own radix. That is a permutation of the format for any radices, so equal
values stay equal across documents, different ones different, and the holder of the key can go
back. Separators, brackets and +1 take no part and stay where they are, so a card, phone, account
or social security number has one pseudonym in all its layouts; dates in all layouts but day
first go by the day they name. Card numbers keep issuer and get a new check digit, dates stay
dates of the same 400 years, phones keep whether area code and exchange start with 0 or 1.

The key comes from the session's ``spark.spindle.pseudonyms.key``; only where it is unset (tests,
demonstrations) a printed key serves, with a warning.

All of it is Spark SQL: the text is split at the matches, the matches are rewritten in
place, and the parts are joined again; a row needs no other row, so nothing is shuffled.

Edge cases: a null text stays null; empty texts and texts without matches come back as they
are; values that fail validation stay; other columns pass through untouched, whatever
their names; repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let

#: Only for tests; a deployment sets its own secret in the session.
KEY = "spindle-demonstration-key"
KEY_SETTING = "spark.spindle.pseudonyms.key"
ROUNDS = 8

#: Lengths of account numbers by country, for those in groups of four; fixed values.
ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
GROUPED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in ACCOUNTS.items())

# Fixed formats. Each alternative starts and ends at a token's border.
PREFIXES = r"gh[opsu]_|github_pat_|glpat-|hf_|npm_|pk_live_|rk_live_|sk_live_|sk-(?:proj-)?|xox[abprs]-"
START, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<=(?i:token|key|secret|password|passwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})" + END,
    "token": START + r"(?:AKIA[0-9A-Z]{16}|(?:" + PREFIXES + r")[A-Za-z0-9]{16,255})" + END,
    "account": START + r"(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|" + GROUPED + ")" + END,
    "address6": START + r"(?<!:)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[23][0-9A-Fa-f]{3}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,4}[0-9A-Fa-f]{1,4})" + END + r"(?!:)",
    "address": START + r"(?<!\b(?i:version|release|build|ver|v)[ .:=]{0,2})(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + END + r"(?!\.[0-9])",
    "date": START + r"(?<![0-9][-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?:" + END + r"(?![-/.][0-9])|(?=T[0-9]{2}:[0-9]{2}))",
    "social": START + r"(?:(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}" + END + r"(?!-[0-9])|(?<=\b(?i:ssn|social security)(?i: number| no)?[.:=# ]{1,3})[0-9]{9}" + END + ")",
    "phone": r"(?<![\p{L}\p{N}_+-])(?:(?:(?:\+1[ .-]?)?\([0-9]{3}\) ?|\+1[ .-]?[0-9]{3}[ .-])[0-9]{3}|[2-9][0-9]{2}[ .-][2-9][0-9]{2})[ .-][0-9]{4}" + END + r"|(?<![\p{L}\p{N}_+-])\+1[0-9]{10}" + END + r"|(?<![\p{L}\p{N}_+-])\+(?!1)[1-9][0-9]{1,2}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}" + END
    + r"|(?<=\b(?i:phone|telephone|tel|mobile|cell|fax|call|whatsapp)(?i: number| no| us| me| at)?[.:=# ]{1,3})(?:[2-9][0-9]{2}[2-9][0-9]{6}|0[0-9]{1,4}(?:[ ./-]?[0-9]{2,7}){1,4})" + END + r"(?![ ./-]?[0-9])",
    "card": START + r"(?:[0-9]{13,19}|(?<![0-9][ -])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![ -][0-9]))" + END,
}
PATTERN = "|".join(FORMATS.values())
#: A text without any of these has no match; the long pattern is not tried on it.
HINT = "[0-9@]"
#: Issuer prefixes of card numbers.
ISSUERS = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|6011|64[4-9]|65|35(?:2[89]|[3-8])|30[0-5]|3[689]|62)"
#: 146,097 days are 400 years of the calendar, as two radices.
DAYS, DAY_RADIX, FIRST_DAY = 146_097, 773, "1800-01-01"
DATE_FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{4}/": "yyyy/MM/dd", r"^\d{2}\.": "dd.MM.yyyy", r"^\d{2}/": "MM/dd/yyyy"}

#: Dates with slashes whose day is over 12 are day first; 400 years have 88,497 such days, as two radices.
DAY_FIRST, LATE_DAYS, LATE_RADIX = r"^(?:1[3-9]|[23][0-9])/[0-9]{2}/", 88_497, 9_833


def chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def digits_of(text: Column) -> Column:
    return F.transform(chars(F.regexp_replace(text, r"[^0-9]", "")), lambda c: c.cast("int"))


def luhn_sum(digits: Column) -> Column:
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def mod97(account: Column) -> Column:
    """The remainder that a valid account number leaves: 1."""
    account = F.replace(account, F.lit(" "))
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    digit = lambda c: F.when(c <= F.lit("9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars(turned), F.lit(0), lambda a, c: (a * F.when(c <= F.lit("9"), 10).otherwise(100) + digit(c)) % 97)


def date_format(value: Column) -> Column:
    return F.coalesce(*[F.when(value.rlike(p), F.lit(f)) for p, f in DATE_FORMATS.items()])


def day_of(value: Column) -> Column:
    """Days since FIRST_DAY, null where the value is no date of those 400 years."""
    found = F.coalesce(*[F.when(value.rlike(p), F.try_to_timestamp(value, F.lit(f))) for p, f in DATE_FORMATS.items()])
    nr = F.datediff(found.cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when((nr >= 0) & (nr < DAYS), nr)


def late_day_of(value: Column) -> Column:
    """The place of a day-first date among the days over 12 since FIRST_DAY, or null."""
    found = F.when(value.rlike(DAY_FIRST), F.try_to_timestamp(value, F.lit("dd/MM/yyyy"))).cast("date")
    nr = F.datediff(found, F.lit(FIRST_DAY).cast("date")) - 12 * ((F.year(found) - 1800) * 12 + F.month(found))
    return F.when((nr >= 0) & (nr < LATE_DAYS), nr)


def late_day(nr: Column) -> Column:
    """The date at a place among the days over 12."""
    first = F.lit(FIRST_DAY).cast("date")
    before = lambda m: F.datediff(F.add_months(first, m), first) - 12 * m
    guess = F.floor(nr * 4800 / LATE_DAYS).cast("int")
    month = F.array_max(F.filter(F.sequence(guess - 2, guess + 2), lambda m: before(m) <= nr))
    return let(month, lambda m: F.date_add(first, nr + 12 * (m + 1)))


def social_parts(value: Column) -> list[Column]:
    digits = F.replace(value, F.lit("-"))
    return [F.substring(digits, *at).cast("int") for at in ((1, 3), (4, 2), (6, 4))]


def kind_of(value: Column) -> Column:
    """The format that a match has and passes, or null."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    area, group, serial = social_parts(value)
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(F.forall(octets, lambda x: x <= 255), F.lit("address")))
        .when(value.rlike(r"^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), F.when(day_of(value).isNotNull(), F.lit("date")).when(late_day_of(value).isNotNull(), F.lit("day_first")))
        .when(value.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})$"), F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), F.lit("social")))
        .when(value.rlike(r"^[1-9][0-9]{3}(?:[0-9]{9,15}|[ -][0-9 -]+)$"), F.when(F.regexp_replace(value, "[ -]", "").rlike(ISSUERS) & (luhn_sum(digits_of(value)) % 10 == 0), F.lit("card")))
        .when(value.rlike(r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{1,4})+)$") & (mod97(value) == 1), F.lit("account"))
        .when(value.rlike(r"^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"), F.when(value.rlike("[0-9]") & value.rlike("[A-Fa-f]"), F.lit("secret")))
        .when(value.rlike(f"^(?:AKIA|{PREFIXES})"), F.when(value.rlike("[0-9]"), F.lit("token")))
        .when(value.rlike("^[0-9A-Fa-f:]+:[0-9A-Fa-f:]+$"), F.lit("address6"))
        .when(value.rlike(r"^\+1|^\(|^[2-9][0-9]{2}[ .-]|^[2-9][0-9]{9}$"), F.lit("phone"))
        .when(value.rlike("^[+0]"), F.when(F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15), F.lit("abroad")))
    )


def element(v, n) -> Column:
    return F.struct(F.coalesce(v.cast("int"), F.lit(0)).alias("v"), (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("n"))


def low_of(c: Column, letters: Column | int) -> Column:
    """(first character, radix) of the class that a character stays in; radix 1 fixes it."""
    n = letters if isinstance(letters, Column) else F.lit(letters)
    return (
        F.when(c.between("0", "9"), F.struct(F.lit(48).alias("low"), F.lit(10).alias("n")))
        .when(c.rlike("^[a-z]$"), F.struct(F.lit(97).alias("low"), n.alias("n")))
        .when(c.rlike("^[A-Z]$"), F.struct(F.lit(65).alias("low"), n.alias("n")))
        .otherwise(F.struct(F.lit(0).alias("low"), F.lit(1).alias("n")))
    )


def bare(value: Column, kind: Column) -> Column:
    """What of a value is permuted: without separators and +1, the same in all its layouts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.substring(digits, F.length(digits) - 9, F.lit(10)))
        .when(kind.isin("card", "abroad"), digits)
        .when(kind == "account", F.replace(value, F.lit(" ")))
        .otherwise(value)
    )


def in_layout(value: Column, new: Column, kind: Column) -> Column:
    """A permuted bare value in the layout of the value that it replaces."""
    kept = lambda text: F.length(F.regexp_replace(text, "[^0-9A-Z]", ""))
    ahead = kept(value) - F.length(new)  # digits of +1

    def put(c: Column, i: Column) -> Column:
        at = kept(F.substring(value, F.lit(1), i + 1)) - ahead
        return F.when((at <= 0) | c.rlike("[^0-9A-Z]"), c).otherwise(F.substring(new, at, F.lit(1)))

    return F.when(kind.isin("card", "phone", "abroad", "account"), F.array_join(F.transform(chars(value), put), "")).otherwise(new)


def classes(text: Column, kind: Column) -> Column:
    """The class of each character of a bare value whose format is one of characters."""
    fixed = F.struct(F.lit(0).alias("low"), F.lit(1).alias("n"))
    plan = F.struct(F.lit(50).alias("low"), F.lit(8).alias("n"))
    no_plan = F.struct(F.lit(48).alias("low"), F.lit(2).alias("n"))
    prefix = F.length(F.regexp_extract(text, f"^(?:AKIA|{PREFIXES})", 0))

    def own(c: Column, i: Column) -> Column:
        return (
            F.when(kind == "card", F.when((i < 4) | (i + 1 == F.length(text)), fixed).otherwise(low_of(c, 1)))
            .when(kind == "phone", F.when((i == 0) | (i == 3), F.when(c >= "2", plan).otherwise(no_plan)).otherwise(low_of(c, 1)))
            .when(kind == "abroad", F.when(i < 2, fixed).otherwise(low_of(c, 1)))
            .when(kind == "email", F.when(i + 1 >= F.instr(text, "@"), fixed).otherwise(low_of(c, 26)))
            .when(kind == "account", F.when(i < 4, fixed).otherwise(low_of(c, 26)))
            .when(kind == "token", F.when(i < prefix, fixed).otherwise(low_of(c, 26)))
            .when((kind == "address6") & (i == 0), fixed)
            .otherwise(low_of(c, 6))
        )

    return F.transform(chars(text), own)


def feistel(elements: Column, kind: Column, key: str, rounds: int = ROUNDS, back: bool = False) -> Column:
    """A keyed permutation of the product of the elements' radices.

    Elements at even places change in even rounds, those at odd places in odd rounds, each
    by a number drawn from the values at the other places.
    """

    def one(state: Column, r: Column) -> Column:
        other = F.array_join(F.transform(F.filter(state, lambda e, i: i % 2 != r % 2), lambda e: e["v"].cast("string")), ".")

        def changed(seed: Column) -> Column:
            def moved(e: Column, i: Column) -> Column:
                drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("bigint")
                new = F.pmod(e["v"] - F.pmod(drawn, e["n"]) if back else e["v"] + F.pmod(drawn, e["n"]), e["n"])
                return F.when((i % 2 == r % 2) & (e["n"] > 1), element(new, e["n"])).otherwise(element(e["v"], e["n"]))

            return F.transform(state, moved)

        return let(F.concat_ws("|", F.lit(key), kind, r.cast("string"), other), changed)

    order = F.array(*[F.lit(r) for r in (reversed(range(rounds)) if back else range(rounds))])
    return F.aggregate(order, elements, one)


def from_chars(value: Column, kind: Column, key: str, back: bool) -> Column:
    """Formats made of characters, with new check digits where the format has them."""

    def permuted(text: Column) -> Column:
        def body(own: Column) -> Column:
            codes = F.transform(F.arrays_zip(chars(text).alias("c"), own.alias("k")), lambda x: element(F.when(x["k"]["n"] > 1, F.ascii(x["c"]) - x["k"]["low"]).otherwise(F.lit(0)), x["k"]["n"]))
            new = feistel(codes, kind, key, back=back)
            put = lambda x: F.when(x["k"]["n"] > 1, F.char((x["k"]["low"] + x["e"]["v"]).cast("int"))).otherwise(x["c"])
            return F.array_join(F.transform(F.arrays_zip(chars(text).alias("c"), own.alias("k"), new.alias("e")), put), "")

        return let(classes(text, kind), body)

    def checked(text: Column) -> Column:
        body = F.substring(text, F.lit(1), F.length(text) - 1)
        check = F.pmod(F.lit(10) - luhn_sum(digits_of(F.concat(body, F.lit("0")))) % 10, F.lit(10))
        iban = F.concat(F.substring(text, 1, 2), F.lit("00"), F.substring(text, F.lit(5), F.length(text)))
        return (
            F.when(kind == "card", F.concat(body, check.cast("string")))
            .when(kind == "account", F.concat(F.substring(text, 1, 2), F.lpad((98 - mod97(iban)).cast("string"), 2, "0"), F.substring(text, F.lit(5), F.length(text))))
            .otherwise(text)
        )

    return let(let(let(bare(value, kind), permuted), checked), lambda new: in_layout(value, new, kind))


def from_numbers(value: Column, kind: Column, key: str, back: bool) -> Column:
    """Formats made of numbers: octets, social security numbers, dates."""
    area, group, serial = social_parts(value)
    day, late = day_of(value), late_day_of(value)
    elements = (
        F.when(kind == "address", F.transform(F.split(value, r"\."), lambda x: element(x, 256)))
        .when(kind == "social", F.array(element(area - F.when(area > 666, 2).otherwise(1), 898), element(group - 1, 99), element(serial - 1, 9999)))
        .when(kind == "day_first", F.array(element(F.floor(late / LATE_RADIX), LATE_DAYS // LATE_RADIX), element(late % LATE_RADIX, LATE_RADIX)))
        .otherwise(F.array(element(F.floor(day / DAY_RADIX), DAYS // DAY_RADIX), element(day % DAY_RADIX, DAY_RADIX)))
    )

    def put(e: Column) -> Column:
        v = lambda i: F.get(e, F.lit(i))["v"]
        dash = F.when(value.contains("-"), "-").otherwise("")
        a = v(0) + F.when(v(0) >= 665, 2).otherwise(1)
        day_ = F.date_add(F.lit(FIRST_DAY).cast("date"), v(0) * DAY_RADIX + v(1))
        dated = F.coalesce(*[F.when(value.rlike(p), F.date_format(day_, f)) for p, f in DATE_FORMATS.items()])
        return (
            F.when(kind == "address", F.array_join(F.transform(e, lambda x: x["v"].cast("string")), "."))
            .when(kind == "social", F.concat(F.lpad(a.cast("string"), 3, "0"), dash, F.lpad((v(1) + 1).cast("string"), 2, "0"), dash, F.lpad((v(2) + 1).cast("string"), 4, "0")))
            .when(kind == "day_first", F.date_format(late_day(v(0) * LATE_RADIX + v(1)), "dd/MM/yyyy"))
            .otherwise(dated)
        )

    return let(feistel(elements, kind, key, back=back), put)


def pseudonym(value: Column, key: str = KEY, back: bool = False) -> Column:
    """The pseudonym of a match, or the match itself where it isn't valid; back: the reverse."""

    def body(kind: Column) -> Column:
        numbers = kind.isin("address", "social", "date", "day_first")
        return F.when(kind.isNull(), value).when(numbers, from_numbers(value, kind, key, back)).otherwise(from_chars(value, kind, key, back))

    return let(kind_of(value), body)


def pseudonymised(text: Column, key: str = KEY, back: bool = False) -> Column:
    """A text with all valid values replaced; a struct of text and number of replacements."""
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def body(found: Column) -> Column:
        def joined(new: Column) -> Column:
            parts = F.zip_with(F.split(text, PATTERN, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
            count = F.aggregate(F.zip_with(found, new, lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x)
            return F.struct(F.array_join(parts, "").alias("text"), count.cast("long").alias("n"))

        return F.when(F.size(found) == 0, F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(let(F.transform(found, lambda m: pseudonym(m, key, back)), joined))

    return F.when(text.rlike(HINT), let(matches, body)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))


def key_of(spark: SparkSession) -> str:
    """The session's key; the printed one, with a warning, where it is unset."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key
    warnings.warn(f"{KEY_SETTING} is unset: pseudonyms are made with a printed key, so anyone can go back", stacklevel=2)
    return KEY


def replace_personal(docs: DataFrame, key: str | None = None, text_col: str = "text", back: bool = False) -> DataFrame:
    """(row, text, n_replaced): the input row as a struct, its text with pseudonyms; key: the session's unless given."""
    key = key or key_of(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return rows.select("row", pseudonymised(F.col("text"), key, back).alias("new")).select("row", F.col("new.text").alias("text"), F.col("new.n").alias("n_replaced"))
