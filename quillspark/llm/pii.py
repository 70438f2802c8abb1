"""Private values replaced by keyed pseudonyms of the same format (DataFrame functions only)."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: Where a session may hold the key of the permutations; whoever has it can undo them.
KEY_CONF = "spark.quillspark.pii.key"
ROUNDS, WALK = 10, 40
#: Dates are permuted among the days from FIRST_DAY to LAST_DAY.
FIRST_DAY, LAST_DAY, DAYS = "1900-01-01", "2099-12-31", 73049

# The shapes of private values, in the order in which they are tried.
EMAIL = r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
HEX = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
KEYS = r"(?=A[KS]IA)(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])|(?=[sprkgx][kho])(?<![A-Za-z0-9])(?:[sprk]k_(?:live|test)_|gh[opsu]_|xox[abps]-)[A-Za-z0-9-]{16,}"
ADDRESS_6 = r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"\+[0-9]{1,3}[ .-][0-9](?:[ .-][0-9]{2}){4}(?![0-9])|(?<![0-9.-])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?! ?[0-9]|[.-][0-9])|\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9./-])(?<![0-9] )0[0-9]{2,4}[ /-][0-9]{6,8}(?![0-9]|[./-][0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
ANY = "|".join((EMAIL, HEX, KEYS, IBAN, ADDRESS_6, ADDRESS, DATE, SOCIAL, PHONE, CARD))
# The countries' calling codes, of one and two digits; all others have three.
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _keyed(*parts: Column) -> Column:
    """A non-negative long from the parts, by SHA-256; the first one holds the key."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, rounds: int = ROUNDS) -> Column:
    """struct(l, r): an alternating Feistel network over pairs below (left_size, right_size), one to one for each tweak, which begins with the key."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        l, r = acc["l"], acc["r"]
        even = i % 2 == 0
        new_l = F.when(even, (l + _keyed(tweak, i, r) % left_size) % left_size).otherwise(l)
        new_r = F.when(even, r).otherwise((r + _keyed(tweak, i, l) % right_size) % right_size)
        return F.struct(new_l.alias("l"), new_r.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn)


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, tweak: Column) -> Column:
    """A string of 2 to 36 digits -> another of the same length, one to one."""

    def permuted(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        b = n - a
        got = feistel(F.substr(d, F.lit(1), a), F.substr(d, a + 1, b), _ten(a), _ten(b), F.concat_ws("|", tweak, n.cast("string")))
        return let(got, lambda g: F.concat(F.lpad(g["l"].cast("string"), a, F.lit("0")), F.lpad(g["r"].cast("string"), b, F.lit("0"))))

    return let(digits, permuted)


def permute_below(value: Column, size: int, left: int, right: int, tweak: str) -> Column:
    """value in [0, size) -> [0, size): Feistel over left * right >= size, walked on until it falls within."""

    def once(x: Column) -> Column:
        got = feistel(F.floor(x / right), x % right, F.lit(left), F.lit(right), F.lit(tweak))
        return let(got, lambda g: g["l"] * right + g["r"])

    # The first step always permutes: it starts from the value put beyond the range, which `once` brings back.
    start = value.cast("long") + left * right
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda acc, i: F.when(acc < size, acc).otherwise(once(acc % (left * right))))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(value: Column, signs: Column, replaced: str = "[0-9]") -> Column:
    """value with its digits (or what else is replaced) exchanged, in order, for the signs given."""
    each = F.filter(F.split(signs, ""), lambda c: c != "")
    return F.array_join(F.zip_with(F.split(value, replaced, -1), each, lambda t, d: F.concat(t, F.coalesce(d, F.lit("")))), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum over a number that ends with its check digit."""

    def add(acc: Column, d: Column) -> Column:
        """acc: the sum and whether the next digit, from the right, is doubled."""
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(each, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add, lambda acc: acc["sum"])


def iban_rest(compact: Column) -> Column:
    """The remainder modulo 97 of an IBAN without spaces: 1 if it is valid."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    moved = let(compact, lambda v: F.concat(F.substr(v, F.lit(5), F.length(v)), F.substr(v, F.lit(1), F.lit(4))))
    each = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(each, F.lit(0), add)


def _is(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def reading(value: Column, apart: str, valid: Callable[[Column], Column], rank: Callable[[Column], Column], make: Callable[[Column], Column], first: bool = False) -> Column:
    """value with a run of its groups, which signs of the class apart divide, replaced; null if none is valid.

    Among valid runs (with first, only those from the start) that of the lowest rank is taken, then the first.
    """
    groups = F.regexp_extract_all(value, F.lit(f"[^{apart}]+[{apart}]?"), F.lit(0))

    def runs(g: Column) -> Column:
        def run(i: Column, j: Column) -> Column:
            mid = F.regexp_replace(F.array_join(F.slice(g, i, j - i + 1), ""), f"[{apart}]$", "")
            at = F.length(F.array_join(F.slice(g, F.lit(1), i - 1), ""))
            return let(mid, lambda m: F.struct(rank(m).alias("rank"), at.alias("at"), m.alias("mid")))

        starts = F.array(F.lit(1)) if first else F.sequence(F.lit(1), F.size(g))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, F.size(g)), lambda j: run(i, j))))

    found = F.array_min(F.filter(let(groups, runs), lambda r: valid(r["mid"])))
    after = lambda r: F.substr(value, r["at"] + F.length(r["mid"]) + 1, F.length(value))
    return let(found, lambda r: F.when(r.isNotNull(), F.concat(F.substr(value, F.lit(1), r["at"]), make(r["mid"]), after(r))))


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(value)), 256), 1, 12), F.lit("@example.org"))


def _digest(value: Column, kind: str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), value), 256)


def _hex(value: Column, key: str) -> Column:
    """Digits and letters must be mixed, as chance mixes them: a long number stays. A file's digest can't be told from a secret."""
    fresh = F.substr(_digest(value, "hex", key), F.lit(1), F.length(value))
    mixed = (F.regexp_count(value, F.lit("[A-Fa-f]")) >= 4) & (F.regexp_count(value, F.lit("[0-9]")) >= 4)
    return F.when(mixed, F.when(value.rlike("[A-F]"), F.upper(fresh)).otherwise(fresh))


def _token(value: Column, key: str) -> Column:
    """The prefix that names the issuer stays."""
    head = F.regexp_extract(value, r"^(?:A[KS]IA|[a-z]+_(?:live_|test_)?|xox[a-z]-)", 0)
    rest = F.length(value) - F.length(head)
    fresh = let(_digest(value, "token", key), lambda d: F.rpad(d, rest, d))
    return F.concat(head, F.when(head.rlike("^A"), F.upper(fresh)).otherwise(fresh))


def _address_6(value: Column, key: str) -> Column:
    """Groups keep their lengths; at most seven of them beside a double colon."""
    groups = F.regexp_count(value, F.lit("[0-9A-Fa-f]+"))
    signs = F.substr(_digest(F.lower(value), "address", key), F.lit(1), F.regexp_count(value, F.lit("[0-9A-Fa-f]")))
    fresh = refill(value, signs, "[0-9A-Fa-f]")
    return F.when((groups <= 7) | ~value.contains("::"), fresh)


def _iban(value: Column, key: str) -> Column:
    """Country and letters stay, digits are permuted, check digits follow; words after it, taken for groups, stay."""

    def remade(compact: Column, value: Column) -> Column:
        country = F.substring(compact, 1, 2)
        account = F.substr(compact, F.lit(5), F.length(compact))
        fresh = let(account, lambda a: refill(a, permute_digits(digits_of(a), F.lit(f"{key}|iban"))))
        check = lambda f: F.lpad((F.lit(98) - iban_rest(F.concat(country, F.lit("00"), f))).cast("string"), 2, "0")
        whole = let(fresh, lambda f: F.concat(country, check(f), f))
        enough = F.length(digits_of(account)) >= 2
        return F.when((iban_rest(compact) == 1) & enough, refill(value, whole, "[A-Z0-9]"))

    compact = lambda v: F.replace(v, F.lit(" "), F.lit(""))
    whole = lambda v: let(compact(v), lambda c: remade(c, v))
    valid = lambda v: (F.length(compact(v)) >= 15) & (iban_rest(compact(v)) == 1)
    return F.coalesce(whole(value), reading(value, " ", valid, lambda v: -F.length(v), whole, first=True))


def _address(value: Column, key: str) -> Column:
    def remade(o: Column) -> Column:
        got = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit(f"{key}|address"))
        dotted = let(got, lambda g: F.concat_ws(".", *[x.cast("string") for x in (F.floor(g["l"] / 256), g["l"] % 256, F.floor(g["r"] / 256), g["r"] % 256)]))
        return F.when(F.forall(o, lambda x: x <= 255), dotted)

    return let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), remade)


def _date(value: Column, key: str) -> Column:
    """The formats that DATE has, day before month where both can be read; a number that is no date in range stays."""
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "d/M/yyyy", "M/d/yyyy", "dd.MM.yyyy")
    fits = (r"^\d{4}-", r"^\d\d/\d\d/", r"^\d\d/\d\d/", r"^(?:\d/|\d\d/\d/)", r"^(?:\d/|\d\d/\d/)", r"^\d{2}\.")
    first = F.lit(FIRST_DAY).cast("date")
    read = F.array(*[F.when(value.rlike(fit), F.struct(F.lit(form).alias("form"), F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), first).alias("index"))) for form, fit in zip(forms, fits)])
    valid = F.filter(read, lambda r: r["index"].between(0, DAYS - 1))

    def remade(r: Column) -> Column:
        day = F.date_add(first, permute_below(r["index"], DAYS, 272, 270, f"{key}|date").cast("int"))
        return let(day, lambda d: F.coalesce(*[F.when(r["form"] == form, F.date_format(d, form)) for form in forms]))

    return F.get(F.transform(valid, remade), F.lit(0))


def _social(value: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def remade(got: Column) -> Column:
        a = F.floor(got / (99 * 9999))
        parts = (a + F.when(a >= 665, 2).otherwise(1), F.floor(got / 9999) % 99 + 1, got % 9999 + 1)
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4))])

    return F.when(valid, let(permute_below(index, 898 * 99 * 9999, 31000, 31000, f"{key}|social"), remade))


def _phone(value: Column, key: str) -> Column:
    """The country's digits stay; the rest, 7 to 14 digits, is permuted."""
    head = F.regexp_extract(value, CALLING, 0)
    fresh = let(F.substr(value, F.length(head) + 1, F.length(value)), lambda rest: refill(rest, permute_digits(digits_of(rest), F.lit(f"{key}|phone"))))
    return F.when((F.length(digits_of(value)) - F.length(digits_of(head))).between(7, 14), F.concat(head, fresh))


def _card(value: Column, key: str) -> Column:
    """All digits if they are valid, else the groups among them that are: 16 digits, 15, then the longest."""

    def checked(fresh: Column) -> Column:
        return F.concat(fresh, ((F.lit(10) - luhn_sum(F.concat(fresh, F.lit("0"))) % 10) % 10).cast("string"))

    def remade(digits: Column, value: Column) -> Column:
        fresh = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit(f"{key}|card"))
        return F.when(luhn_sum(digits) % 10 == 0, refill(value, let(fresh, checked)))

    whole = lambda v: let(digits_of(v), lambda d: remade(d, v))
    size = lambda v: F.length(digits_of(v))
    valid = lambda v: size(v).between(13, 19) & (luhn_sum(digits_of(v)) % 10 == 0)
    rank = lambda v: F.when(size(v) == 16, 0).when(size(v) == 15, 1).otherwise(30 - size(v))
    return F.coalesce(whole(value), reading(value, " -", valid, rank, whole))


#: Kind -> (shape, pseudonym under a key, or null where the value isn't valid).
KINDS = {
    "email": (EMAIL, _email), "secret": (HEX, _hex), "token": (KEYS, _token), "iban": (IBAN, _iban), "address6": (ADDRESS_6, _address_6), "address": (ADDRESS, _address),
    "date": (DATE, _date), "social": (SOCIAL, _social), "phone": (PHONE, _phone), "card": (CARD, _card),
}


def _bare(pattern: str) -> str:
    """A shape without what must stand before it, to test a value cut from its text."""
    import re

    return re.sub(r"\(\?<![^)]*\)", "", pattern)


def kind_of(value: Column) -> Column:
    """The first shape that a value found in a text fits."""
    return F.coalesce(*[F.when(_is(value, _bare(shape)), F.lit(kind)) for kind, (shape, _) in KINDS.items()])


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    """What takes the place of a value; null if it isn't valid."""
    out = F.lit(None).cast("string")
    for name, (_, make) in KINDS.items():
        out = F.when(kind == name, make(value, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text with pseudonyms, n_private, kinds (comma-joined, sorted).

    Values are found by shape and validated: Luhn's sum for cards, remainder 97 for IBANs, octets for addresses, the
    calendar for dates, issuing rules for social security numbers. Numbers and dates are permuted by a keyed Feistel
    network within their format, so equal values stay equal in all documents, different ones stay different, and
    the result is again valid. E-mail addresses, secrets and addresses of the sixth version have no order to permute
    within; a keyed digest takes their place. The key is a parameter or the session's setting KEY_CONF; there is no other. A card or IBAN that other groups adjoin is looked for among the groups; what else fails
    validation stays.

    Null texts stay null with n_private 0, empty texts empty. Null ids and repeated rows are returned like any
    other; an empty table gives no rows. Nothing is shuffled, and texts without any shape are passed through.
    """
    key = key or docs.sparkSession.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"pseudonyms need a key, given or in {KEY_CONF}")
    rows = pick(docs, doc_id="doc_id:long", text="text:string")
    rows = rows.withColumn("met", F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).withColumn("found", F.when(F.size("met") > 0, F.col("met")))
    typed = F.transform("found", lambda v: F.struct(v.alias("old"), kind_of(v).alias("kind")))
    changed = F.transform(typed, lambda t: F.struct(t["old"].alias("old"), t["kind"].alias("kind"), pseudonym(t["kind"], t["old"], key).alias("fresh")))
    rows = rows.withColumn("changed", changed)
    joined = F.zip_with(F.split("text", ANY, -1), F.col("changed"), lambda t, c: F.concat(t, F.coalesce(c["fresh"], c["old"], F.lit(""))))
    kinds = F.transform(F.filter("changed", lambda c: c["fresh"].isNotNull()), lambda c: c["kind"])
    return rows.select(
        "doc_id",
        F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join(joined, "")).alias("text"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size(kinds)).cast("long").alias("n_private"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")).alias("kinds"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the session's key, or one made for this run alone."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(KEY_CONF, None) or secrets.token_hex(16))
