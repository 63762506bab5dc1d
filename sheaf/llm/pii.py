"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

What is found is validated (checksums, calendar, ranges) and then permuted under
a key within its own format by a Feistel network: the value's symbols are cut in
two halves, and in every round each symbol of one half is shifted, modulo the
size of its class, by a key stream made from the other half. What is permuted is
the bare value, without spaces, signs and case, and it is laid out afterwards:
equal values get equal pseudonyms in all documents, however they are written.
Different values of one kind and layout get different ones, and with the key it
can be undone. Dates are permuted as day numbers and walk the cycle until they are
in the calendar range again; check digits are computed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole

ROUNDS = 8
#: Of more symbols than this, a half enters the key stream as its digest, so that time grows with the length only.
LONG = 200
#: Patterns of each kind, in the order in which they are tried at a place.
KINDS = {
    "secret": r"(?i:\b(?:access[_-]?token|auth[_-]?token|token|secret|password|passwd|pwd|api[_-]?key|secret[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-+/.]{6,}+)",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_%+\-][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./\-][0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?:[23][0-9A-Fa-f]{3}|[fF][c-eC-E][0-9A-Fa-f]{2})(?:(?::[0-9A-Fa-f]{1,4}){7}|(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
}
#: Groups of digits side by side that may hold cards, up to where another kind or a word starts; possessive, so that long rows of numbers need no stack.
KINDS["card"] = (
    r"(?<![0-9A-Za-z.\-])(?=[0-9](?:[ \-]?[0-9]){12})[0-9]++(?![A-Za-z]|\.[0-9])(?:[ \-](?!"
    + "|".join(KINDS[k] for k in ("email", "date", "ip", "phone", "ssn"))
    + r")[0-9]++(?![A-Za-z]|\.[0-9]))*+"
)
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Days from FIRST_DAY on that dates are permuted among, within LEFT x RIGHT numbers.
FIRST_DAY, DAYS, LEFT, RIGHT, WALKS = "1900-01-01", 73049, 271, 270, 24


def _stream(key: str, tweak: Column, i: Column, size: Column) -> Column:
    """A number below ``size`` (65,536 at most) for place i; every 12 places share a digest."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, (i / 12).cast("int").cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, F.pmod(i, F.lit(12)) * 5 + 1, F.lit(5)), 16, 10).cast("long"), size)


def _sizes(symbols: Column, hexadecimal: Column) -> Column:
    """Class sizes: digits 10, letters of either case 26 (6 in hexadecimal values), everything else 1."""
    return F.transform(
        symbols,
        lambda c: F.when(c.between("0", "9"), 10)
        .when(c.between("a", "z"), F.when(hexadecimal, 6).otherwise(26))
        .when(c.between("A", "Z"), F.when(hexadecimal, 6).otherwise(26))
        .otherwise(1),
    )


def _base(c: Column) -> Column:
    return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))


def feistel(numbers: Column, sizes: Column, key: str, tweak: Column, undo: bool = False) -> Column:
    """``numbers`` permuted, each below its size; a permutation for every key, tweak and sizes.

    Round r shifts the half that r picks by a stream made from the other half.
    """
    half = (F.size(numbers) / 2).cast("int")

    def rounds(n: Column, s: Column, h: Column) -> Column:
        def step(state: Column, r: Column) -> Column:
            turn = F.lit(ROUNDS - 1) - r if undo else r
            first = F.pmod(turn, F.lit(2)) == 0
            other = F.when(first, F.slice(state, h + 1, F.size(state) - h)).otherwise(F.slice(state, F.lit(1), h))
            said = F.array_join(other.cast("array<string>"), ".")
            brief = F.size(state) <= LONG
            label = F.concat_ws(",", F.when(brief, tweak).otherwise(F.sha2(tweak, 256)), turn.cast("string"), F.when(brief, said).otherwise(F.sha2(said, 256)))
            return let(
                label,
                lambda t: F.transform(
                    state,
                    lambda x, i: F.when(
                        (i < h) == first, F.pmod((x - _stream(key, t, i, F.get(s, i)) if undo else x + _stream(key, t, i, F.get(s, i))), F.get(s, i))
                    ).otherwise(x),
                ),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), n, step)

    bound = let(F.struct(numbers.cast("array<bigint>").alias("n"), sizes.cast("array<bigint>").alias("s"), half.alias("h")), lambda b: rounds(b["n"], b["s"], b["h"]))
    return F.when(F.size(numbers) < 2, numbers.cast("array<bigint>")).otherwise(bound)


def symbols_permuted(value: Column, key: str, tweak: Column, hexadecimal: Column, undo: bool = False) -> Column:
    """A string permuted within its layout: every digit stays a digit, letters keep their case, the rest stays.

    Signs between and the case of letters don't count, so values that differ in them only stay equal but for them.
    """

    def permuted(v: Column) -> Column:
        cs = F.filter(F.split(v, ""), lambda c: c.rlike("^[0-9A-Za-z]$"))
        # What can't move doesn't take part, so that both halves hold symbols that do.
        bound = let(
            F.struct(cs.alias("c"), _sizes(cs, hexadecimal).alias("s")),
            lambda b: F.struct(b["c"].alias("c"), feistel(F.transform(b["c"], lambda c: F.ascii(c) - _base(c)), b["s"], key, tweak, undo).alias("n")),
        )
        return let(bound, lambda b: _laid_out(v, F.zip_with(b["c"], b["n"], lambda c, n: F.char(_base(c) + n))))

    return let(value, permuted)


def _laid_out(value: Column, moved: Column) -> Column:
    """``value`` with its letters and digits replaced, in order, by ``moved``."""
    gaps = F.split(value, "[0-9A-Za-z]")
    return F.array_join(F.zip_with(gaps, moved, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit("")))), "")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last one isn't doubled."""
    n = F.char_length(digits)
    return F.aggregate(
        F.split(digits, ""),
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")),
        lambda a, c: F.struct(
            (a["s"] + F.when(F.pmod(n - 1 - a["i"], F.lit(2)) == 0, F.ascii(c) - 48).otherwise(F.pmod((F.ascii(c) - 48) * 2, F.lit(10)) + ((F.ascii(c) - 48) / 5).cast("int"))).alias("s"),
            (a["i"] + 1).alias("i"),
        ),
        lambda a: a["s"],
    )


def card_pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """All digits but the last permuted, and the check digit made anew; null where the checksum is wrong."""

    def made(v: Column) -> Column:
        body = symbols_permuted(F.substring(v, F.lit(1), F.char_length(v) - 1), key, F.lit("card"), F.lit(False), undo)
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(digits_of(b), F.lit("0"))), F.lit(10)).cast("string")))

    return F.when(F.pmod(luhn_sum(digits_of(value)), F.lit(10)) == 0, let(value, made))


def cards_pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """(p, n) of groups of digits with one sign between: the text with its cards replaced, null without one, and their number.

    Cards are tried at all runs of groups with 13 to 19 digits and a valid checksum;
    where runs overlap, the one of more digits counts, then the earlier one.
    """

    def part(v: Column, start: Column, end: Column) -> Column:
        return F.substring(v, start + 1, end - start)

    def runs(b: Column) -> Column:
        """(-digits, start, end) of all valid ones, those that count first."""
        n = F.size(b["e"])

        def of_start(s: Column, i: Column) -> Column:
            ends = F.slice(b["e"], i + 1, F.least(n - i, F.lit(19)))
            all_ = F.transform(ends, lambda e, k: F.struct((s + k - e).alias("d"), s.alias("s"), e.alias("e")))
            sized = F.filter(all_, lambda x: x["d"].between(-19, -13))
            return F.filter(sized, lambda x: F.pmod(luhn_sum(digits_of(part(b["v"], x["s"], x["e"]))), F.lit(10)) == 0)

        return F.array_sort(F.flatten(F.transform(b["s"], of_start)))

    def chosen(valid: Column) -> Column:
        span = F.transform(valid, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        free = lambda acc, x: ~F.exists(acc, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        none = F.array().cast("array<struct<s:int,e:int>>")
        return F.array_sort(F.aggregate(span, none, lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc)))

    def laid_out(b: Column) -> Column:
        pieces = F.transform(
            b["c"],
            lambda x, k: F.concat(
                part(b["v"], F.when(k > 0, F.get(b["c"], k - 1)["e"]).otherwise(0), x["s"]), card_pseudonym(part(b["v"], x["s"], x["e"]), key, undo)
            ),
        )
        size = F.char_length(b["v"])
        rest = part(b["v"], F.element_at(b["c"], -1)["e"], size)
        return F.struct(F.concat(F.array_join(pieces, ""), rest).alias("p"), F.size(b["c"]).alias("n"))

    def placed(v: Column) -> Column:
        signs = F.array_compact(F.transform(F.split(v, ""), lambda c, i: F.when(c.isin(" ", "-"), i)))
        starts = F.concat(F.array(F.lit(0)), F.transform(signs, lambda i: i + 1))
        return F.struct(v.alias("v"), starts.alias("s"), F.concat(signs, F.array(F.char_length(v))).alias("e"))

    def found(b: Column) -> Column:
        return let(F.struct(b["v"].alias("v"), chosen(runs(b)).alias("c")), lambda x: F.when(F.size(x["c"]) > 0, laid_out(x)))

    return let(placed(value), found)


def mod97(value: Column) -> Column:
    """The remainder of letters and digits read as numbers, A as 10 to Z as 35."""
    return F.aggregate(
        F.split(value, ""),
        F.lit(0).cast("long"),
        lambda a, c: F.when(c.between("0", "9"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))),
    )


def iban_pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The account part permuted, and the check digits made anew, with or without spaces; null where they are wrong.

    A number in groups may be followed by a group of another meaning: the longest run
    of groups from the first one with valid check digits counts.
    """

    def bare(v: Column) -> Column:
        return F.replace(v, F.lit(" "), F.lit(""))

    def valid(v: Column) -> Column:
        return mod97(F.concat(F.substring(bare(v), F.lit(5), F.char_length(v)), F.substring(v, 1, 4))) == 1

    def made(v: Column) -> Column:
        country = F.substring(v, 1, 2)
        body = symbols_permuted(F.substring(bare(v), F.lit(5), F.char_length(v)), key, F.concat(F.lit("iban"), country), F.lit(False), undo)
        full = let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return _laid_out(v, F.split(full, ""))

    def longest(groups: Column) -> Column:
        heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
        return F.get(F.filter(heads, lambda h: (F.char_length(bare(h)) >= 15) & valid(h)), F.lit(0))

    def laid_out(head: Column) -> Column:
        return F.concat(made(head), F.substring(value, F.char_length(head) + 1, F.char_length(value)))

    return let(longest(F.split(value, " ")), lambda head: F.when(head.isNotNull(), laid_out(head)))


def ip6_pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The first group and seven permuted ones, written out in full; null where there are too many or too few groups."""

    def groups(half: Column) -> Column:
        return F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")

    def numbers(h: Column) -> Column:
        left, right = groups(F.get(h, F.lit(0))), groups(F.get(h, F.lit(1)))
        n = F.size(left) + F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
        return F.when(F.when(F.size(h) == 2, n <= 7).otherwise(n == 8), F.transform(filled, lambda g: F.conv(g, 16, 10).cast("long")))

    def moved(n: Column) -> Column:
        rest = feistel(F.slice(n, 2, 7), F.array_repeat(F.lit(65536), 7), key, F.lit("ip6"), undo)
        return F.array_join(F.transform(F.concat(F.slice(n, 1, 1), rest), lambda x: F.lower(F.hex(x))), ":")

    return let(numbers(F.split(value, "::")), lambda n: F.when(n.isNotNull(), moved(n)))


def ip_pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    octets = F.split(value, "\\.").cast("array<bigint>")
    moved = feistel(octets, F.transform(octets, lambda x: F.lit(256)), key, F.lit("ip"), undo)
    return F.array_join(moved.cast("array<string>"), ".")


def date_pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """A day of the same two centuries in the same layout; null where it is none. Ambiguous dates have the day first."""

    def moved(p: Column) -> Column:
        sizes = F.array(F.lit(LEFT), F.lit(RIGHT))

        def once(n: Column) -> Column:
            out = feistel(F.array((n / RIGHT).cast("long"), F.pmod(n, F.lit(RIGHT))), sizes, key, F.lit("date"), undo)
            return let(out, lambda o: o[0] * RIGHT + o[1])

        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(p["n"]), lambda a, _: F.when(a < DAYS, a).otherwise(once(a)))
        return F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), walked.cast("int")), "yyyy-MM-dd")

    def number(text: Column) -> Column:
        return F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.to_date(F.lit(FIRST_DAY))).cast("long")

    year_first = value.rlike("^[0-9]{4}")
    y = F.when(year_first, F.substring(value, 1, 4)).otherwise(F.substring(value, 7, 4))
    a = F.when(year_first, F.substring(value, 6, 2)).otherwise(F.substring(value, 1, 2))
    b = F.when(year_first, F.substring(value, 9, 2)).otherwise(F.substring(value, 4, 2))
    sign = F.when(year_first, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
    day_first = F.when(year_first, False).otherwise((sign == ".") | (b <= "12"))
    iso = F.when(day_first, F.concat_ws("-", y, b, a)).otherwise(F.concat_ws("-", y, a, b))
    form = F.concat(F.when(year_first, "y").when(day_first, "d").otherwise("m"), sign)

    def laid_out(q: Column) -> Column:
        year, month, day = F.substring(q["d"], 1, 4), F.substring(q["d"], 6, 2), F.substring(q["d"], 9, 2)
        s = F.substring(q["f"], 2, 1)
        return (
            F.when(q["f"].startswith("y"), F.concat(year, s, month, s, day))
            .when(q["f"].startswith("d"), F.concat(day, s, month, s, year))
            .otherwise(F.concat(month, s, day, s, year))
        )

    bound = F.struct(number(iso).alias("n"), form.alias("f"))
    return let(
        bound, lambda p: F.when(p["n"].between(0, DAYS - 1), let(F.struct(moved(p).alias("d"), p["f"].alias("f")), laid_out))
    )


def pseudonym(found: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one match of ANY other than groups of cards; null where it isn't valid after all."""

    def is_(kind: str) -> Column:
        return found.rlike(f"^(?:{KINDS[kind]})$")

    head = F.regexp_extract(found, "^([^=:]*[=:]\\s*[\"']?)", 1)
    value = F.substring(found, F.char_length(head) + 1, F.char_length(found))
    tail = F.regexp_extract(found, "(\\.[A-Za-z]+)$", 1)
    lead = F.regexp_extract(found, "^(\\+[0-9]{1,3}(?=[ .(\\-])|\\+[0-9]|)", 1)
    plain = F.lit(False)
    short = lambda c, n: F.substring(c, F.lit(1), F.char_length(c) - n)
    n_digits = F.char_length(digits_of(found))
    return (
        F.when(is_("secret"), F.concat(head, symbols_permuted(value, key, F.lit("secret"), value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), undo)))
        .when(is_("access_key"), F.concat(F.substring(found, 1, 4), symbols_permuted(F.substring(found, 5, 16), key, F.lit("access"), plain, undo)))
        .when(is_("email"), F.concat(symbols_permuted(short(found, F.char_length(tail)), key, F.lit("email"), plain, undo), tail))
        .when(is_("iban"), iban_pseudonym(found, key, undo))
        .when(is_("date"), date_pseudonym(found, key, undo))
        .when(is_("ip"), ip_pseudonym(found, key, undo))
        .when(is_("ip6"), ip6_pseudonym(found, key, undo))
        .when(is_("phone") & n_digits.between(8, 15), F.concat(lead, symbols_permuted(F.substring(found, F.char_length(lead) + 1, F.char_length(found)), key, F.lit("phone"), plain, undo)))
        .when(is_("ssn"), symbols_permuted(found, key, F.lit("ssn"), plain, undo))
    )


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced, and n_found (long): the values that have a pseudonym now.

    Found are secrets after a name such as ``token =``, access keys, e-mail
    addresses, account numbers with valid check digits, in groups of four too, dates
    of the calendar from 1900 to 2099, IPv4 addresses, IPv6 addresses that a host
    can have (written out in full afterwards), telephone numbers of 8 to 15 digits, social
    security numbers of assigned ranges, and card numbers with a valid checksum,
    beside other numbers too.
    What fails validation stays as it is. ``undo`` turns pseudonyms back, where
    permuting doesn't make another kind of value of them. Null texts become
    empty, other columns pass through, ids may be null. Each row is one on its own:
    equal rows stay separate and equal, an empty table stays empty.
    """
    text = whole(F.col("text"))

    def replaced(found: Column) -> Column:
        def one(m: Column) -> Column:
            # No other kind of 13 digits or more has digits and these two signs only.
            groups = m.rlike("^[0-9][0-9 \\-]*$") & (F.char_length(digits_of(m)) >= 13)
            single = let(pseudonym(m, key, undo), lambda p: F.struct(p.alias("p"), F.when(p.isNull(), 0).otherwise(1).alias("n")))
            return let(F.when(groups, cards_pseudonym(m, key, undo)).otherwise(single), lambda x: F.struct(m.alias("m"), x["p"].alias("p"), x["n"].alias("n")))

        made = F.transform(found, one)
        return let(
            made,
            lambda x: F.struct(
                F.array_join(
                    F.zip_with(
                        F.split(text, ANY), x, lambda gap, q: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(q["p"], q["m"], F.lit("")))
                    ),
                    "",
                ).alias("text"),
                F.aggregate(x, F.lit(0).cast("long"), lambda a, q: a + F.coalesce(q["n"], F.lit(0))).alias("n"),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    out = F.when(text.rlike("[0-9@=:]"), let(found, lambda f: F.when(F.size(f) > 0, replaced(f))))
    keyed = docs.select(F.struct("*").alias("__doc"), out.alias("__new"))
    names = [c for c in docs.columns if c not in ("text", "n_found")]
    return keyed.select(
        *[F.col(f"__doc.`{c}`").alias(c) for c in names],
        F.coalesce("__new.text", "__doc.text", F.lit("")).alias("text"),
        F.coalesce("__new.n", F.lit(0).cast("long")).alias("n_found"),
    )
