"""PII surrogates: detected entities get keyed replacements of the same type and format.

Kinds: email, iban, card, ssn, ipv4, phone (7 to 15 digits that are no date, span of years
or list of numbers), name (a title or courtesy form with capitalised names or initials).

An entity is made of parts, and each distinct part has one replacement: an e-mail's domain
and its local part within the domain, a name's given names and surname, or the normalised
number (digits, or an IBAN's letters and digits), which is then poured into the separators
of each place. Everything is drawn from an HMAC-SHA-512 of the part under the key, which
reaches the plan as a scalar subquery and so isn't shown in it.

Numbers go through a keyed permutation of their format's domain: a Feistel network over mixed
radices with cycle walking, P, conjugates a shift by a drawn number: x turns into
P(P^-1(x) + shift). So replacements are one to one without any look at other numbers, can't run
out, need no rounds, and none is its own original (a domain of one value has no other: phones of
zeros only stay). A replacement may be some other number's original, which is itself replaced.
Type consistency: cards keep their first digit and how far they are from passing the Luhn
check, IBANs keep country and their distance from the right check digits (00, 01 and 99 are
taken as wrong ones), social security numbers stay assignable, or stay wrong in the same
part, phones keep country code and leading zeros, octets keep their width and leading zeros.
About one phone of eight digits in a thousand reads as a date afterwards, as phones do.

Names and mails have no bound, so they are drawn and grow: letters keep script and case, given
names follow the title's gender and the word's script, surnames of scripts without a table are
drawn letter by letter. Where two parts of a kind share a replacement, or one equals an original
(given names excepted, they never stand for a person alone), all but the least get the next
attempt, with one syllable or letter more, until none is left; those attempts are joined to the
texts that hold the parts. Coreference: equal parts have equal replacements everywhere, so one
number in two ways of writing, or one surname under two titles, stays one; a name's words that
stand alone in the same text are replaced alike.

Null texts stay null, empty ones empty. Rows with equal texts get equal results. Other
columns, whatever their names, pass through unchanged; an input column `n_entities` is
replaced. An empty table gives an empty table. No repetition in a pattern recurses, so texts
and matches may have any length.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import Staged, once, read

#: The query's key. A deployment passes its own secret to `replace`.
QUERY_KEY = "op7 query key, not a secret"
KINDS = ("email", "iban", "ssn", "ipv4", "card", "phone", "name")
MALE = r"Mr|Sir|Lord|Herrn?|Monsieur|[Ss]e[ñn]or|Sr|Signor|Don|господин|г-н|κύριος"
FEMALE = r"Mrs|Ms|Miss|Madam|Lady|Frau|Fr[äa]ulein|Madame|Mme|Mlle|Mademoiselle|[Ss]e[ñn]ora|[Ss]e[ñn]orita|Sra|Srta|Signora|Do[ñn]a|госпожа|г-жа|κυρία"
OPEN = r"Dr|Prof|Doctor|Professor"
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
#: What digits may be besides phones: dates, spans of years, lists of numbers.
DATE = rf"(?:{_YEAR}[ ./-]{_MONTH}[ ./-]{_DAY}|{_DAY}[ ./-]{_DAY}[ ./-]{_YEAR}|{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])|{_YEAR}[ -]{_YEAR})(?![0-9])"
_EQUAL = ("[0-9]{2}(?: [0-9]{2})", "[0-9]{3}(?: [0-9]{3}){2}(?: [0-9]{3})", "[0-9]{4}(?: [0-9]{4})", "[0-9]{1,15}0(?: [0-9]{1,15}0)")
#: A list of 16 numbers is one whatever follows; so no place looks farther ahead.
LIST = f"(?:(?:{'|'.join(p + '{1,15}+' for p in _EQUAL)})(?![ .-]?[0-9])|{'|'.join(p + '{15}' for p in _EQUAL)})"
#: At least 7 digits each: with a country's prefix, an area in brackets, a leading 0, in one piece, in two, in more.
_PHONES = (
    r"\+[0-9](?:[ ./-]?[0-9]|[ ./-]?\([0-9]{1,4}\)){6,14}",
    r"\([0-9]{2,5}\)[ -]?(?:[0-9]{5,10}|[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,4}|[0-9]{3,4}[ .-][0-9]{2,8}|[0-9]{2}[ .-][0-9]{3,8})",
    rf"(?!{DATE})0[0-9]{{1,5}}(?:[ /-][0-9]{{5,10}}|(?:[ .-][0-9]{{2,4}}){{3,5}}|[ /-][0-9]{{3,4}}[ .-][0-9]{{2,8}})",
    rf"(?!{DATE})(?!{LIST})(?:[0-9]{{7,15}}|[0-9]{{2,4}}-[0-9]{{5,11}}|[0-9]{{3,4}}-[0-9]{{4}}|[0-9]{{2,5}} [0-9]{{6,10}})",
    rf"(?!{DATE})(?!{LIST})(?:1[ .-])?(?:(?:[0-9]{{2,4}}[ .-]){{3,5}}[0-9]{{2,4}}|[0-9]{{3,4}}[ .-][0-9]{{2,4}}[ .-][0-9]{{2,8}}|[0-9]{{2}}[ .-][0-9]{{3,4}}[ .-][0-9]{{2,8}}|[0-9]{{2}}[ .-][0-9]{{2}}[ .-][0-9]{{3,8}})",
)
#: Country calling codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Words of names with inner capitals, hyphens and apostrophes (but no possessive s), initials, and particles before words.
_INNER = r"(?:\p{L}|['’-](?=\p{L})(?!s(?!\p{L})))*+"
_WORD = rf"\p{{Lu}}{_INNER}"
_LINK = r"(?:(?:von|van|de|der|den|del|della|di|da|dos|la|le|du|zu|zur|ter|bin|ibn|al)\x20)*+"
_PART = rf"{_LINK}(?:\p{{Lu}}\.(?=\x20{_LINK}\p{{Lu}})|{_WORD})"
#: Words of scripts without capitals, where a name's end can't be seen: up to three of them count.
_BARE = rf"\p{{Lo}}{_INNER}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "card": r"(?<![\p{L}0-9])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}0-9])",
    "phone": rf"(?<![\p{{L}}0-9+])(?<![0-9][.,:/-])(?:{'|'.join(_PHONES)})(?![\p{{L}}0-9])",
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{OPEN})\.?\x20(?:{_PART}(?:\x20{_PART})*+|{_BARE}(?:\x20{_BARE}){{0,2}}+)(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TOKEN = rf"\p{{L}}{_INNER}|[^\p{{L}}]++"
#: Letters by script, small and capital in the same order; accented Latin letters, and those of scripts neither here nor below, turn into plain Latin ones.
LETTERS = {
    "Cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも",
    "Han": "山川水火木金土田石林花草春夏秋冬東西南北天地日月星雲風雨雪海",
    "Latin": "abcdefghijklmnopqrstuvwxyz",
}
#: Scripts whose letters stand in a row, by their first and last.
_ROWS = {"Armenian": "աֆ", "Georgian": "აჰ", "Katakana": "アン", "Hangul": "가힣", "Thai": "กฮ", "Bengali": "কহ", "Tamil": "கஹ", "Telugu": "కహ", "Gujarati": "કહ", "Gurmukhi": "ਕਹ", "Kannada": "ಕಹ", "Malayalam": "കഹ", "Ethiopic": "ሀፐ", "Khmer": "កហ", "Lao": "ກຮ", "Sinhala": "කෆ", "Myanmar": "ကအ"}
LETTERS = {k: "".join(c for c in map(chr, range(ord(v[0]), ord(v[1]) + 1, 1 if k != "Hangul" else 28)) if unicodedata.category(c) in ("Lo", "Ll")) for k, v in _ROWS.items()} | LETTERS
#: Given names by script and gender (names in use for both under "o").
GIVEN = {
    ("Latin", "m"): "Adam Albert Andrew Anton Arthur Bernard Charles Daniel David Edgar Edward Felix Francis Frederick George Gregory Harold Henry Hugo Jacob James Joseph Julian Leon Louis Marcus Martin Matthew Michael Nathan Oliver Oscar Patrick Paul Peter Philip Ralph Robert Samuel Simon Stephen Theodore Thomas Victor Vincent Walter William",
    ("Latin", "f"): "Ada Agnes Alice Amelia Anna Beatrice Bertha Caroline Catherine Cecilia Charlotte Clara Diana Dorothy Edith Eleanor Elizabeth Emily Emma Esther Eva Florence Frances Gertrude Grace Hannah Helen Ida Irene Jane Josephine Julia Laura Lucy Margaret Martha Mary Matilda Nora Olivia Rachel Rose Ruth Sarah Sophia Theresa Victoria",
    ("Latin", "o"): "Alexis Andrea Ariel Avery Camille Casey Charlie Dominique Eden Francis Gabriele Jamie Jean Jordan Kim Leslie Lou Marion Morgan Nicola Noel Robin Sascha Sidney Taylor Toni",
    ("Cyrillic", "m"): "Александр Алексей Андрей Антон Артём Борис Вадим Валентин Виктор Виталий Владимир Георгий Григорий Денис Дмитрий Егор Захар Кирилл Константин Максим Николай Олег Павел Роман Сергей Степан Тимофей Юрий",
    ("Cyrillic", "f"): "Алина Ангелина Анна Антонина Арина Валентина Галина Диана Екатерина Елена Жанна Зарина Инна Ирина Карина Кристина Марианна Марина Милана Нина Полина Регина Светлана Татьяна Ульяна Эвелина Яна",
    ("Greek", "m"): "Αλέξανδρος Ανδρέας Αντώνης Βασίλης Γιώργος Γιάννης Δημήτρης Ηλίας Θωμάς Κώστας Λεωνίδας Μάριος Μιχάλης Νίκος Παύλος Πέτρος Σπύρος Στέφανος Χρήστος",
    ("Greek", "f"): "Αγγελική Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ευαγγελία Ιωάννα Κατερίνα Μαρία Μαρίνα Νίκη Όλγα Παναγιώτα Σοφία Φωτεινή Χριστίνα",
}
#: Beginnings, middles and endings that surnames are put together from, by script.
SURNAME = {
    "Latin": (
        "Alder Ash Barn Birch Black Brad Brook Carl Clay Cole Crom Dal Den East Ed Elm Fair Farn Gold Green Hal Ham Hart Haw Hill Hol Kel Kirk Lang Lind Marl Mil Nor Oak Old Pem Pres Red Rock Rose Sand Shel Stan Stock Sutter Thorn Wal War West White Wil Win Wood York".split(),
        "ba ve go da se ki la mi no ra so ti".split(),
        "man son berg ton ley well worth stein ford field wick by dale more ner gate".split(),
    ),
    "Cyrillic": (
        "Алт Бел Бор Вер Вол Гор Гром Дол Дуб Ель Жар Звез Зим Кал Кам Кед Клен Лес Лип Луг Мед Мор Нов Озер Ос Пол Род Руч Сад Сев Сос Степ Тих Холм Яс".split(),
        "ба ве го да за ки ла ми но ра со ти".split(),
        "ов ев ин ков анов иков инов аров".split(),
    ),
    "Greek": (
        "Αλεξ Ανδρ Βασιλ Γεωργ Δημ Θεοδ Καλ Καρ Κωνστ Λαμπρ Μακρ Μαρ Νικολ Παπ Παυλ Πετρ Σαρρ Σταυρ Τριαντ Φιλ Χρυσ".split(),
        "βα γε δο ζα κι λα μι νο ρα σο τι πε".split(),
        "ίδης άκης όπουλος άτος έας ίκος ούρης ιάδης".split(),
    ),
}
ROUNDS = 50


def _kind(value: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k in KINDS:
        out = out.when(value.rlike(f"^(?:{PATTERNS[k]})$"), k)
    # what follows a match in its text may have decided how long it is
    return out.otherwise(F.when(value.rlike(r"^\p{L}"), "name").otherwise("phone"))


def _pads(spark: SparkSession, key: str) -> tuple[Column, Column]:
    """Inner and outer block of HMAC-SHA-512 under the key, as scalar subqueries: the plan doesn't show them."""
    own = key.encode()
    own = (hashlib.sha512(own).digest() if len(own) > 128 else own).ljust(128, b"\0")
    row = spark.createDataFrame([(bytearray(x ^ 0x36 for x in own), bytearray(x ^ 0x5C for x in own))], "inner binary, outer binary")
    return row.select("inner").scalar(), row.select("outer").scalar()


def _mac(*parts: Column | str) -> Column:
    """128 hexadecimal digits: HMAC-SHA-512 of the parts under the key whose blocks are the columns __inner and __outer."""
    message = F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary")
    return F.sha2(F.concat(F.col("__outer"), F.unhex(F.sha2(F.concat(F.col("__inner"), message), 512))), 512)


def _draw(noise: Column, i: Column | int, below: Column | int) -> Column:
    """The i-th number below `below` that the noise gives; it repeats after 31 places."""
    i, below = (F.lit(x) if isinstance(x, int) else x for x in (i, below))
    return F.pmod(F.conv(F.substr(noise, F.pmod(i, F.lit(31)) * 4 + 1, F.lit(4)), 16, 10).cast("long"), below).cast("int")


def _letter(c: Column, i: Column, noise: Column) -> Column:
    out = F.when(c.rlike("[0-9]"), _draw(noise, i, 10).cast("string"))
    for script, letters in LETTERS.items():
        of = r"\p{L}" if script == "Latin" else rf"\p{{Is{script}}}"
        place = _draw(noise, i, len(letters)) + 1
        out = out.when(c.rlike(rf"(?={of})\p{{Lu}}"), F.substr(F.lit(letters.upper()), place, F.lit(1))).when(c.rlike(rf"(?={of})\p{{L}}"), F.substr(F.lit(letters), place, F.lit(1)))
    return out.otherwise(c)


def _reshaped(value: Column, noise: Column) -> Column:
    """Every digit and letter drawn anew, the rest as it is."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: _letter(c, i, noise)), "")


def _poured(number: Column, value: Column) -> Column:
    """The digits and letters of `number` in the places of those of `value`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    done = F.aggregate(
        F.split(value, ""), start,
        lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["out"], F.substr(number, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
    )
    return done["out"]


def _digits(count: int, number: Column) -> Column:
    return F.lpad(number.cast("string"), count, "0")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


ROUNDS_OF_FEISTEL, WALK, BLOCK = 8, 64, 12


def _round(v: Column, i: Column, half: Column) -> Column:
    return F.conv(F.substr(_mac(v["tweak"], i.cast("string"), half.cast("string")), F.lit(1), F.lit(15)), 16, 10).cast("long")


def _walked(v: Column, x: Column, back: bool = False) -> Column:
    """A keyed permutation of 0 .. m - 1, or its inverse: a Feistel network over a * b >= m numbers, again where it
    leaves the domain. Numbers outside are fewer than a: below m = 4,096 WALK steps always lead back, above it all
    but never (64 ^ -64) don't, and then the job fails rather than give two numbers one replacement."""
    sign = -1 if back else 1

    def step(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["l"] + sign * F.pmod(_round(v, i, s["r"]), v["a"]), v["a"]).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * F.pmod(_round(v, i, s["l"]), v["b"]), v["b"]).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    order = F.array(*(F.lit(i) for i in (range(ROUNDS_OF_FEISTEL)[::sign])))
    once_ = lambda y: F.aggregate(order, F.struct(_div(y, v["b"]).alias("l"), F.pmod(y, v["b"]).alias("r")), step, lambda s: s["l"] * v["b"] + s["r"])
    again = lambda s, i: F.when((s["n"] > 0) & (s["y"] < v["m"]), s).otherwise(F.struct(once_(s["y"]).alias("y"), (s["n"] + 1).alias("n")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(x.alias("y"), F.lit(0).alias("n")), again, lambda s: s["y"])
    return _let(found, lambda y: F.when(y < v["m"], y).otherwise(F.raise_error(F.lit("a permutation left its domain"))))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _block(places: Column, tweak: Column) -> Column:
    """Digits of the number that stands for that of `places`, an array of (d, r): digits d below r, 2^62 numbers at most."""
    m = F.aggregate(places, F.lit(1).cast("long"), lambda p, v: p * v["r"])
    x = F.aggregate(places, F.lit(0).cast("long"), lambda p, v: p * v["r"] + v["d"])
    shift = lambda v: 1 + F.pmod(_round(v, F.lit(-1), F.lit(0)), v["m"] - 1)
    put = lambda v: F.when(v["m"] < 2, v["x"]).otherwise(_walked(v, _let(_walked(v, v["x"], back=True), lambda y: F.pmod(y + shift(v), v["m"]))))
    halves = lambda v: F.struct(v["x"].alias("x"), v["m"].alias("m"), v["tweak"].alias("tweak"), v["a"].alias("a"), _div(v["m"] + v["a"] - 1, v["a"]).alias("b"))
    root = F.greatest(F.lit(1).cast("long"), F.ceil(F.sqrt(m.cast("double"))).cast("long"))
    new = _let(F.struct(x.alias("x"), m.alias("m"), tweak.alias("tweak"), root.alias("a")), lambda v: _let(halves(v), put))
    start = F.struct(new.alias("y"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(F.reverse(places), start, lambda s, v: F.struct(_div(s["y"], v["r"]).alias("y"), F.concat(F.array(F.pmod(s["y"], v["r"])), s["out"]).alias("out")), lambda s: s["out"])


def _permuted(places: Column, tweak: Column) -> Column:
    """New digits for `places`, in blocks of BLOCK; what a block turns into goes into the next one's tweak."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(places) - 1) / BLOCK).cast("int")), lambda j: F.slice(places, j * BLOCK + 1, F.lit(BLOCK)))
    none = F.expr("cast(array() as array<bigint>)")
    done = F.aggregate(blocks, none, lambda out, block: F.concat(out, _block(block, F.concat_ws("\x1e", tweak, F.array_join(out.cast("array<string>"), ",")))))
    return F.when(F.size(places) > 0, done).otherwise(none)


def _place(d: Column, r: Column | int) -> Column:
    return F.struct(d.cast("long").alias("d"), (F.lit(r) if isinstance(r, int) else r).cast("long").alias("r"))


def _chars(value: Column) -> Column:
    """Places of digits and capital letters."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), _place(c.try_cast("int"), 10)).otherwise(_place(F.ascii(c) - 65, 26)))


def _as_chars(value: Column, new: Column) -> Column:
    """The new digits in the kinds of characters that `value` has."""
    return F.array_join(F.zip_with(F.split(F.substr(value, F.lit(1), F.size(new)), ""), new, lambda c, d: F.when(c.rlike("[0-9]"), d.cast("string")).otherwise(F.char(d + 65))), "")


def _luhn_digit(body: Column) -> Column:
    ten = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    return F.get(F.filter(ten, lambda d: F.call_function("luhn_check", F.concat(body, d))), F.lit(0)).cast("int")


def _iban_digits(country: Column, body: Column) -> Column:
    """The right check digits, as a number."""
    number = F.transform(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.try_cast("int")))
    return 98 - F.aggregate(number, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))


def _number(norm: Column, part: Column) -> tuple[Column, Column, Column]:
    """For each kind of number: what stays in front, its class within the kind, and the places that are permuted."""
    sub = lambda i, n: F.substr(norm, F.lit(i), F.lit(n))
    area, group, serial = (sub(i, n).try_cast("int") for i, n in ((1, 3), (4, 2), (6, 4)))
    bad = (area == 0) | (area == 666) | (area >= 900)
    kind = F.when(bad, "a").when(group == 0, "g").when(serial == 0, "s").otherwise("v")
    good_area = _place(area - F.when(area > 666, 2).otherwise(1), 898)
    ssn = (
        F.when(bad, F.array(_place(F.when(area == 0, 0).when(area == 666, 1).otherwise(area - 898), 102), _place(group, 100), _place(serial, 10_000)))
        .when(group == 0, F.array(good_area, _place(serial, 10_000))).when(serial == 0, F.array(good_area, _place(group - 1, 99)))
        .otherwise(F.array(good_area, _place(group - 1, 99), _place(serial - 1, 9_999)))
    )
    head = F.regexp_extract(norm, rf"(?:{COUNTRY})?0*", 0)
    rest = F.substr(norm, F.length(head) + 1)
    phone = F.transform(_chars(rest), lambda v, i: F.when(i == 0, _place(v["d"] - 1, 9)).otherwise(v))
    octets = F.transform(F.split(norm, r"\."), lambda o: F.when((F.length(o) > 1) & o.startswith("0"), _place(o.try_cast("int"), F.when(F.length(o) == 2, 10).otherwise(100))).when(F.length(o) == 1, _place(o.try_cast("int"), 10)).when(F.length(o) == 2, _place(o.try_cast("int") - 10, 90)).otherwise(_place(o.try_cast("int") - 100, 156)))
    lead = F.array_join(F.transform(F.split(norm, r"\."), lambda o: F.concat(F.length(o).cast("string"), F.when((F.length(o) > 1) & o.startswith("0"), "z").otherwise(""))), ".")
    front = F.when(part == "phone", head).when(part == "iban", sub(1, 2)).when(part == "card", sub(1, 1)).when(part == "ipv4", lead).otherwise("")
    kinds = F.when(part == "ssn", kind).when(part == "iban", F.translate(F.substr(norm, F.lit(5)), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 10 + "A" * 26)).otherwise(F.length(norm).cast("string"))
    places = F.when(part == "phone", phone).when(part == "iban", _chars(F.substr(norm, F.lit(5)))).when(part == "card", _chars(F.substr(norm, F.lit(2), F.length(norm) - 2))).when(part == "ipv4", octets).otherwise(ssn)
    return front, kinds, places


def _number_from(norm: Column, part: Column, front: Column, kinds: Column, new: Column) -> Column:
    """The number that the new digits make, with check digits as far from right as they were."""
    two = lambda n, width: F.lpad(n.cast("string"), width, "0")
    at = lambda i: F.get(new, F.lit(i))
    bad_area = F.when(at(0) == 0, 0).when(at(0) == 1, 666).otherwise(at(0) + 898)
    good_area = at(0) + F.when(at(0) >= 665, 2).otherwise(1)
    ssn = (
        F.when(kinds == "a", F.concat(two(bad_area, 3), two(at(1), 2), two(at(2), 4))).when(kinds == "g", F.concat(two(good_area, 3), F.lit("00"), two(at(1), 4)))
        .when(kinds == "s", F.concat(two(good_area, 3), two(at(1) + 1, 2), F.lit("0000"))).otherwise(F.concat(two(good_area, 3), two(at(1) + 1, 2), two(at(2) + 1, 4)))
    )
    phone = F.concat(F.regexp_replace(front, r"\+", ""), F.array_join(F.transform(new, lambda d, i: F.when(i == 0, d + 1).otherwise(d).cast("string")), ""))
    old_body = F.substr(norm, F.lit(1), F.length(norm) - 1)
    body = F.concat(front, F.array_join(new.cast("array<string>"), ""))
    off = F.substr(norm, F.length(norm), F.lit(1)).try_cast("int") - _luhn_digit(old_body)
    card = _let(body, lambda x: F.concat(x, F.pmod(_luhn_digit(x) + off, F.lit(10)).cast("string")))
    old = F.substr(norm, F.lit(5))
    away = F.substr(norm, F.lit(3), F.lit(2)).try_cast("int") - _iban_digits(front, old)
    iban = _let(_as_chars(old, new), lambda x: F.concat(front, two(F.pmod(_iban_digits(front, x) + away, F.lit(100)), 2), x))
    ipv4 = F.array_join(F.zip_with(F.split(front, r"\."), new, lambda w, d: F.when(w.endswith("z"), two(d, F.substr(w, F.lit(1), F.lit(1)).try_cast("int"))).when(w == "1", d.cast("string")).when(w == "2", (d + 10).cast("string")).otherwise((d + 100).cast("string"))), ".")
    return F.when(part == "phone", phone).when(part == "iban", iban).when(part == "card", card).when(part == "ipv4", ipv4).otherwise(ssn)


NUMBERS = ("iban", "ssn", "ipv4", "card", "phone")


def numbers(parts: DataFrame, key: str) -> DataFrame:
    """`parts` (part, norm) of NUMBERS with `s`, what each turns into: one to one within each format."""
    part, norm = F.col("part"), F.col("norm")
    inner, outer = _pads(parts.sparkSession, key)
    front, kinds, places = _number(norm, part)
    split = parts.select("*", once(F.struct(front.alias("front"), kinds.alias("kinds"), places.alias("places"))).alias("q"))
    split = split.withColumns({"__inner": inner, "__outer": outer})
    new = split.select(*parts.columns, "q", once(_permuted(F.col("q.places"), F.concat_ws("\x1f", part, F.col("q.front"), F.col("q.kinds")))).alias("new"))
    return new.select(*parts.columns, _number_from(norm, part, F.col("q.front"), F.col("q.kinds"), F.col("new")).alias("s"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}$"), "Cyrillic").when(word.rlike(r"\p{IsGreek}$"), "Greek").when(word.rlike(r"\p{IsLatin}['’-]*$"), "Latin").otherwise("Other")


def _one(words: list[str], noise: Column, i: int) -> Column:
    return F.get(F.array(*map(F.lit, words)), _draw(noise, i, len(words)))


def _middle(script: str, noise: Column, count: Column) -> Column:
    of = F.array(*map(F.lit, SURNAME[script][1]))
    return F.when(count < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.get(of, _draw(noise, i + 3, 12))), ""))


def _surname(script: str, noise: Column, attempt: Column) -> Column:
    """One more syllable for each attempt."""
    begin, _, end = SURNAME[script]
    return F.concat(_one(begin, noise, 0), _middle(script, noise, attempt), _one(end, noise, 1))


def _given(script: str, gender: str, noise: Column, attempt: Column) -> Column:
    """A name of the table, at the next attempt two, then one with more and more syllables."""
    names = (GIVEN.get((script, gender)) or f"{GIVEN[script, 'm']} {GIVEN[script, 'f']}").split()
    more = F.when(attempt == 1, _one(names, noise, 2)).otherwise(F.initcap(_middle(script, noise, attempt + 1)))
    return F.when(attempt == 0, _one(names, noise, 0)).otherwise(F.concat_ws("-", _one(names, noise, 0), more))


def _masculine(word: Column) -> Column:
    """A surname as it is compared: a Slavic feminine ending counts as the masculine one."""
    return F.regexp_replace(F.lower(word), "(?<=[оеё]в|ин)а$", "")


def _gender(value: Column) -> Column:
    return F.when(value.rlike(rf"^(?:{FEMALE})[. ]"), "f").when(value.rlike(rf"^(?:{MALE})[. ]"), "m").otherwise("o")


def _mentioned_parts(entities: DataFrame) -> DataFrame:
    """(id, i, word, part, norm): what each of the `entities` (id, kind, value) is made of, in order."""
    value, kind = F.col("value"), F.col("kind")
    mails = entities.where("kind = 'email'")
    mail_parts = F.array(F.struct(F.lit("email").alias("part"), F.lower(value).alias("norm")), F.struct(F.lit("domain").alias("part"), F.lower(F.substring_index(value, "@", -1)).alias("norm")))
    mails = mails.select("id", F.posexplode(mail_parts).alias("i", "x")).select("id", "i", F.lit("").alias("word"), "x.*")
    only = lambda keep: F.regexp_replace(value, keep, "")
    norm = F.when(kind == "iban", only("[^A-Z0-9]")).when(kind == "phone", only("[^+0-9]")).when(kind == "ipv4", value).otherwise(only("[^0-9]"))
    figures = entities.where("kind not in ('email', 'name')").select("id", F.lit(0).alias("i"), F.lit("").alias("word"), kind.alias("part"), norm.alias("norm"))
    names = entities.where("kind = 'name'").select("id", _gender(value).alias("gender"), F.split(value, " ").alias("words"))
    names = names.select("id", "gender", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    word = F.col("word")
    role = (
        F.when((F.col("i") == 0) | word.rlike(r"^\p{Ll}") & ~word.rlike(r"^\p{IsGeorgian}"), "as it is").when(word.rlike(r"^\p{Lu}\.$"), "initial")
        .when(F.col("i") == F.col("n") - 1, F.concat(F.lit("surname."), _script(word))).otherwise(F.concat(F.lit("given."), _script(word), F.lit("."), F.col("gender")))
    )
    names = names.select("id", "i", "word", role.alias("part"))
    names = names.withColumn("norm", F.when(F.col("part").startswith("surname"), _masculine(word)).otherwise(F.lower("word")))
    return mails.unionByName(figures).unionByName(names)


def _made(parts: DataFrame, key: str) -> DataFrame:
    """`parts` (part, norm, attempt) of names and mails with `s`, what each turns into."""
    part, norm, attempt, noise = F.col("part"), F.col("norm"), F.col("attempt"), F.col("noise")
    inner, outer = _pads(parts.sparkSession, key)
    parts = parts.withColumns({"__inner": inner, "__outer": outer}).select("part", "norm", "attempt", once(_mac(part, norm, attempt.cast("string"))).alias("noise"))
    tld = F.substring_index(norm, ".", -1)
    body = F.substr(norm, F.lit(1), F.length(norm) - F.length(tld) - 1)
    more = F.when(attempt < 4, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(4), F.greatest(attempt, F.lit(4))), lambda i: F.substr(F.lit(LETTERS["Latin"]), _draw(noise, i + 11, 26) + 1, F.lit(1))), ""))
    out = F.when(part == "domain", F.concat(_reshaped(body, noise), more, F.lit("."), tld))
    out = out.when(part == "email", F.concat(_reshaped(F.substring_index(norm, "@", 1), noise), more, F.lit("@"), F.substring_index(norm, "@", -1)))
    out = out.when(part == "initial", F.upper(_reshaped(norm, noise)))
    longer = F.concat(norm, F.repeat(F.substr(norm, F.lit(1), F.lit(1)), attempt))
    out = out.when(part.startswith("surname.Other") | part.startswith("given.Other"), F.initcap(_reshaped(longer, noise)))
    for script in SURNAME:
        out = out.when(part == f"surname.{script}", _surname(script, noise, attempt))
        for gender in "mfo":
            out = out.when(part == f"given.{script}.{gender}", _given(script, gender, noise, attempt))
    return parts.withColumn("s", out).drop("noise")


def replacements(mentioned: DataFrame, key: str) -> DataFrame:
    """(part, norm, s) for the distinct parts of `mentioned`: numbers by permutation, names and mails free of collisions."""
    every = Staged(mentioned.where("part != 'as it is'").select("part", "norm").distinct(), "distinct-parts").df
    number = F.col("part").isin(*NUMBERS)
    by_format = Staged(numbers(every.where(number), key), "numbers").df
    table = Staged(_made(every.where(~number).withColumn("attempt", F.lit(0)), key), "parts").df
    strict = "part != 'initial' and part not like 'given.%'"
    originals = table.where(strict).select("part", F.col("norm").alias("low")).distinct()
    for _ in range(ROUNDS):
        own = table.where("part != 'initial'").withColumn("low", F.lower("s"))
        least = own.groupBy("part", "low").agg(F.count("*").alias("n"), F.min("norm").alias("first")).where("n > 1").select("part", "low", "first")
        shared = own.join(least, ["part", "low"]).where("norm != first").select("part", "norm")
        taken = own.join(originals, ["part", "low"], "left_semi").select("part", "norm")
        again = Staged(shared.unionByName(taken).distinct(), "collisions").df
        if not again.limit(1).count():
            return by_format.unionByName(table.select("part", "norm", "s"))
        kept = table.join(again, ["part", "norm"], "left_anti")
        next_ = _made(table.join(again, ["part", "norm"], "left_semi").select("part", "norm", (F.col("attempt") + 1).alias("attempt")), key)
        table = Staged(kept.unionByName(next_), "parts").df
    raise RuntimeError("names or mails go on colliding")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, put) for the distinct `entities` (kind, value)."""
    entities = Staged(entities.withColumn("id", F.md5(F.concat_ws(":", "kind", "value"))), "entities").df
    mentioned = Staged(_mentioned_parts(entities), "entity-parts").df
    made = replacements(mentioned, key)
    word, s, role = F.col("word"), F.col("s"), F.col("part")
    # a surname compared in its masculine form gets its ending back; capitals stay capitals
    ended = F.when(role.startswith("surname") & (_masculine(word) != F.lower(word)), F.concat(s, F.lit("а"))).otherwise(s)
    like = F.when((F.upper(word) == word) & (F.length(word) > 1) & (role != "initial"), F.upper(ended)).otherwise(ended)
    joined = mentioned.join(made, ["part", "norm"], "left").select("id", "i", F.when(role == "as it is", word).when(word != "", like).otherwise(s).alias("s"))
    whole = entities.join(joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "s")))["s"].alias("s")), "id")
    value, first = F.col("value"), F.get("s", F.lit(0))
    cased = F.array_join(F.zip_with(F.split(F.substring_index(first, "@", 1), ""), F.split(F.substring_index(value, "@", 1), ""), lambda a, b: F.when(b.rlike(r"\p{Lu}"), F.upper(a)).otherwise(F.coalesce(a, F.lit("")))), "")
    mail = F.concat(cased, F.lit("@"), F.get("s", F.lit(1)))
    put = F.when(F.col("kind") == "email", mail).when(F.col("kind") == "name", F.array_join("s", " ")).when(F.col("kind") == "ipv4", first).otherwise(_poured(first, value))
    return whole.select("kind", "value", put.alias("put"))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with its text rewritten, and n_entities, the number of entities found."""
    kept = [c for c in docs.columns if c != "n_entities"]
    # most texts have none of these characters or titles, which are cheaper to look for
    has = (F.col("text").rlike("[0-9@]") | F.col("text").rlike(PATTERNS["name"])) & F.col("text").rlike(ANY)
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    each = docs.where(has).select(F.md5("text").alias("text_key"), F.posexplode(found).alias("i", "value")).distinct()
    each = Staged(each.withColumn("kind", _kind(F.col("value"))), "mentions").df
    made = Staged(surrogates(each.select("kind", "value").distinct(), key), "surrogates").df
    in_text = each.join(made, ["kind", "value"]).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("i", "value", "put", "kind"))).alias("made"))
    rows = docs.where(has).select(F.struct(*kept).alias("row"), "text", F.md5("text").alias("text_key")).join(in_text, "text_key")
    names = F.array_distinct(F.transform(F.filter("made", lambda e: e["kind"] == "name"), lambda e: F.struct(e["value"], e["put"])))
    alone = F.flatten(F.transform(names, lambda e: F.arrays_zip(F.split(e["value"], " ").alias("w"), F.split(e["put"], " ").alias("p"))))
    alone = F.filter(alone, lambda x: x["w"].rlike(r"^\p{Lu}\p{L}") & (x["w"] != x["p"]))
    rows = rows.select("row", "made", F.split("text", ANY, -1).alias("gaps"), F.array_distinct(alone).alias("alone"))
    # words of names where they stand alone in the text
    swap = lambda gap: F.array_join(F.transform(F.regexp_extract_all(gap, F.lit(_TOKEN), F.lit(0)), lambda t: F.coalesce(F.get(F.col("alone.p"), (F.array_position(F.col("alone.w"), t) - 1).cast("int")), t)), "")
    rows = rows.withColumn("gaps", F.when(F.size("alone") > 0, F.transform("gaps", swap)).otherwise(F.col("gaps")))
    text = F.concat(F.array_join(F.zip_with(F.slice("gaps", 1, F.size("made")), "made", lambda gap, e: F.concat(gap, e["put"])), ""), F.element_at("gaps", -1))
    changed = rows.select("row", text.alias("text"), F.size("made").cast("long").alias("n_entities"))
    same = docs.where(F.coalesce(~has, F.lit(True))).select(F.struct(*kept).alias("row"), "text", F.lit(0).cast("long").alias("n_entities"))
    out = changed.unionByName(same)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in kept), "n_entities")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(read(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
