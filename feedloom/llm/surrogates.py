"""PII surrogates: every detected entity gets a keyed replacement of its own type and format.

Detection is one pattern over the text. A replacement is a keyed permutation of the strings of the
entity's format: a Feistel network over the two halves of its characters, in which each
character moves within its own alphabet (digits, upper and lower case of its script) by an amount that
a keyed SHA-256 of the other half gives. A permutation keeps what a table would have to check:

* distinctness: two entities of a format never get the same surrogate;
* coreference: the same entity gets the same surrogate in every document and every run with the
  same key, with no table of entities to build, join or keep secret beside the key. What is permuted is the entity without its
  layout (the digits of cards and phones, an address in lower case, an IBAN without spaces); the layout is put back after;
* format and script: punctuation, case, length and alphabet stay. Country codes of phones, the first
  digit of cards, countries of IBANs, prefixes of access keys and names of settings stay too; check digits of cards (Luhn) and
  IBANs (mod 97) are valid after if they were valid before; addresses get a name under a reserved domain.

Names behind titles get a given name of the person's gender in the name's script, joined to the permuted
one, so they stay distinct too. The given name tells the gender, not the title, so that a person stays one; one that no list
has gets a name of either gender. A family name is permuted by itself, vowels among vowels and consonants among consonants, whatever its
capitals, so "Mr A B", "Prof. A B" and "MR B" stay one person and it reads like a name. Names without a title aren't found. collisions() checks distinctness on real data; the query
runs it over all documents and fails if it finds any.

All work is built-in expressions on one row; nothing is shuffled.

Defined cases: a null text stays null; empty texts and texts without entities stay as they are; very long texts
are used whole, and entities of any length; repeated rows are replaced alike; an empty table gives no rows; other columns are kept as they
are, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free

KEY = "feedloom-surrogates-1"
ROUNDS = 4

#: Alphabets within which characters move.
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
CYRILLIC = "".join(map(chr, range(0x430, 0x450)))
GREEK = "".join(map(chr, [*range(0x3B1, 0x3C2), *range(0x3C3, 0x3CA)]))
#: Vowels of the scripts; the other letters are consonants.
VOWELS = "aeiouy" + "àáâãäåæèéêëìíîïòóôõöøùúûüý" + "аеиоуыэюя" + "αεηιουω"
TEXTUAL = (DIGITS, LOWER, LOWER.upper(), ACCENTED, ACCENTED.upper(), CYRILLIC, CYRILLIC.upper(), GREEK, GREEK.upper())
_SOUNDS = tuple("".join(c for c in a if (c in VOWELS) == v) for a in (LOWER, ACCENTED, CYRILLIC, GREEK) for v in (True, False))
SOUNDS = (*_SOUNDS, *(a.upper() for a in _SOUNDS))

#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Rafael Simon Tomas Victor".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Frida Greta Helena Ines Julia Klara Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Римма".split(),
    ("m", "greek"): "Αντώνης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λευτέρης Μάριος Νίκος Πέτρος Σταύρος".split(),
    ("f", "greek"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Λίνα Μαρία Νίκη Σοφία Χρυσή".split(),
}
#: Given names that say nothing about gender.
EITHER = "Alex Ariel Charlie Chris Eli Jamie Jules Kai Kim Luca Morgan Noel Robin Sam Sascha Toni".split()
#: Usual given names, by which a person's gender is told whatever stands before the name.
MEN = (
    "Adam Alan Albert Alberto Alejandro Alessandro Alexander Alfred Ali Anders Andrew Antoine Antonio Arthur Ben Benjamin Bernard Bruno Carl Carlos Charles Christian Christopher Claude Daniel David Diego "
    "Dominik Edward Emil Enrique Eric Fabian Felix Fernando Francesco Francisco Frank François Frederick Gabriel Georg George Giovanni Hans Heinrich Henri Henry Hugo Ivan Jack Jacob Jacques James Jan Javier Jean "
    "Joachim Johannes John Jonas Jorge José Joseph Juan Julian Jürgen Karl Kevin Klaus Lars Leon Louis Ludwig Luigi Luis Lukas Manuel Marc Marco Mario Mark Markus Martin Matthew Max Michael Michel Miguel Mohammed "
    "Nicolas Nils Oliver Oscar Otto Pablo Patrick Paul Pedro Peter Philip Pierre Rafael Ralf Richard Robert Roberto Roger Roland Samuel Sebastian Simon Stefan Stephen Sven Thomas Tim Tobias Tomas Victor Vincent Walter "
    "William Wolfgang Антон Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Илья Максим Михаил Никита Николай Олег Павел Пётр Роман Сергей Фома Юрий"
).split()
WOMEN = (
    "Ada Agnes Alice Ana Andrea Angela Anita Anna Anne Annette Barbara Beatrice Berta Birgit Brigitte Camille Carla Carmen Carol Caroline Catherine Charlotte Chloé Christine Clara Claire Claudia Cristina Deborah Diana "
    "Doris Dorothea Edith Elena Elisabeth Elizabeth Ella Emily Emma Erika Esther Eva Frida Gabriele Giulia Grace Greta Hannah Heidi Helen Helena Helga Ida Inès Ines Ingrid Irene Isabel Isabella Jane Janet Jennifer Jessica "
    "Joan Judith Julia Julie Karin Karen Katharina Klara Laura Linda Lisa Louise Lucia Lucy Luisa Margaret Margarita Maria María Marie Marta Martha Mary Mercedes Mia Michelle Monika Nancy Nathalie Nora Olga Olivia Patricia "
    "Paula Petra Pilar Rachel Rebecca Renate Rita Rosa Ruth Sabine Sandra Sara Sarah Simone Sofia Sophie Stephanie Susan Susanne Sylvia Teresa Ursula Vera Victoria Yvonne Любовь"
).split()
MALE = "Mr|Mister|Sir|Lord|Herrn|Herr|Monsieur|Señor|Don|Sr|Signor|Senhor|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Lady|Dame|Frau|Madame|Mme|Mlle|Señora|Señorita|Doña|Sra|Srta|Signora|Senhora|Госпожа|Κυρία"
#: Titles that say nothing about gender.
NEUTRAL = "Mx|Dr|Professor|Prof|Rev|Доктор|Профессор|Δρ"
#: What stands between the parts of a name, and what a country code of a phone is.
PARTICLES = "von|van|der|den|de|da|di|do|del|della|dos|das|du|la|le|los|las|y|zu|zum|zur|ter|ten|bin|ibn|al|el"
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUP = r"[0-9A-Fa-f]{1,4}"
#: A name: parts of any length, joined by hyphens or apostrophes, or initials; particles between them.
_PART = r"(?:\p{Lu}\.(?= )|\p{Lu}\p{L}*+(?:[-'’]\p{L}++)*+)"
_TITLES = rf"(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.? )+"
#: The name of a setting up to its value: behind "=" or a quote any value of three characters and more, up to white space, a quote or the punctuation before
#: them; behind a colon, as prose has it too, a long one or one with a digit or a sign.
_NAMED = r"(?i:\b(?:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key)\b[\"']?\s{0,3}"
_SETTING = rf"(?:{_NAMED}=\s{{0,3}}[\"']?)|{_NAMED}:\s{{0,3}}[\"'])|{_NAMED}:\s{{0,3}}))"
_VALUE = r"(?:[^\s\"'.,;:!?)\]}>]|[.,;:!?)\]}>](?![.,;:!?)\]}>]*(?:[\s\"']|$)))"
_SECRET = rf"(?:{_NAMED}=\s{{0,3}}[\"']?){_VALUE}{{3,}}+|{_NAMED}:\s{{0,3}}[\"']){_VALUE}{{3,}}+|{_NAMED}:\s{{0,3}})(?:{_VALUE}{{8,}}+|(?={_VALUE}*[\d!@#$%^&*]){_VALUE}{{4,}}+))"
_LABEL = r"[\p{L}\p{N}][\p{L}\p{N}\-]*+"
#: (type, pattern); the first that matches at a place wins.
PATTERNS = (
    ("email", rf"(?<![\p{{L}}\p{{N}}._%+\-])[\p{{L}}\p{{N}}._%+\-]++@{_LABEL}(?:\.{_LABEL})+"),
    ("setting", _SECRET),
    ("access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("ipv6", rf"(?<![\w:.])(?:{_GROUP}:){{7}}{_GROUP}(?![\w:])|(?<![\w:.])(?=[A-Fa-f:]*\d){_GROUP}(?::{_GROUP}){{0,6}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?(?![\w:])"),
    ("phone", r"(?<![\w+])\+?\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}(?!\d)|(?<![\w+])\+\d{7,15}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])|(?<![\w.,+\-/=])[2-9]\d{9}(?![\w\-/]|[.,]\d)"),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("card", r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])"),
    ("name", rf"\b{_TITLES}{_PART}(?: (?:(?:{PARTICLES}) ){{0,3}}{_PART}){{0,3}}"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What a text needs for any of the patterns to match; far cheaper than they are.
HINT = rf"[0-9@]|\b(?i:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key)\b|\b(?:{MALE}|{FEMALE}|{NEUTRAL})\b"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _amount(key: str, *parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 7), 16, 10).cast("int")


def _moved(c: Column, amount: Column, alphabets) -> Column:
    """c, moved within the alphabet that holds it: the letters of all alphabets stand in one string, with the start and size
    of each letter's own beside it."""
    letters = "".join(alphabets)
    starts = [len("".join(alphabets[:k])) for k in range(len(alphabets))]
    own = F.expr(f"map({', '.join(f"{k}, named_struct('at', {starts[k]}, 'n', {len(a)})" for k, a in enumerate(alphabets))})")
    which = "".join(chr(0x100 + k) * len(a) for k, a in enumerate(alphabets))
    alphabet = lambda at: own[F.ascii(F.substring(F.lit(which), at, F.lit(1))) - 0x100]
    to = lambda at, a: F.substring(F.lit(letters), a["at"] + (at - 1 - a["at"] + amount) % a["n"] + 1, F.lit(1))
    return _let(F.call_function("locate", c, F.lit(letters)), lambda at: F.when(at > 0, _let(alphabet(at), lambda a: to(at, a))).otherwise(c))


def permuted(s: Column, key: str, alphabets=TEXTUAL) -> Column:
    """A keyed permutation of the strings with the same alphabet at each place. A string of one
    character is moved by the key alone."""
    one = F.array().cast("array<string>")

    def turn(state: Column, k: Column) -> Column:
        # the other half's digest is computed once for all characters, so time follows the length
        return _let(F.sha2(F.array_join(state["r"], "").cast("binary"), 256), lambda other: F.struct(state["r"].alias("l"), F.transform(state["l"], lambda c, i: _moved(c, _amount(key, k, i, other), alphabets)).alias("r")))

    def halves(cs: Column) -> Column:
        half = F.floor(F.size(cs) / 2).cast("int")
        return F.struct(F.when(half > 0, F.slice(cs, F.lit(1), half)).otherwise(one).alias("l"), F.when(half >= 0, F.slice(cs, half + 1, F.size(cs))).otherwise(one).alias("r"))

    # a half of no characters takes no part, so one character is moved by the key alone
    def whole(cs: Column) -> Column:
        many = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves(cs), turn, lambda state: F.array_join(F.concat(state["l"], state["r"]), ""))
        return F.when(F.size(cs) > 1, many).otherwise(F.array_join(F.transform(cs, lambda c: _moved(c, _amount(key, F.lit(0)), alphabets)), ""))

    return _let(_chars(s), whole)


def _laid_out(e: Column, chars: Column, own: str) -> Column:
    """chars in the places of e's characters that match own; the others stay."""
    count = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), f"(?!{own}).", ""))
    return F.array_join(F.transform(_chars(e), lambda c, i: F.when(c.rlike(own), F.substring(chars, count(i), F.lit(1))).otherwise(c)), "")


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _cased(moved: Column, e: Column) -> Column:
    """moved, with capitals where e has them."""
    return F.array_join(F.zip_with(_chars(moved), _chars(e), lambda m, c: F.when(c != F.lower(c), F.upper(m)).otherwise(m)), "")


def _email(e: Column, key: str) -> Column:
    plain = lambda x: _let(x, lambda y: _cased(permuted(F.lower(y), key, (DIGITS, LOWER, ACCENTED, CYRILLIC, GREEK)), y))
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    known = r"(?i)(^|\.)(example\.(?:com|net|org))$"
    kept = F.regexp_extract(domain, known, 2)
    rest = F.regexp_replace(domain, known, "")
    other = F.concat(plain(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)), F.lit("."), F.substring_index(domain, ".", -1), F.lit(".example"))
    return F.concat(plain(local), F.lit("@"), F.when(kept == "", other).when(rest == "", kept).otherwise(F.concat(plain(rest), F.lit("."), kept)))


def _phone(e: Column, key: str) -> Column:
    """The country code stays; the digits behind it are permuted without their layout."""
    head = F.regexp_extract(e, rf"^({COUNTRY}|\d{{1,3}}(?=[ .\-]?\()|)", 1)
    rest = F.substring(e, F.length(head) + 1, F.length(e))
    return F.concat(head, _let(permuted(_digits(rest), key, (DIGITS,)), lambda d: _laid_out(rest, d, r"\d")))


def _mod97(country: Column, rest: Column) -> Column:
    """The check digits that an IBAN of this country and account has."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    left = F.aggregate(_chars(F.concat(rest, country, F.lit("00"))), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.lit(98) - left


def _iban(e: Column, key: str) -> Column:
    """The account is permuted; the check digits are as far from the right ones as before."""
    country, check, account = F.substring(e, 1, 2), F.substring(e, 3, 2).cast("int"), F.regexp_replace(F.substring(e, F.lit(5), F.length(e)), " ", "")
    pair = F.struct(permuted(account, key).alias("m"), (check - _mod97(country, account)).alias("off"))
    whole = lambda x: F.concat(country, F.lpad(F.pmod(_mod97(country, x["m"]) + x["off"], F.lit(100)).cast("string"), 2, "0"), x["m"])
    return _let(_let(pair, whole), lambda x: _laid_out(e, x, r"[A-Z0-9]"))


def _kept_prefix(e: Column, pattern: str, key: str, alphabets=TEXTUAL) -> Column:
    """The group that pattern captures stays; the rest is permuted."""
    head = F.regexp_extract(e, pattern, 1)
    return F.concat(head, permuted(F.substring(e, F.length(head) + 1, F.length(e)), key, alphabets))


def _luhn(digits: Column) -> Column:
    """The check digit that belongs behind digits."""
    ds = F.reverse(_chars(digits))
    doubled = F.transform(ds, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(e: Column, key: str) -> Column:
    """The first digit stays; the check digit is as far from the right one as before."""

    def moved(d: Column) -> Column:
        body, check = F.substring(d, F.lit(1), F.length(d) - 1), F.substring(d, F.length(d), F.lit(1)).cast("int")
        pair = F.struct(F.concat(F.substring(body, 1, 1), permuted(F.substring(body, F.lit(2), F.length(body)), key, (DIGITS,))).alias("m"), (check - _luhn(body)).alias("off"))
        return _let(pair, lambda x: F.concat(x["m"], F.pmod(_luhn(x["m"]) + x["off"], F.lit(10)).cast("string")))

    return _let(moved(_digits(e)), lambda d: _laid_out(e, d, r"\d"))


def _ip(e: Column, key: str) -> Column:
    octets = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))
    start = F.struct(F.slice(octets, 1, 2).alias("l"), F.slice(octets, 3, 2).alias("r"))
    turn = lambda s, k: F.struct(s["r"].alias("l"), F.transform(s["l"], lambda o, i: (o + _amount(key, F.lit("ip"), k, i, F.array_join(F.transform(s["r"], lambda z: z.cast("string")), "."))) % 256).alias("r"))
    text = lambda x: F.array_join(F.transform(x, lambda z: z.cast("string")), ".")
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(text(s["l"]), F.lit("."), text(s["r"])))


def _ipv6(e: Column, key: str) -> Column:
    """The digits are permuted in lower case; the groups stay as long as they are."""
    return _let(permuted(F.regexp_replace(F.lower(e), ":", ""), key, (HEX,)), lambda d: _let(_laid_out(e, d, r"[0-9A-Fa-f]"), lambda x: _cased(x, e)))


def _word(w: Column, key: str) -> Column:
    """A part of a name, permuted in lower case, so that capitals make no other person."""
    return _cased(permuted(F.lower(w), key, SOUNDS), w)


def _given(w: Column, key: str) -> Column:
    """A given name of the same gender and script, and the permuted one behind it, which keeps people with one family name apart. The name alone decides, so
    that a person keeps theirs behind any title: by the list of usual names, else by its ending (Cyrillic, Greek), else a name of either gender."""
    first = F.regexp_extract(w, r"^(\p{L}+)", 1)
    known = _let(F.initcap(F.lower(first)), lambda n: F.when(n.isin(*WOMEN, *GIVEN["f", "latin"]), "f").when(n.isin(*MEN, *GIVEN["m", "latin"]), "m"))
    script = F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    ending = F.when(w.rlike(r"\p{IsCyrillic}"), F.when(first.rlike("(?iu)[ая]$"), "f").otherwise("m")).when(w.rlike(r"\p{IsGreek}"), F.when(first.rlike("(?iu)[ςσ]$"), "m").otherwise("f")).otherwise("e")
    names = {**GIVEN, ("e", "latin"): EITHER}

    def of(kind: Column) -> Column:
        chosen, by = None, _amount(key, F.lit("given"), F.lower(w))
        for (g, s), own in names.items():
            name = F.element_at(F.expr(f"array({', '.join(f"'{n}'" for n in own)})"), by % len(own) + 1)
            here = (kind["g"] == g) & (kind["s"] == s)
            chosen = F.when(here, name) if chosen is None else chosen.when(here, name)
        return F.concat(chosen, F.lit("-"), _word(w, key))

    return _let(F.struct(F.coalesce(known, ending).alias("g"), script.alias("s")), of)


def _name(e: Column, key: str) -> Column:
    """Titles and particles stay; of several parts the first is a given name, unless it is an initial, and the others are family names."""
    title = F.regexp_extract(e, f"^({_TITLES})", 1)
    particle = lambda w: w.isin(*PARTICLES.split("|"))

    def new(ws: Column) -> Column:
        given = F.size(F.filter(ws, lambda w: ~particle(w))) > 1
        return F.transform(ws, lambda w, i: F.when(particle(w), w).when((i == 0) & given & ~w.endswith("."), _given(w, key)).otherwise(_word(w, key)))

    return F.concat(title, F.array_join(_let(F.split(F.substring(e, F.length(title) + 1, F.length(e)), " "), new), " "))


def kind_of(e: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS:
        # what stood around the entity isn't there any more, and a whole match is asked for
        here = e.rlike(rf"^(?:{pattern})$")
        out = F.when(here, kind) if out is None else out.when(here, kind)
    return out.otherwise("card")


def surrogate(e: Column, key: str = KEY) -> Column:
    """The replacement of one entity."""
    setting = f"(?s)^({_SETTING})"
    value = F.regexp_replace(e, setting, "")

    def of(kind: Column) -> Column:
        return (
            F.when(kind == "email", _email(e, key))
            .when(kind == "setting", F.when(value.rlike("^[0-9a-f]+$"), _kept_prefix(e, setting, key, (HEX,))).otherwise(_kept_prefix(e, setting, key)))
            .when(kind == "access_key", _kept_prefix(e, "^(....)", key))
            .when(kind == "iban", _iban(e, key))
            .when(kind == "ip", _ip(e, key))
            .when(kind == "ipv6", _ipv6(e, key))
            .when(kind == "phone", _phone(e, key))
            .when(kind == "ssn", _let(permuted(_digits(e), key, (DIGITS,)), lambda d: _laid_out(e, d, r"\d")))
            .when(kind == "name", _name(e, key))
            .otherwise(_card(e, key))
        )

    return _let(kind_of(e), of)


def entities(text: Column) -> Column:
    """The entities of a text in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def replaced(text: Column, found: Column, key: str = KEY) -> Column:
    """text with a surrogate in place of each of its entities (found)."""
    between = F.split(text, ANY, -1)
    new = F.transform(found, lambda e: surrogate(e, key))
    join = lambda parts, subs: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(subs, i), F.lit("")))), "")
    return F.when(F.size(found) > 0, join(between, new)).otherwise(text)


def with_surrogates(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """docs with the entities of text_col replaced; count_col, if given, counts them."""
    (found,) = free(docs, "__found")
    out = docs.withColumn(found, entities(F.col(text_col)))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(found), F.lit(0)).cast("long"))
    return out.withColumn(text_col, replaced(F.col(text_col), F.col(found), key)).drop(found)


def collisions(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """Surrogates that two different entities of a type share, with how many: no rows if
    distinctness holds."""
    e = docs.select(F.explode(entities(F.col(text_col))).alias("e")).distinct()
    return e.select(kind_of(F.col("e")).alias("kind"), surrogate(F.col("e"), key).alias("surrogate")).groupBy("kind", "surrogate").count().filter("count > 1")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    if found := collisions(docs).take(1):
        raise ValueError(f"a surrogate stands for {found[0]['count']} entities of type {found[0]['kind']}: choose another key")
    out = with_surrogates(docs, count_col="n_entities")
    return out.select("doc_id", "text", "n_entities")
