"""Surrogates for personal data. Column expressions and joins only.

Detected entities are e-mail, IPv4 and IPv6 addresses, card, phone, social-security and bank account numbers, and names after a title. Each gets a
replacement made from a keyed hash of its normal form, of the same type and format: digits for digits, the punctuation as it stood, a card's first digit
and check digit, a phone's country code, an account's country and valid check digits where they were valid, a social-security number of an area that exists, a
private address for a private one, a name's script, gender and case. Equal normal forms have equal surrogates in the whole corpus, however they are
written; given names and surnames are entities of their own, so a person stays one person when only the surname is repeated or another title is used. The
first of several name words is the given name, the others are surnames; initials get other initials, and particles stay. A given name's gender is
that of all its titles in the corpus, none if they differ. A name word that stands after a title is replaced wherever it stands in the same text, with a
title or without one.

Collision checks: a surrogate must not be an entity of the corpus, nor another entity's surrogate; names of all kinds are compared with each
other. Candidates are made for all distinct entities, each candidate is kept by the least entity that has it, and the others try again with another
attempt number, until none is left. The mapping never leaves the cluster.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import spans
from weftline.llm.shared import drop_written, written

_FREE = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles by gender.
_MALE = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Don", "Господин")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Sra", "Señora", "Doña", "Госпожа")
_EITHER = ("Dr", "Prof", "Доктор")
#: Groups that repeat without a bound are possessive here and below: others recurse, and a long text would end the stack.
_TITLE = rf"(?:{'|'.join(_MALE + _FEMALE + _EITHER)})\.?(?: (?:{'|'.join(_EITHER)})(?!\p{{L}})\.?)*+"
#: Words inside names that are no names. What a name is made of: words, initials, and particles before them.
_PARTICLE = "(?:van|von|vom|der|den|de|del|della|di|da|dos|das|do|du|la|le|el|al|bin|ibn|ben|zu|zum|zur|ter|ten|y|e|af|av)"
_INITIAL = r"\p{Lu}(?:\.(?:-?\p{Lu}\.)*+|(?= \p{Lu}))"
_WORD = r"(?:[\p{Lu}\p{Lt}][\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]++)++|[\p{Lu}\p{Lt}][\p{L}\p{M}]+|[dl]['’]\p{Lu}[\p{L}\p{M}]+|\p{Lo}[\p{L}\p{M}]*)"
#: A domain has 127 labels at most.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
IP4 = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\p{{N}}|\p{{L}})"
_H = "[0-9A-Fa-f]{1,4}"
#: Whole, or with one gap; with a gap, a digit must be there, so that names of code such as a::b are none.
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_H}:){{7}}{_H}|(?=[A-Fa-f:]*\d)(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)(?![\p{{L}}\p{{N}}:])"
IP = f"{IP4}|{IP6}"
CARD = rf"{_FREE[0]}(?:\d{{4}}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}|3[0-9]\d{{2}}[ -]?\d{{6}}[ -]?\d{{4,5}}){_FREE[1]}"
SSN = rf"{_FREE[0]}\d{{3}}-\d{{2}}-\d{{4}}{_FREE[1]}"
PHONE = rf"(?<![\p{{L}}\p{{N}}+])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]\d{{3,4}}(?:[ .-]\d{{2,4}})?{_FREE[1]}|(?<![\p{{L}}\p{{N}}+])\+\d{{8,15}}{_FREE[1]}"
_NO = r"(?<![\p{L}\p{N}+.,-])"
#: Also after a country code in any grouping; in pairs; with an area code in front; and seven digits.
PHONE += rf"|(?<![\p{{L}}\p{{N}}+])(?:\+|00)[1-9](?:[ .()/-]{{0,2}}\d){{7,14}}{_FREE[1]}|{_NO}0[1-9](?:[ .-]?\d{{2}}){{4}}{_FREE[1]}"
PHONE += rf"|(?<![\p{{L}}\p{{N}}+.,-])\(?0[1-9]\d{{1,3}}\)?[ /-]{{1,2}}\d{{5,9}}{_FREE[1]}|{_NO}[2-9]\d{{2}}-\d{{4}}(?![\p{{L}}\p{{N}}]|-\d)"
IBAN = rf"{_FREE[0]}[A-Z]{{2}}\d{{2}} ?(?:[A-Z]{{4}}|\d{{4}})(?: ?\d{{4}}){{2,6}}(?: ?\d{{1,3}})?{_FREE[1]}"
#: The lengths, without country and check digits, of account numbers that may hold letters anywhere.
_IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK|FI|FO|GL|NL", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|XK", 17: "CH|CR|HR|LI|LV", 18: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 19: "AE|GI|IL|IQ|TL", 20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    21: "PT|ST", 22: "IS|TR", 23: "FR|IT|MC|MR|SM", 24: "AL|AZ|CY|DO|GT|HU|LB|PL|SV|BY", 25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU", 27: "MT|SC",
}
_WHOLE = "|".join(rf"(?:{c})\d{{2}}(?: ?[A-Z0-9]){{{n}}}{_FREE[1]}(?! \d{{4}}(?!\d))" for n, c in _IBAN_LENGTHS.items())
IBAN = rf"{_FREE[0]}(?:{_WHOLE})|{IBAN}"
NAME = rf"{_FREE[0]}{_TITLE}(?: (?:{_PARTICLE} ){{0,3}}(?:{_WORD}|{_INITIAL}))++"
#: All of them: the first that matches at a place counts. What they begin with is looked at first, which decides nothing but saves most of the time.
_NUMBER = "|".join((IP4, CARD, SSN, PHONE))
ENTITY = rf"{EMAIL}|(?=[0-9+(])(?:{_NUMBER})|(?=[A-Z]{{2}}[0-9])(?:{IBAN})|(?=[0-9A-Fa-f]{{0,4}}:)(?:{IP6})|(?=[{''.join(sorted({t[0] for t in _MALE + _FEMALE + _EITHER}))}])(?:{NAME})"
#: Attempts that keep an entity's length: of names and e-mail addresses, whose values are many once they are longer, and of numbers.
SHORT, ATTEMPTS = 4, 40

#: What invented names are made of, by script.
_SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "ga", "ka", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "no", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "to", "va", "ve", "vi"),
    "cyrillic": ("ба", "бо", "ва", "ве", "га", "го", "да", "де", "ка", "ко", "ла", "ле", "ли", "ма", "ме", "ми", "на", "не", "но", "па", "ра", "ро", "са", "се", "та", "то"),
    "greek": ("βα", "γα", "δα", "δε", "κα", "κο", "λα", "λε", "λι", "μα", "με", "μι", "να", "νε", "πα", "πε", "ρα", "ρο", "σα", "σε", "τα", "το"),
    "armenian": ("բա", "գա", "դա", "կա", "լա", "մա", "նա", "պա", "ռա", "սա", "տա", "րի", "նե", "լո", "մի", "վա"),
    "georgian": ("ბა", "გა", "და", "კა", "ლა", "მა", "ნა", "პა", "რა", "სა", "თა", "რი", "ნე", "ლო", "მი", "ვა"),
    "hebrew": ("בא", "גא", "דא", "כא", "לא", "מא", "נא", "פא", "רא", "סא", "טא", "רי", "נו", "לו", "מי", "שא"),
    "arabic": ("با", "دا", "را", "سا", "كا", "لا", "ما", "نا", "فا", "تا", "ري", "نو", "لو", "مي", "شا", "جا"),
    "devanagari": ("बा", "गा", "दा", "का", "ला", "मा", "ना", "पा", "रा", "सा", "ता", "री", "नो", "लो", "मी", "वा"),
    "hangul": ("가", "나", "다", "라", "마", "바", "사", "아", "자", "하", "민", "수", "진", "우", "현", "영"),
    "katakana": ("カ", "キ", "サ", "シ", "タ", "ト", "ナ", "ノ", "ハ", "マ", "ミ", "ヤ", "ラ", "リ", "ロ", "ワ"),
    "hiragana": ("か", "き", "さ", "し", "た", "と", "な", "の", "は", "ま", "み", "や", "ら", "り", "ろ", "わ"),
    "han": ("安", "白", "成", "大", "方", "高", "海", "江", "金", "林", "明", "宁", "平", "文", "云", "志"),
}
_ENDINGS = {
    "latin": {"m": ("ron", "nus", "ldo", "rik"), "f": ("lia", "nna", "rina", "lotte"), "n": ("ren", "ley", "lin"), "s": ("mann", "sen", "ley", "rez", "dier")},
    "cyrillic": {"m": ("н", "р", "слав", "мир"), "f": ("на", "рия", "лина", "ша"), "n": ("ня", "ля"), "s": ("нко", "вич", "нюк")},
    "greek": {"m": ("ρος", "νης"), "f": ("νη", "ρία"), "n": ("λη", "ρη"), "s": ("δης", "πουλος", "κης")},
}
#: The letters that initials are moved in.
_CAPITALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _byte(digest: Column, i: Column | int) -> Column:
    """Byte i of a hex digest, a number from 0 to 255."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32 * 2 + 1
    return F.conv(F.substr(digest, at, F.lit(2)), 16, 10).cast("int")


def _pick(digest: Column, i: Column | int, of: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, of)), _byte(digest, i) % len(of))


#: The letters that letters of a script become.
_SMALL = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Latin": "abcdefghijklmnopqrstuvwxyz"}


def _letters(text: Column, digest: Column) -> Column:
    """Each letter and digit of text moved within its kind by the digest; capitals become capitals."""
    def moved(c: Column, i: Column) -> Column:
        by = F.ascii(c) + _byte(digest, i)
        pick = lambda letters: F.substr(F.lit(letters), by % len(letters) + 1, F.lit(1))
        letter = pick(_SMALL["Latin"])
        for script in ("Cyrillic", "Greek"):
            letter = F.when(c.rlike(rf"\p{{Is{script}}}"), pick(_SMALL[script])).otherwise(letter)
        return F.when(c.rlike("[0-9]"), (by % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def _mod97(text: Column) -> Column:
    """The remainder that checks account numbers: letters count as 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _account(norm: Column, digest: Column, over: Column) -> Column:
    """An account number of the same country, shape and letters, which name its bank, with valid check digits if norm's are."""
    moved = F.transform(F.split(F.substr(norm, F.lit(5)), ""), lambda c, i: F.when(c.rlike("[0-9]"), ((F.ascii(c) + _byte(digest, i)) % 10).cast("string")).otherwise(c))
    country, body = F.left(norm, F.lit(2)), F.concat(F.array_join(moved, ""), over)
    valid = _mod97(F.concat(F.substr(norm, F.lit(5)), F.left(norm, F.lit(4)))) == 1
    check = F.when(valid, 98 - _mod97(F.concat(body, country, F.lit("00")))).otherwise(_byte(digest, 31) % 100)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _new_address(norm: Column, digest: Column, attempt: Column) -> Column:
    """An address of the same version, private if norm is. Where ATTEMPTS were all taken the range is a larger one, and at last that of version 6."""
    at = lambda i: (_byte(digest, i) % 254 + 1).cast("string")
    dotted = lambda *parts: F.concat_ws(".", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    between = lambda low, n: (_byte(digest, 0) % n + low).cast("string")
    private = norm.rlike(r"\A(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\.")
    own = (
        F.when(norm.startswith("10."), dotted("10", at(1), at(2), at(3))).when(norm.startswith("127."), dotted("127", at(1), at(2), at(3)))
        .when(norm.startswith("192.168."), dotted("192", "168", at(2), at(3))).when(norm.startswith("169.254."), dotted("169", "254", at(2), at(3)))
        .when(private, dotted("172", between(16, 16), at(2), at(3))).otherwise(dotted(between(11, 89), at(1), at(2), at(3)))
    )
    wider = F.when(private, dotted("10", at(1), at(2), at(3))).otherwise(dotted(between(240, 16), at(1), at(2), at(3)))
    groups = F.regexp_replace(F.left(digest, F.lit(32)), "(....)(?=.)", "$1:")
    local = norm.rlike(r"\A(?:f[cd]|fe[89ab]|0000:0000)")
    six = F.concat(F.when(local, F.when(norm.startswith("f"), F.left(norm, F.lit(4))).otherwise("fe80")).otherwise(F.concat(F.lit("2"), F.substr(groups, F.lit(2), F.lit(3)))), F.substr(groups, F.lit(5)))
    return F.when(norm.contains(":") | (attempt >= 2 * ATTEMPTS), six).when(attempt >= ATTEMPTS, wider).otherwise(own)


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for a valid card number."""
    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, v: a + v)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The candidate of an entity: for numbers, all their digits; for addresses and names, the whole in lower case."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm), 256)
    own = F.regexp_replace(norm, "[^0-9]", "")
    longer = F.floor(attempt / SHORT).cast("int")
    digits = F.translate(digest, "abcdef", "012345")
    prefix = F.when(kind == "card", F.left(own, F.lit(1))).when(kind == "phone", F.regexp_extract(norm, r"^\+(1|7|\d\d)", 1)).otherwise("")
    number = F.concat(prefix, F.substr(digits, F.lit(1), F.length(own) - F.length(prefix)))
    body = F.left(number, F.length(own) - 1)
    checked = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    card = F.when(_luhn(own) % 10 == 0, checked).otherwise(number)
    domain = F.substring_index(norm, "@", -1)
    by_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    added = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(longer, F.lit(1))), lambda i: _pick(digest, i + 15, tuple("abcdefghijklmnopqrstuvwxyz"))), "")
    email = F.concat(_letters(F.substring_index(norm, "@", 1), digest), F.when(longer > 0, added).otherwise(""), F.lit("@"), _letters(F.regexp_replace(domain, r"\.[^.]+$", ""), by_domain), F.lit(".example"))
    part = lambda a, n, least, of: (F.conv(F.substr(digest, F.lit(a), F.lit(n)), 16, 10).cast("long") % of + least)
    area = part(1, 6, 1, 898)
    ssn = F.format_string("%03d%02d%04d", area + F.when(area >= 666, 1).otherwise(0), part(7, 4, 1, 99), part(11, 6, 1, 9999))

    def name(script: str) -> Column:
        stem = F.array_join(F.transform(F.sequence(F.lit(1), longer + 1), lambda i: _pick(digest, i.cast("int"), _SYLLABLES[script])), "")
        end = F.lit("")
        for part, endings in _ENDINGS.get(script, {}).items():
            end = F.when(kind == f"name_{part}", _pick(digest, 0, endings)).otherwise(end)
        return F.concat(stem, end)

    # digits that _fill puts after the last one, where a format has too few values
    over = F.when(attempt >= ATTEMPTS, F.substr(F.reverse(digits), F.lit(1), F.floor((attempt - ATTEMPTS) / SHORT).cast("int") + 1)).otherwise("")
    named = name("latin")
    for script in list(_SYLLABLES)[1:]:
        named = F.when(norm.rlike(rf"\p{{Is{script.capitalize()}}}"), name(script)).otherwise(named)
    return (
        F.when(kind == "email", email).when(kind == "ip", _new_address(norm, digest, attempt)).when(kind == "card", F.concat(card, over))
        .when(kind == "iban", _account(norm, digest, over)).when((kind == "ssn") & (F.length(own) == 9), F.concat(ssn, over))
        .when(kind.startswith("name"), named).otherwise(F.concat(number, over))
    )


def _kind(match: Column) -> Column:
    whole = lambda p: match.rlike(rf"\A(?:{p})\z")
    return (
        F.when(match.contains("@"), "email").when(match.rlike(rf"\A{_TITLE} |\A[\p{{L}}\p{{M}}'’-]+\z"), "name").when(whole(IP), "ip").when(whole(CARD), "card")
        .when(whole(SSN), "ssn").when(match.rlike(r"\A[A-Z]"), "iban").otherwise("phone")
    )


def _words(match: Column) -> Column:
    """A name's words without its titles; initials and particles among them."""
    return F.split(F.regexp_replace(match, rf"\A{_TITLE} ", ""), " ")


def _is_name(word: Column) -> Column:
    """Neither an initial nor a particle."""
    return ~word.rlike(rf"\A(?:\p{{Lu}}(?:\.(?:-?\p{{Lu}}\.)*+)?|{_PARTICLE})\z")


def _parts(match: Column) -> Column:
    """The entities of a match: one, or a name's given name and surnames: kind, norm, and the gender that a given name's title tells. A name word without a title is
    a mention of one with a title."""
    kind = _kind(match)
    norm = F.when(kind == "phone", F.regexp_replace(match, "[^0-9+]", "")).when(kind.isin("card", "ssn", "iban"), F.upper(F.regexp_replace(match, "[ -]", ""))).when(kind == "ip", _address(match)).otherwise(F.lower(match))
    title = F.regexp_extract(match, rf"\A({'|'.join(_MALE + _FEMALE + _EITHER)})\.? ", 1)
    sex = F.when(title.isin(*_MALE), "m").when(title.isin(*_FEMALE), "f").otherwise("")
    words = F.filter(_words(match), _is_name)
    role = lambda i: F.when(title == "", "mention").when((i > 0) | (F.size(words) == 1), "name_s").otherwise("name_g")
    named = F.transform(words, lambda w, i: F.struct(role(i).alias("kind"), F.lower(w).alias("norm"), F.when(role(i) == "name_g", sex).otherwise("").alias("sex")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"), F.lit("").alias("sex"))))


def _address(match: Column) -> Column:
    """An IP address in its normal form: that of version 6 with all its eight groups of four digits."""
    sides = F.transform(F.split(F.lower(match), "::"), lambda s: F.filter(F.split(s, ":"), lambda g: g != ""))
    left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
    groups = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    return F.when(match.contains(":"), F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":")).otherwise(match)


def _mentions(text: Column) -> Column:
    """A pattern of the name words that stand after titles in the text, in their usual cases; null if there are none."""
    titled = F.filter(spans.matches(text, ENTITY), lambda m: m.rlike(rf"\A{_TITLE} "))
    words = F.filter(F.flatten(F.transform(titled, _words)), lambda w: _is_name(w) & (F.length(w) > 1))
    cased = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), F.initcap(F.lower(w))))))
    return F.when(F.size(cased) > 0, F.concat(F.lit(rf"{_FREE[0]}(?:"), F.array_join(cased, "|"), F.lit(r")(?![\p{L}\p{N}\p{M}])")))


def _initials(word: Column, key: str) -> Column:
    """The word with its capitals moved within their alphabet, by the key; capitals of other alphabets become the first letter."""
    out = F.regexp_replace(word, rf"[\p{{Lu}}&&[^{''.join(_CAPITALS)}]]", "A")
    for letters in _CAPITALS:
        by = 1 + int(hashlib.sha256(f"{key}|initial|{letters}".encode()).hexdigest(), 16) % (len(letters) - 1)
        out = F.translate(out, letters, letters[by:] + letters[:by])
    return out


def _cased(like: Column, core: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.lower(like) != like) & (F.length(like) > 1), F.upper(core)).otherwise(core)


def _fill(match: Column, chars: Column, places: str = "[0-9]") -> Column:
    """The match with its digits, or what else ``places`` names, replaced by chars in their order, and any chars that are left behind the last one."""
    step = lambda acc, c: F.when(c.rlike(places), F.struct(F.concat(acc["out"], F.substr(chars, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n")))
    return F.aggregate(F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda acc: F.concat(acc["out"], F.substr(chars, acc["n"] + 1, F.length(chars))))


def _written_as(match: Column, own: Column, key: str) -> Column:
    """The surrogates of a match's entities, in their order, in the match's own format."""
    kind, core = _kind(match), F.get(own, F.lit(0))
    words = _words(match)
    number = spans.running(F.transform(words, lambda w: F.when(_is_name(w), 1).otherwise(0)))

    def word(s: Column) -> Column:
        w, new = s["w"], F.get(own, (s["number"] - 1).cast("int"))
        return F.when(_is_name(w), _cased(w, F.initcap(new))).when(w.rlike(rf"\A{_PARTICLE}\z"), w).otherwise(_initials(w, key))

    name = F.array_join(F.transform(F.arrays_zip(words.alias("w"), number.alias("number")), word), " ")
    return (
        F.when(kind == "name", F.concat(F.regexp_extract(match, rf"\A({_TITLE} )", 1), name)).when(kind == "email", _cased(match, core))
        .when(kind == "ip", core).when(kind == "iban", _fill(match, core, "[A-Z0-9]")).otherwise(_fill(match, core))
    )


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, norm), distinct, to (kind, norm, surrogate), each surrogate once and none of them an entity.

    It ends when every entity has a surrogate of its own. Later attempts are longer: those of names and e-mail addresses soon, those of numbers where ATTEMPTS of their own length
    were all taken, as where a format has hardly more values than the corpus has entities.
    """
    # entities in the form in which candidates are made; of names, all kinds are one class
    whole = F.col("kind").isin("email", "ip", "iban") | F.col("kind").startswith("name")
    form = F.when(whole, F.col("norm")).otherwise(F.regexp_replace("norm", "[^0-9]", ""))
    kinds = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    real = written(entities.select("kind", "norm", kinds.alias("class"), form.alias("surrogate")), "surrogate-entities")
    open_, done = real.select("kind", "norm", "class"), None
    for attempt in itertools.count():
        candidates = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key))
        free = candidates.join(real.select("class", "surrogate"), ["class", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("class", "surrogate"), ["class", "surrogate"], "left_anti")
        won = free.groupBy("class", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("one"))
        step = written(won.select("one.kind", "one.norm", "class", "surrogate"), "surrogate-won")
        done = step if done is None else done.unionByName(step)
        left = written(open_.join(step, ["kind", "norm"], "left_anti"), "surrogate-open")
        if attempt:
            drop_written(open_)
        open_ = left
        if open_.isEmpty():
            return done.select("kind", "norm", "surrogate")


def _surrogates(found: DataFrame, key: str) -> DataFrame:
    """found(row, place, part, kind, norm, sex) to (row, place, part, surrogate): joins that Spark can split where an entity is common."""
    own = found.where("kind <> 'mention'")
    titles = own.groupBy("kind", "norm").agg(F.max(F.col("sex") == "m").alias("m"), F.max(F.col("sex") == "f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "name_m").when(F.col("f") & ~F.col("m"), "name_f").otherwise("name_n")
    names = mapping(titles.select(F.when(F.col("kind") == "name_g", gender).otherwise(F.col("kind")).alias("kind"), "norm"), key)
    names = names.withColumn("kind", F.when(F.col("kind").isin("name_m", "name_f", "name_n"), "name_g").otherwise(F.col("kind")))
    named = own.join(names, ["kind", "norm"]).select("row", "place", "part", "kind", "norm", "surrogate")
    # a mention takes the surrogate of the first name with a title in its text
    first = named.where(F.col("kind").startswith("name")).groupBy("row", "norm").agg(F.min(F.struct("place", "part", "surrogate")).alias("first")).select("row", "norm", "first.surrogate")
    mentions = found.where("kind = 'mention'").join(first, ["row", "norm"]).select("row", "place", "part", "surrogate")
    return named.select("row", "place", "part", "surrogate").unionByName(mentions)


def pseudonymise(docs: DataFrame, key: str = "weftline") -> DataFrame:
    """docs with its text's entities replaced, and entities (kind:start:end in the old text, comma-joined; empty if there are none) and n_entities.

    All columns of docs are kept, in their order, whatever their names; of columns that are called entities or n_entities the new ones take the place. Null and empty
    texts, and texts without entities, are left as they are. Null or repeated doc_ids: each row is treated alone, doc_id is not read. An empty table gives an empty table.
    A text's work grows with its length and with the logarithm of its number of entities; only its distinct name words are looked for together.
    """
    kept = [c for c in docs.columns if c not in ("entities", "n_entities")]
    has = F.coalesce(docs["text"].rlike(ENTITY), F.lit(False))
    packed = F.struct(*(docs[f"`{c}`"].alias(c) for c in kept)).alias("doc")
    titled = written(docs.where(has).select(packed, F.monotonically_increasing_id().alias("row"), _mentions(docs["text"]).alias("mentions")), "surrogate-titled")
    pattern = F.concat_ws("|", F.lit(ENTITY), F.col("mentions"))
    rest = F.struct(*(F.col(f"doc.`{c}`").alias(c) for c in kept if c != "text"), F.lit(True).alias("text")).alias("doc")  # the text is that of matches and gaps
    hits = written(titled.select(rest, "row", spans.matches(F.col("doc.text"), pattern).alias("match"), spans.gaps(F.col("doc.text"), pattern).alias("gap")), "surrogate-hits")
    drop_written(titled)
    found = hits.select("row", F.posexplode("match").alias("place", "match")).select("row", "place", F.posexplode(_parts(F.col("match"))).alias("part", "entity")).select("row", "place", "part", "entity.*")
    cores = _surrogates(written(found, "surrogate-found"), key).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "part", "surrogate"))).alias("cores"))
    # cores are null in a text whose names are all initials. Functions below capture stored columns only: others would be evaluated for each element.
    joined = hits.join(cores, "row", "left").select("doc", "gap", "match", "cores")
    n = F.transform("match", lambda m: F.when(_kind(m) == "name", F.size(F.filter(_words(m), _is_name))).otherwise(1))
    own = lambda s: F.transform(F.slice("cores", (s["upto"] - s["n"] + 1).cast("int"), s["n"]), lambda c: c["surrogate"])
    each = F.transform(F.arrays_zip(F.col("match").alias("m"), n.alias("n"), spans.running(n).alias("upto")), lambda s: F.struct(s["m"].alias("m"), own(s).alias("own")))
    new = F.transform(each, lambda e: _written_as(e["m"], e["own"], key))
    text = F.concat(F.array_join(F.transform(new, lambda s, i: F.concat(F.get("gap", i), s)), ""), F.element_at("gap", -1))
    place = lambda s: F.concat_ws(":", _kind(s["m"]), s["at"].cast("string"), (s["at"] + F.length(s["m"])).cast("string"))
    said = F.array_join(F.transform(F.arrays_zip(F.col("match").alias("m"), spans.starts(F.col("gap"), F.col("match")).alias("at")), place), ",")
    changed = joined.select(*(text.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in kept), said.alias("entities"), F.size("match").cast("long").alias("n_entities"))
    same = docs.where(~has).select(*(docs[f"`{c}`"] for c in kept), F.lit("").alias("entities"), F.lit(0).cast("long").alias("n_entities"))
    return same.unionByName(changed)
