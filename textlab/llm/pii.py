"""Personal data: detection, and keyed surrogates of the same type and format.

Every detected entity is replaced by a surrogate that a keyed permutation of *all* strings
of its format gives. A format fixes what must stay: separators, script and case of every
letter, the number of digits, a card's network digit and whether its check digit is right,
whether an address is a public one, an e-mail's last domain label, a name's gender. So

* distinct entities have distinct surrogates, over the whole corpus, without a table of
  them: within a format the map is one-to-one, and it never leaves the format;
* the same entity has the same surrogate in every document, however it is punctuated or
  capitalised (what is permuted is the digits of a number, the small letters of a name);
* no surrogate is its own original: the permutation is one long cycle.

The collision checks are cycle walks: a candidate that isn't of the entity's class (an
address that isn't public, an invented name that is also a listed one) is permuted again
until it is, which keeps the map one-to-one on the class.

Kinds: e-mail addresses (letters of any script), phone numbers (international and US ones,
those with a leading zero in the groups of Germany and France, any after a word like
*phone*), card numbers (13 to 19 digits), IBANs, US social
security numbers, IPv4 and IPv6 addresses, secrets (any value assigned to a word like *password*,
*token* or *secret*, long ones with a digit assigned to *key* or *auth*, and keys with
well-known prefixes), and names after a title: any number of capitalised words of any
script with capitals, initials, hyphens, apostrophes, words like *van* between. Further
mentions of such a word in the same document, also in capitals, are replaced alike.

The key comes from a parameter or the session's ``spark.textlab.pii.key``; where neither is
given it is random, and surrogates are the same within an application alone. With the key
surrogates can be walked back, so it isn't kept anywhere else.

A word before the last is a first name. Where it isn't listed, its surrogate has an ending
of the gender of the title; so one such name has a surrogate for each gender it occurs with.
Slavic family names keep the ending of their gender, and both forms have one stem. Names
without a title aren't found, but for further mentions of one that had a title.

Defined results: a null text stays null with 0 entities, an empty one stays empty. Texts are
read whole. Repeated rows give repeated rows; an empty table gives an empty one. Text that
isn't part of an entity is kept byte by byte. ``replace`` reads id and text alone; ``replace_in``
keeps all columns, also ones named like the results here, and sets ``n_chars`` where there is
such a column of whole numbers.
"""

from __future__ import annotations

import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import kind_of, over_slices, slices

#: The setting of the session that has the key.
KEY_SETTING = "spark.textlab.pii.key"
#: The key where neither a parameter nor the session gives one: random, of this application alone.
KEY = secrets.token_bytes(32)
ROUNDS = 8
SCHEMA = "text string, n_entities int"

MALE = "James John Robert Michael William David Thomas Daniel Paul Mark Hans Peter Klaus Jürgen Wolfgang Pierre Jean Michel François Jacques José Juan Carlos Luis Miguel Antonio".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Nancy Anna Ursula Monika Petra Sabine Marie Nathalie Isabelle Sylvie Françoise María Carmen Josefa Isabel Dolores Pilar".split()
MALE_CYRILLIC = "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split()
LISTS = [[n.lower() for n in names] for names in (MALE, FEMALE, MALE_CYRILLIC, FEMALE_CYRILLIC)]
LISTED = {n: names for names in LISTS for n in names}

_EMAIL = r"(?<![\w.%+-])(?P<email>[\w%+-](?:[\w.%+-]{0,126}[\w%+-])?@(?:[^\W_](?:[^\W_]|-){0,62}\.){1,8}[^\W\d_]{2,24})(?![\w-])"
_IP = r"(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)"
_IP6 = r"(?<![\w:.])(?P<ip6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
_IBAN = r"(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
_CARD = r"(?<![\w.-])(?P<card>\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}|\d{4}([ -])\d{6}\3\d{5})(?![\w-])"
_SSN = r"(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
_PHONE = r"(?<![\w.])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\5\d{4})(?!\w)"
# numbers without the country: with a leading zero as in Germany and France, or after a word like phone
_NATIONAL = re.compile(r"0(?<!\w0)(?:[1-9](?:[ .-]\d\d){4}|[1-9]\d{1,3}[ /-]\d{3,4} ?\d{3,5})(?![\w-])")
_CALL_WORDS = "tel phone fon phon téléphon teléfono mobil móvil fax handy тел".split()
_CALLED = re.compile(r"(?<!\w)(?i:tel|phone|telephone|telefon|téléphone|teléfono|fon|mobile|mobil|móvil|fax|handy|тел|телефон)\b[.: ]{1,3}(\(?\d(?:[ ./()-]{0,2}\d){6,13})(?![\w-])")
_PASSWORD = r"password|passwd|pwd|passphrase|passcode|passwort|kennwort|contraseña|mot de passe|пароль|token|secret|api[_-]?key|access[_-]?key"
_SECRET = (
    r"(?i:(?<![^\W_])(?:" + _PASSWORD + r")(?![^\W_])[\"']?\s{0,3}[=:]\s{0,3})(?:\"(?P<quoted>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|[\"']?(?P<secret>(?:(?![,;&]+[\w.-]+[\"']?\s?[=:])[^\s\"'<>])*[^\s\"'<>.,;:!?&)\]}]))"
    r"|(?i:\b(?:[a-z]+[_-])*(?:auth|key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<long>[A-Za-z0-9+/_=-]{12,})"
    r"|(?<!\w)(?P<key>(?:AKIA|ghp_|gho_|sk-|xoxb-|xoxp-)[A-Za-z0-9_-]{12,})(?!\w)"
)
_TITLES = {"m": "Mr|Herr|Herrn|Monsieur|Señor|Господин", "f": "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Госпожа", "": "Dr|Prof"}
_GENDER = {t: g for g, titles in _TITLES.items() for t in titles.split("|")}


def _capitals() -> str:
    """The capitals of the basic plane as ranges of a character class."""
    at = [c for c in range(0x10000) if unicodedata.category(chr(c)) in ("Lu", "Lt")]
    starts = [c for c, before in zip(at, [-1, *at], strict=False) if c != before + 1]
    ends = [c for c, after in zip(at, [*at[1:], -1], strict=True) if c != after - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


_MARKS = "\u0300-\u036f"
_LETTER, _CAPITAL = f"(?:[^\\W\\d_]|[{_MARKS}])", f"[{_capitals()}]"
_PART = f"(?:{_CAPITAL}['’]{_LETTER}{{2,}}|{_CAPITAL}{_LETTER}*)(?:['’]{_CAPITAL}{_LETTER}+)*"
_ANY_TITLE = "(?:" + "|".join(_TITLES.values()) + ")"
_SINGLE = f"(?!{_ANY_TITLE}\\b)(?:{_CAPITAL}[{_MARKS}]*\\.(?:[ -]?{_CAPITAL}[{_MARKS}]*\\.)*|{_PART}(?:[-‐‑]{_PART})*)"
_BETWEEN = "(?:(?:van|von|der|den|ten|ter|zu|de|del|della|di|da|dos|du|la|le|al|el|bin|ibn) |d['’])*"
_NAME = re.compile(f"\\b(?P<titles>(?:{_ANY_TITLE}(?:\\.\\s{{0,3}}|\\s{{1,3}}))+)(?P<names>{_BETWEEN}{_SINGLE}(?:(?:[ \u00a0]{{1,2}}|(?<=\\.)){_BETWEEN}{_SINGLE})*)")
_WORD = re.compile(_PART)
_AT = re.compile(_EMAIL)
_DIGITS = re.compile("|".join((_IP, _IP6, _CARD.replace(r"\2", r"(?P=a)").replace(r"\3", r"(?P=b)").replace("([ -])", "(?P<a>[ -])", 1).replace("([ -])", "(?P<b>[ -])", 1), _SSN, _PHONE.replace(r"([.-])\d{3}\5", r"(?P<c>[.-])\d{3}(?P=c)"), _IBAN)))
_KEYS = re.compile(_SECRET)
_HINT = re.compile(r"(?i:token|secret|pass[wpce]|pwd|kennwort|contraseña|пароль|key|auth)|AKIA|gh[po]_|sk-|xox[bp]-")

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_CYR_VOWELS, _CYR_CONSONANTS = "аеиоуэюя", "бвгджзклмнпрстфхцчшщ"
_ACCENTED = "àáâäãåèéêëìíîïòóôöõùúûüñç"


def _noise(key: bytes, tweak: bytes, i: int, x: int) -> int:
    return int.from_bytes(blake2b(b"%d|%d|" % (i, x) + tweak, key=key, digest_size=32).digest(), "little")


def next_in_cycle(digits: list[int], radices: list[int], key: bytes, tweak: bytes) -> list[int]:
    """The string that follows in a keyed cycle through all strings with these radices.

    A Feistel network (with sums modulo the sizes of the halves) permutes the strings; the
    step is: permute, add one, permute back.
    """
    if not digits:
        return digits
    half = len(digits) // 2
    sizes = [1, 1]
    parts = [0, 0]
    for side, span in enumerate((range(half), range(half, len(digits)))):
        for j in span:
            parts[side] = parts[side] * radices[j] + digits[j]
            sizes[side] *= radices[j]
    tweak = tweak + b"|%d|%d" % (sizes[0] % (1 << 128), sizes[1] % (1 << 128))
    for i in range(ROUNDS):
        s = i & 1
        parts[s] = (parts[s] + _noise(key, tweak, i, parts[1 - s])) % sizes[s]
    whole = (parts[0] * sizes[1] + parts[1] + 1) % (sizes[0] * sizes[1])
    parts = [whole // sizes[1], whole % sizes[1]]
    for i in reversed(range(ROUNDS)):
        s = i & 1
        parts[s] = (parts[s] - _noise(key, tweak, i, parts[1 - s])) % sizes[s]
    out = [0] * len(digits)
    for side, span in enumerate((range(half), range(half, len(digits)))):
        for j in reversed(span):
            parts[side], out[j] = divmod(parts[side], radices[j])
    return out


def walk(digits: list[int], radices: list[int], key: bytes, tweak: bytes, good: Callable[[list[int]], bool] = lambda _: True) -> list[int]:
    """The next string of the cycle that ``good`` accepts."""
    now = digits
    while True:
        now = next_in_cycle(now, radices, key, tweak)
        if now == digits or good(now):
            return now


_ALPHABETS = ("0123456789", _VOWELS, _CONSONANTS, _CYR_VOWELS, _CYR_CONSONANTS, _ACCENTED)
_CLASS = {c: a for a in _ALPHABETS for c in a}


@lru_cache(maxsize=1 << 12)
def alphabet(c: str) -> str | None:
    """The letters or digits that may take the place of a small letter, caseless letter or digit."""
    if c in _CLASS or c < "\x80":
        return _CLASS.get(c)

    def kind(x: str) -> str:
        cased = unicodedata.category(x) == "Ll" and len(x.upper()) == 1 and x.upper() != x == x.upper().lower()
        return "" if x in _CLASS or unicodedata.normalize("NFC", x) != x else "Ll" if cased else "Lo" * (unicodedata.category(x) == "Lo")

    if not kind(c):
        return None
    block = ord(c) & ~127
    return "".join(x for x in map(chr, range(block, block + 128)) if kind(x) == kind(c))


def permuted(text: str, key: bytes, tweak: bytes, good: Callable[[str], bool] = lambda _: True) -> str:
    """A small-letter string whose letters and digits are replaced within their classes."""
    places = [i for i, c in enumerate(text) if alphabet(c)]
    if not places:
        return text
    sets = [alphabet(text[i]) for i in places]

    def build(d: list[int]) -> str:
        out = list(text)
        for i, s, x in zip(places, sets, d, strict=True):
            out[i] = s[x]
        return "".join(out)

    return build(walk([s.index(text[i]) for i, s in zip(places, sets, strict=True)], [len(s) for s in sets], key, tweak, lambda d: good(build(d))))


def with_case(text: str, like: str) -> str:
    """``text`` with the capitals of ``like``, place by place."""
    return "".join(c.upper() if o != o.lower() and len(c.upper()) == 1 else c for c, o in zip(text, like, strict=True))


def folded(text: str) -> str:
    """Small letters, place by place (letters whose small form is longer stay)."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def with_digits(like: str, digits: Iterable[int]) -> str:
    it = iter(digits)
    return "".join(str(next(it)) if c.isdecimal() else c for c in like)


def _luhn(digits: list[int]) -> int:
    """The check digit that belongs to these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 == 0 else d
    return -total % 10


def _email(x: str, key: bytes) -> str:
    head, _, last = x.rpartition(".")
    return with_case(permuted(folded(head), key, b"email"), head) + "." + last


def _card(x: str, key: bytes) -> str:
    d = [int(c) for c in x if c.isdecimal()]
    off = (d[-1] - _luhn(d[:-1])) % 10
    body = [d[0], *walk(d[1:-1], [10] * (len(d) - 2), key, b"card")]
    return with_digits(x, [*body, (_luhn(body) + off) % 10])


def _phone(x: str, key: bytes) -> str:
    """The last ten digits change, or all but the country's where there are fewer."""
    d = [int(c) for c in x if c.isdecimal()]
    keep = max(0, len(d) - 10)
    if x[0] == "+" and len(d) <= 10:
        keep = len(re.match(r"\+(\d+)", x)[1]) if re.match(r"\+(\d+)[ .(-]", x) else 2
    first = d[keep]
    tail = d[keep:]
    # a number's first digit stays what it was where it is 0 or 1, and otherwise is 2 to 9
    radices = [1 if first < 2 else 8, *[10] * (len(tail) - 1)]
    tail[0] = 0 if first < 2 else first - 2
    new = walk(tail, radices, key, b"phone")
    new[0] = first if first < 2 else new[0] + 2
    return with_digits(x, [*d[:keep], *new])


def _ssn(x: str, key: bytes) -> str:
    d = [int(c) for c in x if c.isdecimal()]
    return with_digits(x, walk(d, [10] * 9, key, b"ssn"))


def _private(o: list[int]) -> int:
    """Bytes that stay: of private and special networks their prefix, of public addresses none."""
    if o[0] in (0, 10, 127) or o[0] >= 224:
        return 1
    if o[:2] in ([192, 168], [169, 254]) or (o[0] == 172 and 16 <= o[1] < 32):
        return 2
    return 0


def _ip(x: str, key: bytes) -> str:
    o = [int(c) for c in x.split(".")]
    n = _private(o)
    new = walk(o[n:], [256] * (4 - n), key, b"ip", lambda d: n > 0 or _private(d) == 0)
    return ".".join(map(str, [*o[:n], *new]))


def _ip6(x: str, key: bytes) -> str:
    """Groups keep their length, groups of zeros stay, and so does a network prefix that isn't a public one; a public one's first digit stays."""
    texts = re.findall("[0-9A-Fa-f]+", x)
    value = [int(t, 16) for t in texts]
    base, radix = [], []
    for i, v in enumerate(value):
        top = not i and x[0] != ":"
        low = 16 ** (len(f"{v:x}") - 1)
        public = 0x2000 <= v < 0x4000
        base.append(v if not v or (top and not public) else v & 0xF000 if top else low)
        radix.append(1 if not v or (top and not public) else 0x1000 if top else 15 * low)
    new = walk([v - b for v, b in zip(value, base, strict=True)], radix, key, b"ip6" + b"".join(b"%x," % b for b in base))
    groups = iter(f"{b + d:x}".zfill(len(t)) for b, d, t in zip(base, new, texts, strict=True))
    out = re.sub("[0-9A-Fa-f]+", lambda _: next(groups), x)
    return out.upper() if x != x.lower() else out


def _iban(x: str, key: bytes) -> str:
    """Country stays; digits and letters change; the two check digits stay right, or stay wrong by as much."""
    plain = x.replace(" ", "")
    body = permuted(plain[4:].lower(), key, b"iban" + plain[:2].encode()).upper()
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    right = lambda s: 98 - number(s + plain[:2] + "00") % 97
    off = (int(plain[2:4]) - right(plain[4:])) % 100
    it = iter(plain[:2] + f"{(right(body) + off) % 100:02d}" + body)
    return "".join(c if c == " " else next(it) for c in x)


_HEX = "0123456789abcdef"


def _secret(x: str, key: bytes) -> str:
    low = folded(x)
    if (x == low or x == x.upper()) and all(c in _HEX for c in low):
        new = "".join(_HEX[i] for i in walk([_HEX.index(c) for c in low], [16] * len(low), key, b"hex" + (b"" if x == low else b"u"), lambda d: x == low or any(i > 9 for i in d)))
        return new if x == low else new.upper()
    return with_case(permuted(low, key, b"secret", lambda s: not all(c in _HEX for c in s)), x)


def _key(x: str, key: bytes) -> str:
    prefix = re.match(r"AKIA|gh[po]_|sk-|xox[bp]-", x)[0]
    return prefix + with_case(permuted(folded(x[len(prefix) :]), key, b"key"), x[len(prefix) :])


#: Endings of invented first names: of women, of men, and of other names that have such an ending.
_ENDINGS = (("ina", "in", "inu"), ("лина", "лин", "лину"), ("ινα", "ιν", "ινυ"))


_FAMILY = re.compile("(.{2,}(?:ов|ев|ёв|ин|ын))(а?)|(.{2,}ск)(ий|ая|ой)")


def _family(low: str) -> tuple[str, str, str] | None:
    """Stem, suffix and ending by gender of a Slavic family name."""
    m = _FAMILY.fullmatch(low)
    if not m or low.endswith(_ENDINGS[1]):
        return None
    body, ending = (m[1], m[2]) if m[1] else (m[3], m[4])
    return body[:-2], body[-2:], ending


def _name(x: str, key: bytes, gender: str = "") -> str:
    """Listed first names become listed names of the same gender and script, others invented ones.

    Family names whose ending tells the gender keep it, and the stem of both forms is one.
    """
    low = folded(x)
    if not gender and (parts := _family(low)):
        stem, suffix, ending = parts
        every = ("ий", "ая", "ой") if suffix == "ск" else ("", "а")
        fits = lambda s: not any((s + suffix + e) in LISTED or (s + suffix + e).endswith(_ENDINGS[1]) for e in every)
        return with_case(permuted(stem, key, b"family" + suffix.encode(), fits) + suffix + ending, x)
    if low in LISTED:
        names = LISTED[low]
        new = names[walk([names.index(low)], [len(names)], key, b"name" + names[0].encode())[0]]
        return new.upper() if x == x.upper() else new[:1].upper() + new[1:]
    # the endings of gendered names are theirs alone: a name that has one already gets the third
    marks = next((e for e in _ENDINGS if unicodedata.name(e[0][0]).split(" ")[0] == unicodedata.name(low[-1], "").split(" ")[0]), None)
    ending = ""
    if marks and len(low) > 1:
        ending = marks["fm".index(gender)] if gender else marks[2] if low.endswith(marks) else ""
    good = lambda s: s not in LISTED and (bool(ending) or not ((marks and s.endswith(marks)) or _family(s)))
    new = with_case(permuted(low, key, b"name", good), x)
    return new + (ending.upper() if len(x) > 1 and x == x.upper() else ending)


SURROGATE: dict[str, Callable[[str, bytes], str]] = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "ip6": _ip6, "iban": _iban, "secret": _secret, "key": _key, "name": _name, "name_m": partial(_name, gender="m"), "name_f": partial(_name, gender="f")}


@lru_cache(maxsize=1 << 16)
def surrogate(kind: str, text: str, key: bytes = KEY) -> str:
    """The surrogate of an entity."""
    return SURROGATE[kind](text, key)


def _is_ip6(x: str) -> bool:
    """An address with a digit and more than three signs, not a name like ``ab::cd``."""
    if not any(c.isdecimal() for c in x) or len(x.replace(":", "")) < 4:
        return False
    try:
        ipaddress.IPv6Address(x)
    except ValueError:
        return False
    return True


def session_key(spark: SparkSession) -> bytes:
    """The session's key, or this application's random one."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else KEY


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's entities, in order and without overlaps; of those that overlap the first wins, then the longest."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span("email"), "email") for m in _AT.finditer(text)]
    if _HINT.search(text):
        for m in _KEYS.finditer(text):
            kind = m.lastgroup
            if kind not in ("long", "key") or any(c.isdecimal() for c in m[kind]):
                found.append((*m.span(kind), "key" if kind == "key" else "secret"))
    for m in _DIGITS.finditer(text):
        kind = m.lastgroup if m.lastgroup in SURROGATE else next(k for k in ("card", "phone", "ip", "ssn", "iban") if m[k])
        if kind != "ip6" or _is_ip6(m[kind]):
            found.append((*m.span(kind), kind))
    found += [(*m.span(), "phone") for m in _NATIONAL.finditer(text)]
    low = text.lower()
    if any(w in low for w in _CALL_WORDS):
        found += [(*m.span(1), "phone") for m in _CALLED.finditer(text)]
    names: dict[str, str] = {}
    titled: list[tuple[int, int, str]] = []
    for m in _NAME.finditer(text):
        words = list(_WORD.finditer(text, *m.span("names")))
        gender = next((g for t in re.findall(_ANY_TITLE + r"\b", m["titles"]) if (g := _GENDER[t])), "")
        last = text[: words[-1].start()].endswith(("-", "‐", "‑"))  # the parts of a double name are one
        for i, w in enumerate(words):
            kind = "name_" + gender if gender and i < len(words) - 1 - last and len(w[0]) > 1 else ""
            titled.append((*w.span(), kind))
            if len(w[0]) > 1:
                for form in {w[0], w[0].upper(), w[0][0] + w[0][1:].lower() if w[0].isupper() else w[0]}:
                    names[form] = names.get(form) or kind
    found += [(a, b, kind or names.get(text[a:b]) or "name") for a, b, kind in titled]
    if names:
        edge = f"[\\w{_MARKS}]"
        mention = re.compile(f"(?<!{edge})(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + f")(?!{edge})")
        found += [(*m.span(), names[m[0]] or "name") for m in mention.finditer(text)]
    if len(found) < 2:
        return found
    out: list[tuple[int, int, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


_MAYBE = re.compile(r"[0-9@]")
_TITLE = re.compile("|".join(_TITLES.values()))


def replaced(text: str, key: bytes = KEY) -> tuple[str, int]:
    """The text with surrogates, and the number of entities."""
    if not _MAYBE.search(text) and not _TITLE.search(text) and not _HINT.search(text):
        return text, 0
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind in found:
        out += [text[at:start], surrogate(kind, unicodedata.normalize("NFC", text[start:end]) if kind.startswith("name") else text[start:end], key)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """(doc_id, text, n_entities) of every document, in one pass without a shuffle."""
    key = key or session_key(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [(None, 0) if t is None else replaced(t, key) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=["doc_id", "text", "n_entities"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(over_slices(run), f"doc_id {kind_of(docs, id_col)}, {SCHEMA}")


def replace_in(docs: DataFrame, text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """The documents with surrogates in their texts, with all of their columns."""
    key = key or session_key(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            old = part.column(at).to_pylist()
            new = [t if t is None else replaced(t, key)[0] for t in old]
            if any(a is not b for a, b in zip(old, new, strict=True)):
                part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
            yield part

    out = docs.mapInArrow(run, docs.schema)
    if isinstance(dict((f.name, f.dataType) for f in docs.schema).get("n_chars"), T.IntegralType) and text_col != "n_chars":
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and the number of entities."""
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet"))
