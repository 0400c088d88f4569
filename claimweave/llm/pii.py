"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

An entity is a type and a canonical value (a phone number its digits, an address its lower case, a
name its folded letters), so that the same entity written differently stays the same. Its surrogate is
the canonical value that a keyed hash of (type, value, attempt) gives, written in the format of each
occurrence: digits for digits, the same case, separators and quotes; card numbers and IBANs keep their
check sums' validity, names keep their script and the ending usual for their gender.

Attempt 0 is computed where the text is. The distinct entities of all documents are also gathered, and
those whose surrogate is another entity's or is itself an original of the corpus get further attempts,
round by round, until no two entities share one. What is left after MAX_ATTEMPTS exchanges values. These exceptions are few; they are broadcast while
they are at most BROADCAST_ENTITIES, and beyond that joined to their documents.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices, text_or_empty, work_table

#: Exceptions that are broadcast at most (a type, a value and a number each).
BROADCAST_ENTITIES = 50_000
MAX_ATTEMPTS = 64
#: Attempts after which surrogates come from a wider space of the same type.
WIDEN = 4
#: Entities that exchange their values in one task, on average, where a format has too few values.
CYCLE = 100_000
DEFAULT_KEY = b"claimweave-surrogates"

# Common given names by script and gender, and titles by gender ("" says nothing).
MALE = "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul Hans Karl Klaus Jürgen Wolfgang Stefan Pierre Jean Michel Philippe Antoine Carlos José Juan Miguel Pedro Javier Иван Сергей Дмитрий Алексей Николай Γιώργος Νίκος Δημήτρης".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emily Emma Anna Julia Ursula Sabine Petra Heike Ingrid Marie Sophie Camille Nathalie Isabelle Claire Carmen Lucía Isabel Elena Pilar Мария Елена Ольга Наталья Анна Μαρία Ελένη Κατερίνα".split()
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "", "Prof": ""}

_GENDER = {**{n: "m" for n in MALE}, **{n: "f" for n in FEMALE}}
_UP, _LOW = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆ-Ώ]", r"[a-zß-öø-ÿа-яёα-ωά-ώ]"
_NAME = rf"{_UP}{_LOW}+(?:-{_UP}{_LOW}+)?"

#: Each kind is searched by itself, so that a candidate that fails its check hides nothing.
_EMAIL = re.compile(r"(?<![\w.+%-])\w[\w.+%-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])")
_SECRET = re.compile(
    r"""(?<![A-Za-z0-9_])(?:(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*["']?)(?P<value>[A-Za-z0-9_\-+/]{12,}={0,2})|(?<![A-Za-z0-9])(?=[0-9a-fA-F]*\d)(?P<hex>[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?P<aws>AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"""
)
_IBAN = re.compile(r"(?=(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))")
_IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(r"(?<![\w+])(?:\(\d{3}\)[\x20]?\d{3}[\x20.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3}\x20\d{3}\x20\d{4})(?!\d)")
_ABROAD = re.compile(r"(?<![\w+])\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d(?:[\x20.-]?\d){5,11}(?!\d)")
#: Digits in groups with one space or hyphen between, of which cards are whole groups.
_RUN = re.compile(r"(?<!\d)(?<!\d\.)\d+(?:[\x20-]\d+)*")
_DATE = re.compile(r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])")
_GROUP = re.compile(r"\d+")
#: Lengths of the groups in which cards are printed.
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 3, 3, 3), (6, 13), (8, 8)} | {(n,) for n in range(13, 20)}
_PERSON = re.compile(
    rf"(?<![\w'])(?:(?P<title>{'|'.join(TITLES)})\.?\x20(?:(?P<first>{_NAME})\x20)?(?P<last>{_NAME})|(?P<given>{'|'.join(sorted(_GENDER, key=len, reverse=True))})\x20(?P<family>{_NAME}))(?!\w)"
)
_HAS_NAME = re.compile("|".join([rf"{t}\.? " for t in TITLES] + [f"{n} " for n in _GENDER]))
# Words after which a capitalised given and family name stand, whatever they are.
CUES = ["Contact", "contact", "Dear", "Attn:", "Attention:", "Name:", "name:", "name is", "Name is", "Regards,", "Sincerely,", "Signed:", "signed by", "Signed by", "Patient:", "Employee:", "Customer:"]
#: One or more full names after a cue, joined by "and", "or", "&" or commas.
_CUED = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, CUES))})\s+(?P<names>{_NAME}\x20{_NAME}(?:(?:,\x20|\x20(?:and|or|&)\x20){_NAME}\x20{_NAME})*)(?!\w)")
_FULL = re.compile(rf"(?P<given>{_NAME})\x20(?P<family>{_NAME})")
# Words that announce a birth date or a passport, and those that end or begin the name of a street.
_BORN = ["born", "birth", "dob", "geboren", "geburt", "née", "né le", "nacid", "naissance"]
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Way Place Square".split()
STREETS_BEFORE = "rue avenue boulevard place calle plaza avenida".split()
STREETS_WITHIN = "straße strasse weg platz allee gasse".split()
_BIRTH = re.compile(rf"(?i:(?<!\w)(?:date\x20of\x20birth|d\.o\.b\.|{'|'.join(_BORN)})[^\d\n]{{0,24}}?)(?<!\d)(?P<value>\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?P<mark>[./-])\d{{1,2}}(?P=mark)\d{{4}})(?![\d-])")
_PASSPORT = re.compile(r"(?i:(?<!\w)(?:passport|reisepass|passeport|pasaporte)(?:\s+(?:no\.?|nr\.?|number|#|n°))?\s*[:=]?\s*)(?P<value>[A-Z]{0,2}\d{6,9})(?![A-Za-z0-9])")
_ADDRESS = re.compile(
    rf"(?<![\w.,-])(?:\d{{1,5}}[a-z]?\x20(?:{_NAME}\x20){{1,3}}(?:{'|'.join(STREETS)})|\d{{1,5}},?\x20(?:{'|'.join(STREETS_BEFORE)})\x20(?:(?:de\x20la|du|des|de)\x20)?{_NAME}(?:\x20{_NAME})?|{_UP}{_LOW}*(?:{'|'.join(STREETS_WITHIN)})\x20\d{{1,4}}[a-z]?)(?!\w)"
)
#: Words near a number that say it is a card's though its check sum is wrong.
_CARD_WORDS = re.compile(r"(?i:card|visa|mastercard|maestro|amex|karte|carte|tarjeta)\W{0,3}(?:(?:no|nr|number|num|#)\W{0,3})?\Z")
_MARKED = re.compile("[@0-9]")


def _may_hold(text: str) -> bool:
    """Whether any pattern but those of names can match: quick searches for what each of them needs."""
    if _MARKED.search(text) or "AKIA" in text:
        return True
    if "=" not in text and ":" not in text:
        return False
    low = text.lower()
    return any(word in low for word in ("token", "secret", "passw", "key"))


def _script(name: str) -> str:
    first = name[:1]
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each place where one may begin, the longest run of characters whose check sum is right."""
    for m in _IBAN.finditer(text):
        (a, b), ends = m.span(1), [m.end(1)]
        ends += [k for k in range(b - 1, a, -1) if text[k] == " "]
        for end in ends:
            plain = text[a:end].replace(" ", "")
            if len(plain) >= 12 and _iban_check(plain[:2], plain[4:]) == plain[2:4]:
                yield a, end
                break


def _phones(text: str) -> list[tuple[int, int]]:
    """Exact shapes, and numbers with a country code, which end where another number begins."""
    exact = [m.span() for m in _PHONE.finditer(text)]
    others = exact + [m.span() for m in _SSN.finditer(text)]
    abroad = []
    for m in _ABROAD.finditer(text) if "+" in text else ():
        a, b = m.span()
        cut = min([s for s, e in others if a < s < b < e], default=b)
        m = _ABROAD.fullmatch(text[a:cut].rstrip(" .-"))
        if m:
            abroad.append((a, a + m.end()))
    return abroad + [(a, b) for a, b in exact if not any(x <= a and b <= y for x, y in abroad)]


def _cards(text: str, taken: list[tuple[int, int]], doubtful: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of 13 to 19 digits with a right check sum, or 16 that a word calls a card, outside ``taken`` places.

    At ``doubtful`` places, which look like an IBAN, only a right check sum counts. A card is groups of a run as cards are printed, or after such a word any; a right check sum goes first.
    """
    for m in _RUN.finditer(text):
        a, b = m.span()
        if sum(c.isdigit() for c in m.group()) < 13:
            continue
        held = [(x, y) for x, y in taken if x < b and y > a] + [d.span() for d in _DATE.finditer(text, a, b)]
        runs: list[list[tuple[int, int]]] = [[]]
        for g in _GROUP.finditer(text, a, b):
            if any(x < g.end() and y > g.start() for x, y in held):
                runs.append([])
            else:
                runs[-1].append(g.span())
        for groups in runs:
            sizes, found = [y - x for x, y in groups], []
            for i in range(len(groups)):
                n = 0
                for k in range(i, len(groups)):
                    n += sizes[k]
                    if n > 19:
                        break
                    if n < 13:
                        continue
                    shape, whole = tuple(sizes[i : k + 1]), k - i + 1 == len(groups)
                    right = _luhn("".join(text[x:y] for x, y in groups[i : k + 1]))
                    sixteen = n == 16 and not any(x < groups[k][1] and y > groups[i][0] for x, y in doubtful) and _CARD_WORDS.search(text[max(0, groups[i][0] - 32) : groups[i][0]])
                    called = sixteen and (whole or shape in _CARD_GROUPS)
                    if called or right and (shape in _CARD_GROUPS or _CARD_WORDS.search(text[max(0, groups[i][0] - 32) : groups[i][0]])):
                        found.append((shape not in _CARD_GROUPS, not right, groups[i][0], groups[k][1]))
            # printed forms with a right sum, other runs with one, then 16 digits without
            yield from (f[2:] for f in sorted(found, key=lambda f: (f[1], f[0], f[2], -f[3])))


def _spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, type, canonical value)`` of the entities that patterns find, without overlaps.

    Candidates are checked first; of those that overlap the kind searched earlier stays, so that exact
    shapes go before runs of digits.
    """
    if _may_hold(text):
        taken: list[tuple[int, int, str, str]] = []

        def add(a: int, b: int, kind: str, value: str) -> None:
            if all(b <= x or y <= a for x, y, *_ in taken):
                taken.append((a, b, kind, value))

        for m in _EMAIL.finditer(text) if "@" in text else ():
            add(*m.span(), "email", m.group().lower())
        for m in _SECRET.finditer(text):
            part = next(k for k in ("value", "hex", "aws") if m.group(k) is not None)
            add(*m.span(part), "secret", m.group(part))
        for a, b in _ibans(text):
            add(a, b, "iban", text[a:b].replace(" ", ""))
        for m in _IPV4.finditer(text):
            add(*m.span(), "ipv4", ".".join(str(int(x)) for x in m.group().split(".")))
        for m in _SSN.finditer(text):
            add(*m.span(), "ssn", re.sub(r"\D", "", m.group()))
        for a, b in _phones(text):
            digits = re.sub(r"\D", "", text[a:b])
            add(a, b, "phone", digits[1:] if len(digits) == 11 and digits[0] == "1" else digits)
        low = text.lower()
        if any(word in low for word in _BORN) or "d.o.b" in low:
            for m in _BIRTH.finditer(text):
                add(*m.span("value"), "birth", m.group("value"))
        if "passport" in low or "reisepass" in low or "passeport" in low or "pasaporte" in low:
            for m in _PASSPORT.finditer(text):
                add(*m.span("value"), "passport", m.group("value"))
        for m in _ADDRESS.finditer(text):
            add(*m.span(), "address", m.group().lower())
        for a, b in _cards(text, [t[:2] for t in taken], [m.span(1) for m in _IBAN.finditer(text)]):
            add(a, b, "card", re.sub(r"\D", "", text[a:b]))
        yield from taken
    yield from _names(text)


def _name_kind(name: str, given: bool, gender: str = "") -> str:
    """A common given name is one wherever it stands, so that a name has one surrogate in each of its places."""
    known = _GENDER.get(name)
    if known or given:
        return f"given-{_script(name)}-{known or gender or 'f' * name.endswith(('a', 'α', 'а')) or 'm'}"
    return f"family-{_script(name)}"


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Names after a title, a common given name or a cue, and the same names elsewhere in the text."""
    known: dict[str, str] = {}
    held: set[int] = set()

    def place(m: re.Match, part: str, given: bool, gender: str = "", shift: int = 0) -> Iterator[tuple[int, int, str, str]]:
        name = m.group(part)
        if name and m.start(part) + shift not in held:
            kind = known.setdefault(name, _name_kind(name, given, gender))
            held.add(m.start(part) + shift)
            yield m.start(part) + shift, m.end(part) + shift, kind, name.lower()

    if _HAS_NAME.search(text):
        for m in _PERSON.finditer(text):
            gender = TITLES.get(m.group("title") or "", "")
            yield from place(m, "first", True, gender)
            yield from place(m, "given", True, gender)
            yield from place(m, "last", False)
            yield from place(m, "family", False)
    if any(cue in text for cue in CUES):
        for m in _CUED.finditer(text):
            for full in _FULL.finditer(m.group("names")):
                if full.group("given") not in TITLES:
                    yield from place(full, "given", True, "", m.start("names"))
                    yield from place(full, "family", False, "", m.start("names"))
    if known:  # the same person later in the text, by one name alone
        for m in re.finditer(rf"(?<![\w'])(?:{'|'.join(map(re.escape, known))})(?!\w)", text):
            if m.start() not in held:
                yield *m.span(), known[m.group()], m.group().lower()


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """Entities of a text from left to right, without overlaps (the earlier, then longer one wins)."""
    out: list[tuple[int, int, str, str]] = []
    for span in sorted(_spans(text or ""), key=lambda s: (s[0], -s[1])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


class _Stream:
    """Endless small numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.parts, self.n, self.pool = key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.parts + b"\x1f%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


# Syllables of invented names by script, and endings by gender.
_SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga ge go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi zo".split(), "cyrillic": "ба бе да де ка ки ла ле ма ми на не па ра ре са се та ти ва ве до ро".split(), "greek": "βα γα δα κα κε λα λε μα με να νε πα ρα ρε σα σε τα τε φα".split()}
_ENDINGS = {"latin": {"m": ["n", "r", "s", "rt", "ld"], "f": ["na", "ra", "la", "sa", "ia"], "": ["ner", "mann", "ton", "sen", "ley"]}, "cyrillic": {"m": ["н", "р", "м", "с"], "f": ["на", "ра", "ла", "ия"], "": ["нов", "ров", "лев"]}, "greek": {"m": ["ς", "νος", "ρης"], "f": ["να", "ρα", "λη"], "": ["ίδης", "άκης"]}}


_PRIVATE = [("10.0.0.0", 1 << 24), ("172.16.0.0", 1 << 20), ("192.168.0.0", 1 << 16)]


def surrogate(kind: str, value: str, attempt: int, key: bytes = DEFAULT_KEY) -> str:
    """Canonical surrogate of an entity: same type, keyed, never the value itself."""
    for again in range(64):
        made = _surrogate(kind, value, _Stream(key, kind, value, f"{attempt}.{again}"), attempt + again, key)
        if made != value:
            return made
    return made


def _like(value: str, stream: _Stream) -> str:
    """Character by character: digits for digits, hex letters for hex letters, letters for letters."""
    hexed = re.fullmatch(r"[0-9a-fA-F]+", value) is not None and len(value) >= 32
    letters = "abcdef" if hexed else "abcdefghijklmnopqrstuvwxyz"
    return "".join(str(stream.below(10)) if c.isdigit() else letters[stream.below(len(letters))] if c.islower() else letters[stream.below(len(letters))].upper() if c.isupper() else c for c in value)


_STREET_WORDS = {w.lower() for w in STREETS + STREETS_BEFORE} | {"de", "la", "du", "des"}


def _street_word(word: str, stream: _Stream, attempt: int) -> str:
    """Digits for digits and an invented name for a name; what kind of street it is stays."""
    if word[:1].isdigit():
        return str(1 + stream.below(9)) + "".join(str(stream.below(10)) if c.isdigit() else c for c in word[1:])
    if word in _STREET_WORDS:
        return word
    end = next((e for e in STREETS_WITHIN if word.endswith(e)), "")
    syllables = _SYLLABLES[_script(word)]
    return "".join(syllables[stream.below(len(syllables))] for _ in range(min(8, 2 + attempt // 4))) + (end or syllables[stream.below(len(syllables))])


def _surrogate(kind: str, value: str, stream: _Stream, attempt: int, key: bytes) -> str:
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        # one domain stays one domain; only the local part takes further attempts
        more = "".join("abcdefghij"[stream.below(10)] for _ in range(attempt // 16)) + ("abcdefghij"[attempt % 10] if attempt > 8 else "")
        return f"{_like(local, stream)}{more}@{_like(host, _Stream(key, 'host', domain))}.{top}"
    if kind == "secret":
        if attempt >= WIDEN and not re.search("[A-Za-z0-9]", value):  # only signs, which have no others like them
            return "".join("abcdefghijklmnopqrstuvwxyz0123456789"[stream.below(36)] for _ in value)
        return "AKIA" + _like(value[4:], stream) if re.fullmatch("AKIA[0-9A-Z]{16}", value) else _like(value, stream)
    if kind == "iban":
        rest = _like(value[4:], stream)
        return value[:2] + _iban_check(value[:2], rest) + rest
    if kind == "ipv4":
        if ip_address(value).is_private and attempt >= WIDEN:  # anywhere in the private networks
            at = stream.below(sum(n for _, n in _PRIVATE))
            for base, n in _PRIVATE:
                if at < n:
                    return str(ip_address(int(ip_address(base)) + at))
                at -= n
        if ip_address(value).is_private:
            return ".".join([value.split(".")[0], *(value.split(".")[1:2]), *(str(1 + stream.below(254)) for _ in range(2))])
        while True:
            made = ".".join(str(1 + stream.below(254)) for _ in range(4))
            if ip_address(made).is_global:
                return made
    if kind == "card":
        body = value[0] + "".join(str(stream.below(10)) for _ in value[1:-1])
        check = next(d for d in "0123456789" if _luhn(body + d))
        return body + (check if _luhn(value) else str((int(check) + 1 + stream.below(9)) % 10))
    if kind == "passport":
        return _like(value, stream)
    if kind == "birth":  # days and months from 1 to 12, so that the date is one in any order
        return re.sub(r"\d+", lambda m: str(1930 + stream.below(80)) if len(m.group()) == 4 else f"{1 + stream.below(12):0{len(m.group())}d}"[-2:], value)
    if kind == "address":
        return " ".join(_street_word(w, stream, attempt) for w in value.split(" "))
    if kind in ("phone", "ssn"):
        return str(2 + stream.below(7)) + "".join(str(stream.below(10)) for _ in value[1:])
    sort, script, *gender = kind.split("-")
    long = min(1 + max(0, len(value) - 4) // 2 + attempt // 4, 8)
    one = lambda: "".join(_SYLLABLES[script][stream.below(len(_SYLLABLES[script]))] for _ in range(long))
    ends = _ENDINGS[script][gender[0] if gender else ""]
    return "-".join(one() + ends[stream.below(len(ends))] for _ in value.split("-"))


def render(raw: str, kind: str, made: str) -> str:
    """The canonical surrogate in the format of an occurrence."""
    if kind in ("phone", "card", "ssn"):
        more = sum(c.isdigit() for c in raw) - len(made)  # a country code that the value leaves out
        digits = iter("1" * more + made)
        return "".join(next(digits) if c.isdigit() else c for c in raw)
    if kind == "iban":
        chars = iter(made)
        return "".join(c if c == " " else next(chars) for c in raw)
    if kind == "email":
        same = len(made) == len(raw)
        return "".join(m.upper() if o.isupper() else m for o, m in zip(raw, made)) if same else made.upper() if raw.isupper() else made
    if kind.startswith(("given", "family")):
        return "-".join(p[:1].upper() + p[1:] for p in made.split("-"))
    if kind == "address":
        return " ".join(m[:1].upper() + m[1:] if o[:1].isupper() else m for o, m in zip(raw.split(" "), made.split(" ")))
    return made


def replace(text: str | None, attempts: dict[tuple[str, str], int | str], key: bytes = DEFAULT_KEY) -> tuple[str | None, dict[str, int]]:
    """The text with surrogates, and how many entities of each type it held.

    ``attempts`` names the attempt, or the surrogate itself, of entities that don't have attempt 0.
    """
    if text is None:
        return None, {}
    out, at, seen = [], 0, {}
    for a, b, kind, value in find_entities(text):
        given = attempts.get((kind, value), 0)
        out += [text[at:a], render(text[a:b], kind, given if isinstance(given, str) else surrogate(kind, value, given, key))]
        sort = "name" if kind.startswith(("given", "family")) else kind
        seen[sort] = seen.get(sort, 0) + 1
        at = b
    return "".join([*out, text[at:]]), seen


def _entity_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [(i, k, v) for i, t in zip(part.column("row_key").to_pylist(), part.column("text").to_pylist()) for k, v in dict.fromkeys((k, v) for _, _, k, v in find_entities(t))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["row_key", "kind", "value"])


def entities(docs: DataFrame) -> DataFrame:
    """``(row_key, kind, value)``: the distinct entities of each text; equal texts share a key."""
    keyed = docs.select(F.xxhash64("text").alias("row_key"), text_or_empty().alias("text"))
    return keyed.mapInArrow(_entity_batches, "row_key long, kind string, value string")


def _made_batches(key: bytes):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "value", "attempt")), pa.array([surrogate(k, v, n, key) for k, v, n in rows], pa.string())], names=["kind", "value", "attempt", "made"])

    return made


def value_format(kind: str, value: str) -> str:
    """What a surrogate keeps of a value: values of one kind and format may stand for each other."""
    if kind == "ipv4":
        return str(ip_address(value).is_private)
    if kind == "email":
        return value.partition("@")[2]
    if kind == "iban":
        return value[:2] + re.sub("[A-Z]", "A", re.sub(r"\d", "0", value[4:]))
    if kind == "card":
        return f"{value[0]}{len(value)}{_luhn(value)}"
    if kind == "secret":
        return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", value)))
    if kind in ("birth", "passport"):
        return re.sub(r"\d", "0", value)
    if kind == "address":
        return re.sub(r"\d", "0", " ".join(w if w in _STREET_WORDS or w[:1].isdigit() else "x" + next((e for e in STREETS_WITHIN if w.endswith(e)), "") for w in value.split(" ")))
    return str(len(value)) if kind in ("phone", "ssn") else ""


def _format_batches(key: bytes):
    def formats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist()))
            drawn = [hmac.new(key, f"cycle\x1f{k}\x1f{v}".encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest() for k, v in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([value_format(k, v) for k, v in rows], pa.string()), pa.array(drawn, pa.string())], names=[*batch.schema.names, "format", "drawn"])

    return formats


def exchanged(left: DataFrame, settled: DataFrame, key: bytes) -> DataFrame:
    """``(kind, value, made)`` for the entities without a free surrogate, distinct by construction.

    Those of one format take each other's values, in a keyed circle: no surrogate is a value of these,
    because surrogates are no originals. Where one is left alone, it takes the surrogate of the least settled
    entity of its format, which takes its value.
    """
    own = work_table(left.select("kind", "value").mapInArrow(_format_batches(key), "kind string, value string, format string, drawn string"), "left")
    sizes = own.groupBy("kind", "format").agg(F.count(F.lit(1)).alias("n"))
    crowd = own.join(sizes.filter("n > 1"), ["kind", "format"])
    # some CYCLE to a bucket, by a hash: none holds a single one
    placed = crowd.withColumn("bucket", F.pmod(F.xxhash64("drawn"), F.ceil(F.col("n") / CYCLE)))
    circle = Window.partitionBy("kind", "format", "bucket").orderBy("drawn", "value")
    whole = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = placed.withColumn("made", F.coalesce(F.lead("value").over(circle), F.first("value").over(whole))).select("kind", "value", "made")
    alone = own.join(sizes.filter("n = 1"), ["kind", "format"]).select("kind", "format", F.col("value").alias("lone"))
    if alone.isEmpty():
        return out
    others = settled.join(alone.select("kind").distinct(), "kind").select("kind", "value", "made")
    others = others.mapInArrow(_format_batches(key), "kind string, value string, made string, format string, drawn string")
    partners = others.join(alone, ["kind", "format"]).groupBy("kind", "format", "lone").agg(F.min(F.struct("value", "made")).alias("p"))
    partners = work_table(partners, "partners")
    if partners.count() < alone.count():
        raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts: a format has too few values")
    swapped = partners.select("kind", F.col("lone").alias("value"), F.col("p.made").alias("made"))
    return out.unionByName(swapped).unionByName(partners.select("kind", F.col("p.value").alias("value"), F.col("lone").alias("made")))


def exceptions(distinct: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``(kind, value, attempt, made)`` of the entities that need an attempt beyond the first.

    ``made`` is null unless the surrogate isn't that of an attempt but another entity's value.

    ``distinct`` holds ``(kind, value)`` without repeats. A surrogate is refused if it is an original
    of its kind or another entity's surrogate; of entities that meet, the one settled first, then the
    smallest value keeps it.
    """
    schema = "kind string, value string, attempt int, made string"
    originals = distinct.select("kind", F.col("value").alias("made"))
    settled, todo = None, distinct.withColumn("attempt", F.lit(0))
    for attempt in range(MAX_ATTEMPTS):
        made = work_table(todo.mapInArrow(_made_batches(key), schema), "made")
        first = F.row_number().over(Window.partitionBy("kind", "made").orderBy("value")) == 1
        fresh = made.withColumn("first", first).join(originals.withColumn("taken", F.lit(True)), ["kind", "made"], "left")
        if settled is not None:
            fresh = fresh.join(settled.select("kind", "made", F.lit(True).alias("used")), ["kind", "made"], "left")
        else:
            fresh = fresh.withColumn("used", F.lit(None).cast("boolean"))
        ruled = work_table(fresh.withColumn("good", F.col("first") & F.col("taken").isNull() & F.col("used").isNull()).select("kind", "value", "attempt", "made", "good"), "ruled")
        good = ruled.filter("good").drop("good")
        settled = good if settled is None else settled.unionByName(good)
        todo = ruled.filter("NOT good").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return settled.filter("attempt > 0").select("kind", "value", "attempt", F.lit(None).cast("string").alias("made"))
    swapped = work_table(exchanged(todo, settled, key), "exchanged")
    drawn = settled.filter("attempt > 0").join(swapped.select("kind", "value"), ["kind", "value"], "left_anti")
    return drawn.select("kind", "value", "attempt", F.lit(None).cast("string").alias("made")).unionByName(swapped.select("kind", "value", F.lit(MAX_ATTEMPTS).alias("attempt"), "made"))


_COUNTED = ("email", "phone", "ipv4", "card", "ssn", "iban", "secret", "birth", "passport", "address", "name")


def _replace_batches(attempts, key: bytes, keep: list[str], with_map: bool):
    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = attempts.value if attempts is not None else {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts, counts = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    own = {(e["kind"], e["value"]): e["attempt"] if e["made"] is None else e["made"] for e in part.column("pii_map")[i].as_py() or ()} if with_map else known
                    new, seen = replace(text, own, key)
                    texts.append(new)
                    counts.append([seen.get(k, 0) for k in _COUNTED])
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in keep]
                columns += [pa.array([row[j] for row in counts], pa.int64()) for j in range(len(_COUNTED))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f"n_{k}" for k in _COUNTED)])

    return replaced


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, broadcast_limit: int = BROADCAST_ENTITIES) -> DataFrame:
    """``docs`` with surrogates in ``text``, and a count column ``n_<type>`` for each type of entity.

    Rows pass through one by one; null texts stay null, texts without entities stay as they are.
    Columns that are called like a count column are replaced.
    """
    added = [f"n_{k}" for k in _COUNTED]
    kept = docs.drop(*added, "pii_map", "row_key")
    found = work_table(entities(kept), "entities")
    odd = work_table(exceptions(found.select("kind", "value").distinct(), key), "exceptions")
    schema = StructType([*kept.schema])
    for name in added:
        schema = StructType([*schema, StructType().add(name, "long")[0]])
    if odd.count() <= broadcast_limit:
        known = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): r.attempt if r.made is None else r.made for r in odd.collect()})
        return kept.mapInArrow(_replace_batches(known, key, kept.columns, False), schema)
    maps = found.join(odd, ["kind", "value"]).distinct().groupBy("row_key").agg(F.collect_list(F.struct("kind", "value", "attempt", "made")).alias("pii_map"))
    joined = kept.withColumn("row_key", F.xxhash64("text")).join(maps, "row_key", "left").select(*kept.columns, "pii_map")
    return joined.mapInArrow(_replace_batches(None, key, kept.columns, True), schema)
