"""PII surrogates: keyed, type-consistent replacements that keep distinctness and coreference.

Entities: email, key (PEM private keys), secret (long hex strings, provider keys, JSON web tokens), iban, card, ssn, phone, ipv4, ipv6,
person. Persons are found by title, by a listed given name before another name, by cue ("my name is", "Dear", a name right before
its mail address or number), and, once found, by their single names elsewhere in the same text.

An entity's canonical form (case folded, separators dropped, addresses as numbers) is mapped by a keyed bijection on strings
of the same shape: each character stays in its class (digit, vowel or consonant of its script and case, ideograph, ...), so
format and script are kept, the same entity gets the same surrogate in every document however it is written, and distinct entities of a
type never meet. Mailbox and domain are mapped apart, so one domain stays one domain, under its own top-level domain. Phones keep their
country code, cards whether their check digit is right, IPv6 addresses their zero groups, persons their title and gender: listed
given names are permuted within the list of their gender, other names walk on until they meet no listed one.

Collision check: every surrogate is mapped back before it is used and must give its entity again, which no two entities can
share; a failure raises. `collisions` lists, for a whole corpus, any surrogate that two entities share.

Defined cases: null text stays null with no entities; empty text stays empty; overlapping candidates resolve to the
leftmost, then to the type listed first; repeated rows get equal results; an empty table gives no rows; other columns pass through, a
column named as the spans (`entities`) is replaced; very long texts are scanned whole.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import unused

#: The session setting that holds the secret key, and what stands in for it where it is unset, as in tests.
KEY_SETTING, TEST_KEY = "spark.quillspark.pii.key", "not a secret: set spark.quillspark.pii.key"
# Given names by gender, titles by gender.
FEMALE = "Alice Amanda Andrea Anna Barbara Camille Carla Carmen Caroline Charlotte Clara Diana Elena Elisabeth Emily Emma Eva Hannah Helen Ines Isabel Jane Jessica Julia Karen Laura Linda Lisa Lucia Maria Marta Mary Nina Olivia Patricia Paula Sarah Sofia Susan Teresa".split()
MALE = "Adam Alexander Andrew Antonio Carlos Christian Daniel David Diego Edward Felix Frank George Hans Henry Jack James Jean Johann John Jorge Joseph Juan Karl Louis Lucas Luis Marco Mark Martin Michael Oscar Paul Pedro Peter Philip Robert Stefan Thomas William".split()
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Dr": "", "Prof": ""}
# Words that follow a cue without being a name.
NO_NAMES = frozenset("All Colleague Colleagues Customer Everyone Friend Friends Madam Sir Sirs Student Students Team".split())
# Telephone country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Words that follow a cue without being a name.
NO_NAMES = frozenset("All Colleague Colleagues Customer Everyone Friend Friends Madam Sir Sirs Student Students Team".split())
# Telephone country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Words that follow a cue without being a name.
NO_NAMES = frozenset("All Colleague Colleagues Customer Everyone Friend Friends Madam Sir Sirs Student Students Team".split())
# Telephone country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Words that follow a cue without being a name.
NO_NAMES = frozenset("All Colleague Colleagues Customer Everyone Friend Friends Madam Sir Sirs Student Students Team".split())
# Telephone country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Words that follow a cue without being a name.
NO_NAMES = frozenset("All Colleague Colleagues Customer Everyone Friend Friends Madam Sir Sirs Student Students Team".split())
# Telephone country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßğışžčřšćłńśźż"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"

_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_cap = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+"
PATTERNS = {
    "email": re.compile(r"(?<![\w%+-])(?<![\w%+-]\.)[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "secret": re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|(?<![_-])sk-[0-9A-Za-z_-]{20,}|(?<![_-])eyJ[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,})(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d{9}(?![\w-]))(?!\d)"),
    "ipv4": re.compile(rf"(?<![\d.])(?:{_octet}\.){{3}}{_octet}(?!\d|\.\d)"),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![0-9A-Za-z:])"),
    "person": re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\b\.? {_cap}(?: {_cap})?|(?:{'|'.join(FEMALE + MALE)}) {_cap})"),
}
TYPES = ["key", *PATTERNS]
_key_head, _key_foot, _key_line = re.compile(r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"), re.compile(r"\s*-----END (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"), re.compile(r"[A-Za-z0-9+/=]{16,}\s*|[A-Za-z-]{1,40}: [^\n]*|\s*")
#: Where a name, the group, follows a cue or stands before its owner's address or number.
CUES = (
    re.compile(rf"(?i:\b(?:name is|name:|named|dear)) ({_cap}(?: {_cap}){{0,2}})"),
    re.compile(rf"(?i:\b(?:i am|i'm|signed,?|sincerely,|regards,|attn:|contact:|patient|customer|employee))\s({_cap}(?: {_cap}){{1,2}})"),
    re.compile(rf"\b({_cap}(?: {_cap}){{1,2}}) ?(?=[<(] ?(?:[\w%+.-]+@|\+\d)|, ?\+\d)"),
)


def _classes() -> dict[str, str]:
    out = {}
    for letters in ("0123456789", VOWELS, CONSONANTS, ACCENTED, GREEK, CYRILLIC):
        for c in letters:
            out[c] = letters
        upper = "".join(dict.fromkeys(c.upper() for c in letters if len(c.upper()) == 1 and c.upper() not in out))
        for c in upper:
            out.setdefault(c, upper)
    return out


CLASS_OF = _classes()
#: Larger scripts as ranges of code points.
RANGES = [(0x4E00, 0x9FA5), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3), (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0905, 0x0939)]


def _radix(c: str, plain: dict[str, str] | None = None) -> tuple[int, int]:
    """(size of the character's class, its place there); (1, 0) stays."""
    letters = (plain or CLASS_OF).get(c)
    if letters:
        return len(letters), letters.index(c)
    at = ord(c)
    for low, high in RANGES:
        if low <= at <= high:
            return high - low + 1, at - low
    return 1, 0


def _char(c: str, place: int, plain: dict[str, str] | None = None) -> str:
    letters = (plain or CLASS_OF).get(c)
    if letters:
        return letters[place]
    for low, high in RANGES:
        if low <= ord(c) <= high:
            return chr(low + place)
    return c


class Surrogates:
    """Keyed bijections by entity type. Each method maps a canonical form, forth with step 1, back with step -1."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.known: dict[tuple[str, str], tuple[str, str]] = {}
        self.orders: dict[tuple[str, int], list[int]] = {}

    def _round(self, label: str, k: int, value: int, most: int) -> int:
        data = f"{label}:{k}:".encode() + value.to_bytes(value.bit_length() // 8 + 1, "big")
        size = most.bit_length() // 8 + 9
        h = hashlib.blake2b(data, key=self.key, digest_size=size).digest() if size <= 64 else hashlib.shake_256(self.key + data).digest(size)
        return int.from_bytes(h, "big") % most

    def permute(self, label: str, x: int, n: int, step: int = 1) -> int:
        """A fixed-point-free keyed bijection of range(n): a Feistel network around a shift by one."""
        if n < 2:
            return x
        a = int(n**0.5) or 1
        while n % a:
            a -= 1
        if a > 1:
            return self._halves(label, x, a, n // a, step)
        if n > 5000:  # no halves: a shift of a long range, a keyed order of a short one
            return (x + step * (1 + self._round(label, 0, n, n - 1))) % n
        order = self.orders.get((label, n))
        if order is None:
            order = self.orders[label, n] = sorted(range(n), key=lambda i: self._round(label, i, n, 1 << 128))
        return order[(order.index(x) + step) % n]

    def _halves(self, label: str, x: int, a: int, b: int, step: int) -> int:
        left, right = divmod(x, b)
        for k in range(8):
            left = (left + self._round(label, 2 * k, right, a)) % a
            right = (right + self._round(label, 2 * k + 1, left, b)) % b
        left, right = divmod((left * b + right + step) % (a * b), b)
        for k in reversed(range(8)):
            right = (right - self._round(label, 2 * k + 1, left, b)) % b
            left = (left - self._round(label, 2 * k, right, a)) % a
        return left * b + right

    def shape(self, label: str, text: str, step: int = 1, plain: dict[str, str] | None = None) -> str:
        """The text with every character replaced by one of its class."""
        radix = [_radix(c, plain) for c in text]
        free = [k for k, (n, _) in enumerate(radix) if n > 1]  # what can change, in two halves
        if not free:
            return text
        sizes, places = [1, 1], [0, 0]
        for i, k in enumerate(free):
            h = 2 * i >= len(free)
            sizes[h], places[h] = sizes[h] * radix[k][0], places[h] * radix[k][0] + radix[k][1]
        value = places[0] * sizes[1] + places[1]
        value = self._halves(label, value, *sizes, step) if sizes[0] > 1 and sizes[1] > 1 else self.permute(label, value, sizes[0] * sizes[1], step)
        out = list(text)
        for k in reversed(free):
            value, place = divmod(value, radix[k][0])
            out[k] = _char(text[k], place, plain)
        return "".join(out)

    def replace(self, kind: str, text: str) -> tuple[str, str]:
        """(surrogate, entity): the text that takes the entity's place, and a keyed name of the entity itself."""
        done = self.known.get((kind, text))
        if done is None:
            if len(self.known) > 100_000:
                self.known.clear()
            plain, move = canonical(kind, text), getattr(self, f"_{kind}")
            new = move(plain, 1)
            if move(new, -1) != plain:
                raise RuntimeError(f"a surrogate of type {kind} does not lead back to its entity")
            entity = hashlib.blake2b(f"{kind}:{plain}".encode("utf-8", "surrogatepass"), key=self.key, digest_size=8).hexdigest()
            done = self.known[kind, text] = (_written(kind, text, new), entity)
        return done

    def _email(self, c: str, step: int) -> str:
        box, _, domain = c.partition("@")
        body, _, top = domain.rpartition(".")
        return f"{self.shape('mailbox', box, step)}@{self.shape('domain', body, step)}.{top}"

    def _key(self, c: str, step: int) -> str:
        head, foot = _key_head.match(c).end(), c.rfind("-----END ")
        foot = foot if foot >= head else len(c)
        return c[:head] + "\n".join(self.shape(f"key{k}", x, step) for k, x in enumerate(c[head:foot].split("\n"))) + c[foot:]

    def _secret(self, c: str, step: int) -> str:
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|eyJ|", c)[0]
        if not head:
            return self.shape("secret", c, step, HEX)
        return head + ".".join(self.shape("secret", x, step) for x in c[len(head) :].split("."))

    def _iban(self, c: str, step: int) -> str:
        return c[:2] + self.shape("iban", c[2:], step)

    def _card(self, c: str, step: int) -> str:
        off = (int(c[-1]) - _luhn(c[:-1])) % 10
        new = self.shape("card", c[:-1], step)
        return new + str((_luhn(new) + off) % 10)

    def _ssn(self, c: str, step: int) -> str:
        return self.shape("ssn", c, step)

    def _phone(self, c: str, step: int) -> str:
        code, _, rest = c.partition("|")
        return f"{code}|{self.shape('phone', rest, step)}"

    def _ipv4(self, c: str, step: int) -> str:
        return str(self.permute("ipv4", int(c), 1 << 32, step))

    def _ipv6(self, c: str, step: int) -> str:
        """Groups that are zero stay so: an address that can be shortened still can."""
        groups = [int(x, 16) for x in c.split(":")]
        full = [k for k, g in enumerate(groups) if g]
        value = 0
        for k in full:
            value = value * 65535 + groups[k] - 1
        half = len(full) // 2  # of two groups or more
        value = self._halves(f"ipv6:{full}", value, 65535**half, 65535 ** (len(full) - half), step)
        for k in reversed(full):
            value, g = divmod(value, 65535)
            groups[k] = g + 1
        return ":".join(f"{g:x}" for g in groups)

    def _person(self, c: str, step: int) -> str:
        return " ".join(self._name(w, step) for w in c.split(" "))

    def _name(self, word: str, step: int) -> str:
        for names in GIVEN:
            if word in names:
                return names[self.permute("given", names.index(word), len(names), step)]
        new = self.shape("name", word, step)
        while new in LISTED:
            new = self.shape("name", new, step)
        return new


HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
GIVEN = [[n.lower() for n in names] for names in (FEMALE, MALE)]
LISTED = frozenset(GIVEN[0] + GIVEN[1])
_title = re.compile(rf"(?:{'|'.join(TITLES)})\b\.? ")


def _low(text: str) -> str:
    """Lower case, where that keeps every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text


def _phone_digits(text: str) -> tuple[str, str]:
    """Country code, rest."""
    digits = re.sub(r"\D", "", text)
    if not text.startswith("+"):
        return "", digits
    code = next((digits[:k] for k in (1, 2) if digits[:k] in COUNTRY_CODES), digits[:3])
    return code, digits[len(code) :]


def canonical(kind: str, text: str) -> str:
    """The same for every way to write an entity."""
    if kind == "email":
        return _low(text)
    if kind == "key":
        return text
    if kind == "secret":
        return text.lower() if re.fullmatch(r"[0-9a-fA-F]+", text) else text
    if kind == "phone":
        return "|".join(_phone_digits(text))
    if kind == "ipv4":
        return str(int(ipaddress.IPv4Address(text)))
    if kind == "ipv6":
        return ":".join(f"{int(g, 16):x}" for g in ipaddress.IPv6Address(text).exploded.split(":"))
    if kind == "person":
        return _low(_title.sub("", text, count=1))
    return re.sub(r"[^0-9A-Za-z]", "", text)


def _written(kind: str, old: str, new: str) -> str:
    """A canonical surrogate in the way its entity was written."""
    if kind == "key":
        return new
    if kind == "ipv4":
        return str(ipaddress.IPv4Address(int(new)))
    if kind == "ipv6":
        address = ipaddress.IPv6Address(new)
        out = str(address) if "::" in old else address.exploded if all(len(g) == 4 for g in old.split(":")) else new
        return out.upper() if old != old.lower() else out
    if kind == "phone":
        return _pour(old, new.replace("|", ""))
    if kind == "person":
        title = _title.match(old)
        words = old[title.end() if title else 0 :].split(" ")
        return (title[0] if title else "") + " ".join(_like_case(w, n) if len(w) == len(n) and w != w.capitalize() else n.upper() if w.isupper() and len(w) > 1 else n.capitalize() for w, n in zip(words, new.split(" ")))
    return _like_case(old, new) if kind in ("email", "secret") else _pour(old, new)


def _like_case(old: str, new: str) -> str:
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(old, new)) if old != old.lower() else new


def _pour(old: str, fresh: str) -> str:
    """fresh's characters in the places of old's letters and digits."""
    it = iter(fresh)
    return "".join(next(it) if c.isalnum() else c for c in old)


def _luhn(digits: str) -> int:
    """The check digit that belongs after digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 - k % 2)
        total += v - 9 if v > 9 else v
    return -total % 10


_digit = re.compile(r"\d")


def _valid(kind: str, found: str) -> bool:
    if kind != "ipv6":
        return True
    try:
        return sum(g != "0000" for g in ipaddress.IPv6Address(found).exploded.split(":")) > 1
    except ValueError:
        return False


def _leftmost(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    out, end = [], 0
    for start, _, stop, kind in sorted(found):
        if start >= end:
            out.append((start, stop, kind))
            end = stop
    return out


def _private_keys(text: str):
    """(start, end) of PEM private keys: to the closing line, or as far as lines look like a key's."""
    end = 0
    for m in _key_head.finditer(text):
        if m.start() < end:
            continue
        end = m.end()
        while end < len(text):
            foot = _key_foot.match(text, end)
            if foot:
                end = foot.end()
                break
            stop = text.find("\n", end + 1)
            stop = stop if stop >= 0 else len(text)
            if not _key_line.fullmatch(text, end + (text[end] == "\n"), stop):
                break
            end = stop
        yield m.start(), end


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type), in order, without overlaps."""
    found = []
    digits = _digit.search(text) is not None
    if "PRIVATE KEY-----" in text:
        found += [(a, 0, b, "key") for a, b in _private_keys(text)]
    for rank, (kind, pattern) in enumerate(PATTERNS.items(), 1):
        if kind == "email" and "@" not in text or kind == "ipv6" and "::" not in text and text.count(":") < 7 or kind in ("iban", "card", "ssn", "phone", "ipv4") and not digits:
            continue
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if _valid(kind, m[0])]
    last = len(TYPES)
    for pattern in CUES:
        found += [(m.start(1), last, m.end(1), "person") for m in pattern.finditer(text) if NO_NAMES.isdisjoint(m[1].split(" "))]
    spans = _leftmost(found)
    names = {w for a, b, kind in spans if kind == "person" for w in _title.sub("", text[a:b], count=1).split(" ")}
    if names:  # single names of persons that the text has named
        again = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=lambda w: (-len(w), w))))})\b")
        starts, more = [a for a, _, _ in spans], []
        for m in again.finditer(text):
            k = bisect.bisect_left(starts, m.end()) - 1  # the last span that starts before the name ends
            if k < 0 or spans[k][1] <= m.start():
                more.append((m.start(), m.end(), "person"))
        spans = sorted(spans + more)
    return spans


def redact(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int, str, str]]]:
    """New text; type, start and end in the old text, surrogate and entity of each."""
    parts, spans, last = [], [], 0
    for start, stop, kind in detect(text):
        new, entity = surrogates.replace(kind, text[start:stop])
        parts += [text[last:start], new]
        spans.append((kind, start, stop, new, entity))
        last = stop
    return "".join([*parts, text[last:]]), spans


FIELDS = ("type", "start", "end", "surrogate", "entity")
SPANS = "array<struct<type string, start int, end int, surrogate string, entity string>>"
_span_type = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("entity", pa.string())]))


def replace_pii(df: DataFrame, key: str, text: str = "text", entities: str | None = "entities") -> DataFrame:
    """df with the text column's entities replaced, and their spans in the column `entities` (None: none)."""

    made: list[Surrogates] = []

    @F.arrow_udf(f"struct<text string, entities {SPANS}>")
    def run(column: pa.Array) -> pa.Array:
        if not made:
            made.append(Surrogates(key))
        found = [redact(x.as_py(), made[0]) if x.is_valid else (None, []) for x in column]
        spans = [[dict(zip(FIELDS, s)) for s in f[1]] for f in found]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array(spans, _span_type)], ["text", "entities"])

    at = unused(df, "_found")
    out = df.withColumn(at, run(F.col(text))).withColumn(text, F.col(at)["text"])
    return (out.withColumn(entities, F.col(at)["entities"]) if entities else out).drop(at)


def session_key(spark: SparkSession) -> str:
    """The key that this session is given."""
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


def collisions(replaced: DataFrame, entities: str = "entities") -> DataFrame:
    """(type, surrogate, entities) for surrogates that stand for more than one entity of the corpus: empty if all is well."""
    e = replaced.select(F.explode(entities).alias("e")).select("e.type", "e.entity", F.lower(F.regexp_replace("e.surrogate", f"^{_title.pattern}", "")).alias("s"))
    plain = F.when(F.col("type").isin("email", "ipv4", "ipv6", "person", "key"), F.col("s")).otherwise(F.regexp_replace("s", "[^0-9A-Za-z+]", ""))
    pairs = e.filter("type <> 'secret'").select("type", plain.alias("surrogate"), "entity").distinct()
    return pairs.groupBy("type", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = replace_pii(docs, session_key(spark))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.to_json("entities").alias("entities"))
