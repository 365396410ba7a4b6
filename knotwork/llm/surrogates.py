"""Personal data replaced by keyed, type-consistent surrogates.

Detected entities are addresses of mail, IP addresses of both kinds, card, account
(IBAN), phone and identity numbers, and names after a title, and in the same document
every later or earlier mention of a part of such a name. An entity has a canonical form
(digits of a number without country code, lower-case letters, the value of an address),
so that its spellings are one entity everywhere in the corpus, and one surrogate, which
keeps type, script, gender, issuer, network class and format.

Numbers and addresses are mapped by a keyed permutation of all values of their kind
without fixed points, so distinct entities have distinct surrogates by construction,
however full the space is, and no task needs a table. Names are made from a keyed hash
of (script, canonical form, gender, attempt). No made name may be a name of the corpus
or another's surrogate: collisions are found over the distinct names with two joins; of
those that collide the smallest keeps its surrogate and the others make the next
attempt, with longer names in time, until none collides. A given name has one gender,
that of most of its titles in the corpus. Only names that have a gender or are past
their first attempt form a table (`retries`).
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm.common import bounded, durable, fresh

#: Names of the table that are broadcast at most; beyond it they are joined to the documents that hold them.
MOST_BROADCAST = 200_000

# Titles by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Doña", "госпожа", "г-жа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н"),
    "n": ("Dr", "Prof"),
}
_GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
# A possessive 's is not part of a name, nor is a second title ("Herr Dr Weber").
_UPPER, _PART = r"[^\W\d_a-zà-öø-ÿа-яё]", r"['’-](?![sS](?!\w))[^\W\d_]+"
_SECOND = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts if t != "Don"), key=len, reverse=True))
_NAME = rf"(?!(?:{_SECOND})(?!\w)){_UPPER}(?:[^\W\d_]+|{_PART})(?:{_PART})*"
#: White space with one line break at most.
_GAP = r"(?:[^\S\n]+(?:\n[^\S\n]*)?|\n[^\S\n]*)"
#: Initials before a name: "J.", "J. R.", "J.-P.".
_INITIALS = rf"(?:(?P<initials>{_UPPER}\.(?:[^\S\n]?-?{_UPPER}\.)*){_GAP})?"
_PARTICLE = rf"(?:(?:de|del|della|di|da|do|dos|das|du|des|la|las|los|le|el|y|e|van|von|vom|der|den|ter|ten|zu|zum|zur|af|av|al|bin|ibn|фон){_GAP}){{0,3}}"

# How an entity is written. The first that matches at a place wins.
PATTERNS = (
    # Parts are bounded as addresses are, so that a long run of letters is not searched from each of its places.
    ("email", r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]{1,64}+(?:\.[A-Za-z0-9_%+-]{1,64}+){0,32}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,32}\.[A-Za-z]{2,63}"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)(?!\w)"),
    ("id", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])(?:\+\d{1,3}[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\d{2,4}){3,4}(?!\w)"),
    ("name", rf"(?<!\w)(?P<title>{_TITLE})\.?{_GAP}{_INITIALS}{_PARTICLE}(?P<given>{_NAME})(?:{_GAP}{_PARTICLE}(?P<family>{_NAME}))?(?:{_GAP}{_PARTICLE}(?P<last>{_NAME}))?"),
)
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
#: Every entity needs one of these, so texts without are not searched.
_HINT = re.compile(rf"@|\d|(?<!\w)(?:{_TITLE})\.?\s")
#: Words that can be a mention of a name, with the parts that hyphens and apostrophes join.
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’-][^\W\d_]+)*(?!\w)")

#: Entities that other patterns would cut up, and what a text needs to hold one.
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|[0-9A-Fa-f]{1,4})(?::?[0-9A-Fa-f]{1,4}){0,7}(?![\w:])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
# Country calling codes of one and of two digits; the others have three.
_ONE, _TWO = ("1", "7"), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

# Syllables of invented names, by script.
_SYLLABLES = {
    "latin": ("ba", "ca", "da", "fe", "ga", "he", "ja", "ka", "la", "ma", "na", "pe", "ra", "sa", "ta", "ve", "wi", "lo", "mi", "ro", "te", "li", "no", "be"),
    "cyrillic": ("ба", "ва", "га", "да", "же", "за", "ка", "ла", "ма", "на", "по", "ра", "са", "та", "фе", "ха", "ло", "ми", "ро", "те", "ли", "но", "бе", "ве"),
    "greek": ("βα", "γα", "δα", "ζα", "κα", "λα", "μα", "να", "πα", "ρα", "σα", "τα", "φα", "χα", "λο", "μι", "ρο", "τε", "λι", "νο", "βε", "κο", "δη", "νι"),
    "cjk": ("安", "柏", "晨", "德", "恩", "方", "光", "海", "佳", "康", "乐", "明", "宁", "平", "青", "瑞", "思", "天", "文", "新", "雅", "玉", "远", "志"),
    "arabic": ("با", "تا", "جا", "دا", "را", "سا", "فا", "كا", "لا", "ما", "نا", "ها", "لو", "مي", "رو", "تي", "لي", "نو", "بي", "سي", "شا", "زا", "حا", "وا"),
}
_ENDINGS = {
    "latin": {"f": ("na", "lia", "ra", "ela"), "m": ("no", "rio", "tan", "lek"), "n": ("ris", "lin", "ren", "kim"), "family": ("mann", "ford", "ley", "sen", "dez", "ier")},
    "cyrillic": {"f": ("на", "лия", "ра", "ела"), "m": ("ан", "ил", "тан", "лек"), "n": ("ша", "ня", "ля", "ка"), "family": ("ко", "ук", "ян", "ич")},
    "greek": {"f": ("να", "λια", "ρα", "ελα"), "m": ("νος", "ριος", "τας", "λης"), "n": ("ρις", "λιν"), "family": ("ιδης", "ακης", "πουλος", "ογλου")},
    "cjk": {"f": ("丽", "芳", "梅", "婷"), "m": ("强", "伟", "军", "刚"), "n": ("华", "林", "文", "宇"), "family": ("山", "川", "田", "原")},
    "arabic": {"f": ("ية", "نة", "مة"), "m": ("ان", "ير", "يم"), "n": ("ين", "ات"), "family": ("اوي", "اني", "وري")},
}


def _script(s: str) -> str:
    """The script of the first letter, as Unicode names it."""
    return unicodedata.name(s[0], "LATIN").split()[0].lower()


@lru_cache
def _letters_of(script: str) -> list[str]:
    """The small letters of a script, or all of one without cases; for names in scripts without syllables."""
    every = [chr(c) for c in range(0x250, 0xD7B0) if chr(c).isalpha() and _script(chr(c)) == script]
    return [c for c in every if c.islower()] or every


class Stream:
    """Numbers from HMAC-SHA-256 of a message."""

    def __init__(self, key: bytes, *message: object):
        self.key, self.message, self.block, self.pool = key, "\x1f".join(map(str, message)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.block.to_bytes(4, "big") + self.message, hashlib.sha256).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32

    def pick(self, options):
        return options[self.below(len(options))]


def luhn(digits: str) -> int:
    """0 if the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10


def scramble(key: bytes, tweak: str, x: int, n: int, fits: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of the numbers below n (of those that fit), in which none stays, if there are two.

    A Feistel network P over the next even number of bits gives Q = P^-1(P(x) + k), one
    cycle through all of its numbers as k is odd; steps along Q until a number is below
    n and fits are a cycle through just those.
    """
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask, size, seed = (1 << half) - 1, -(-half // 8), f"{tweak}\x1f{n}\x1f".encode("utf-8", "surrogatepass")

    def mix(i: int, v: int) -> int:
        return int.from_bytes(hashlib.shake_256(key + b"\0" + seed + bytes([i]) + v.to_bytes(size, "big")).digest(size), "big") & mask

    step = int.from_bytes(hashlib.shake_256(key + b"\1" + seed).digest(2 * size), "big") | 1
    while True:
        a, b = x >> half, x & mask
        for i in range(6):
            a, b = b, a ^ mix(i, b)
        x = ((a << half | b) + step) & ((1 << 2 * half) - 1)
        a, b = x >> half, x & mask
        for i in reversed(range(6)):
            a, b = b ^ mix(i, a), a
        x = a << half | b
        if x < n and (fits is None or fits(x)):
            return x


# What a place of a canonical form may hold, by what it holds.
_PLACES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def scramble_places(key: bytes, tweak: str, text: str) -> str:
    """A permutation of the texts with the same vowels, consonants, digits, capitals and marks at the same places."""
    kinds = [next((p for p in _PLACES if c in p), c) for c in text]
    n = x = 0
    for c, p in zip(text, kinds, strict=True):
        if len(p) > 1:
            n, x = max(n, 1) * len(p), x * len(p) + p.index(c)
    if not n:
        return text
    x, out = scramble(key, tweak + "\x1f" + "".join(p[0] for p in kinds), x, n), []
    for p in reversed(kinds):
        out.append(p if len(p) == 1 else p[x % len(p)])
        x //= len(p) if len(p) > 1 else 1
    return "".join(reversed(out))


def _country(digits: str) -> int:
    """How many of an international number's digits are its country code."""
    return 1 if digits.startswith(_ONE) else 2 if digits[:2] in _TWO else 3


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _groups(address: str) -> list[int] | None:
    """The eight numbers of an IPv6 address of the public, private or local-link range; None for other texts."""
    try:
        x = int(ipaddress.IPv6Address(address))
    except ValueError:
        return None
    out = [x >> 16 * i & 0xFFFF for i in reversed(range(8))]
    return out if out[0] >> 13 == 1 or out[0] >> 9 == 0x7E or out[0] >> 6 == 0x3FA else None


def entities(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical form, gender) in order; a name gives one for each of its parts, and of their mentions.

    The gender is f, m or n, as the title before a given name says, and empty for the rest.
    """
    out: list[tuple[int, int, str, str, str]] = []
    named: dict[str, str] = {}
    if not text or not _HINT.search(text):
        return out
    if text.count(":") > 1:
        out += [(*m.span(), "ipv6", str(ipaddress.IPv6Address(m[0])), "") for m in _IPV6.finditer(text) if _groups(m[0])]
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if _remainder(plain) == 1:
            out.append((*m.span(), "iban", plain, ""))
    taken = sorted(x[:2] for x in out)
    initials, people = [], []
    for m in FIND.finditer(text):
        kind = next(k for k, _ in PATTERNS if m[k] is not None)
        near = bisect_left(taken, (m.end(),))
        if near and taken[near - 1][1] > m.start():
            continue
        if kind == "name":
            script = _script(m["given"])
            parts = [p for p in ("given", "family", "last") if m[p]]
            people.append(([], _canonical(m[parts[-1]])))
            for part in parts:
                given = part == "given" and (len(parts) > 1 and not m["initials"])
                type_ = f"given-{script}" if given else f"family-{script}"
                for piece in re.finditer(r"[^-]+", m[part]):
                    canon = _canonical(piece[0])
                    named.setdefault(canon, type_)
                    at = m.start(part) + piece.start()
                    out.append((at, at + len(piece[0]), type_, canon, _GENDER[m["title"].casefold()] if given else ""))
                    if given:
                        people[-1][0].append(canon)
            if m["initials"]:
                initials += [(m.start("initials") + x.start(), x[0], people[-1][1], script) for x in re.finditer(r"[^\W\d_]", m["initials"])]
        elif kind == "email":
            out.append((m.start(), m.end(), kind, m[0].lower(), ""))
        elif kind == "ip":
            out.append((m.start(), m.end(), kind, ".".join(str(int(x)) for x in m[0].split(".")), ""))
        else:
            digits = "".join(c for c in m[0] if c.isdecimal())
            if kind == "phone":
                digits = digits[_country(digits) if m[0].startswith("+") else 0 :]
                digits = digits[1:] if digits.startswith("0") else digits
            out.append((m.start(), m.end(), f"{kind}{len(digits)}", digits, ""))
    known: dict[tuple[str, str], set[str]] = {}
    for given, family in people:
        for g in given[:1]:
            known.setdefault((family, g[0]), set()).add(g)
    for at, letter, family, script in initials:
        # An initial stands for the given name that the document knows with this family name, or for itself.
        whose = known.get((family, letter.casefold()), set())
        if len(whose) == 1:
            out.append((at, at + 1, f"given-{script}", *whose, ""))
        else:
            out.append((at, at + 1, f"initial-{script}", letter.casefold(), ""))
    return sorted(out + _mentions(text, named, sorted(out))) if named else sorted(out)


def _canonical(name: str) -> str:
    return name.casefold().replace("’", "'")


def _mentions(text: str, named: dict[str, str], found: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """Words outside of what was found that are not in lower case and equal a part of a name.

    named: type by canonical form. Of joined words the longest runs that are names count.
    """
    out: list[tuple[int, int, str, str, str]] = []
    starts = [x[0] for x in found]
    longest = max(len(re.findall(r"[^\W\d_]+", n)) for n in named)
    for m in _WORD.finditer(text):
        pieces = list(re.finditer(r"[^\W\d_]+", m[0]))
        i = 0
        while i < len(pieces):
            for j in range(min(len(pieces), i + longest), i, -1):
                s, e = m.start() + pieces[i].start(), m.start() + pieces[j - 1].end()
                canon = _canonical(text[s:e])
                before = bisect_left(starts, e)
                if canon in named and not text[s].islower() and not (before and found[before - 1][1] > s):
                    out.append((s, e, named[canon], canon, ""))
                    break
            else:
                j = i + 1
            i = j
    return out


#: Classes of IPv4 addresses that surrogates stay in: leading bits, and how many these are.
_NETWORKS = ((10, 8), (127, 8), (0, 8), (192 << 8 | 168, 16), (169 << 8 | 254, 16), (172 << 4 | 1, 12), (100 << 2 | 1, 10), (7, 3))


def _network(x: int) -> tuple[int, int] | None:
    return next(((lead, bits) for lead, bits in _NETWORKS if x >> 32 - bits == lead), None)


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0, gender: str = "n") -> str:
    """The canonical form of an entity's surrogate; only names have attempts and a gender."""
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        *host, top = domain.split(".")  # one domain stays one domain
        return scramble_places(key, "local", local) + "@" + ".".join([*(scramble_places(key, "domain", x) for x in host), top])
    if kind == "ip":
        x = int(ipaddress.IPv4Address(canon))
        net = _network(x)
        if net:
            low = 32 - net[1]
            x = net[0] << low | scramble(key, f"ip{net}", x & ((1 << low) - 1), 1 << low)
        else:
            x = scramble(key, "ip", x, 1 << 32, lambda y: _network(y) is None)
        return str(ipaddress.IPv4Address(x))
    if kind == "ipv6":
        groups = _groups(canon)
        at = [i for i in range(1, 8) if groups[i]]  # the first group and zeros stay
        x = 0
        for i in at:
            x = x << 16 | groups[i]
        if at:
            whole = lambda y: all(y >> 16 * j & 0xFFFF for j in range(len(at)))
            x = scramble(key, f"ipv6 {groups[0]} {at}", x, 1 << 16 * len(at), whole)
        for j, i in enumerate(reversed(at)):
            groups[i] = x >> 16 * j & 0xFFFF
        return ":".join(f"{g:x}" for g in groups)
    if kind == "iban":
        new = canon[:2] + "00" + scramble_places(key, "iban" + canon[:2], canon[4:].lower()).upper()
        return f"{new[:2]}{98 - _remainder(new):02d}{new[4:]}"
    if kind.startswith("card"):
        body = canon[0] + f"{scramble(key, kind + canon[0], int(canon[1:-1]), 10 ** (len(canon) - 2)):0{len(canon) - 2}d}"
        right = lambda b: next(c for c in range(10) if luhn(f"{b}{c}") == 0)
        # A wrong check digit is as wrong afterwards.
        return body + str((right(body) + int(canon[-1]) - right(canon[:-1])) % 10)
    if kind[-1].isdecimal():
        # A number that starts with 0 or 1 goes on to do so.
        n, low = 10 ** (len(canon) - 1), "" if canon[0] in "01" else "2"
        if low:
            return str(2 * n + scramble(key, kind, int(canon) - 2 * n, 8 * n))
        return canon[0] + (f"{scramble(key, kind + canon[0], int(canon[1:]), n):0{len(canon) - 1}d}" if canon[1:] else "")
    part, script = kind.split("-")
    if part == "initial":
        return _other_letter(key, canon)
    s = Stream(key, kind, canon, gender if part == "given" else "", attempt)
    if script not in _SYLLABLES:
        letters = _letters_of(script)
        return "".join(s.pick(letters) for _ in range(max(2, len(canon)) + attempt // 8))
    ending = s.pick(_ENDINGS[script][gender if part == "given" else "family"])
    few = 1 if script == "cjk" and len(canon) < 3 else 2
    return "".join(s.pick(_SYLLABLES[script]) for _ in range(few + attempt // 8)) + ending


def _other_letter(key: bytes, letter: str) -> str:
    """Another letter of the same script and case."""
    letters = list("abcdefghijklmnopqrstuvwxyz") if letter in "abcdefghijklmnopqrstuvwxyz" else sorted({*_letters_of(_script(letter)), letter})
    return letters[scramble(key, "initial", letters.index(letter), len(letters))] if len(letters) > 1 else letter


def in_format(found: str, kind: str, canon: str, new: str) -> str:
    """The surrogate's canonical form written as the entity was."""
    if kind == "email":
        return new.upper() if found.isupper() else new
    if kind == "ip":
        return new
    if kind == "ipv6":
        return _as_address(found, new)
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in found)
    if kind.startswith("initial"):
        return new.upper() if found.isupper() else new
    if kind.startswith(("given", "family")):
        if len(found) == 1 and len(canon) > 1:  # an initial
            return new[0].upper()
        return new.upper() if found.isupper() and len(found) > 1 else new.title() if found[0].isupper() else new
    digits = iter(new)
    skip = sum(c.isdecimal() for c in found) - len(canon)
    out = []
    for c in found:
        if c.isdecimal() and skip:
            skip -= 1
            out.append(c)
        else:
            out.append(next(digits) if c.isdecimal() else c)
    return "".join(out)


def _as_address(found: str, new: str) -> str:
    """Eight groups written with the gap, the case and the widths of an address."""
    groups = new.split(":")
    head, _, tail = found.partition("::")
    head, tail = (x.split(":") if x else [] for x in (head, tail))
    wide = lambda old, g: g.rjust(len(old), "0") if old.startswith("0") or len(old) == 4 else g
    first = [wide(o, g) for o, g in zip(head, groups, strict=False)]
    last = [wide(o, g) for o, g in zip(tail, groups[8 - len(tail) :], strict=True)]
    out = ":".join(first) + "::" + ":".join(last) if "::" in found else ":".join(first)
    return out.upper() if any(c.isupper() for c in found) else out


def replace(text: str | None, key: bytes, table: dict[tuple[str, str], tuple[int, str]]) -> tuple[str | None, int, str]:
    """The text with surrogates, the number of entities, and their spans in the old text; table: attempt and gender of names."""
    found = entities(text)
    if not found:
        return text, 0, ""
    out, at = [], 0
    for start, end, kind, canon, _ in found:
        new = surrogate(key, kind, canon, *table.get((kind, canon), ()))
        out += [text[at:start], in_format(text[start:end], kind, canon, new)]
        at = end
    return "".join(out) + text[at:], len(found), ",".join(f"{k}:{s}:{e}" for s, e, k, *_ in found)


_IS_NAME = "kind LIKE 'given-%' OR kind LIKE 'family-%'"


def distinct_entities(docs: DataFrame, names: bool = False) -> DataFrame:
    """kind, canon, gender: every entity once, or only the names; gender as most titles say, and n where none or as many say either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[tuple[str, str], list[int]] = {}
            for t in batch.column("text").to_pylist():
                for _, _, kind, canon, gender in entities(t):
                    if not names or kind.startswith(("given-", "family-")):
                        says = own.setdefault((kind, canon), [0, 0])
                        if gender in ("f", "m"):
                            says[gender == "m"] += 1
            rows = [(k, c, f, m) for (k, c), (f, m) in sorted(own.items())]
            kind, canon, f, m = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(canon, pa.string()), pa.array(f, pa.int64()), pa.array(m, pa.int64())], ["kind", "canon", "f", "m"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(bounded(run), "kind string, canon string, f long, m long")
    f, m = F.sum("f"), F.sum("m")
    return found.groupBy("kind", "canon").agg(F.when(f > m, "f").when(m > f, "m").otherwise("n").alias("gender"))


def resolve(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, gender, attempt, new: distinct surrogates of distinct entities, and of names none that is a name of the table.

    Each round only the names that collided try again, against all that have settled;
    later attempts are longer, so names never run out.
    """
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k, c, a, g) for k, c, g, a in zip(*(b.column(x).to_pylist() for x in ("kind", "canon", "gender", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "canon", "gender", "attempt")), pa.array(new, pa.string())], ["kind", "canon", "gender", "attempt", "new"])

    schema = "kind string, canon string, gender string, attempt int, new string"
    names, others = found.filter(_IS_NAME), found.filter(f"NOT ({_IS_NAME})")
    settled = others.withColumn("attempt", F.lit(0)).select("kind", "canon", "gender", "attempt").mapInArrow(bounded(assign), schema)
    originals = names.select(F.col("kind").alias("okind"), F.col("canon").alias("ocanon"))
    pending, won_before = names.withColumn("attempt", F.lit(0)), None
    while True:
        tried = durable(pending.select("kind", "canon", "gender", "attempt").mapInArrow(bounded(assign), schema))
        if tried.isEmpty():
            return settled
        real = (F.col("kind") == F.col("okind")) & (F.col("new") == F.col("ocanon"))
        free = tried.join(originals, real, "left_anti")
        if won_before is not None:
            free = free.join(won_before.select("kind", "new"), ["kind", "new"], "left_anti")
        owners = free.groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        won = durable(tried.join(owners, ["kind", "new", "canon"], "left_semi").select("kind", "canon", "gender", "attempt", "new"))
        won_before = won if won_before is None else won_before.unionByName(won)
        settled = settled.unionByName(won)
        pending = tried.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti").withColumn("attempt", F.col("attempt") + 1)


def apply(docs: DataFrame, key: bytes, retries: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with the text replaced, and n_entities, spans; retries: kind, canon, attempt, gender of the names that are not as by default.

    Where docs has a column n_entities or spans, the new one's name gets an underscore.
    """
    names = docs.columns
    out = T.StructType([*docs.schema.fields, T.StructField(fresh(names, "n_entities"), T.LongType()), T.StructField(fresh(names, "spans"), T.StringType())])
    few = retries.count() <= most_broadcast
    sent = docs.sparkSession.sparkContext.broadcast({(r.kind, r.canon): (r.attempt, r.gender) for r in retries.collect()} if few else {})
    held = fresh(names, "retries")
    if not few:
        docs = _with_own_retries(docs, retries, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(held).to_pylist() if not few else None
            rows = []
            for i, t in enumerate(b.column("text").to_pylist()):
                table = sent.value if own is None else {(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in own[i] or []}
                rows.append(replace(t, key, table))
            new = pa.array([r[0] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(new if c == "text" else b.column(c) for c in names), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], out.names)

    return docs.mapInArrow(bounded(run), out)


def _with_own_retries(docs: DataFrame, retries: DataFrame, held: str) -> DataFrame:
    """docs with a column `held`, the names of each row that are in retries; for more than are broadcast."""
    a, b, n = (fresh(docs.columns, c) for c in ("at", "at2", "len"))
    keyed = docs.withColumns({a: F.xxhash64("text"), b: F.xxhash64(F.lit(1), "text"), n: F.length("text")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(*r[:3], k, c) for r in zip(*(batch.column(x).to_pylist() for x in (a, b, n, "text")), strict=True) for _, _, k, c, _ in entities(r[3])})
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True))], ["a", "b", "n", "kind", "canon"])

    found = keyed.select(a, b, n, "text").mapInArrow(bounded(run), "a long, b long, n int, kind string, canon string").distinct()
    found = found.join(retries.select("kind", "canon", "attempt", "gender"), ["kind", "canon"])
    own = found.groupBy(F.col("a").alias(a), F.col("b").alias(b), F.col("n").alias(n)).agg(F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias(held))
    return keyed.join(own, [a, b, n], "left").drop(a, b, n)


def pseudonymise(docs: DataFrame, key: bytes, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with every entity replaced, and n_entities, spans (kind:start:end in the old text).

    A null text stays null, texts without entities stay as they are, repeated rows get
    the same surrogates, rows without doc_id are replaced like any other, a text of any
    length is searched whole, and an empty table stays empty. As many titles of either
    gender leave a given name neutral. Other columns are passed through; where docs has
    a column n_entities or spans, the new one's name gets an underscore.
    """
    found = durable(distinct_entities(docs, names=True))
    retries = resolve(found, key).filter((F.col("attempt") > 0) | (F.col("gender") != "n"))
    return apply(docs, key, retries, most_broadcast)
