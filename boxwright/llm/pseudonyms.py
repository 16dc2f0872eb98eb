"""Personal data by format-preserving Feistel pseudonyms: validated values are permuted by key within their format.

A value is taken apart into symbols of its format (digits, hexadecimal digits, letters, a day number, an address), the
symbols run through a keyed Feistel network over their own domain, and the result is written back with the separators
and letter case of the original; check digits are computed anew. The network is a permutation of the domain, so equal
values get equal pseudonyms in every document, different ones stay different, and the key owner can invert it. Where a
domain has invalid members, the network is walked until it meets a valid one, which is a permutation of the valid ones.
Values that fail validation (a card number whose check digit is wrong, an octet over 255) are left alone. What follows a
value may look like more of it. A card's first digits say which lengths it may have, and its digits stand in one run or in
known groups; in the order of these lengths the first that has a valid check digit is the card, and a pseudonym is one that
is read the same way. So a card is found alike whatever stands beside it. A list of numbers is no card: at most
BESIDE groups may stand beside cards in groups. An IBAN's country says how long it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import blake2b, shake_256

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_batches, text_steps

#: For tests and the registered query; a deployment passes its own secret.
EXAMPLE_KEY = b"example key, not a secret"
ROUNDS = 8
_EPOCH, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
_HINT = re.compile(r"[0-9@]")
_CANDIDATES = re.compile(
    r"(?P<email>(?<![\w.+-])[^\W_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<secret>(?<=\")[0-9a-fA-F]{32,}(?=\")|(?<![0-9A-Za-z])(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{40,}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}|[a-z]{2}[0-9]{2}(?: ?[0-9a-z]){11,30})(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![\w/-])(?<![0-9]\.)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:(?=[Tt][0-9]{2}:)|(?![\w/-]|\.[0-9])))"
    r"|(?P<ip>(?<!\w)(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w+(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])|(?<![\w.-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![\w-]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![0-9A-Za-z])(?<![0-9A-Za-z]-)(?<![0-9]\.)(?=[0-9](?:[ -]?[0-9]){12})[0-9]+(?:(?: [0-9]+)+|(?:-[0-9]+)+|)(?![0-9A-Za-z_]|-(?![0-9])|\.[0-9]))"
)
#: Which lengths the cards have that begin with these digits, the usual one first.
CARD_LENGTHS = [
    ("4", "4", (16, 19, 13)), ("34", "34", (15,)), ("37", "37", (15,)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("62", "62", (16, 17, 18, 19)),
    ("3528", "3589", (16, 17, 18, 19)), ("36", "36", (14,)), ("38", "39", (14,)), ("300", "305", (14,)), ("50", "50", (16, 18, 19)), ("56", "58", (16, 18, 19)), ("60", "69", (16, 18, 19)),
]
#: The groups that a card's digits are written in.
CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 6, 5), (4, 6, 4)}
#: Groups of digits that may stand before and after cards in groups, together.
BESIDE = 2
#: Lengths of IBANs by country.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}


class Feistel:
    """Keyed permutations of ranges and symbol strings; with ``back``, their inverses.

    Round functions are as wide as the half that they change, so no part of a value of any length stays as it was.
    """

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = blake2b(key, digest_size=32).digest(), back
        self.order, self.sign = (range(ROUNDS - 1, -1, -1), -1) if back else (range(ROUNDS), 1)
        self.known: dict[tuple[str, str], str] = {}

    def _round(self, tweak: bytes, i: int, value: int) -> int:
        return int.from_bytes(blake2b(tweak + bytes([i]) + value.to_bytes(8, "big"), key=self.key, digest_size=16).digest(), "big")

    def _split(self, value: int, left: int, right: int, tweak: bytes) -> int:
        """One permutation of range(left * right), up to 2**64: halves add keyed functions of each other."""
        a, b = divmod(value, right)
        for i in self.order:
            if i % 2:
                b = (b + self.sign * self._round(tweak, i, a)) % right
            else:
                a = (a + self.sign * self._round(tweak, i, b)) % left
        return a * right + b

    def number(self, value: int, size: int, tweak: bytes, valid: Callable[[int], bool] = lambda _: True) -> int:
        """A permutation of the valid members of range(size)."""
        right = 1
        while right * right < size:
            right *= 2
        left = -(-size // right)
        while True:
            value = self._split(value, left, right, tweak)
            if value < size and valid(value):
                return value

    def symbols(self, text: str, alphabet: str, tweak: bytes) -> str:
        """A permutation of the strings of this length over ``alphabet``: halves add keyed streams of each other, symbol by symbol."""
        base, n = len(alphabet), len(text)
        if not n:
            return ""
        place = {c: i for i, c in enumerate(alphabet)}
        if n == 1:
            return alphabet[self.number(place[text], base, tweak + bytes([base, 1]))]
        values = [place[c] for c in text]
        halves = [values[: n // 2], values[n // 2 :]]
        head = self.key + tweak + bytes([base]) + n.to_bytes(8, "big")
        for i in self.order:
            changed, read = i % 2, 1 - i % 2
            stream = shake_256(head + bytes([i, *halves[read]])).digest(4 * len(halves[changed]))
            halves[changed] = [(x + self.sign * y) % base for x, y in zip(halves[changed], memoryview(stream).cast("I"), strict=True)]
        return "".join([alphabet[x] for half in halves for x in half])


_DIGITS, _HEX, _LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"


def _refill(pattern: str, symbols: str, belongs: Callable[[str], bool]) -> str:
    """``pattern`` with its belonging characters replaced in order, upper case where it had upper case."""
    source = iter(symbols)
    return "".join((n.upper() if c.isupper() else n) if belongs(c) and (n := next(source)) else c for c in pattern)


def luhn_valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(digits: str) -> str:
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_valid(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def card_lengths(digits: str) -> tuple[int, ...]:
    """Lengths of cards that begin like these digits; none if no card does."""
    return next((lengths for low, high, lengths in CARD_LENGTHS if low <= digits[: len(low)] <= high), ())


def card_length(digits: str, ends: list[int]) -> int:
    """Of the lengths ``ends`` the one at which a card ends; 0 if it ends at none."""
    return next((n for n in card_lengths(digits) if n in ends and luhn_valid(digits[:n]) and len(set(digits[:n])) > 1), 0)


def _ends(groups: list[int]) -> list[int]:
    """Where a card that begins with the first of these groups may end."""
    return [sum(groups[:k]) for k in range(1, 6) if k == 1 or tuple(groups[:k]) in CARD_GROUPS]


def card_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the cards in a list of groups of digits."""
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    sizes = [b - a for a, b in groups]
    single = [(a, b) for a, b in groups if b - a > 12 and card_length(text[a:b], [b - a])]
    if single or len(groups) < 3:
        return single
    for before in range(min(BESIDE, len(groups) - 3) + 1):
        k, found = before, []
        while k < len(groups) and (n := card_length("".join(text[a:b] for a, b in groups[k : k + 5]), [e for e in _ends(sizes[k : k + 5]) if e > sizes[k]])):
            last = k
            while sum(sizes[k : last + 1]) < n:
                last += 1
            found.append((groups[k][0], groups[last][1]))
            k = last + 1
        if found and before + len(groups) - k <= BESIDE:
            return found
    return []


def _card(f: Feistel, text: str) -> str:
    digits, groups = re.sub(r"[ -]", "", text), [len(x) for x in re.split("[ -]", text)]
    ends = _ends(groups) if len(groups) > 1 else groups
    body = digits[:-1]
    while True:
        body = f.symbols(body, _DIGITS, b"card")
        made = body + luhn_digit(body)
        if card_length(made, ends) == len(made):
            return _refill(text, made, str.isdigit)


def _iban(f: Feistel, text: str) -> str | None:
    bare = text.replace(" ", "")
    if not 15 <= len(bare) <= 34 or not iban_valid(bare) or bare[0].islower() and IBAN_LENGTHS.get(bare[:2].upper()) != len(bare):
        return None
    digits, letters = "".join(filter(str.isdigit, bare[4:])), "".join(filter(str.isalpha, bare[4:])).lower()
    body = _refill(_refill(bare[4:], f.symbols(letters, _LETTERS, b"iban"), str.isalpha), f.symbols(digits, _DIGITS, b"iban"), str.isdigit)
    check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
    source = iter(bare[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(source) for c in text)


def _date(f: Feistel, text: str) -> str | None:
    """A day of 1900 to 2099. What is no date with the day first may be one with the month first; its pseudonym is neither."""
    numbers = [int(x) for x in re.split(r"[-/.]", text)]
    forms = ["%Y-%m-%d"] if text[4] == "-" else [f"%d{text[2]}%m{text[2]}%Y", f"%m{text[2]}%d{text[2]}%Y"]
    for form in forms:
        order = dict(zip((x[0] for x in form.split("%")[1:]), numbers, strict=True))
        try:
            at = (date(order["Y"], order["m"], order["d"]) - _EPOCH).days
        except ValueError:
            continue
        if not 0 <= at < _DAYS:
            return None
        late = form[1] == "m"  # the month first
        made = _EPOCH + timedelta(f.number(at, _DAYS, b"date", (lambda n: (_EPOCH + timedelta(n)).day > 12) if late else (lambda _: True)))
        return made.strftime(form)
    return None


def _ip(f: Feistel, text: str) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    return ".".join(map(str, f.number(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip").to_bytes(4, "big")))


def _phone(f: Feistel, text: str) -> str | None:
    country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head = country.group() if country else text[:1] if text[0] == "+" else ""
    digits = re.sub(r"[^0-9]", "", text[len(head) :])
    if not 7 <= len(digits) <= 15:
        return None
    return head + _refill(text[len(head) :], f.symbols(digits, _DIGITS, b"phone"), str.isdigit)


def _ssn_valid(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(f: Feistel, text: str) -> str | None:
    n = int(text.replace("-", ""))
    return _refill(text, f"{f.number(n, 10**9, b'ssn', _ssn_valid):09d}", str.isdigit) if _ssn_valid(n) else None


def _email(f: Feistel, text: str) -> str | None:
    local, _, domain = text.rpartition("@")
    lower = local.lower()
    letters, accented, digits = ("".join(c for c in lower if c in known) for known in (_LETTERS, _ACCENTED, _DIGITS))
    if not letters and not digits and not accented:
        return None
    # the letters' permutation depends on the original digits: names that differ in digits alone share no letters
    numbers = f.symbols(digits, _DIGITS, b"email")
    mixed = f.symbols(letters, _LETTERS, b"email" + (numbers if f.back else digits).encode())
    others = f.symbols(accented, _ACCENTED, b"email")
    plain = _refill(_refill(local, mixed, lambda c: c.lower() in _LETTERS), numbers, lambda c: c in _DIGITS)
    return _refill(plain, others, lambda c: c.lower() in _ACCENTED) + "@" + domain


def _secret(f: Feistel, text: str) -> str | None:
    return _refill(text, f.symbols(text.lower(), _HEX, b"secret"), lambda c: c.lower() in _HEX)


_KINDS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def _stretches(value: str) -> list[str]:
    """What may be an IBAN at a candidate's start: its whole first groups, of its country's length before all, then the longest."""
    found = [value, *(value[: m.start()] for m in reversed([*re.finditer(" ", value)]))]
    usual = IBAN_LENGTHS.get(value[:2].upper())
    found.sort(key=lambda x: len(x.replace(" ", "")) != usual)
    return found


def _places(kind: str, value: str) -> list[list[tuple[int, int]]]:
    """Where values may be in a candidate: lists of starts and ends, of which the first that has one counts."""
    if kind == "card":
        return [[place] for place in card_spans(value)]
    return [[(0, len(x)) for x in (_stretches(value) if kind == "iban" else [value])]]


def pseudonymised(f: Feistel, text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end (in the original) of each replaced value."""
    if not _HINT.search(text):
        return text, []
    parts, spans, at, search = [], [], 0, 0
    while match := _CANDIDATES.search(text, search):
        kind, whole, start = match.lastgroup, match.group(), match.start()
        search = start
        for choices in _places(kind, whole):
            for low, high in choices:
                value = whole[low:high]
                if pseudonym := f.known.get((kind, value)) or _KINDS[kind](f, value):
                    break
            else:
                continue
            if len(f.known) > 200_000:
                f.known.clear()
            if len(value) < 100:
                f.known[kind, value] = pseudonym
            parts += [text[at : start + low], pseudonym]
            at = search = start + high
            spans.append((kind, start + low, at))
        if kind == "card":  # the last group may begin something else
            search = max(search, start + max(whole.rfind(" "), whole.rfind("-")) + 1, start + 1)
            if search == start + 1:
                search = match.end()
        elif search == start:
            search = start + max(1, re.match(r"\w*", whole).end())
    return "".join([*parts, text[at:]]), spans


def _replacing(key: bytes, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key, back)
        for batch in batches:
            for step in text_steps(batch):
                done = [(None, []) if t is None else pseudonymised(f, t) for t in step.column("text").to_pylist()]
                yield pa.record_batch(
                    [
                        step.column("doc_id").cast(pa.int64()),
                        pa.array([t for t, _ in done], pa.string()),
                        pa.array([len(s) for _, s in done], pa.int64()),
                        pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "text", "n_replaced", "spans"],
                )

    return run


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """(doc_id, text, n_replaced, spans) of each row of ``docs`` (doc_id, text; further columns are ignored).

    ``spans`` lists kind, start and end (code points of the original) of the replaced values, in order. A null text stays
    null with no spans; texts without valid values come back as they are. Each row is treated on its own, whatever its
    doc_id; an empty table gives an empty result. Values may have any length. With ``back`` the key owner turns
    pseudonyms into the originals: they are of the same formats, so the same places are found.
    """
    return map_batches(docs.select("doc_id", "text"), _replacing(key, back), "doc_id long, text string, n_replaced long, spans array<struct<kind string, start long, end long>>")
