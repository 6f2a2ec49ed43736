"""PII: format-preserving Feistel pseudonyms.

One pass finds candidates; each is validated by its kind's own rule (Luhn, mod 97, octets, calendar,
area and group numbers). A valid value is replaced by a keyed permutation inside its own format: digits
stay digits, separators stay, letters keep their case, check digits are computed anew, dates stay dates.
The permutation depends on the key, the kind and the length alone, so equal values stay equal, and
different values different, across all documents and all runs with the same key.

Defined results: a null text stays null with no findings; overlapping candidates go to the leftmost,
then to the kind listed first, then to the longest valid one; groups are left off its end only where no
whole candidate that is valid begins inside; repeated rows get the same pseudonyms; an empty table gives
no rows; extra columns are ignored. The time is in proportion to the length of a text, whatever is in it:
every part of a pattern is bounded. Without a key nothing runs.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrowed

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date", "secret")
#: The setting that holds the key, where none is given. There is no default: who knows the key can undo every pseudonym.
KEY_CONF = "spark.loomlens.pii.key"
ROUNDS = 10

#: One source a kind, in the order in which they are tried at one start.
SOURCES = {
    "email": r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63})",
    "iban": r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)",
    "secret": r"(?P<secret>(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[A-Za-z0-9_\-+/]{12,}))",
    "date": r"(?P<date>(?<![\w.-])(?:[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}|[0-9]{2}(?P<s2>[-/.])[0-9]{2}(?P=s2)[0-9]{4})(?:(?=[Tt][0-9]{2}:?[0-9]{2})|(?![\w-]|\.[0-9])))",
    "ip": r"(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))",
    "ssn": r"(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))",
    "phone": r"(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w-]))",
    "card": r"(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))",
}
PATTERN = re.compile("|".join(SOURCES.values()))
ALONE = {kind: re.compile(source) for kind, source in SOURCES.items()}
#: Kinds of several groups, and what must hold behind the last one.
GROUPED = {"iban": re.compile(r"\b"), "phone": re.compile(r"(?![\w-])"), "card": re.compile(r"(?![\w-])")}
FIRST_RUN = re.compile(r"(?s:\w+|.)")
#: A text without any of these has no candidate.
MAY = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")


@lru_cache(maxsize=200_000)
def _round(key: bytes, i: int, radix: int, n: int, value: int, most: int) -> int:
    h = hashlib.blake2b(b"%d|%d|%d|%d" % (i, radix, n, value), key=key, digest_size=max(16, most // 8 + 9))
    return int.from_bytes(h.digest(), "big")


def permute(value: int, radix: int, n: int, key: bytes) -> int:
    """A keyed permutation of the numbers of n digits in this radix: an unbalanced Feistel network."""
    if n == 1:
        return (value + _round(key, 0, radix, 1, 0, 8)) % radix
    low = n // 2
    a, b = divmod(value, radix**low)
    sizes = (radix ** (n - low), radix**low)
    for i in range(ROUNDS):
        if i % 2 == 0:
            a = (a + _round(key, i, radix, n, b, sizes[0].bit_length())) % sizes[0]
        else:
            b = (b + _round(key, i, radix, n, a, sizes[1].bit_length())) % sizes[1]
    return a * sizes[1] + b


def restore(value: int, radix: int, n: int, key: bytes) -> int:
    """The inverse of ``permute``."""
    if n == 1:
        return (value - _round(key, 0, radix, 1, 0, 8)) % radix
    low = n // 2
    a, b = divmod(value, radix**low)
    sizes = (radix ** (n - low), radix**low)
    for i in reversed(range(ROUNDS)):
        if i % 2 == 0:
            a = (a - _round(key, i, radix, n, b, sizes[0].bit_length())) % sizes[0]
        else:
            b = (b - _round(key, i, radix, n, a, sizes[1].bit_length())) % sizes[1]
    return a * sizes[1] + b


DIGITS, LOWERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def walk(value: int, size: int, key: bytes) -> int:
    """A permutation of 0..size-1: the next power of ten's, repeated until it lands inside."""
    n = len(str(size - 1))
    while True:
        value = permute(value, 10, n, key)
        if value < size:
            return value


def permute_in(text: str, alphabet: str, key: bytes) -> str:
    """The characters of text that are in the alphabet, permuted as one number; others stay in place."""
    at = [i for i, c in enumerate(text) if c in alphabet]
    if not at:
        return text
    radix, value = len(alphabet), 0
    for i in at:
        value = value * radix + alphabet.index(text[i])
    value, out = permute(value, radix, len(at), key), list(text)
    for i in reversed(at):
        value, d = divmod(value, radix)
        out[i] = alphabet[d]
    return "".join(out)


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(text: str, key: bytes) -> str | None:
    digits = [i for i, c in enumerate(text) if c.isdigit()]
    number = "".join(text[i] for i in digits)
    if luhn_digit(number[:-1]) != number[-1] or len(set(number)) == 1:
        return None
    new = permute_in(number[:-1], DIGITS, key)
    out = list(text)
    for i, c in zip(digits, new + luhn_digit(new), strict=True):
        out[i] = c
    return "".join(out)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = permute_in(permute_in(plain[4:], DIGITS, key), LOWERS.upper(), key)
    new = plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = walk(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key)
    return ".".join(map(str, value.to_bytes(4, "big")))


FIRST_DAY, DAYS = datetime.date(1000, 1, 1).toordinal(), datetime.date(9999, 12, 31).toordinal() - datetime.date(1000, 1, 1).toordinal() + 1
RECENT, RECENT_DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _date(text: str, key: bytes) -> str | None:
    """Equal days in different formats get equal days again; 1900-2099 stays in itself."""
    sep = next(c for c in text if not c.isdigit())
    a, b, c = map(int, text.split(sep))
    year_first = text[4] == sep
    for y, m, d, form in ([(a, b, c, 0)] if year_first else [(c, b, a, 1), (c, a, b, 2)]):
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            continue
        if day < FIRST_DAY:
            continue
        base, size = (RECENT, RECENT_DAYS) if RECENT <= day < RECENT + RECENT_DAYS else (FIRST_DAY, DAYS)
        while True:
            day = base + walk(day - base, size, key)
            t = datetime.date.fromordinal(day)
            # A month-first date is one whose second number can only be a day; it stays one.
            if (size == RECENT_DAYS or not RECENT <= day < RECENT + RECENT_DAYS) and (form != 2 or t.day > 12):
                break
        if form == 2:
            return sep.join((f"{t.month:02d}", f"{t.day:02d}", f"{t.year:04d}"))
        return sep.join((f"{t.year:04d}", f"{t.month:02d}", f"{t.day:02d}") if form == 0 else (f"{t.day:02d}", f"{t.month:02d}", f"{t.year:04d}"))
    return None


def _ssn(text: str, key: bytes) -> str | None:
    valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    if not valid(text):
        return None
    while True:
        text = permute_in(text, DIGITS, key)
        if valid(text):
            return text


def _phone(text: str, key: bytes) -> str | None:
    n = sum(c.isdigit() for c in text)
    if not 9 <= n <= 15:
        return None
    head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|", text)[0]
    return head + permute_in(text[len(head) :], DIGITS, key)


#: Longer values are permuted in pieces of so many characters, as the numbers of a network get long with them.
PIECE = 256


def _mixed(text: str, key: bytes) -> str:
    if len(text) > PIECE:
        return "".join(_mixed(text[i : i + PIECE], key) for i in range(0, len(text), PIECE))
    if re.fullmatch(r"[0-9a-f]+", text):
        return permute_in(text, HEX, key)
    for alphabet in (DIGITS, LOWERS, LOWERS.upper()):
        text = permute_in(text, alphabet, key)
    return text


def _email(text: str, key: bytes) -> str:
    name, _, host = text.partition("@")
    host, dot, top = host.rpartition(".")
    return f"{_mixed(name, key)}@{_mixed(host, key)}{dot}{top}"


RULES = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


def _valid_at(text: str, m: re.Match, key: str, shorter: bool) -> tuple[str, int, int, str] | None:
    """(kind, start, end, new value) of the first kind, from that of m on, with a valid value where m starts: the whole candidate or, if shorter, the longest with groups left off its end."""
    start, kinds = m.start(), list(SOURCES)
    for kind in kinds[kinds.index(next(k for k in KINDS if m[k])) :]:
        c = ALONE[kind].match(text, start)
        if c is None:
            continue
        if kind == "secret":
            return kind, *c.span("value"), _mixed(c["value"], _kind_key(key, kind))
        ends = [c.end()]
        if shorter:
            ends = [e for e in range(c.end() - 1, start, -1) if kind in GROUPED and not text[e].isalnum() and text[e - 1].isalnum() and GROUPED[kind].match(text, e) and ALONE[kind].fullmatch(text, start, e)]
        for end in ends:
            new = RULES[kind](text[start:end], _kind_key(key, kind))
            if new is not None:
                return kind, start, end, new
    return None


def _behind(text: str, at: int) -> int:
    return FIRST_RUN.match(text, at).end()


def _shortened(text: str, m: re.Match, key: str) -> tuple[str, int, int, str] | None:
    """A valid value where m starts with groups left off its end, unless a whole one begins inside and ends behind it."""
    hit = _valid_at(text, m, key, True)
    at = _behind(text, m.start())
    while hit and (m := PATTERN.search(text, at)) and m.start() < hit[2]:
        whole = _valid_at(text, m, key, False)
        if whole and whole[2] > hit[2]:
            return None
        at = _behind(text, m.start())
    return hit


def pseudonymise(text: str, key: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every valid value replaced, and (kind, start, end) of each in the input."""
    found: list[tuple[str, int, int]] = []
    if not MAY.search(text):
        return text, found
    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        hit = _valid_at(text, m, key, False) or _shortened(text, m, key)
        if hit is None:  # nothing valid starts here: look again behind its first run of word characters
            at = _behind(text, m.start())
            continue
        kind, start, end, new = hit
        out += [text[done:start], new]
        found.append((kind, start, end))
        done = at = end
    return "".join([*out, text[done:]]), found


@lru_cache(maxsize=64)
def _kind_key(key: str, kind: str) -> bytes:
    return hashlib.blake2b(f"{key}|{kind}".encode(), digest_size=32).digest()


def pii(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pseudonymised text, n_found, and the spans (kind, start, end) in the input. Refuses to run without a key."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"pseudonyms need a secret key: give one or set {KEY_CONF}")
    src = narrowed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, found = [], []
            for t in batch.column(1):
                t = t.as_py()
                new, spans = (None, []) if t is None else pseudonymise(t, key)
                texts.append(new), found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, span)], [id_col, text_col, "n_found", "spans"])

    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, n_found long, spans array<struct<kind:string,start:long,end:long>>")


#: For the query over made-up tables alone, where no key is set: results must not differ between runs.
QUERY_KEY = "made-up tables hold no secrets"


def op7(spark, sf_dir: str) -> DataFrame:
    return pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(KEY_CONF, None) or QUERY_KEY)
