"""Personal data: format-preserving Feistel pseudonyms.

Each kind of value is found by a pattern, validated (Luhn, mod 97, calendar, ranges), read as a number below the
size of its format's domain, and mapped by a keyed Feistel permutation of that domain (cycle walking inside the
next square domain). The result is written in the format of the original: separators, length, letter case and
check digits hold. The permutation depends on key, kind and shape alone, so equal values stay equal in every
document and different ones stay different; reveal() inverts it with the key. As in any permutation a value may map to itself,
with a chance of one over the size of the domain.

Kinds: card (13 to 19 digits, Luhn, from a digit group's start to a group's end, also beside other numbers), iban (mod 97,
also before other words), phone (North American with separators, or + or 00 and 8 to 15 digits), ssn, ipv4, date (ISO, also before
a time, or day, month and year between / or .; 1900 to 2099), email (local part), secret (access-key ids, tokens with a
known prefix, tokens and passwords after = or :). Ten digits without a separator, a prefix or a cue are no phone: most are other numbers.

Values are linked within a format: a.b@x.com and A.B@x.com, or one date written two ways, have pseudonyms of their own.

The key is an argument; where none is given it is the session's setting `spark.talus.pii.key`, and where that is unset a
random one that lasts as long as the session, so that pseudonyms link within a run but nobody can invert them later.

Defined cases: null and empty texts stay as they are; numbers that no validation accepts stay; where matches of
two kinds overlap, the one that starts first, then the longer, then the first kind of the list counts; rows with
a null doc_id and repeated rows are treated alike; pseudonymize() keeps all columns of the
input, and report() counts the replaced values of each row.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEY_SETTING = "spark.talus.pii.key"
ROUNDS = 10

# What each kind looks like before validation.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9_-])(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|sk-|npm_|hf_|AIza)[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_-])|(?i:\b(?:password|passwd|pwd|token|secret|api_?key)\b\s*[=:]\s*[\"']?)[A-Za-z0-9+/_-]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.])\d{1,2}\1\d{4})(?![\w/-])|(?<![\w/.-])\d{4}-\d{2}-\d{2}(?=T\d\d:)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\w)|(?<![\w+])(?:\+|(?<!\d[ -])00)[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-])",
}
KINDS = tuple(PATTERNS)
_NORTH_AMERICAN = re.compile(PATTERNS["phone"].partition(r"|(?<![\w+])(?:\+")[0])
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_NUMERIC = tuple(k for k in KINDS if k not in ("email", "secret"))
_SECRET_CUE = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|sk-|npm_|hf_|AIza|(?i:passw|pwd|token|secret|api_?key)")
_PREFIX = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|sk-|npm_|hf_|AIza)(?=[A-Za-z0-9_-]{16,}\Z)")
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() - datetime.date(1900, 1, 1).toordinal() + 1


class Feistel:
    """A keyed permutation of 0 .. size - 1 for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, x: int, width: int) -> int:
        h = hashlib.blake2b(x.to_bytes((width + 7) // 8 + 1, "big") + bytes([r]) + tweak, key=self.key, digest_size=(width + 7) // 8 + 8)
        return int.from_bytes(h.digest(), "big") & ((1 << width) - 1)

    def _once(self, x: int, half: int, tweak: bytes, back: bool) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ self._round(tweak, r, a, half), a) if back else (b, a ^ self._round(tweak, r, b, half))
        return (a << half) | b

    def permute(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)

        def walk(y: int) -> int:
            while (y := self._once(y, half, tweak, back)) >= size:
                pass
            return y

        return walk(x)


def luhn_digit(digits: str) -> str:
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _card_spans(run: str) -> list[tuple[int, int]]:
    """Valid cards in a run of digit groups, from a group's start to a group's end: the usual groupings first, then the first, then the longer."""
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    options = []
    for i, (a, _) in enumerate(groups):
        digits, shape = "", []
        for c, b in groups[i:]:
            digits, shape = digits + run[c:b], [*shape, b - c]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and digits[0] in "23456" and luhn_digit(digits[:-1]) == digits[-1]:
                usual = len(shape) == 1 or shape in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
                options.append((not usual, a, -b))
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(options):
        if all(-b <= c or d <= a for c, d in out):
            out.append((a, -b))
    return sorted(out)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in turn."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _radix(values: list[int], sizes: list[int]) -> tuple[int, int]:
    x, total = 0, 1
    for v, n in zip(values, sizes, strict=True):
        x, total = x * n + v, total * n
    return x, total


def _unradix(x: int, sizes: list[int]) -> list[int]:
    out = []
    for n in reversed(sizes):
        x, v = divmod(x, n)
        out.append(v)
    return out[::-1]


def _hexadecimal(text: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", text)) and any(c.isdigit() for c in text)


def _classes(text: str) -> list[tuple[int, int]]:
    """(first, size) of each character's alphabet; size 1 keeps it. A lower-case hexadecimal string keeps to hexadecimal letters."""
    letters = 6 if _hexadecimal(text) else 26
    return [(48, 10) if "0" <= c <= "9" else (97, letters) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1) for c in text]


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.value = functools.lru_cache(20_000)(self._value)

    def _number(self, values, sizes, tweak: str) -> list[int]:
        x, total = _radix(values, sizes)
        return _unradix(self.feistel.permute(x, total, tweak.encode(), self.back), sizes)

    def _text(self, text: str, kind: str) -> str:
        if not text:
            return text
        classes = _classes(text)
        shape = "".join(f"{chr(a)}{n}," for a, n in classes)
        new = text
        while True:  # on among the texts that are read with the same alphabets
            values = self._number([ord(c) - a for c, (a, _) in zip(new, classes, strict=True)], [n for _, n in classes], f"{kind}:{shape}")
            new = "".join(chr(a + v) for v, (a, _) in zip(values, classes, strict=True))
            if _hexadecimal(new) == _hexadecimal(text):
                return new

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where validation fails."""
        return getattr(self, f"_{kind}")(text)

    def _email(self, text):
        local, _, domain = text.partition("@")
        return f"{self._text(local, 'email')}@{domain}"

    def _secret(self, text):
        if text[:4] in ("AKIA", "ASIA") and len(text) == 20 and text.isalnum():
            return text[:4] + self._text(text[4:], "key")
        if prefix := _PREFIX.match(text):
            return prefix[0] + self._text(text[prefix.end() :], "token") if re.search(r"\d", text[prefix.end() :]) else None
        value = re.search(r"[A-Za-z0-9+/_-]{8,}\Z", text)[0]
        cue = text[: len(text) - len(value)]
        return cue + self._text(value, "secret") if re.search(r"\d", value) or cue[-1:] in "\"'" else None

    def _iban(self, text):
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self._text(plain[4:], f"iban{plain[:2]}")
        new = iter(f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def _ibans(self, run: str) -> list[tuple[int, int, str]]:
        """(start, end, pseudonym) of the IBAN at the start of a run, up to the last end of a group where it is valid."""
        ends = [k for k in range(len(run), 14, -1) if k == len(run) or run[k] == " "]
        return next(([(0, k, new)] for k in ends if (new := self.value("iban", run[:k])) is not None), [])

    def _ipv4(self, text):
        octets = text.split(".")
        if any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in octets):
            return None
        low = [(0, 10, 100)[len(x) - 1] for x in octets]  # each part keeps its number of digits
        size = [(10, 90, 156)[len(x) - 1] for x in octets]
        new = self._number([int(x) - a for x, a in zip(octets, low, strict=True)], size, f"ipv4{size}")
        return ".".join(str(v + a) for v, a in zip(new, low, strict=True))

    def _date(self, text):
        iso = "-" in text
        a, b, c = (text.split("-") if iso else re.split(r"[/.]", text))
        year, month, day = (a, b, c) if iso else (c, b, a)
        swap = not iso and int(month) > 12
        if swap:
            month, day = day, month
        try:
            x = datetime.date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= x < _DAYS:
            return None
        if iso:
            return datetime.date.fromordinal(self._number([x], [_DAYS], "date")[0] + _FIRST_DAY).isoformat()
        # within the dates that are written with as many digits and read the same way round
        shape, sep = (len(a), len(b)), text[len(a)]
        y = x
        while True:
            y = self._number([y], [_DAYS], f"date{shape}{swap}")[0]
            d = datetime.date.fromordinal(y + _FIRST_DAY)
            first, second = (str(v).zfill(n) for v, n in zip((d.month, d.day) if swap else (d.day, d.month), shape, strict=True))
            if (len(first), len(second)) == shape and (d.day > 12 or not swap):
                return f"{first}{sep}{second}{sep}{d.year:04d}"

    def _ssn(self, text):
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, g, s = self._number([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn")
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"

    def _phone(self, text):
        digits = re.sub(r"\D", "", text)
        if text[:2] == "00" and digits[2:]:  # read as + and the rest
            new = self._phone("+" + text[2:])
            return new and "00" + new[1:]
        if _NORTH_AMERICAN.fullmatch(text):
            ten = digits[-10:]
            new = self._number([int(ten[0]) - 2, int(ten[1:3]), int(ten[3]) - 2, int(ten[4:])], [8, 100, 8, 10**6], "nanp")
            return _fill(text, digits[:-10] + f"{new[0] + 2}{new[1]:02d}{new[2] + 2}{new[3]:06d}")
        if not 8 <= len(digits) <= 15:
            return None
        rest = digits[2:]
        while True:  # on among the numbers that are no North American ones
            rest = str(self._number([int(rest)], [10 ** len(rest)], f"phone{digits[:2]}{len(rest)}")[0]).zfill(len(rest))
            new = _fill(text, digits[:2] + rest)
            if not _NORTH_AMERICAN.fullmatch(new):
                return new

    def _card(self, text):
        digits = re.sub(r"\D", "", text)
        body = digits[0] + str(self._number([int(digits[1:-1])], [10 ** (len(digits) - 2)], f"card{digits[0]}{len(digits)}")[0]).zfill(len(digits) - 2)
        return _fill(text, body + luhn_digit(body))

    def _cards(self, run: str) -> list[tuple[int, int, str]]:
        """(start, end, pseudonym) of the cards in a run of digit groups."""
        spans, new = _card_spans(run), run
        while spans:  # on among the runs whose cards are read at the same places
            for a, b in spans:
                new = new[:a] + self.value("card", new[a:b]) + new[b:]
            if _card_spans(new) == spans:
                break
        return [(a, b, new[a:b]) for a, b in spans]

    def replace(self, text: str, digits: int) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and (start, end, kind) of each replaced value in the input. digits: how many digits the text has."""
        found = []
        for order, kind in enumerate(KINDS):
            if kind in _NUMERIC and digits < 4 or kind == "email" and "@" not in text or kind == "secret" and not _SECRET_CUE.search(text):
                continue
            for m in _COMPILED[kind].finditer(text):
                if kind in ("card", "iban"):
                    found += [(m.start() + a, -m.start() - b, order, new) for a, b, new in getattr(self, f"_{kind}s")(m[0])]
                    continue
                if (new := self.value(kind, m[0])) is not None:
                    found.append((m.start(), -m.end(), order, new))
        if not found:
            return text, []
        out, spans, end = [], [], 0
        for start, stop, order, new in sorted(found):
            if start >= end:
                out += [text[end:start], new]
                spans.append((start, -stop, KINDS[order]))
                end = -stop
        return "".join([*out, text[end:]]), spans


_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _rewrite(batch: pa.RecordBatch, p: Pseudonyms) -> tuple[pa.Array, list[int], list[str]]:
    """New texts, how many values were replaced, and their kinds, of each row."""
    data, at = C.buffer(batch.column("text"))
    digits = C.sums(_DIGIT[data], at)
    ats = C.sums(data == 64, at)
    cue = digits + ats
    texts = batch.column("text")
    out, n, kinds = [], [], []
    for i in range(batch.num_rows):
        text = texts[i].as_py()
        if not text or not cue[i] and not _SECRET_CUE.search(text):
            spans = []
        else:
            text, spans = p.replace(text, int(digits[i]))
        out.append(text)
        n.append(len(spans))
        kinds.append(",".join(sorted({k for _, _, k in spans})))
    return pa.array(out, batch.schema.field("text").type), n, kinds


_session_keys: dict[str, bytes] = {}


def key_of(spark) -> bytes:
    """The session's key: its setting, or a random one for as long as the application runs."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymize(docs: DataFrame, key: bytes | None = None, back: bool = False) -> DataFrame:
    """docs, all columns, with pseudonyms in text (back: with the originals again)."""
    key = key or key_of(docs.sparkSession)

    def run(batches):
        p = Pseudonyms(key, back)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                rows = b.slice(lo, 1000)
                yield rows.set_column(rows.schema.get_field_index("text"), rows.schema.field("text"), _rewrite(rows, p)[0])

    return docs.mapInArrow(run, docs.schema)


def reveal(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    return pseudonymize(docs, key, back=True)


def report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii and the kinds found, of each row."""
    key = key or key_of(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_pii", pa.int64()), ("kinds", pa.string())])

    def run(batches):
        p = Pseudonyms(key)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                rows = b.slice(lo, 1000)
                text, n, kinds = _rewrite(rows, p)
                yield C.batch(schema, rows.column("doc_id"), text.cast(pa.string()), n, kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, n_pii long, kinds string")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return report(C.read(spark, sf_dir, "documents"))
