"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern, validated (Luhn for cards, mod 97 for IBANs, issued
ranges for social security numbers, octets for IPv4, the calendar for dates),
and replaced by their image under a keyed Feistel permutation of the format's own
domain. The image is valid in the same format, keeps separators and layout, and is
the same for equal values in all documents: a date has one image in every layout, a
phone number, card or IBAN one under every separator. International numbers keep
their country code. ``reveal`` inverts it with the key.

Scale: one map-side pass over whole texts, no shuffle, no state.

Defined cases: a null text stays null with no spans, an empty one stays empty;
overlapping finds are settled by start, then length; repeated rows are treated
each; an empty table gives an empty result; columns other than id and text are
not read. No value of a domain of up to 4096 stays in place; of a larger one, one
value in all is expected to.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmesh.llm.batches import slices
from nearmesh.llm.feistel import Permutation

_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "iban": re.compile(_B + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _E),
    "ip": re.compile(r"(?<![0-9A-Za-z_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_])(?!\.[0-9])"),
    "card": re.compile(_B + r"(?:[0-9]{13,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{5})" + _E),
    "ssn": re.compile(_B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E),
    "phone": re.compile(
        r"(?<![0-9A-Za-z_+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}|\+[1-9][0-9]{0,14}(?:[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,8})){0,6})" + _E
    ),
    "date": re.compile(_B + r"(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\2[0-9]{4})" + _E),
}
KINDS = list(PATTERNS)
_LAST = re.compile(r"[ .-]\(?[0-9A-Z]+\)?$")
_DAY0, _DAYS = dt.date(1900, 1, 1), (dt.date(2099, 12, 31) - dt.date(1900, 1, 1)).days + 1
#: Fixed country calling codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


class Pseudonyms:
    """Images of values under the key; ``back=True`` inverts them."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.image = lru_cache(maxsize=100_000)(self._image)
        self.perm = lru_cache(maxsize=4096)(self._perm)
        self.table = lru_cache(maxsize=256)(self._table)

    def _perm(self, n: int, tweak: str) -> Permutation:
        return Permutation(n, self.key + b"/" + tweak.encode())

    def _map(self, x: int, n: int, tweak: str) -> int:
        p = self.perm(n, tweak)
        if n <= 4096:
            table = self.table(p)
            return table.index(x) if self.back else table[x]
        return p.inverse(x) if self.back else p(x)

    def _table(self, p: Permutation) -> list[int]:
        """The images of a small domain, with the values that stayed in place exchanged."""
        table = [p(i) for i in range(p.n)]
        still = [i for i, x in enumerate(table) if i == x]
        if len(still) == 1 and p.n > 1:
            still.append((still[0] + 1) % p.n)
        for i, x in zip(still, [table[i] for i in still[1:] + still[:1]]):
            table[i] = x
        return table

    def _mixed(self, s: str, sets: list[str], tweak: str) -> str:
        """Permute a string whose i-th character is drawn from sets[i]."""
        x, n = 0, 1
        for c, a in zip(s, sets):
            x, n = x * len(a) + a.index(c), n * len(a)
        x, out = self._map(x, n, tweak), []
        for a in reversed(sets):
            x, r = divmod(x, len(a))
            out.append(a[r])
        return "".join(reversed(out))

    def _chars(self, s: str, tweak: str) -> str:
        """Permute the letters and digits of a string within their classes; the rest stays."""
        at = [i for i, c in enumerate(s) if c in _UP or c in _LOW or c in _DIG]
        sets = [next(a for a in (_UP, _LOW, _DIG) if s[i] in a) for i in at]
        got, out = self._mixed("".join(s[i] for i in at), sets, tweak) if at else "", list(s)
        for i, c in zip(at, got):
            out[i] = c
        return "".join(out)

    def _laid(self, value: str, new: str) -> str:
        """``new`` in the layout of ``value``: separators stay where they are."""
        it = iter(new)
        return "".join(next(it) if c in _DIG or c in _UP else c for c in value)

    def _image(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value; None if it is not valid."""
        digits = "".join(c for c in value if c in _DIG)
        if kind == "email":
            local, _, domain = value.rpartition("@")
            return self._chars(local, "email:" + domain.lower()) + "@" + domain
        if kind == "iban":
            plain = value.replace(" ", "")
            if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
                return None
            body = self._chars(plain[4:], "iban:" + plain[:2])
            return self._laid(value, plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
                return None
            x = self._map(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "card":
            if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
                return None
            body = self._mixed(digits[:-1], [_DIG] * (len(digits) - 1), "card")
            return self._laid(value, body + luhn_digit(body))
        if kind == "ssn":
            a, g, s = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if a in (0, 666) or a >= 900 or not g or not s:
                return None
            x = self._map(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn")
            x, s = divmod(x, 9999)
            a, g = divmod(x, 99)
            return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"
        if kind == "phone" and value[0] == "+" and (digits[0] != "1" or len(digits) != 11):
            if not 8 <= len(digits) <= 15:
                return None
            n = next((n for n in (1, 2) if digits[:n] in CODES), 3)
            sets = ["0" if digits[n] == "0" else _DIG[1:], *[_DIG] * (len(digits) - n - 1)]
            return self._laid(value, digits[:n] + self._mixed(digits[n:], sets, "phone:" + digits[:n]))
        if kind == "phone":
            head, ten = digits[:-10], digits[-10:]
            first = [next(x for x in ("01", "23456789") if ten[i] in x) for i in (0, 3)]
            sets = [first[0], _DIG, _DIG, first[1], *[_DIG] * 6]
            return self._laid(value, head + self._mixed(ten, sets, "phone"))
        if kind == "date":
            parts = re.split(r"[-/.]", value)
            year_first = len(parts[0]) == 4
            y, m, d = map(int, parts if year_first else parts[::-1])
            if not year_first and m > 12:  # month first
                m, d, swapped = d, m, True
            else:
                swapped = False
            try:
                at = (dt.date(y, m, d) - _DAY0).days
            except ValueError:
                return None
            if not 0 <= at < _DAYS:
                return None
            new = _DAY0 + dt.timedelta(self._map(at, _DAYS, "date"))
            if year_first:
                return new.isoformat().replace("-", value[4])
            a, b = (new.month, new.day) if swapped else (new.day, new.month)
            wide = len(parts[0]) == 2 and len(parts[1]) == 2
            return value[len(parts[0])].join([f"{a:02d}" if wide else str(a), f"{b:02d}" if wide else str(b), f"{new.year:04d}"])
        raise ValueError(kind)

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the valid values, in order, without overlaps."""
        found = []
        digit = re.search("[0-9]", text) is not None
        for kind, pattern in PATTERNS.items():
            if not digit and kind != "email" or kind == "email" and "@" not in text or kind == "ssn" and "-" not in text:
                continue
            for m in pattern.finditer(text):
                value = m[0]
                while (new := self.image(kind, value)) is None and (kind == "iban" or value[0] == "+") and (cut := _LAST.search(value)):
                    value = value[: cut.start()]  # a word or number that follows may look like a last group
                if new is not None:
                    found.append((m.start(), m.start() + len(value), kind, new))
        found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
        out, end = [], 0
        for f in found:
            if f[0] >= end:
                out.append(f)
                end = f[1]
        return out

    def rewrite(self, text: str | None):
        """(spans, new text)."""
        if not text:
            return [], text
        spans, out, at = self.spans(text), [], 0
        for start, end, _, new in spans:
            out += [text[at:start], new]
            at = end
        return spans, "".join(out) + text[at:] if spans else text


def pseudonymise(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", reveal: bool = False) -> DataFrame:
    """Per row: doc_id, n_pii, spans (kind:start:end of the input text), text with pseudonyms."""

    def run(batches):
        work = Pseudonyms(key, reveal)
        for batch in slices(batches, 1):
            spans, texts = [], []
            for value in batch.column(1).to_pylist():
                found, new = work.rewrite(value)
                spans.append(found)
                texts.append(new)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array([",".join(f"{k}:{a}:{b}" for a, b, k, _ in s) for s in spans], pa.string()),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_pii", "spans", "text"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pii long, spans string, text string")
