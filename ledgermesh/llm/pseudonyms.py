"""Format-preserving pseudonyms for personal numbers and dates (operator 5).

Values are found in every whole text and validated: payment cards (Luhn), IBANs
(mod 97), phone numbers (8 to 15 digits after +), IPv4 addresses, US social
security numbers, calendar dates, and the local part of e-mail addresses. A
valid value is permuted within its own format by a keyed Feistel network: the
value is numbered within the set of valid values of its format, ten rounds
permute that number, and values that leave the set are permuted again until they
return (cycle walking). Check digits are made anew, separators stay. The same
value has the same pseudonym in every document, different values have different
ones, and ``restore=True`` with the same key undoes it.

Only texts that hold a digit or an @ are handed to Python; the rest pass by.

Edge cases: null text stays null, empty text empty; values that fail validation
stay as they are; equal rows are changed alike; an empty table gives no rows.
Dates like 03/04/2001 are read day first; a date whose day is over 12 in the
second place is month first. Equal dates in different formats differ.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "phone", "ip", "date", "ssn", "card")
ROUNDS = 10
_TOKEN = re.compile(r"""
    (?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)
  | (?<![0-9A-Za-z])(?:
      (?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)
    | (?P<phone>\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,4})
    | (?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))
    | (?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<mark>[/.])[0-9]{1,2}(?P=mark)[0-9]{4})
    | (?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})
    | (?P<card>[0-9](?:[\x20-]?[0-9]){12,18})
    )(?![0-9A-Za-z])""", re.X)
_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())
_ALL_DAYS = datetime.date(9999, 12, 31).toordinal()


def permute(x: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return x
    side = isqrt(size - 1) + 1
    width = (side.bit_length() + 71) // 8
    salt = key + b"|" + tweak.encode() + b"|%d|" % size

    def f(r: int, half: int) -> int:
        return int.from_bytes(hashlib.shake_256(salt + b"%d|%d" % (r, half)).digest(width), "big") % side
    while True:
        left, right = divmod(x, side)
        for r in range(ROUNDS):
            if inverse:
                left, right = (right - f(ROUNDS - 1 - r, left)) % side, left
            else:
                left, right = right, (left + f(r, right)) % side
        x = left * side + right
        if x < size:
            return x


def _mixed(text: str, key: bytes, tweak: str, inverse: bool, kinds: str = "0aA") -> str:
    """Permute the digits and ASCII letters of ``text``, each within its kind."""
    base = [(10, 48) if "0" in kinds and "0" <= c <= "9" else (26, 97) if "a" in kinds and "a" <= c <= "z"
            else (26, 65) if "A" in kinds and "A" <= c <= "Z" else (1, ord(c)) for c in text]
    x, size = 0, 1
    for c, (radix, low) in zip(text, base, strict=True):
        x, size = x * radix + ord(c) - low, size * radix
    shape = "".join(chr(low) for _, low in base)
    x = permute(x, size, key, f"{tweak}:{shape}", inverse)
    out = []
    for radix, low in reversed(base):
        x, d = divmod(x, radix)
        out.append(chr(low + d))
    return "".join(reversed(out))


def _refill(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in template)


def luhn_digit(payload: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _mod97(country: str, check: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def _card(v, key, inverse):
    digits = re.sub("[^0-9]", "", v)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = _mixed(digits[:-1], key, "card", inverse)
    return _refill(v, body + luhn_digit(body))


def _iban(v, key, inverse):
    flat = v.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[:2], flat[2:4], flat[4:]) != 1 or not "02" <= flat[2:4] <= "98":
        head, gap, tail = v.rpartition(" ")  # capitals that follow may have been taken for a part of it
        shorter = _iban(head, key, inverse) if len(head.replace(" ", "")) >= 15 else None
        return shorter and shorter + gap + tail
    account = _mixed(flat[4:], key, "iban" + flat[:2], inverse)
    new = iter(flat[:2] + f"{98 - _mod97(flat[:2], '00', account):02d}" + account)
    return "".join(c if c == " " else next(new) for c in v)


def _phone(v, key, inverse):
    digits = re.sub("[^0-9]", "", v)
    if not 8 <= len(digits) <= 15:
        return None
    country = re.match(r"\+([0-9]{1,3}?)(?=[^0-9]|[0-9]{7})", v)
    k = len(country[1]) if country else 1
    return _refill(v, digits[:k] + _mixed(digits[k:], key, "phone" + digits[:k], inverse))


def _ip(v, key, inverse):
    parts = v.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", inverse)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(v, key, inverse):
    mark = v[4] if v[4:5] == "-" else "/" if "/" in v else "."
    a, b, c = v.split(mark)
    wide = mark == "-" or (len(a) == 2 and len(b) == 2)
    orders = [("ymd", a, b, c)] if mark == "-" else [("dmy", c, b, a), ("mdy", c, a, b)]
    for order, year, month, day in orders:
        try:
            n = datetime.date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            continue
        lo, hi = _DAYS
        if order == "mdy":  # the months-first dates are those that can't be read day first
            return _walk_date(n, lambda d: d.day > 12, f"%m{mark}%d{mark}%Y", wide, order, key, inverse)
        form = "%Y-%m-%d" if order == "ymd" else f"%d{mark}%m{mark}%Y"
        return _walk_date(n, lambda d: True, form, wide, order, key, inverse)
    return None


def _walk_date(n, fits, form, wide, order, key, inverse):
    lo, hi = _DAYS
    if not wide:  # 3/4/2001: days and months without a leading zero, in at least one place
        fits_all = fits
        fits = lambda d: fits_all(d) and (d.day < 10 or d.month < 10)
    if not fits(datetime.date.fromordinal(n)):
        return None
    inside = lo <= n <= hi
    x, size, tweak = (n - lo, hi - lo + 1, "days") if inside else (n - 1, _ALL_DAYS, "other days")
    while True:
        x = permute(x, size, key, f"{tweak}:{order}:{form}:{wide}", inverse)
        d = datetime.date.fromordinal(x + (lo if inside else 1))
        if fits(d) and (inside or not lo <= d.toordinal() <= hi):
            break
    if wide:
        return form.replace("%Y", f"{d.year:04d}").replace("%m", f"{d.month:02d}").replace("%d", f"{d.day:02d}")
    return form.replace("%Y", f"{d.year:04d}").replace("%m", str(d.month)).replace("%d", str(d.day))


def _ssn(v, key, inverse):
    area, group, serial = int(v[:3]), int(v[4:6]), int(v[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, 898 * 99 * 9999, key, "ssn", inverse), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _email(v, key, inverse):
    local, _, host = v.partition("@")
    return f"{_mixed(local, key, 'email', inverse)}@{host}"


_PSEUDONYM = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}


def pseudonymize_text(text: str, key: bytes, restore: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)

    def one(m: re.Match) -> str:
        new = _PSEUDONYM[m.lastgroup](m[0], key, restore)
        if new is None:
            return m[0]
        counts[m.lastgroup] += 1
        return new
    return _TOKEN.sub(one, text), counts


def _rewrite(key: bytes, restore: bool):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for text, maybe in zip(batch.column(1), batch.column(2), strict=True):
                new, n = (pseudonymize_text(text.as_py(), key, restore) if maybe.as_py()
                          else (text.as_py(), dict.fromkeys(KINDS, 0)))
                texts.append(new)
                for k in KINDS:
                    counts[k].append(n[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *[pa.array(counts[k], pa.int64()) for k in KINDS]],
                ["doc_id", "text", *[f"n_{k}" for k in KINDS]])
    return run


def pseudonymize(docs: DataFrame, key: str, restore: bool = False) -> DataFrame:
    """``doc_id, text`` with pseudonyms, and ``n_<kind>`` values replaced."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.regexp_like("text", F.lit("[0-9]|@")), F.lit(False)).alias("maybe"))
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_rewrite(key.encode(), restore), schema)
