"""Personal data: exact base patterns, and a semi-Markov conditional random field over whole spans.

Text around digits, @ signs and spelled-out marks is cut into atoms (runs of letters, runs of digits, single other
characters). A candidate segment is up to LONGEST atoms that may make an address or a number; its features describe
the whole span: counts and lengths of its groups, separators, checksum, number parts, the kind of its at sign, what
stands beside it. All regions of a batch are scored together in arrays. Decoding chooses boundaries and types together
by dynamic programming; a span of the best segmentation is added if its posterior is high and it does not touch a base
span.

The field is trained by gradient ascent on the conditional likelihood of segmentations of a bounded sample: its base
spans, the same spans disguised in ways that the base patterns miss, invented entities of all four kinds, disguised or
not, and numbers that are none (dates, amounts, versions, lists) in the places of words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, ship

KINDS = ("email", "ip", "card", "phone")
#: Longest entity in atoms.
LONGEST = 32
#: A new span needs this posterior.
SURE = 0.9
#: Training sample: about so many texts, of which executors take at most so many snippets of so many characters.
SAMPLE = 1500
SNIPPETS = 1200
SNIPPET_CHARS = 240
#: Invented entities of each kind, and numbers that are none, in each training set.
INVENTED = 350
#: Examples with more places where a candidate may begin or end are left out of the training.
NODES = 40
EPOCHS = 90
RATE = 0.25
DECAY = 2e-4
#: Candidates whose score is below this (in nats) weigh nothing in posteriors.
NEGLIGIBLE = -25.0
#: Characters of context on both sides of a trigger, widened to whole words or by WIDEN atoms.
CONTEXT = 24
WIDEN = 20
#: Characters of regions that are scored together.
TOGETHER = 400_000

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A number that fails at its first digit fails at its later ones, so only first digits are tried.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_trigger = re.compile(r"[0-9@\uff20]+|[\[({<][ ]?(?:[Aa][Tt]|[Dd][Oo][Tt])\b|\bAT\b|\bat (?=(?:[A-Za-z0-9-]+\.)+[A-Za-z]|[A-Za-z0-9-]+ (?:dot|DOT) )|\b(?:dot|DOT)\b")
_atom = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base patterns in code points, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _any_digit(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _card.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_digit = re.compile("[0-9]")


def _any_digit(text: str) -> bool:
    return _digit.search(text) is not None


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# Regions and candidates.


def regions(text: str) -> list[tuple[int, int]]:
    """Places where an entity may be: triggers with their context in whole words, joined where they meet."""
    raw: list[list[int]] = []
    for m in _trigger.finditer(text):
        a, b = m.span()
        if raw and a - CONTEXT <= raw[-1][1]:
            raw[-1][1] = b + CONTEXT
        else:
            raw.append([max(0, a - CONTEXT), b + CONTEXT])
    out: list[tuple[int, int]] = []
    for a, b in raw:
        done = out[-1][1] if out else 0
        a, b = _word_start(text, max(a, done), done), _word_end(text, min(b, len(text)))
        if out and a <= done:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _word_start(text: str, at: int, least: int) -> int:
    """The start of the word that a place is in, or of WIDEN atoms of it."""
    first = at
    while first > least and not text[first - 1].isspace() and at - first < 400:
        first -= 1
    if first < at:
        units = [m.start() for m in _atom.finditer(text, first, at)]
        at = units[max(0, len(units) - WIDEN)]
    return at


def _word_end(text: str, at: int) -> int:
    """The end of the word that goes on at a place, or of WIDEN more atoms of it."""
    for _ in range(WIDEN):
        if at >= len(text) or text[at].isspace():
            break
        at = _atom.match(text, at).end()
    return at


LETTER, DIGIT, LINE, BLANK, PLUS, DASH, DOT, COMMA, SLASH, OPEN, CLOSE, BOPEN, BCLOSE, AT, COLON, UNDER, PERCENT, OTHER = range(18)
CLASSES = 18


#: Full-width forms of signs that addresses are made of.
WIDE = {"\uff20": AT, "\uff0e": DOT}


def _classes() -> np.ndarray:
    table = np.full(128, OTHER, np.int8)
    for chars, kind in (("\n\r\v\f", LINE), (" \t", BLANK), ("+", PLUS), ("-", DASH), (".", DOT), (",", COMMA), ("/", SLASH), ("(", OPEN), (")", CLOSE), ("[{<", BOPEN), ("]}>", BCLOSE), ("@", AT), (":", COLON), ("_", UNDER), ("%", PERCENT), ("0123456789", DIGIT)):
        table[[ord(c) for c in chars]] = kind
    table[[*range(65, 91), *range(97, 123)]] = LETTER
    return table


_ascii_class = _classes()


def _class_of(codes: np.ndarray) -> np.ndarray:
    out = np.full(len(codes), OTHER, np.int8)
    plain = codes < 128
    out[plain] = _ascii_class[codes[plain]]
    if not plain.all():
        kinds, back = np.unique(codes[~plain], return_inverse=True)
        chars = [chr(c) for c in kinds.tolist()]
        named = [WIDE[c] if c in WIDE else LETTER if c.isalpha() else LINE if c in "\x85\u2028\u2029" else BLANK if c.isspace() else DASH if 0x2010 <= ord(c) <= 0x2015 else OTHER for c in chars]
        out[~plain] = np.array(named, np.int8)[back]
    return out


def _sum(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


#: Sizes of the feature templates, in the order in which Candidates builds them; a feature is its template's start plus its value.
TEMPLATES = {"all": 2, "digits": 21, "groups and front": 9 * 5, "separators": 256, "ends": 49, "lengths": 64, "pattern": 2048, "card sum": 6, "bytes": 4, "left": 40, "right": 40, "digits and separators": 84, "brackets": 4, "at": 8, "dots": 10, "label": 16, "mail left": 20, "mail right": 20, "local": 32, "at and dots": 16}
_at_template = dict(zip(TEMPLATES, np.cumsum([0, *TEMPLATES.values()])[:-1].tolist()))
FEATURES = sum(TEMPLATES.values())


class Candidates:
    """The candidate segments of strings: first and last character, their atoms, and features as columns of numbers."""

    def __init__(self, strings: list[str]):
        whole = "\n".join(strings) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds = _class_of(codes)
        #: Where each string starts in the whole.
        self.offsets = _sum(np.array([len(x) + 1 for x in strings], np.int64))
        first = np.ones(len(kinds), bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] > DIGIT)
        self.starts = np.append(np.flatnonzero(first), len(kinds))
        start = self.starts[:-1]
        kind, size = kinds[start], np.diff(self.starts)
        n = self.n = len(start)
        low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        low = np.append(low, [0, 0, 0])
        word_at = (kind == LETTER) & (size == 2) & (low[start] == ord("a")) & (low[start + 1] == ord("t"))
        word_dot = (kind == LETTER) & (size == 3) & (low[start] == ord("d")) & (low[start + 1] == ord("o")) & (low[start + 2] == ord("t"))

        def beside(x: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, x.dtype)
            if by > 0:
                out[:-by or None] = x[by:]
            else:
                out[-by:] = x[:by]
            return out

        blank = kind == BLANK
        mark = word_at | word_dot | (kind == AT) | (kind == DOT)
        opens, closes = (kind == OPEN) | (kind == BOPEN), (kind == CLOSE) | (kind == BCLOSE)
        ahead = beside(mark, 1) | (beside(blank, 1) & beside(mark, 2))
        behind = beside(mark, -1) | (beside(blank, -1) & beside(mark, -2))
        around_mark = (opens & ahead) | (closes & behind)
        glued = blank & (beside(mark & (kind != DOT), 1) | beside(mark & (kind != DOT), -1) | beside(around_mark, 1) | beside(around_mark, -1))
        in_mail = (kind == LETTER) | (kind == DIGIT) | (kind == DOT) | (kind == UNDER) | (kind == PERCENT) | (kind == PLUS) | (kind == DASH) | (kind == AT) | (kind == COMMA) | around_mark | glued
        in_number = (kind == DIGIT) | word_dot | blank | (kind == PLUS) | (kind == DASH) | (kind == DOT) | (kind == COMMA) | (kind == SLASH) | (kind == UNDER) | opens | closes
        at_mark = word_at | (kind == AT)
        digit = kind == DIGIT
        group = np.where(digit, np.minimum(size, 7), 0)
        value_ok = digit & (size <= 3)
        value = np.zeros(n, np.int64)
        for k in range(3):
            has = value_ok & (size > k)
            value[has] = value[has] * 10 + codes[start[has] + k] - 48
        value_ok &= value < 256

        lines, not_mail, not_number = _sum(kind == LINE), _sum(~in_mail), _sum(~in_number)
        ats, dots = _sum(at_mark), _sum(word_dot | (kind == DOT))
        digits, groups, byte = _sum(np.where(digit, size, 0)), _sum(digit), _sum(value_ok)
        plain = (kind == LETTER) & ~word_at & ~word_dot
        letters = _sum(plain)
        number_first = digit | (kind == PLUS) | (kind == OPEN)
        mail_first = plain | digit
        twice = _sum(blank & beside(blank, 1))
        found: list[tuple[np.ndarray, ...]] = []
        longest, shortest, pattern = np.zeros(n, np.int64), np.full(n, 7), np.zeros(n, np.int64)
        for d in range(1, min(LONGEST, n) + 1):
            m = n - d + 1
            tail = group[d - 1 :]
            longest, pattern = np.maximum(longest[:m], tail), pattern[:m]
            shortest = np.where(tail > 0, np.minimum(shortest[:m], tail), shortest[:m])
            pattern = np.where(tail > 0, (pattern * 8 + tail) % 2039, pattern)
            i = np.arange(m)
            clean = lines[d:] == lines[:m]
            n_digits, n_groups = digits[d:] - digits[:m], groups[d:] - groups[:m]
            number = clean & number_first[:m] & digit[d - 1 :] & (not_number[d:] == not_number[:m]) & (n_digits <= 20) & ((n_digits >= 7) | ((n_groups == 4) & (byte[d:] - byte[:m] == 4))) & (twice[d:] - twice[:m] <= 4)
            mail = clean & mail_first[:m] & mail_first[d - 1 :] & (ats[d:] - ats[:m] == 1) & (not_mail[d:] == not_mail[:m]) & (letters[d:] - letters[:m] > 0) & (dots[d:] > dots[:m])
            for is_mail, chosen in ((False, number), (True, mail)):
                k = np.flatnonzero(chosen)
                if len(k):
                    found.append((i[k], i[k] + d, np.full(len(k), is_mail), longest[k], shortest[k], pattern[k]))
        if not found:
            found = [tuple(np.zeros(0, t) for t in (int, int, bool, int, int, int))]
        i, j, mail, longest, shortest, pattern = (np.concatenate(x) for x in zip(*found))
        at_place = np.append(np.flatnonzero(at_mark), 0)
        at = at_place[np.minimum(ats[np.minimum(i, n)], len(at_place) - 1)]
        # An address needs its at sign within, and a dot behind it.
        fine = ~mail | ((at > i) & (at < j - 1) & (dots[j] > dots[np.minimum(at + 1, n)]))
        i, j, mail, longest, shortest, pattern, at = (x[fine] for x in (i, j, mail, longest, shortest, pattern, at))
        order = np.lexsort((i, j))
        i, j, mail, longest, shortest, pattern, at = (x[order] for x in (i, j, mail, longest, shortest, pattern, at))
        self.i, self.j = i, j
        self.first, self.last = start[i], self.starts[j]

        count = lambda flags: (lambda s: s[j] - s[i])(_sum(flags))
        n_digits, n_groups = digits[j] - digits[i], groups[j] - groups[i]
        number_places = np.append(np.flatnonzero(digit), 0)
        first_group = size[number_places[np.minimum(groups[i], len(number_places) - 1)]]
        seps = [count(blank), count(kind == DASH), count(kind == DOT), count(kind == COMMA), count(kind == SLASH), count((kind == OPEN) | (kind == CLOSE)), count((kind == BOPEN) | (kind == BCLOSE)), count(word_dot) + count(kind == UNDER)]
        mask = sum((x > 0) * (1 << k) for k, x in enumerate(seps))
        sep_kinds = sum((x > 0).astype(int) for x in seps)
        lead = codes[self.first]
        second = codes[np.minimum(self.first + 1, len(codes) - 1)]
        front = np.where(kind[i] == PLUS, 3, np.where(kind[i] == OPEN, 4, np.where((lead == 48) & (second == 48), 2, np.where(lead == 48, 1, 0))))
        luhn_ok = self._luhn(codes, kinds, self.first, self.last)
        card = np.where((n_digits >= 13) & (n_digits <= 19), np.where(luhn_ok, 2, 1), 0)
        padded = np.concatenate(([LINE, LINE], kind, [LINE, LINE]))
        left, right = padded[i + 1] + CLASSES * (padded[i] == DIGIT), padded[j + 2] + CLASSES * (padded[j + 3] == DIGIT)
        mail_left, mail_right = padded[i + 1], padded[j + 2]
        open_, close_ = count(opens), count(closes)
        plus_inside = count(kind == PLUS) - (kind[i] == PLUS)
        zero = np.zeros(len(i), np.int64)
        numeric = [
            ("all", zero), ("digits", n_digits), ("groups and front", np.minimum(n_groups, 8) * 5 + front), ("separators", mask),
            ("ends", np.minimum(first_group, 6) * 7 + np.minimum(size[j - 1], 6)), ("lengths", np.minimum(longest, 7) * 8 + shortest), ("pattern", pattern), ("card sum", card * 2 + (sep_kinds <= 1)),
            ("bytes", 2 * ((n_groups == 4) & (byte[j] - byte[i] == 4)) + (sep_kinds == 1)), ("left", left), ("right", right), ("digits and separators", n_digits * 4 + np.minimum(sep_kinds, 3)), ("brackets", 2 * (open_ != close_) + (plus_inside > 0)),
        ]
        sign = kind[at] == AT
        before, after = padded[at + 1], padded[at + 3]
        bracketed = (before == OPEN) | (before == BOPEN) | ((before == BLANK) & np.isin(padded[at], (OPEN, BOPEN)))
        upper = codes[start[np.minimum(at, n - 1)]] < 97 if n else zero
        at_type = np.where(sign, np.where(bracketed, 2, np.where((before == BLANK) | (after == BLANK), 1, 0)), np.where(bracketed, 3, np.where(upper, 5, 4)))
        spelled = ((count(word_dot) > 0) | (count(around_mark & (opens | closes)) > np.where(bracketed, 2, 0))).astype(int)
        n_dots = np.minimum(dots[j] - dots[np.minimum(at + 1, n)], 4)
        label = np.minimum(size[j - 1], 7) * 2 + (kind[j - 1] == LETTER)
        in_local = lambda flags: (lambda s: s[np.maximum(at, i)] - s[i])(_sum(flags)) > 0
        local = in_local(digit) + 2 * in_local(kind == DOT) + 4 * in_local(word_dot) + 8 * in_local((kind == COMMA) | (kind == BLANK)) + 16 * (count(kind == COMMA) > 0)
        address = [
            ("all", zero + 1), ("at", at_type), ("dots", n_dots * 2 + spelled), ("label", label), ("mail left", mail_left), ("mail right", mail_right), ("local", local), ("at and dots", at_type * 2 + spelled), ("brackets", 2 * (open_ != close_) + (plus_inside > 0)),
        ]
        width = max(len(numeric), len(address))
        #: Features of each candidate, filled up with the number past the last.
        self.features = np.full((len(i), width), FEATURES, np.int32)
        for chosen, own in ((~mail, numeric), (mail, address)):
            for k, (name, values) in enumerate(own):
                self.features[chosen, k] = (_at_template[name] + values)[chosen]

    @staticmethod
    def _luhn(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether the digits between places pass the card checksum, by sums over digits at odd and even places."""
        is_digit = kinds == DIGIT
        before = _sum(is_digit)
        digit = codes[is_digit].astype(np.int64) - 48
        double = 2 * digit - 9 * (digit > 4)
        odd = np.arange(len(digit)) % 2 == 1
        single = [_sum(np.where(odd, 0, digit)), _sum(np.where(odd, digit, 0))]
        doubled = [_sum(np.where(odd, 0, double)), _sum(np.where(odd, double, 0))]
        a, b = before[first], before[last]
        parity = (b - 1) % 2
        total = np.where(parity == 1, single[1][b] - single[1][a] + doubled[0][b] - doubled[0][a], single[0][b] - single[0][a] + doubled[1][b] - doubled[1][a])
        return total % 10 == 0


class Field:
    """Weights by feature and kind; an atom outside entities scores zero."""

    def __init__(self):
        self.weights = np.zeros((FEATURES + 1, len(KINDS)))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1) if len(features) else np.zeros((0, len(KINDS)))


def _sum_log(a: float, b: float) -> float:
    top = max(a, b)
    return top if top == -math.inf else top + math.log(math.exp(a - top) + math.exp(b - top))


def posteriors(size: int, segs: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Posterior of each segment and kind by the forward and backward sums, and the log of the total."""
    merged = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    ends: list[list[int]] = [[] for _ in range(size + 1)]
    starts: list[list[int]] = [[] for _ in range(size + 1)]
    for k, (i, j) in enumerate(segs):
        ends[j].append(k)
        starts[i].append(k)
    forward, backward = [0.0] * (size + 1), [0.0] * (size + 1)
    for j in range(1, size + 1):
        total = forward[j - 1]
        for k in ends[j]:
            total = _sum_log(total, forward[segs[k][0]] + merged[k])
        forward[j] = total
    for i in range(size - 1, -1, -1):
        total = backward[i + 1]
        for k in starts[i]:
            total = _sum_log(total, backward[segs[k][1]] + merged[k])
        backward[i] = total
    whole = forward[size]
    if not segs:
        return np.zeros((0, len(KINDS))), whole
    outer = np.array([forward[i] + backward[j] - whole for i, j in segs])
    return np.exp(np.minimum(scores + outer[:, None], 0.0)), whole


def best(size: int, segs: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) of the best segmentation."""
    top = scores.max(axis=1) if len(scores) else np.zeros(0)
    kind = scores.argmax(axis=1) if len(scores) else np.zeros(0, int)
    ends: list[list[int]] = [[] for _ in range(size + 1)]
    for k, (_, j) in enumerate(segs):
        ends[j].append(k)
    value, back = [0.0] * (size + 1), [-1] * (size + 1)
    for j in range(1, size + 1):
        value[j] = value[j - 1]
        for k in ends[j]:
            v = value[segs[k][0]] + top[k]
            if v > value[j]:
                value[j], back[j] = v, k
    out, j = [], size
    while j:
        k = back[j]
        if k < 0:
            j -= 1
        else:
            out.append((k, int(kind[k])))
            j = segs[k][0]
    return out[::-1]


# Training.


def _invented(kind: str, draw: random.Random, words: list[str]) -> str:
    """An entity of a kind, as the base patterns find it."""
    number = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    word = lambda: draw.choice(words)
    if kind == "email":
        local = draw.choice([word(), f"{word()}.{word()}", f"{word()}{number(draw.randint(1, 3))}", f"{word()}.{number(2)}", f"{word()[0]}_{word()}", f"{word()}-{word()}"])
        return f"{local}@{draw.choice([word(), word() + number(1), word() + '-' + word(), 'mail.' + word()])}.{draw.choice(['com', 'org', 'net', 'de', 'io', 'co.uk', 'example.com', 'info'])}"
    if kind == "ip":
        return ".".join(str(draw.choice([draw.randint(0, 255), draw.randint(100, 255), draw.randint(0, 20), draw.choice([10, 127, 168, 172, 192, 255])])) for _ in range(4))
    if kind == "card":
        body = draw.choice("3456") + number(draw.choice([11, 13, 14, 14, 14, 14, 17]))
        return body + next(d for d in "0123456789" if luhn(body + d))
    form = draw.choice(["+{c} {a} {n}", "+{c} ({a}) {n}", "+{c}{a}{n}", "+{c}-{a}-{n}"])
    n = draw.choice([f"{number(3)}-{number(4)}", number(7), f"{number(3)} {number(4)}", f"{number(3)} {number(2)} {number(2)}"])
    return form.format(c=draw.choice(["1", "44", "49", "33", "34", "351"]), a=draw.choice("23456789") + number(draw.choice([1, 2, 2])), n=n)


def _disguised(kind: str, old: str, draw: random.Random) -> str:
    """The entity written in a way that the base patterns miss, or break up."""
    if kind == "email":
        local, _, domain = old.rpartition("@")
        word = draw.choice(["at", "at", "AT", "At"])
        at = draw.choice(["[{}]", " [{}] ", "({})", " ({}) ", "{{{}}}", " {{{}}} ", " [ {} ] ", "<{}>"]).format(word)
        dot = "."
        if draw.random() < 0.5:
            dot = draw.choice([" dot ", "[dot]", "(dot)", " [dot] ", " (dot) ", "[.]", "(.)", " DOT "])
            at = draw.choice([at, at, f" {word} ", "@"])
        else:
            at = draw.choice([at, at, at, at, " AT ", " @ ", "[@]", "(@)", " @", "@ ", "\uff20"])
        domain = domain.replace(".", draw.choice([dot, dot, ","]) if dot == "." and "@" in at and len(at) == 1 else dot)
        return (local.replace(".", dot) if draw.random() < 0.5 else local) + at + domain
    if kind == "ip":
        return draw.choice(["[.]", "(.)", "[dot]", "(dot)", " dot ", " . ", ",", " [.] ", "{.}", ". ", " [dot] "]).join(old.split("."))
    digits = _digits(old)
    if kind == "card":
        sizes = draw.choice([[4] * 5, [4] * 5, [4, 6, 9], [4] * 5, [6, 13], [2] * 10])
        parts, at = [], 0
        for k in sizes:
            parts += [digits[at : at + k]] * (at < len(digits))
            at += k
        return draw.choice([".", "/", " - ", "  ", "_", ", ", " . ", " / "]).join(parts)
    country, rest = (digits[:1], digits[1:]) if digits[0] == "1" else (digits[:2], digits[2:])
    k = draw.choice([2, 3, 3])
    area, own = rest[:k], rest[k:]
    own = draw.choice([own, f"{own[:3]}-{own[3:]}", f"{own[:3]} {own[3:]}", f"{own[:3]}.{own[3:]}", f"{own[:3]} {own[3:5]} {own[5:]}".strip()])
    sep = draw.choice([" ", "-", ".", "/"])
    national = draw.random()
    if national < 0.1:
        return f"({(area + '5')[:3]}) {_digits(own)[:3]}-{(_digits(own) + '0')[3:7]}"
    if national < 0.2:
        pairs = _digits(own) + draw.choice(["", draw.choice("0123456789")])
        return f"0{area}{draw.choice([' ', ' ', '-', '/'])}{' '.join(pairs[i : i + 2] for i in range(0, len(pairs), 2))}"
    return draw.choice([f"00{country} {area} {own}", f"00{country}{sep}{area}{sep}{own}", f"({area}) {own}", f"({area}){own}", f"{area}-{own}", f"{area}.{own.replace(' ', '.').replace('-', '.')}", f"0{area}{sep}{own}", f"(0{area}) {own}", f"{country}-{area}-{own}", f"+{country}/{area}/{own}", f"0{area} {own}", f"+{country} [{area}] {own}"])


def _no_entity(draw: random.Random, words: list[str]) -> str:
    """A number, or a phrase with an at sign, that is no personal data."""
    number = lambda k: draw.choice("123456789") + "".join(draw.choice("0123456789") for _ in range(k - 1))
    word = lambda: draw.choice(words)
    digits = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    coded = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))
    y, m, d = draw.randint(1850, 2060), draw.randint(1, 12), draw.randint(1, 28)
    if draw.random() < 0.3:  # decimals, measurements, ranges, codes
        return draw.choice([
            f"{number(1)}.{digits(draw.randint(5, 14))}", f"{number(draw.randint(2, 3))}.{digits(draw.randint(5, 12))}", f"0.{digits(draw.randint(5, 14))}", f"0.{'0' * draw.randint(1, 4)}{digits(draw.randint(3, 8))}", f"-{number(1)}.{digits(draw.randint(5, 12))}",
            f"{number(2)}.{digits(6)}, {number(2)}.{digits(6)}", f"{number(1)}.{digits(4)}e-{number(2)}", f"{number(draw.randint(4, 6))}.{digits(draw.randint(2, 4))} {draw.choice(['km', 'kg', 'm', 'EUR', 'ms'])}", f"{number(3)}.{digits(4)}", f"{number(1)},{digits(draw.randint(6, 9))}",
            f"{number(4)}..{number(4)}", f"{number(5)}..{number(5)}", f"{number(4)}...{number(4)}", f"{number(4)}-{number(4)}", f"{number(6)}-{number(6)}", f"{number(5)}/{number(5)}", f"{number(1)}.{number(1)}.{number(4)}.{number(4)}", " ".join(f"{draw.randint(0, 9)}.{digits(draw.choice([1, 2, 2]))}" for _ in range(draw.randint(2, 6))), " ".join(f"{draw.randint(0, 99)}.{digits(draw.choice([1, 2, 2]))}" for _ in range(draw.randint(2, 4))), coded(draw.choice([16, 32, 40])), "-".join(map(coded, (8, 4, 4, 4, 12))),
        ])
    body = number(draw.choice([12, 14, 15, 15, 18]))
    unsound = body + next(c for c in "0123456789" if not luhn(body + c))
    return draw.choice([
        f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{d:02}-{m:02}-{y}", f"{y}{m:02}{d:02}", f"{y}/{m:02}/{d:02} {d:02}:{m:02}", f"{y}-{m:02}-{d:02} {number(2)}:{number(2)}:{number(2)}", f"{y}-{y + 7}", f"{y} {y + 1} {y + 2} {y + 3}",
        f"{number(1)},{number(3)},{number(3)}.{number(2)}", f"{number(3)} {number(3)} {number(3)}", f"{number(2)}.{number(3)}.{number(3)}", f"{number(2)} {number(3)} {number(3)}", f"{number(4)}.{number(4)}", number(draw.randint(7, 12)), number(10), number(20), unsound,
        f"{unsound[:4]}.{unsound[4:8]}.{unsound[8:12]}.{unsound[12:]}", f"{unsound[:4]}/{unsound[4:8]}/{unsound[8:12]}/{unsound[12:]}", f"{number(1)}.{number(2)}.{number(1)}", f"v{number(1)}.{number(2)}.{number(1)}", f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        ", ".join(number(draw.randint(1, 3)) for _ in range(draw.randint(3, 8))), " ".join(number(draw.randint(1, 4)) for _ in range(draw.randint(3, 9))), " ".join(f"{number(1)}.{number(2)}" for _ in range(4)), f"{number(2)}.{number(4)}, {number(1)}.{number(4)}", ",".join(number(4) for _ in range(4)),
        f"{number(2)}-{number(4)}-{number(2)}", f"{number(5)}-{number(4)}", f"{number(3)}-{number(2)}-{number(4)}", f"({y}) {number(3)}-{number(3)}", f"({number(1)}) {number(4)} ({number(1)}) {number(4)}", f"{number(2)} - {number(2)} - {number(2)} - {number(2)}", f"{number(2)}. {number(2)}. {number(2)}", f"pp. {number(3)}-{number(3)}, {number(4)}",
        f"{word()} at {word()}.{draw.choice(['com', 'org', 'net', 'de'])}", f"{word()} at {word()}.{word()}.com", f"{number(2)} @ {number(1)}.{number(2)}", f"{word()} @{word()}", f"{word()} at {number(2)}.{number(2)}", f"{word()} dot {word()}", f"{word()} (at) {word()}", f"{word()}@{word()}", f"{word()} AT {word()}. {word()}",
    ])


def snippets(text: str, most: int = 3) -> list[str]:
    """A few bounded pieces of a text for training: regions, cut to whole words, and its beginning."""
    parts = regions(text)
    chosen = parts[:: max(1, -(-len(parts) // most))]
    out = [text[a : min(b, a + SNIPPET_CHARS)] for a, b in chosen] + [text[:SNIPPET_CHARS]]
    return [x.rpartition(" ")[0] if len(x) == SNIPPET_CHARS else x for x in out]


def _examples(pieces: list[str], draw: random.Random) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts and their true spans: the pieces, the same disguised, and pieces with invented entities and other numbers for some of their words."""
    words = sorted({w.lower() for p in pieces for w in re.findall(r"[A-Za-z]{3,9}", p)}) or ["lorem", "ipsum", "dolor", "amet"]
    draw.shuffle(words)
    words = words[:2000]
    out: list[tuple[str, list[tuple[str, int, int]]]] = []

    def put(text: str, spans: list[tuple[str, int, int, str]]) -> None:
        made, done, truth = "", 0, []
        for kind, a, b, new in sorted(spans, key=lambda s: s[1]):
            if a < done:
                continue
            made += text[done:a]
            truth.append((kind, len(made), len(made) + len(new)))
            made += new
            done = b
        out.append((made + text[done:], truth))

    plain = [p for p in pieces if " " in p and not base_spans(p)] or ["lorem ipsum dolor sit amet consectetur"]
    for piece in pieces:
        spans = base_spans(piece)
        put(piece, [(k, a, b, piece[a:b]) for k, a, b in spans])
        if spans:
            put(piece, [(k, a, b, _disguised(k, piece[a:b], draw)) for k, a, b in spans])
    for kind in (*KINDS, None, None):
        for n in range(INVENTED):
            text = draw.choice(plain)
            blanks = [m.start() for m in re.finditer(" ", text)]
            at = draw.choice(blanks) + 1
            new = _no_entity(draw, words) if kind is None else _invented(kind, draw, words)
            if kind and n % 4:
                new = _disguised(kind, new, draw)
            close = draw.choice(["", "", "", ",", ".", ";", ")"])
            text = text[:at] + draw.choice(["", "", "", "(" if close == ")" else "", ": "]) + "\0" + close + " " + text[at:]
            place = text.index("\0")
            spans = base_spans(text.replace("\0", "X"))
            if not spans:
                put(text, [(kind or "", place, place + 1, new)])
    # What a base pattern finds is the truth wherever no disguise stands: other numbers may pass by chance.
    return [(text, [t for t in truth if t[0]] or base_spans(text)) for text, truth in out]


def fit(pieces: list[str], seed: int = 7) -> Field:
    """Train on pieces of text; their base spans, disguises and inventions are the truth. Deterministic for equal pieces."""
    draw, model = random.Random(seed), Field()
    examples = _examples(pieces, draw)
    found = Candidates([text for text, _ in examples])
    owner = np.searchsorted(found.offsets, found.first, side="right") - 1
    at = {(a, b): k for k, (a, b) in enumerate(zip(found.first.tolist(), found.last.tolist()))}
    gold = np.zeros((len(owner), len(KINDS)))
    use = np.ones(len(examples), bool)
    for e, (_, truth) in enumerate(examples):
        for kind, a, b in truth:
            k = at.get((a + int(found.offsets[e]), b + int(found.offsets[e])))
            if k is None:
                use[e] = False
            else:
                gold[k, KINDS.index(kind)] = 1.0
    # Of each example only the places where candidates begin or end matter, in order.
    places = np.unique(np.concatenate((np.stack((owner, found.i), 1), np.stack((owner, found.j), 1))), axis=0)
    if not len(places):
        return model
    nodes = np.bincount(places[:, 0], minlength=len(examples))
    use &= (nodes > 0) & (nodes <= NODES)
    rank = np.arange(len(places)) - np.searchsorted(places[:, 0], places[:, 0])
    index = {(e, p): r for (e, p), r in zip(map(tuple, places.tolist()), rank.tolist())}
    keep = use[owner]
    rows = np.cumsum(use) - 1
    own = rows[owner[keep]]
    begin = np.array([index[e, p] for e, p in zip(owner[keep].tolist(), found.i[keep].tolist())], np.int64)
    stop = np.array([index[e, p] for e, p in zip(owner[keep].tolist(), found.j[keep].tolist())], np.int64)
    features, gold, size = found.features[keep], gold[keep], int(use.sum())
    squares = np.full(model.weights.shape, 1e-8)
    step = np.zeros_like(model.weights)
    for _ in range(EPOCHS):
        scores = model.scores(features)
        arcs = np.full((size, NODES, NODES), -np.inf)
        merged = np.logaddexp.reduce(scores, axis=1)
        arcs[own, begin, stop] = merged
        steps = np.arange(NODES - 1)
        arcs[:, steps, steps + 1] = np.logaddexp(arcs[:, steps, steps + 1], 0.0)
        forward, backward = np.full((size, NODES), -np.inf), np.full((size, NODES), -np.inf)
        forward[:, 0] = backward[:, -1] = 0.0
        for k in range(1, NODES):
            forward[:, k] = np.logaddexp.reduce(forward[:, :k] + arcs[:, :k, k], axis=1)
        for k in range(NODES - 2, -1, -1):
            backward[:, k] = np.logaddexp.reduce(backward[:, k + 1 :] + arcs[:, k, k + 1 :], axis=1)
        expected = np.exp(scores + (forward[own, begin] + backward[own, stop] - forward[own, -1])[:, None])
        pull = gold - expected
        for k in range(len(KINDS)):
            step[:, k] = np.bincount(features.ravel(), np.repeat(pull[:, k], features.shape[1]), FEATURES + 1)
        step /= size
        step -= DECAY * model.weights / 10
        squares = 0.9 * squares + 0.1 * step**2
        model.weights += RATE * step / np.sqrt(squares + 1e-8)
        model.weights[-1] = 0.0
    return model


# Decoding.


def _added(model: Field, strings: list[str]) -> list[tuple[int, str, int, int]]:
    """(string, kind, start, end) of the spans that the model is sure of."""
    found = Candidates(strings)
    scores = model.scores(found.features)
    if not len(scores):
        return []
    alive = np.flatnonzero(scores.max(axis=1) > NEGLIGIBLE)
    i, j, scores = found.i[alive], found.j[alive], scores[alive]
    # Segments meet only where one goes over a boundary of atoms; the parts between boundaries that none goes over are
    # independent, and those in which no segment scores above zero hold no entity.
    over = np.zeros(found.n + 1, np.int64)
    np.add.at(over, i + 1, 1)
    np.add.at(over, j, -1)
    part = np.cumsum(np.cumsum(over) == 0)[i]
    likely = np.zeros(part.max(initial=0) + 1, bool)
    likely[part[scores.max(axis=1) > 0]] = True
    chosen = np.flatnonzero(likely[part])
    chosen = chosen[np.argsort(part[chosen], kind="stable")]
    out = []
    for own in np.split(chosen, np.flatnonzero(np.diff(part[chosen])) + 1) if len(chosen) else ():
        low = int(i[own].min())
        segs = [(int(a) - low, int(b) - low) for a, b in zip(i[own], j[own])]
        size = max(b for _, b in segs)
        taken = best(size, segs, scores[own])
        sure, _ = posteriors(size, segs, scores[own])
        for k, kind in taken:
            if sure[k, kind] >= SURE:
                c = alive[own[k]]
                at = int(np.searchsorted(found.offsets, found.first[c], side="right")) - 1
                out.append((at, KINDS[kind], int(found.first[c] - found.offsets[at]), int(found.last[c] - found.offsets[at])))
    return out


def spans_of_all(texts: list[str | None], model: Field | None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its base spans, and all spans with those that the model adds; both ordered by kind and start."""
    base = [base_spans(t or "") for t in texts]
    if model is None:
        return [(b, b) for b in base]
    more: dict[int, list[tuple[str, int, int]]] = {}
    places: list[tuple[int, int]] = []
    strings: list[str] = []

    def settle_() -> None:
        for at, kind, a, b in _added(model, strings) if strings else ():
            text, start = places[at]
            if not any(x < start + b and start + a < y for _, x, y in base[text]):
                more.setdefault(text, []).append((kind, start + a, start + b))
        places.clear()
        strings.clear()

    size = 0
    for k, text in enumerate(texts):
        for a, b in regions(text) if text else ():
            places.append((k, a))
            strings.append(text[a:b])
            size += b - a
            if size >= TOGETHER:
                settle_()
                size = 0
    settle_()
    return [(b, ordered(b + more[k]) if k in more else b) for k, b in enumerate(base)]


def spans_of(text: str, model: Field | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    return spans_of_all([text], model)[0]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Train on a bounded sample: of about `sample` different texts with digits or @, chosen by a hash of the text, at most SNIPPETS snippets.

    Executors cut the snippets out, so that the driver gets SNIPPETS times SNIPPET_CHARS characters at most, whatever the
    length of the texts. Null texts teach nothing; without texts the model learns from inventions alone.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text rlike '[0-9@]'")
    # Copies of a text count once, or a group of copies would shrink the sample.
    count = rows.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    taken = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1e6 < min(1.0, sample / max(1, count))).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for t in batch.column(0).to_pylist() for x in snippets(t)], pa.string())], names=["piece"])

    pieces = taken.mapInArrow(cut, "piece string").distinct().orderBy(F.xxhash64("piece"), "piece").limit(SNIPPETS)
    return fit([r["piece"] for r in pieces.collect()])


def find(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as text.

    A null text counts as empty and has no spans. Repeated rows and null ids give a row each; other columns are ignored
    whatever their names; an empty table gives no rows. Texts are read whole; the work grows with their length.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    counts = [f"n_{k}" for k in KINDS]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for base, spans in spans_of_all(batch.column(1).to_pylist(), known):
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[id_col, *counts, "base_sha256", "spans"])

    return only(docs, id_col, text_col).mapInArrow(scan, schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, and what spans share, replaced by its kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= done:
            continue
        out += [text[done:a], f"[{kind.upper()}]"] if a >= done else []
        done = b
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, model: Field | None, text_col: str = "text") -> DataFrame:
    """The same rows and columns with all spans in the text replaced; null stays null."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            texts = [t if t is None else redact(t, spans) for t, (_, spans) in zip(texts, spans_of_all(texts, known))]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(rewrite, docs.schema)
