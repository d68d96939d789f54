"""Which encoding a text without a mark is in: likelihoods of byte pairs under each candidate.

Each candidate gives every byte a kind: small or capital letter of a script, digit, space, stop, sign, control or
nothing. Natural text keeps to few transitions: letters follow letters of their script, capitals begin words, signs do not
stand inside words; and to the letters that most languages of a script share. A candidate's likelihood is the sum of what the pairs with a byte above 127 cost; confidence is its
share of all candidates' likelihoods, less when there are few pairs. Candidates that read the sample alike count as one.
UTF-16 without a mark shows by high bytes that are zero or all the same.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Tried in this order; the first of those that read a text alike gives the name.
CANDIDATES = ("cp1252", "iso-8859-1", "iso-8859-2", "iso-8859-5", "cp1251", "koi8-r", "iso-8859-7")
SAMPLE, PAIRS = 1 << 16, 400
#: From here on a guess counts; below the second it is warned of.
ENOUGH, SURE = 0.60, 0.90
#: What a text that begins with a small letter costs, and with a capital; by how much more than the likeliest reading the
#: common one, that of the first candidate, has to cost for a guess of common letters to count however short the text is.
BEGINS_SMALL, BEGINS_CAPITAL, CLEAR = 1.0, -0.5, 2.0
NONE, CONTROL, SPACE, DIGIT, STOP, SIGN = range(6)
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
#: Kinds of letters: two for each script, small and capital, then letters of other scripts.
LETTER = SIGN + 1
OTHER = LETTER + 2 * len(SCRIPTS)


def _kind(sign: str | None) -> int:
    if sign is None:
        return NONE
    category = unicodedata.category(sign)
    if category in ("Cc", "Cf"):
        return SPACE if sign in "\t\n\r" else CONTROL
    if category[0] == "Z":
        return SPACE
    if category == "Nd":
        return DIGIT
    if category[0] == "P":
        return STOP
    if category[0] != "L":
        return SIGN
    script = unicodedata.name(sign, "").split(" ")[0]
    if script not in SCRIPTS:
        return OTHER
    return LETTER + 2 * SCRIPTS.index(script) + (category == "Lu")


@cache
def kinds(encoding: str) -> np.ndarray:
    """The kind of each byte."""
    out = []
    for byte in range(256):
        try:
            out.append(_kind(bytes([byte]).decode(encoding)))
        except UnicodeDecodeError:
            out.append(NONE)
    return np.array(out)


#: First and last letters that cost nothing beside the script's own; others cost RARE each.
COMMON = ((0, 0xFF), (0x386, 0x3CE), (0x410, 0x451))
RARE = 0.7


@cache
def rare(encoding: str) -> np.ndarray:
    """What each byte costs for being an uncommon letter."""
    letters = [bytes([b]).decode(encoding, "replace") for b in range(256)]
    return np.array([RARE if unicodedata.category(x)[0] == "L" and not any(a <= ord(x) <= b for a, b in COMMON) else 0.0 for x in letters])


def _cost(a: int, b: int) -> float:
    """What it costs, in natural logarithms, that a sign of kind b follows one of kind a."""
    if NONE in (a, b):
        return 12.0
    if CONTROL in (a, b):
        return 7.0
    letters = (a >= LETTER) + (b >= LETTER)
    if letters == 2:
        if OTHER in (a, b):
            return 5.0
        if (a - LETTER) // 2 != (b - LETTER) // 2:
            return 5.0
        small_a, small_b = (a - LETTER) % 2 == 0, (b - LETTER) % 2 == 0
        return 0.1 if small_a and small_b else 0.6 if small_b else 4.0 if small_a else 1.2
    if letters == 1:
        letter, other = (a, b) if a >= LETTER else (b, a)
        capital = letter < OTHER and (letter - LETTER) % 2 == 1
        if other == SIGN:
            return 4.0
        if other == DIGIT:
            return 2.5
        # capitals begin words rather than end them
        return 0.5 + (1.5 if capital and letter == a else 0.3 if capital else 0.0)
    if SIGN in (a, b):
        return 1.5 if SPACE in (a, b) or DIGIT in (a, b) else 3.0
    return 0.8


COST = np.array([[_cost(a, b) for b in range(OTHER + 1)] for a in range(OTHER + 1)])


def wide(data: bytes) -> tuple[str, float] | None:
    """UTF-16 without a mark: the high bytes of nearly all signs are zero or one other value."""
    head = np.frombuffer(data[: SAMPLE // 2 * 2], np.uint8)
    head = head[: len(head) // 2 * 2].reshape(-1, 2).astype(np.int64)
    if not len(head) or len(data) % 2:
        return None
    shares = {}
    for name, high, low in (("utf-16-le", head[:, 1], head[:, 0]), ("utf-16-be", head[:, 0], head[:, 1])):
        block = np.bincount(high[high > 0], minlength=256).argmax()
        control = (high == 0) & (low < 32) & ~np.isin(low, (9, 10, 13))
        plain = ((high == 0) | (high == block)) & ~control
        # zeros are the high bytes of spaces and stops; text of one byte a sign has none
        least = 0.03 if len(head) > 3 else 0.99  # the high bytes of a few signs have to be all zero
        shares[name] = float(plain.mean()) if (high == 0).mean() > least and (low == 0).mean() < 0.02 else 0.0
    name = max(shares, key=lambda n: shares[n])
    if shares[name] < 0.9:
        return None
    try:
        data.decode(name)
    except UnicodeDecodeError:
        return None
    return name, shares[name]


def detect(data: bytes, candidates: tuple[str, ...] = CANDIDATES) -> tuple[str, float] | None:
    """The likeliest encoding and its confidence, 0 to 1; None for data that are ASCII or that no candidate can read.

    Of a long text, up to PAIRS pairs spread over all of it are judged. Few pairs prove little, unless the common reading
    is far less likely than the likeliest.
    """
    found = wide(data)
    if found:
        return found
    at = np.flatnonzero(np.frombuffer(data, np.uint8) > 127)
    if not len(at):
        return None
    at = at[np.linspace(0, len(at) - 1, min(PAIRS, len(at))).astype(np.int64)]
    padded = np.frombuffer(b" " + data + b" ", np.uint8)
    pairs = np.concatenate([np.stack([padded[at], padded[at + 1]], 1), np.stack([padded[at + 1], padded[at + 2]], 1)])
    readings: dict[str, list] = {}
    common = np.inf
    for name in candidates:
        try:
            data.decode(name)
            reading = bytes(np.unique(padded[at + 1])).decode(name)
        except UnicodeDecodeError:
            continue
        kind = kinds(name)
        cost = COST[kind[pairs[:, 0]], kind[pairs[:, 1]]].sum() + rare(name)[padded[at + 1]].sum()
        if at[0] == 0 and LETTER <= kind[padded[1]] < OTHER:
            cost += BEGINS_CAPITAL if (kind[padded[1]] - LETTER) % 2 else BEGINS_SMALL
        common = cost if name == candidates[0] else common
        readings.setdefault(reading, [name, -cost, rare(name)[padded[at + 1]].any()])
    if not readings:
        return None
    best = max(readings.values(), key=lambda x: x[1])
    total = sum(np.exp(min(0.0, x[1] - best[1])) for x in readings.values())
    confidence = float((1 - np.exp(-len(pairs) / 6)) / total)
    return best[0], max(confidence, ENOUGH) if CLEAR < common + best[1] < np.inf and not best[2] else confidence
