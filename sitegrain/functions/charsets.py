"""Charset of bytes, by how likely their bytes and byte pairs are in running text.

A charset of two-byte characters is a few blocks of pairs, each with its share of running text. A
charset of one-byte letters is told by case, by frequent letters, and by what stands beside a
letter: letters of the Latin charset meet ASCII letters, those of other scripts each other. The
letters of Latin text are those of one language at a time, if that is likelier than any mixture.
Words of ASCII alone are left out, so markup does not count, and a word counts once, however
often it is repeated. The likeliest charset wins.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np

# Fixed values, after the layout of the standards: first and last lead byte, first and last trail
# byte, share of running text, characters in the block.
PAIRS = {
    "gb18030": (
        (0xA1, 0xA3, 0xA1, 0xFE, 0.12, 282),
        (0xB0, 0xD7, 0xA1, 0xFE, 0.84, 3755),
        (0xD8, 0xF7, 0xA1, 0xFE, 0.03, 3008),
    ),
    "cp950": (
        (0xA1, 0xA3, 0x40, 0xFE, 0.12, 408),
        (0xA4, 0xC6, 0x40, 0xFE, 0.84, 5401),
        (0xC9, 0xF9, 0x40, 0xFE, 0.03, 7652),
    ),
    "cp949": (
        (0xA1, 0xA3, 0xA1, 0xFE, 0.03, 282),
        (0xB0, 0xC8, 0xA1, 0xFE, 0.95, 2350),
        (0xCA, 0xFD, 0xA1, 0xFE, 0.01, 4888),
    ),
    "euc_jp": (
        (0xA1, 0xA1, 0xA1, 0xFE, 0.10, 94),
        (0xA3, 0xA3, 0xA1, 0xFE, 0.02, 94),
        (0xA4, 0xA4, 0xA1, 0xF3, 0.45, 83),
        (0xA5, 0xA5, 0xA1, 0xF6, 0.12, 86),
        (0xB0, 0xCF, 0xA1, 0xFE, 0.28, 2965),
        (0xD0, 0xF4, 0xA1, 0xFE, 0.02, 3390),
    ),
    "cp932": (
        (0x81, 0x81, 0x40, 0xFC, 0.10, 147),
        (0x82, 0x82, 0x4F, 0x9A, 0.02, 62),
        (0x82, 0x82, 0x9F, 0xF1, 0.45, 83),
        (0x83, 0x83, 0x40, 0x96, 0.12, 86),
        (0x88, 0x97, 0x40, 0xFC, 0.28, 2965),
        (0x98, 0xEA, 0x40, 0xFC, 0.02, 3390),
    ),
    "utf-8": ((0xC2, 0xDF, 0x80, 0xBF, 0.5, 300), (0xE0, 0xEF, 0x80, 0xBF, 0.49, 5000)),
}
# The frequent letters of each script; none where the letters are Latin.
LETTERS = {
    "cp1252": "",
    "cp1251": "оеаинтсрвлкмдпу",
    "koi8-r": "оеаинтсрвлкмдпу",
    "cp1253": "αοιετσνηυρπκμλς",
    "cp1255": "יוהלאמרתבשנםדחע",
    "cp1256": "اليمونرتبةعد",
    "cp874": "านรอกเงมยลวดทส่้",
}
# Letters beyond ASCII of languages written in Latin letters, the frequent ones first: French, German, Spanish,
# Portuguese, Italian, Swedish, Danish, Icelandic, and of several at once.
LATIN = ("éàèêçîôâûùïëæ", "üäöß", "óíáéñúü", "ãçéáíóêõâúàô", "èàùòìé", "äåöé", "åøæé", "íáðóéþúöýæ", "éèàüäöçêßáíóñãåøæúôîâû")
#: What other pairs cost, and bytes that fit nothing; what any charset but Latin does; what an ASCII word adds to Latin.
REST, BROKEN, LATER, PLAIN = math.log(0.01 / 20000), -12.0, -2.0, 2.0
#: What stands beside a letter beyond ASCII: an ASCII letter, only other such letters, neither.
BESIDE = {True: (0.9, 0.04, 0.06), False: (0.003, 0.897, 0.1)}
#: What a small letter costs, and a capital that begins a word, stands inside one, or follows a capital.
SMALL, CAPITAL, INSIDE, CAPITALS = math.log(0.95), math.log(0.3), math.log(0.03), math.log(0.6)
# No charset has one of these bytes inside a character.
BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x3f]+")
TAG = re.compile(rb"<[^>]*+>")


@lru_cache(maxsize=1 << 16)
def _pair_cost(codec: str, char: str) -> float:
    if char < "\x80":
        return 0.0
    if char == "�":
        return BROKEN
    code = char.encode(codec)
    if len(code) > 1:
        for lead, lead_end, trail, trail_end, share, size in PAIRS[codec]:
            if lead <= code[0] <= lead_end and trail <= code[1] <= trail_end:
                return math.log(share / size)
    return REST


def _pairs_score(raw: bytes, codec: str) -> float:
    return sum(n * _pair_cost(codec, char) for char, n in Counter(raw.decode(codec, "replace")).items())


@lru_cache(maxsize=None)
def _byte_costs(codec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: its cost; what it is to the byte beside it (0 ASCII letter, 1 other letter, 2 neither);
    its case (2 upper, 1 any other letter, 0 no letter)."""
    chars = [bytes([b]).decode(codec, "replace") for b in range(256)]
    is_letter = [unicodedata.category(c)[0] in "LM" for c in chars]
    frequent = LETTERS[codec]
    kinds = [
        "ascii" if b < 128
        else "broken" if c == "�"
        else "symbol" if not letter
        else "frequent" if c.lower() in frequent
        else "letter"
        for b, (c, letter) in enumerate(zip(chars, is_letter, strict=True))
    ]
    shares = {"symbol": 0.12, "frequent": 0.7, "letter": 0.18} if frequent else {"symbol": 0.12, "letter": 0.88}
    sizes = Counter(kind for kind, _ in {(k, c.lower()) for k, c in zip(kinds, chars, strict=True)})
    cost = np.array([{"ascii": 0.0, "broken": BROKEN}.get(k, math.log(shares.get(k, 1) / sizes[k])) for k in kinds])
    beside = np.array([2 if not letter else 0 if b < 128 else 1 for b, letter in enumerate(is_letter)])
    case = np.array([0 if not letter else 2 if c.isupper() else 1 for c, letter in zip(chars, is_letter, strict=True)])
    return cost, beside, case


@lru_cache(maxsize=None)
def _latin_costs() -> np.ndarray:
    """A row of costs per byte where all letters have one share, and one for each of ``LATIN``, whose letters have
    shares like 1, 1/2, 1/3 and so on."""
    even, _, case = _byte_costs("cp1252")
    rows = [even]
    for letters in LATIN:
        share = {c: 0.85 / (i + 1) / sum(1 / (k + 1) for k in range(len(letters))) for i, c in enumerate(letters)}
        lower = [bytes([b]).decode("cp1252", "replace").lower() for b in range(256)]
        other = math.log(0.03 / len({c for b, c in enumerate(lower) if b >= 128 and case[b] and c not in share}))
        rows.append(np.where((np.arange(256) >= 128) & (case > 0), [math.log(share[c]) if c in share else other for c in lower], even))
    return np.stack(rows)


def _bytes_score(raw: bytes, codec: str) -> float:
    cost, beside, case = _byte_costs(codec)
    row = np.frombuffer(b" " + raw + b" ", np.uint8)
    at = np.flatnonzero(row >= 128)
    here, ahead, after = row[at], row[at - 1], row[at + 1]
    place, kind = np.minimum(beside[ahead], beside[after]), case[here]
    total = _latin_costs()[:, here].sum(axis=1).max() if codec == "cp1252" else cost[here].sum()
    total += np.log(np.array(BESIDE[codec == "cp1252"]))[place[kind > 0]].sum() + (kind == 0).sum() * math.log(1 / 3)
    # Capitals begin words or follow each other.
    capital, before = kind == 2, case[ahead]
    costs = ((kind == 1, SMALL), (capital & (before == 0), CAPITAL), (capital & (before == 1), INSIDE), (capital & (before == 2), CAPITALS))
    return float(total + sum(at.sum() * cost for at, cost in costs))


def likeliest_charset(raw: bytes) -> str:
    """Codec under which ``raw`` is likeliest; of equals the first listed. Bytes need not be whole:
    some broken characters do not rule a charset out. Without a byte beyond ASCII it is Latin.
    ASCII words outside tags speak for Latin, twice as many as there are other words at most. Texts all
    in capitals may be misread where a charset has capitals in the place of another's small letters."""
    words = sorted(w for w in set(BETWEEN.split(raw)) if not w.isascii())
    plain = sum(w.isalpha() for w in set(BETWEEN.split(TAG.sub(b" ", raw))))
    text = b" ".join(words)
    scores = {codec: _bytes_score(text, codec) + LATER for codec in LETTERS}
    scores |= {codec: _pairs_score(text, codec) + LATER for codec in PAIRS}
    scores["cp1252"] += PLAIN * min(plain, 2 * len(words)) - LATER
    return max(scores, key=scores.get)
