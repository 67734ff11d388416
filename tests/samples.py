"""Seeded texts over mixed scripts with the characters rules disagree about."""

import random

ALPHABET = (
    "アイウカキクー・゠ヿヴ" "あいうがはです" "変換結果東京鿀龯" "abcXYZ" "0189" "²①５９٣" "é한ß"
    " 　\t\n\x1c \xa0" "。、！？「」（）" "!@#$%^&*()_+=[]{}|;:<>?/~`\"'\\-.," "：😀𠮷"
)
PHRASES = ["変換すると", "カタカナで", "答えは", "以下", "です", "になります", "  ", "\n\n", "アアアアアアア"]


def texts(n, seed, longest=60):
    rng = random.Random(seed)
    out = ["", " ", "　\n", "ア", "アア", "アイウ", "アイウエオ", "アイウエオカ", "キョウハヨイテンキデス。"]
    while len(out) < n:
        weights = rng.choice([None, [20 if "゠" <= c <= "ヿ" else 1 for c in ALPHABET]])
        size = rng.choice([3, 10, 30, longest, 3 * longest])
        parts = rng.choices(ALPHABET, weights, k=rng.randrange(size))
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(PHRASES))
        out.append("".join(parts))
    return out
