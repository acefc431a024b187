"""Made-up prose for tests, the same in every run."""

import random


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(("ba", "ne", "ti", "lo", "ru", "sha", "mi", "ko")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def text(seed, n):
    return " ".join(words(seed, n))
