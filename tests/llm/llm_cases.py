"""Texts and tables that the tests of this folder share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", " ", "\n\t\x0b", "a", "a b", "A B", "é" * 50, "one two three", "x " * 3000, "\x1c\x85\xa0 z"]


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))
