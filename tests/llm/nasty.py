"""Rows that every operator must take."""

import random

# Column names that the operators use for themselves somewhere
CLASHES = ["k1", "k2", "__k1", "__k2", "__row", "kept", "n_words", "text_hash", "fp", "line", "key", "piece", "length", "start", "gram", "pos", "host", "path", "y", "evidence"]


def words(seed, n, alphabet="abcdefghijklmnop"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n))


def nasty_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd characters."""
    long = "\n".join(words(i, 12) for i in range(400))
    shared = words(999, 90)
    rows = [
        (None, None), (None, "no id here"), (0, ""), (1, None), (2, "a"), (3, "\n\n \t\n"), (4, words(4, 60)), (4, words(4, 60)), (5, words(5, 60) + "\n" + shared),
        (6, shared + "\n" + words(6, 60)), (7, long), (8, long + "\nlast line of it"), (9, "é" * 50 + " ß x \x1c y"), (10, "same line of text here\nsame line of text here\nSame line of text here"),
        (11, "x " * 3000), (12, words(12, 300)), (13, words(12, 299) + " changed"), (14, "日本 語 텍스트 🙂 <|endoftext|> don't"), (-5, words(5, 60)),
    ]
    return rows
