"""Small document tables with the awkward cases, and brute-force versions of the operators."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, score string, __part string"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(BASE[(x >> 16) % len(BASE)] + str((x >> 8) % 50))
    return " ".join(out)


def rows():
    """Nulls, empty and blank texts, ties, repeated rows, copies, near copies and a very long text."""
    long = prose(99, 30_000)
    near = prose(5, 200).split()
    texts = [
        (1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "one two"), (8, "one two"),
        (9, long), (10, " ".join(near)), (11, " ".join(near[:199] + ["changed"])), (12, " ".join(["start"] + near[1:])), (13, prose(3, 60) + "\n" + prose(1, 40)),
        (14, "word " * 80), (15, "$$$ %%% ### " * 20), (16, "mail a.b@mail.example.com, card 4111111111111111."), (None, prose(4, 30)), (17, "a  b \n\n\n c\t\td  "), (18, "日本語 テスト " * 20),
    ]
    sources = ["s1", "s2", None, "s1", "é"]
    return [(i, t, "en", sources[n % 5], None if t is None else len(t), "k", "z", "s", "p") for n, (i, t) in enumerate(texts)]


def words(t):
    return WORD.findall(t or "")
