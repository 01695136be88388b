"""Small tables with every odd case, and brute-force versions to compare with."""

import re
from collections import defaultdict

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, kept string, keep_id string, component_id string, sequence_id string, "
          "offset string, piece string, epoch string, block string, block_order string, n_tokens string, text_hash string, lang_pred string, "
          "score string, n string, k string, page string, bitmap string, start string, length string, ids string, spans string")
LONG = " ".join(f"word{i % 977} the{i % 13}" for i in range(30_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, None), (5, "one"), (6, "One"), (7, "one two three four five six seven"), (8, "one  two three\nfour five six seven"),
    (9, LONG), (10, LONG + " tail"), (11, "12 34 !!"), (12, "same id other text here now"), (12, "same id and yet another text here"),
    (13, "repeated row of words that is long enough"), (13, "repeated row of words that is long enough"),
    (None, "a text without an id that is here twice"), (None, "a text without an id that is here twice"), (None, None),
    (14, "ends with a\x00nul and ퟿ and \U0001f600 signs"),
]


def odd(spark, empty=False):
    rows = [] if empty else [(i, t, [None, "en", "de"][n % 3], [None, "a", "a", "a", "b"][n % 5], *["x"] * 21) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def linked(rows, width):
    """(doc_id, text) rows to {doc_id: (set size, component)} by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_item = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by_item[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by_item[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}
