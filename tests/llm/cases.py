"""Small tables with what production tables hold at worst, and brute-force versions of the operators."""

import random
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 700}x{i * i % 311}" for i in range(9000))
BASE = " ".join(f"tok{i}" for i in range(60))
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: doc_id, text
ROWS = [
    (0, BASE), (1, BASE), (2, BASE.upper()), (3, BASE + " more words at the end"), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"), (9, "One two"),
    (10, LONG), (11, LONG[:20000] + " changed " + LONG[20000:]), (12, "same " * 40), (13, "same " * 40), (14, "straße ÉTÉ naïve 日本語 😀  x"), (15, "a\x0bb\x0cc\rd e"),
    (16, " ".join(f"tok{i}" for i in range(20, 45)) + " tail"), (16, " ".join(f"tok{i}" for i in range(20, 45)) + " tail"), (17, "x" * 3000), (18, "a b c d e f g h " * 3 + "i"),
    (19, "line one is here\nline one is here\n \n$$ ## | <b>\nother line"), (None, BASE), (None, None), (20, "## " * 200), (21, "z"),
]


def near_rows(seed=3, groups=6, copies=7):
    """Groups of copies with edits around the threshold, shuffled."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        words = [f"g{g}v{rng.randrange(4000)}" for _ in range(150)]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out, 100))


def messy(spark, rows=ROWS):
    """With extra columns whose names operators use themselves."""
    full = [(i, t, "en" if i and i % 2 else None, None if i == 3 else "src", len(t or ""), "x", 1.0, 7) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, chunk string, score double, n_words int")


def smallest_reachable(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, k):
    words = WORDS.findall((text or "").translate(FOLD))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def near_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return smallest_reachable({i for i, _ in sets}, links)


def repeats(rows, length):
    """(n_words, n_removed, kept) by row."""
    first = defaultdict(set)
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - length + 1):
            first[tuple(w[k : k + length])].add(float("inf") if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if min(first[tuple(w[k : k + length])]) < (float("inf") if i is None else i):
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def base_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    again = [False] * len(words)
    for k in range(len(words) - 7):
        if seen[tuple(words[k : k + 8])] > 1:
            again[k : k + 8] = [True] * 8
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(again)
