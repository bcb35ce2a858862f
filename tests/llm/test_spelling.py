"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from tocsin.llm import spelling
from tocsin.llm.spelling import Shard, spelling_variants, word_counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(cases.FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def variants(words):
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def misspelt(word, rng):
    k, c = rng.randrange(len(word)), rng.choice("etaoàÿz")
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :]])


def vocabulary(seed=9):
    rng = random.Random(seed)
    words = {}
    for _ in range(60):
        word = "".join(rng.choice("etaoinÀàxÿ") for _ in range(rng.randrange(7, 12)))
        n = 10 ** rng.randrange(1, 5)
        for _ in range(rng.randrange(1, 12)):
            words[word] = max(2, n)
            word, n = misspelt(word, rng), n // rng.choice([1, 10, 11, 100])
    words |= {"".join(p): rng.randrange(2, 40) for p in (rng.sample("abcdefg", 7) for _ in range(500))}  # one vector
    words |= {"a" * 5000: 5, "a" * 4999: 70, "a" * 4998 + "b": 700, "eeeeeee": 3, "eeeeeeee": 30, "eeeeeeeee": 300}
    return words


@pytest.mark.parametrize(("levels", "block"), [(0, 1 << 19), (2, 700), (3, 1 << 19)])
def test_variants(spark, levels, block):
    words = vocabulary()
    table = spark.createDataFrame([*((w, n, "s", 1) for w, n in words.items()), (None, 4, "s", 1)], "word string, n long, shard string, i int")
    found = spelling_variants(table.repartition(3), block=block, levels=levels)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, variants(words)))
    assert spelling_variants(table.limit(0)).count() == 0


@pytest.mark.parametrize("most_pairs", [0, 1 << 14])
def test_shard_links(monkeypatch, most_pairs):
    """A leaf's pairs, compared or joined by hashes."""
    monkeypatch.setattr(spelling, "MOST_PAIRS", most_pairs)
    rng = random.Random(10)
    home = list({"".join(rng.choice("ab") for _ in range(8)) for _ in range(150)})
    visitors = home + list({"".join(rng.choice("ab") for _ in range(7)) for _ in range(80)})
    a, b = Shard(home, visitors).links()
    found = Counter((visitors[x - len(home)], home[y]) for x, y in zip(a.tolist(), b.tolist()))
    assert found == Counter((v, h) for v in visitors for h in home if one_edit(v, h) and (len(v) < len(h) or v < h))


def test_words(spark):
    rows = [*cases.ROWS, *cases.near_rows(), (40, "Naïveté×÷ NAÏVETÉ naïveté×÷ abcdefg Abcdefg zZz ŒuvreS"), (41, "naÏveté " * 40 + "Ünterstützung" * 2000), (42, "straßenbahn " * 70)]
    rows += [(k, "keyboards Keyboards keyboard") for k in range(100, 300)]
    want = counted(rows)
    assert {r["word"]: r["n"] for r in word_counts(cases.messy(spark, rows).repartition(4)).collect()} == want
    assert len(want) == 10 and word_counts(cases.messy(spark, rows).limit(0)).count() == 0


def test_groups_cover_all_letters():
    letters = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
    assert set(spelling._group[letters].tolist()) == set(range(spelling.GROUPS))
    assert [spelling.upper_levels(n) for n in (0, 10**7, 10**9, 10**12)] == [0, 2, 6, 8]
