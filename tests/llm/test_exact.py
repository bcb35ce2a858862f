"""Operators with exact results against brute force, on messy and on generated tables."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tocsin.llm import common, embedding_dedup, license_scan, queries
from tocsin.llm.common import Scratch
from tocsin.llm.components import components, union_find
from tocsin.llm.embedding_dedup import Layout, layout, learn_rotation, near_vectors
from tocsin.llm.license_scan import bodies, license_matches, license_sql
from tocsin.llm.near_dup import near_duplicates, superminhash
from tocsin.llm.packing import pack, pieces, sum_of_squares
from tocsin.llm.piece_bpe import PieceEncoder, PieceModel, encode_pieces
from tocsin.llm.quality import RULES, SHRINK, limits, measures, quality_verdicts
from tocsin.llm.substring_dedup import remove_repeats
from tocsin.llm.token_output import BLOCK, CHECKPOINT, LANES, Segment, encode_segment, frequencies, read_tokens, write_tokens
from tocsin.llm.word_tokens import WordEncoder

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = cases.ROWS + cases.near_rows()


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    rest = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(160)]
    links = chain + star + rest + [(5, 5), (None, 3)]
    rng.shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long").repartition(7), Scratch(spark)).collect()
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = cases.smallest_reachable({x for link in real for x in link}, real)
    assert {r["node"]: r["component"] for r in found} == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0
    nodes, roots = union_find(np.array([3, 9, 9]), np.array([5, 5, 8]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {3: 3, 5: 3, 8: 3, 9: 3}


def test_substring_dedup(spark):
    rng = random.Random(2)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(4)]
    rows = list(ROWS)
    for i in range(60):
        words = [f"u{rng.randrange(10**6)}" for _ in range(30)]
        p = passages[rng.randrange(4)]
        a = rng.randrange(50)
        words[10:10] = p[a : a + rng.randrange(5, 40)]
        rows.append((1000 + i, " ".join(words)))
    found = remove_repeats(cases.messy(spark, rows).repartition(5), length=13, chunk_bytes=3000)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect())
    assert got == Counter(cases.repeats(rows, 13))
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert [(s["start"], s["end"]) for s in spans[3]] == [(0, 60)] and spans[0] == []
    assert remove_repeats(cases.messy(spark, rows).limit(0)).count() == 0
    short = remove_repeats(cases.messy(spark, rows), length=3, carry=("lang",))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in short.collect()) == Counter(cases.repeats(rows, 3))
    with pytest.raises(ValueError, match="result"):
        remove_repeats(cases.messy(spark, rows), carry=("chunk",))
    alike = [(None if i % 3 else 7, " ".join(f"n{i % 40}w{k}" for k in range(20))) for i in range(240)]  # one id, or none, on all rows
    found = remove_repeats(cases.messy(spark, alike), chunk_bytes=3000).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found) == Counter(cases.repeats(alike, 13))


def test_words_of_a_pattern_differ(spark):
    """Words of two letters that a polynomial hash modulo 2^64 can't tell apart, as whole words and inside texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    for x, y in ((one, two), (one.upper(), two)):
        rows = [(1, f"{x} " * 15), (2, f"{y} " * 15)]
        docs = cases.messy(spark, rows)
        assert [r["n_removed"] for r in remove_repeats(docs).collect()] == [0, 0]
        assert all(r["kept"] for r in near_duplicates(docs).collect())
        tokenizer, model = Tokenizer.from_file(WORD_BPE), SentencePieceProcessor(model_file=PIECE_BPE)
        data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
        ids, ptr = WordEncoder(WORD_BPE).encode(data, np.array([0, len(rows[0][1]), len(data)]))
        assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for _, t in rows]
        encoder = PieceEncoder(PieceModel(PIECE_BPE))
        assert [encoder.encode_text(t) for _, t in rows] == [(model.encode(t), t) for _, t in rows]


def test_ranges_are_told_apart_by_their_bytes(monkeypatch):
    data = np.frombuffer(b"ab\0ab ab abcdefgh abcdefgi abcdefgh\0", np.uint8)
    cuts = [(0, 2), (0, 3), (3, 5), (6, 8), (6, 6), (9, 17), (18, 26), (27, 35), (27, 36)]
    start, end = np.array(cuts).T
    a, b = common.hash_ranges(data, start, end, seed=5), common.hash_ranges(data, start, end)
    assert not (set(a.tolist()) & set(b.tolist()))
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(common, "hash_ranges", lambda buffer, start, end: np.zeros(len(start), np.uint64))
        first, at = common.distinct_ranges(data, start, end)
        assert [data[start[first[k]] : end[first[k]]].tobytes() for k in at] == [data[a:b].tobytes() for a, b in cuts] and len(first) == 6


@pytest.mark.parametrize(("shingle", "percent"), [(4, 80), (5, 80)])
def test_near_duplicates(spark, shingle, percent):
    found = near_duplicates(cases.messy(spark, ROWS).repartition(4), shingle=shingle, percent=percent).collect()
    want = cases.near_components(ROWS, shingle, percent)
    assert len(found) == len(ROWS)
    for r in found:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = Counter((i, len(cases.shingles(t, shingle))) for i, t in ROWS)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in found) == sizes
    assert len(set(want.values())) < len(want)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(cases.messy(spark).limit(0)).count() == 0
    assert [r["kept"] for r in near_duplicates(cases.messy(spark, [(1, None), (2, "")])).collect()] == [True, True]


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    signature = superminhash(np.concatenate([a, b]), np.array([0, 1000, 2000]), 256)
    assert abs((signature[0] == signature[1]).mean() - 800 / 1200) < 0.1
    one = superminhash(np.array([5], np.uint64), np.array([0, 1]), 150)
    assert sorted((one[0] >> np.uint64(40)).tolist()) == list(range(150))  # one element ranks every place once
    shuffled = superminhash(np.concatenate([a[::-1], b]), np.array([0, 1000, 2000]), 256)
    assert (shuffled == signature).all()


def test_quality_measures(spark):
    docs = cases.messy(spark, ROWS)
    got = Counter(tuple(r) for r in measures(docs.drop("n_words"), ["doc_id"]).collect())
    assert got == Counter((i, *cases.base_measures(t)) for i, t in ROWS)
    for r in quality_verdicts(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (r["reason"] is None) and not (r["base_failed"] and r["kept"])
    assert quality_verdicts(docs.limit(0)).count() == 0


def test_quality_limits_follow_the_source(spark):
    prose = [(i, " ".join(f"word{i}n{k}" for k in range(60)), "en", "plain") for i in range(300)]
    tables = [(1000 + i, " ".join(f"cell{i}n{k} |" for k in range(30)), "en", "tables") for i in range(300)]
    odd = [(2000, " ".join(f"cellzn{k} |" for k in range(30)), "en", "plain")]
    docs = spark.createDataFrame(prose + tables + odd, "doc_id long, text string, lang string, source string")
    gone = {r["doc_id"]: r["reason"] for r in quality_verdicts(docs).where("not kept").collect()}
    assert gone == {2000: "symbol_share"}


def test_junk_does_not_lift_its_own_limit(spark):
    prose = [(i, " ".join(f"word{i}n{k}" for k in range(60)), "en", "mixed") for i in range(400)]
    junk = [(1000 + i, " ".join(f"cell{i}n{k} {'|' * (1 + i % 4)}" for k in range(30)), "en", "mixed") for i in range(100)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")
    gone = {r["doc_id"]: r["reason"] for r in quality_verdicts(docs).where("not kept").collect()}
    assert gone == {1000 + i: "symbol_share" for i in range(100)}


def _measured(rng, lang, source, n, symbols):
    words = np.maximum(20, rng.lognormal(5.5, 0.9, n).astype(int))
    rows = zip(words.tolist(), (words * rng.normal(5, 0.3, n)).astype(int).tolist(), rng.binomial(words, symbols).tolist(), (rng.random(n) < 0.05).astype(int).tolist(), (16 * (rng.random(n) < 0.04)).astype(int).tolist())
    return [(lang, source, *r, False) for r in rows]


MEASURED = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def test_quality_limits_are_near_exact_quantiles(spark):
    """Each limit lies between those from exact quantiles two percent of the ranks lower and higher; no group has the same limit."""
    rng = np.random.default_rng(8)
    groups = [("en", "a", 3000, 0.0), ("en", "b", 400, 0.02), ("de", "a", 30, 0.0), (None, "c", 1500, 0.001), ("de", None, 5, 0.1)]
    rows = [r for g in groups for r in _measured(rng, *g)]
    found = {(r["_lang"], r["_source"]): r for r in limits(spark.createDataFrame(rows, MEASURED).repartition(5)).collect()}
    assert len(found) == len(groups)
    value = {
        "symbol_share": lambda t: np.log((t[:, 2] + 0.5) / (t[:, 0] + 1)), "duplicate_line_share": lambda t: np.log((t[:, 3] + 0.5) / (t[:, 0] + 1)),
        "repeat_share": lambda t: np.log((t[:, 4] + 8) / (t[:, 0] + 16)), "word_length": lambda t: t[:, 1] / t[:, 0],
    }
    everything = np.array([r[2:7] for r in rows], float)
    for name, (_, above, below) in RULES.items():
        for (lang, source), limit in found.items():
            nested = [everything, np.array([r[2:7] for r in rows if r[0] == lang], float), np.array([r[2:7] for r in rows if r[:2] == (lang, source)], float)]

            def at(q, nested=nested, name=name):
                x = [np.quantile(value[name](t), min(1.0, max(0.0, q)), method="inverted_cdf") for t in nested]
                near = (len(nested[1]) * x[1] + SHRINK * x[0]) / (len(nested[1]) + SHRINK)
                return (len(nested[2]) * x[2] + SHRINK * near) / (len(nested[2]) + SHRINK)

            least, most = (above * at(0.75 + e) - (above - 1) * at(0.5 - e) for e in (-0.02, 0.02))
            assert least - 1e-9 <= limit[f"{name}_most"] <= most + 1e-9
            if below is not None:
                least, most = (below * at(0.25 + e) - (below - 1) * at(0.5 - e) for e in (-0.02, 0.02))
                assert least - 1e-9 <= limit[f"{name}_least"] <= most + 1e-9
    assert len({round(r["symbol_share_most"], 6) for r in found.values()}) == len(groups)


def test_quality_limits_move_with_a_source(spark):
    """A small shift of one source's symbols moves its limit and others' far less."""
    limit = {}
    for share in (0.01, 0.02):
        rows = _measured(np.random.default_rng(9), "en", "still", 2000, 0.01) + _measured(np.random.default_rng(10), "en", "moved", 2000, share)
        limit[share] = {r["_source"]: r["symbol_share_most"] for r in limits(spark.createDataFrame(rows, MEASURED)).collect()}
    assert limit[0.02]["moved"] != limit[0.01]["moved"] and abs(limit[0.02]["still"] - limit[0.01]["still"]) < 0.25 * abs(limit[0.02]["moved"] - limit[0.01]["moved"])


def test_quality_verdicts_follow_the_limits(spark):
    """kept against limits that are applied row by row."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = quality_verdicts(docs, carry=("lang", "source")).collect()
    found = {(r["_lang"], r["_source"]): r for r in limits(spark.createDataFrame([(r["lang"], r["source"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in rows], MEASURED)).collect()}
    for r in rows:
        limit = found.get((r["lang"], r["source"]))
        bad = r["base_failed"]
        if not bad:
            n = r["n_words"]
            values = {"symbol_share": np.log((r["n_symbols"] + 0.5) / (n + 1)), "duplicate_line_share": np.log((r["n_dup_lines"] + 0.5) / (n + 1)), "repeat_share": np.log((r["n_repeat_words"] + 8) / (n + 16)), "word_length": r["word_chars"] / n}
            bad = any(v > limit[f"{k}_most"] + 1e-12 for k, v in values.items()) or values["word_length"] < limit["word_length_least"] - 1e-12
        assert r["kept"] == (not bad)
    assert {r["kept"] for r in rows} == {True, False}
    with pytest.raises(ValueError, match="result"):
        quality_verdicts(docs, carry=("kept",))


def test_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = [*ROWS, (500, "it's 12a34 <|endoftext|>'S o'clock"), (501, "été ÉCOLE ×÷ ΣΑΣ İx")]
    docs = cases.messy(spark, rows)
    encoded = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    write_tokens(docs.repartition(6), f"{tmp_path}/tokens", WORD_BPE, end_id=1)
    found = read_tokens(spark, f"{tmp_path}/tokens").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at = 0
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["start"], r["n_tokens"], ids[-1]) == (at, len(ids), 1)
        if r["doc_id"] is not None:
            assert ids[:-1] == encoded[r["doc_id"]]
        at += len(ids)
    write_tokens(docs.limit(0), f"{tmp_path}/none", WORD_BPE, end_id=1)
    assert read_tokens(spark, f"{tmp_path}/none").count() == 0

    cut = pieces(docs, WORD_BPE, end_id=0, size=256).collect()
    by = {}
    for r in cut:
        by.setdefault((r["doc_id"], r["piece"]), r)
    for i, ids in encoded.items():
        if i is None:
            continue
        whole = [*ids, 0]
        for k in range(0, len(whole), 256):
            r = by[i, k // 256]
            assert (r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()) == (k, len(whole[k : k + 256]), whole[k : k + 256])


def test_segments():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.01, 3 * BLOCK + 77), 49_000).astype(np.uint32)
    raw = encode_segment(np.array([7, 9]), np.array([5, len(ids) - 5]), ids)
    segment = Segment(raw)
    assert (segment.decode() == ids).all() and segment.doc_ids.tolist() == [7, 9]
    assert (segment.decode(1, 2, 1) == ids[BLOCK + CHECKPOINT * LANES : 2 * BLOCK]).all()
    assert (Segment(encode_segment(np.array([1]), np.array([3]), np.array([4, 4, 4], np.uint32))).decode() == 4).all()
    broken = bytearray(raw)
    broken[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        Segment(bytes(broken)).decode()


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.choice([2048, 1, 2047, *range(10, 1500)])) for i in range(3000)] + [(5, 0, 700), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    found = pack(df, 2048, group_pieces=1000).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in found) == Counter(rows)
    held = {}
    for r in sorted(found, key=lambda r: (r["offset"], r["length"] or 0)):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + (r["length"] or 0)
    assert max(held.values()) <= 2048
    assert len(held) <= 1.02 * sum(n or 0 for *_, n in rows) / 2048 + 4
    assert pack(df.limit(0), 2048).count() == 0
    assert sum_of_squares(np.array([6, 4, 5, 5]), 10)[0].max() == 1
    one = spark.createDataFrame([(None, None, 100)] * 2500, "doc_id long, piece int, length long")  # no key at all
    alike = pack(one, 2048, group_pieces=500).collect()
    assert len(alike) == 2500 and len({r["sequence_id"] for r in alike}) <= 2500 / 20 + 5
    assert {(r["sequence_id"] % 5) for r in alike} == set(range(5))
    with pytest.raises(ValueError, match="result"):
        pack(df.withColumn("offset", F.lit(1)), 2048)
    with pytest.raises(Exception, match="longer than a sequence"):
        pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8).collect()


def test_sum_of_squares_equals_a_plain_loop():
    """Each placement against one that tries every open sequence and counts the squares anew."""
    rng = random.Random(12)
    for size in (10, 37, 200):
        lengths = [rng.randrange(0, size + 1) for _ in range(250)]
        gaps, want = [], {}
        last = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            n, best = lengths[i], None
            for b, gap in enumerate(gaps):
                if 0 < gap and n <= gap and n < size:
                    after = Counter(g for k, g in enumerate(gaps) if k != b and g)
                    if gap - n:
                        after[gap - n] += 1
                    cost = sum(v * v for v in after.values()), gap, -last[b]
                    best = min(best, (cost, b)) if best else (cost, b)
            if best is None:
                gaps.append(size)
                last.append(0)
                best = None, len(gaps) - 1
            b = best[1]
            want[i] = b, size - gaps[b]
            gaps[b] -= n
            last[b] = len(want)
        sequence, offset = sum_of_squares(np.array(lengths), size)
        assert [want[i] for i in range(len(lengths))] == list(zip(sequence.tolist(), offset.tolist()))


def test_frequencies_sum_and_keep_shares():
    rng = np.random.default_rng(13)
    for counts in (np.array([5]), np.ones(40_000, np.int64), np.r_[10**9, 10**6, np.ones(30_000, np.int64)], rng.integers(1, 10**6, 5000)):
        f = frequencies(counts).astype(np.int64)
        assert f.sum() == 1 << 20 and f.min() >= 1
        assert (np.abs(f - counts / counts.sum() * (1 << 20)) <= np.maximum(2, 0.05 * (1 << 20) * counts / counts.sum())).all()


def test_sentencepiece(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECE_BPE)
    rng = random.Random(6)
    rows = [*ROWS, (600, "▁▁a ▁b  ▁ <s> </s> <0x0A>"), (601, "the" * 400), (602, " " * 90 + "end" + " " * 40), (603, "\n\n\t x\r\n")]
    rows += [(700 + k, "".join(rng.choice("ab the\n\t.,ÀéßΣ0123▁́日😀") for _ in range(rng.randrange(120)))) for k in range(300)]
    for r in encode_pieces(cases.messy(spark, rows), PIECE_BPE).collect():
        if r["doc_id"] is None:
            continue
        text = dict(rows)[r["doc_id"]] or ""
        ids = model.encode(text)
        assert (np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["decoded"]) == (ids, len(ids), model.decode(ids))
    r = encode_pieces(cases.messy(spark, [(1, "two words")]), PIECE_BPE, digest=True).first()
    assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, model.encode("two words"))).encode()).hexdigest()
    assert encode_pieces(cases.messy(spark).limit(0), PIECE_BPE).count() == 0


def test_licenses(spark):
    extra = [(800, "MIT"), (801, "released under the mit license\nnothing"), (802, "Released, under the MIT licence"), (803, "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.")]
    docs = cases.messy(spark, [*ROWS, *extra])
    columns = ["doc_id", "line_no", "license", "common", "size", "template_size"]
    got = sorted(map(tuple, license_matches(docs).select(*columns).collect()))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({license_sql()})").fetchall())
    assert {(r[0], r[2]) for r in got} >= {(801, "MIT"), (803, "MIT")}
    assert license_matches(docs.limit(0)).count() == 0


def test_license_spans(spark):
    prose = lambda k: "\n".join(" ".join(f"word{k}n{i}x{j}" for j in range(12)) for i in range(40))
    grant = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction."
    rows = [(k, f"{prose(k)}\nCopyright (c) 2020 Some Holder\n{text}\n{prose(-k)}", name) for k, (name, (text,)) in enumerate(sorted(bodies().items()))]
    rows += [(100, f"{prose(100)}\n{grant}\n{prose(101)}", "MIT"), (101, f"{prose(102)}\nA longer line of prose says in the end: licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), (102, prose(103), None)]
    rows += [(103, f"{bodies()['MIT'][0]}\n{prose(104)}\n{bodies()['ISC'][0]}", None)]
    found = license_matches(spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3)).collect()
    best = {}
    for r in sorted(found, key=lambda r: r["common"]):
        best[r["doc_id"]] = r["license"], r["line_no"]
    body = {k: (name, 42) for k, _, name in rows if k < 100}
    assert {k: best[k][0] for k in body} == {k: name for k, (name, _) in body.items()}
    assert all(41 <= best[k][1] <= 46 for k in body)
    assert best[100] == ("MIT", 41) and best[101] == ("CC-BY-SA-4.0", 41) and 102 not in best
    assert {r["license"] for r in found if r["doc_id"] == 103} == {"MIT", "ISC"}
    assert all(200 * r["common"] >= 80 * (r["size"] + r["template_size"]) for r in found)


def spans_by_hand(text, templates, percent):
    """Spans of a text as (line_no, last_line, license, common, size, template_size), by plain loops."""
    words = [(w, k) for k, line in enumerate(text.split("\n"), 1) for w in license_scan._words_of(line)]
    pairs = [(f"{a} {b}", i, j) for (a, i), (b, j) in zip(words, words[1:])]
    every, found = {p for p, _, _ in pairs}, set()
    for name, own, n_words, rare in templates:
        size = len(own)
        if not pairs or (200 - percent) * len(every) < percent * size or not every & rare or (200 - percent) * len(every & own) < percent * size:
            continue
        runs, run = [], None

        def close(run):
            if run and 2 * run["top"] >= percent * size:
                runs.extend([(run["lo"], run["hi"]), (run["lo"], run["near"])])

        for p in (k for k, (pair, _, _) in enumerate(pairs) if pair in own):
            score = run["score"] - percent * (p - run["last"] - 1) if run else 0
            if score <= 0 or (p - run["lo"]) * percent >= n_words * (200 - percent):
                close(run)
                run = {"lo": p, "last": p, "score": 200 - percent, "top": 200 - percent, "hi": p, "most": 200 - percent, "near": p}
                continue
            score += 200 - percent
            run |= {"last": p, "score": score}
            if score >= run["top"]:
                run |= {"top": score, "hi": p}
            if score >= run["most"] and p - run["lo"] < n_words:
                run |= {"most": score, "near": p}
        close(run)
        for lo, hi in runs:
            length = max(hi - lo + 1, min(n_words - 1, len(pairs)) if n_words < license_scan.SHORT else 0)
            begin = min(lo, len(pairs) - length)
            part = {p for p, _, _ in pairs[begin : begin + length]}
            if 200 * len(part & own) >= percent * (len(part) + size):
                common = len(part & own)
                found.add((lo, hi, name, (common, 2 * common / (len(part) + size)), pairs[lo][1], pairs[hi][2], common, len(part), size))
    kept = []
    for x in sorted(found):
        if not kept or kept[-1][1] < x[0]:
            kept.append(x)
        elif x[3] > kept[-1][3]:
            kept[-1] = x
    return [(x[4], x[5], x[2], *x[6:]) for x in kept]


def test_license_spans_equal_plain_loops(spark):
    rng, percent = random.Random(13), 80
    templates = {"one": ("a b c d e f g h",), "two": ("a b c d x y z", "k l m n o p q r s t u v w k l m n"), "long": (" ".join(f"w{i % 37}" for i in range(90)),)}
    known = []
    table = license_scan._table(spark, templates, percent)
    for r in table.collect():
        text = templates[r["license"]][r["variant"]]
        own = license_scan.bigrams_of(text)
        rare = {b for b, h in zip(own, r["template"]) if h in set(r["rare"])}
        known.append((r["license"], set(own), r["words"], rare))
    texts = ["", "a", "a b", templates["one"][0], templates["long"][0] + " " + templates["long"][0]]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice([t for ts in templates.values() for t in ts]).split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice("abcxyz") + rng.choice(["", "q"])
            parts.append(rng.choice([" ", "\n", " , "]).join(words) if rng.random() < 0.5 else " ".join(words))
            parts.append(" ".join(rng.choice(["prose", "a", "b", "w1", "w2"]) for _ in range(rng.randrange(12))))
        texts.append("\n".join(parts))
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string").repartition(3)
    got = {}
    for r in license_scan._spans(df, table, percent).collect():
        got.setdefault(r["row"], []).append((r["line_no"], r["last_line"], r["license"], r["common"], r["size"], r["template_size"]))
    want = {k: sorted(found) for k, t in enumerate(texts) if (found := spans_by_hand(t, known, percent))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 40


def test_near_vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for label in (1, 2):
        centres = rng.normal(size=(5, 24))
        for _ in range(150):
            rows.append((len(rows), (centres[rng.integers(5)] + rng.normal(size=24) * rng.uniform(0, 0.25)).tolist(), label))
    rows += [(len(rows) + k, rows[3][1], 1) for k in range(30)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] + [1.0] * 23, 1), (904, [None] + [1.0] * 23, 1), (905, rows[3][1], None), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, rows[3][1], 1), (908, [float("inf")] * 24, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1))
    good = [(i, np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for n, (a, x, p) in enumerate(good) for b, y, q in good[:n] if p == q and len(x) == len(y) and x @ y >= 0.98]
    want = cases.smallest_reachable({i for i, *_ in rows if i is not None}, links)
    count = Counter(x for link in links for x in link)
    found = near_vectors(df.repartition(3), least=0.98, block=16).collect()
    assert len(found) == len(rows)
    close = sum(r["n_links"] == count[r["vec_id"]] for r in found) / len(found)
    assert close >= 0.97 and sum(r["n_links"] for r in found) >= 0.99 * sum(count.values())
    assert all(r["n_links"] <= count[r["vec_id"]] for r in found)
    assert sum(r["vec_id"] is None or r["component_id"] == want[r["vec_id"]] for r in found) >= 0.99 * len(found)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dims", "lean"), [(32, 0.0), (64, 0.7), (128, 0.5)])
def test_near_vectors_recall(spark, monkeypatch, dims, lean):
    """Links found by the tables against brute force, also where all vectors lean one way; exact finds all of them."""
    rng = np.random.default_rng(dims)
    toward = np.ones(dims) / dims**0.5
    x = rng.normal(size=(700, dims))
    x = lean**0.5 * toward + (1 - lean) ** 0.5 * x / np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.normal(size=x.shape)
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    x = np.concatenate([x, x + step * rng.uniform(0.0, 0.2, (700, 1))])
    x = np.concatenate([x, x[:1] + rng.normal(size=(400, dims)) * 0.02 / dims**0.5])  # near copies that share a cell
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    exact = {r["vec_id"]: r["n_links"] for r in near_vectors(df, exact=True, block=64).collect()}
    assert [exact[i] for i in range(len(x))] == near.sum(axis=1).tolist()
    alone, results = near.sum(axis=1) < 100, []
    tables = ((None, 4096), (None, 20), (layout(10**8, 0.98), 50)) if dims == 64 else ((None, 4096),)  # tables for more vectors, and split buckets
    for shape, bucket in tables:
        monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
        found = {r["vec_id"]: r["n_links"] for r in near_vectors(df, block=64, shape=shape).collect()}
        recall = sum(found[i] for i in np.flatnonzero(alone).tolist()) / near[alone].sum()
        print(f"recall at {dims} dimensions, lean {lean}, {shape}: {recall:.4f}")
        assert 0.95 <= recall <= 1 and sum(found.values()) >= 0.99 * near.sum()
        results.append(found)
    assert results[0] == results[min(1, len(results) - 1)]
    _, projection, _ = learn_rotation(unit)
    codes = (unit[:700] - unit.mean(axis=0)) @ projection > 0
    apart = (codes[:, None, :] != codes[None]).reshape(700, 700, 4, 16).sum(axis=3)
    assert ((apart <= 1).any(axis=2)).mean() < 0.02  # tables don't make cells of unrelated vectors meet


def test_layout_follows_the_vectors():
    shapes = [layout(n, 0.98) for n in (0, 1, 2**16, 2**16 + 1, 10**6, 10**8, 10**12)]
    assert shapes[0] == shapes[2] == Layout(16, 4) and shapes[3].sub == 17
    assert all(x.sub <= y.sub and x.tables <= y.tables and y.words * 64 >= y.bits for x, y in zip(shapes[:-1], shapes[1:]))
    assert layout(10**6, 0.9).tables > layout(10**6, 0.98).tables and layout(10, 1.0).tables == 4


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_crc_columns(spark):
    found = queries.op4_best_fit_packing(spark, "/root/testdata/sf0.001").limit(3).collect()
    assert all(0 <= r["ids_crc32"] < 1 << 32 for r in found) and zlib.crc32(b"") == 0
