"""Operators that learn: exactness of what can be exact, held-out accuracy of the rest, and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tocsin.llm import queries
from tocsin.llm.language_id import identify, prototypes
from tocsin.llm.toxicity import Index, fold, learn, monotone, toxicity_scores

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_index_finds_the_nearest():
    rng = np.random.default_rng(1)
    dense = np.zeros((500, 60), np.float32)
    for row in dense:
        at = rng.choice(60, rng.integers(1, 8), replace=False, p=np.arange(1, 61) / 1830)
        row[at] = rng.random(len(at)) + 0.1
        row /= np.linalg.norm(row)
    dense = dense[np.argsort(dense.argmax(axis=1), kind="stable")]
    example, term = np.nonzero(dense)
    index = Index(example, term, dense[example, term], np.zeros(500), np.ones(500), 60)
    assert 0 < index.table.shape[1] < 60
    opened = []
    for row in dense[::7]:
        at = np.flatnonzero(row)
        found, scores, n = index.nearest(at, row[at], 10)
        want = np.round(dense[:, at].astype(float) @ row[at], 6)
        order = np.lexsort((np.arange(500), -want))[:10]
        assert np.allclose(scores, want[order][want[order] > 0], atol=2e-6) and (want[found] >= want[order[-1]] - 2e-6).all()
        opened.append(n)
    assert min(opened) < index.blocks


def test_monotone_map():
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.9, 0.95]), np.array([0, 1, 0, 0, 1, 1])
    at, level = monotone(x, y, np.ones(6), 0.5)
    assert (np.diff(at) > 0).all() and (np.diff(level) >= 0).all() and len(at) == 3
    assert np.allclose(level, [0.5 / 2, 1.5 / 4, 2.5 / 3]) and np.allclose(at, [0.1, 0.3, 0.925])


def _plain_scores(texts, labels, examples_of):
    """The method's scores with Counters and dense vectors: {id: score} for every text."""
    def found(text):
        raw = (text or "").encode()
        raw = re.sub(rb"\xc3[\x80-\x96\x98-\x9e]", lambda m: bytes([0xC3, m.group()[1] + 0x20]), raw)
        words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", raw)]
        return Counter(words) + Counter(b"^" + w[:5] for w in words if len(w) > 5)

    terms = {i: found(t) for i, t in texts.items()}
    df = Counter(t for c in terms.values() for t in c)
    idf = lambda t: math.log((1 + len(texts)) / (1 + df[t])) + 1
    index, fit = examples_of
    size = [sum(labels[i] == c for i in index) for c in (0, 1)]
    held = [Counter(t for i in index if labels[i] == c for t in terms[i]) for c in (0, 1)]
    smooth = [5.0 * n / sum(size) for n in size]

    def relevance(t):
        if not held[0][t] and not held[1][t]:
            return 0.02
        p = [(held[c][t] + smooth[c] + 1e-9) / (size[c] + 2 * smooth[c] + 2e-9) for c in (0, 1)]
        return 0.02 + math.log(p[1] / p[0]) ** 2

    def vector(c):
        v = {t: (1 + math.log(n)) * idf(t) * relevance(t) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(c) for i, c in terms.items()}
    stands = [sum(v == c for v in labels.values()) / size[c] for c in (0, 1)]
    prior = sum(labels.values()) / len(labels)

    def vote(i):
        near = sorted(((-round(sum(x * vectors[e].get(t, 0.0) for t, x in vectors[i].items()), 6), e) for e in index), key=lambda x: x[0])[:15]
        near = [(min(1.0, -s), e) for s, e in near if s < 0]
        votes = [(stands[labels[e]] * s**3 / (1.05 - s), labels[e]) for s, e in near]
        scale = 0.5 * sum(stands[labels[e]] for _, e in near) / len(near) if near else 1.0
        return (sum(v for v, y in votes if y) + scale * prior) / (sum(v for v, _ in votes) + scale)

    per = [sum(v == c for v in labels.values()) / sum(labels[i] == c for i in fit) for c in (0, 1)]
    y = np.array([labels[i] for i in fit])
    knots = monotone(np.array([vote(i) for i in fit]), y, np.array(per)[y], prior)
    return {i: float(np.interp(vote(i), *knots)) for i in texts}


def test_toxicity_scores_equal_brute_force(spark):
    """Whole scores of every text, from its words to the calibrated probability; ties go by the index's order, as there."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = learn(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null").collect() if texts.get(r["doc_id"]) is not None}
    index = model.examples.tolist()
    want = _plain_scores(texts, marks, (index, sorted(set(marks) - set(index))))
    off = [i for i in texts if abs(found[i] - want[i]) > 1e-3]
    assert not off, (len(off), [(i, found[i], want[i]) for i in off[:5]])


def test_toxicity_is_calibrated(spark):
    """Held-out rows in bins of the score: a bin's share of toxic rows is near its mean score."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = learn(docs, labels.where(fold("doc_id", 5) != 0))
    rows = toxicity_scores(docs.where(fold("doc_id", 5) == 0), model).join(labels, "doc_id").select("score", "toxic").collect()
    score, toxic = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    bins = np.minimum((score * 5).astype(int), 4)
    error = sum(abs(score[bins == b].mean() - toxic[bins == b].mean()) * (bins == b).sum() for b in range(5) if (bins == b).any()) / len(rows)
    assert error < 0.03
    assert ((score - toxic) ** 2).mean() < 0.02


def test_toxicity(spark):
    found = queries.op5_toxicity(spark, SF).join(table(spark, "labels"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert queries.op5_toxicity(spark, SF).count() == table(spark, "documents").count()
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)
    assert not [r for r in held if r["predicted"] and not r["toxic"]]


def test_toxicity_of_messy_rows(spark):
    docs = cases.messy(spark)
    labels = spark.createDataFrame([(0, 0), (1, None), (4, 1), (7, 1), (7, 1), (99, 1), (None, 1)], "doc_id long, toxic int")
    scored = toxicity_scores(docs, learn(docs, labels), carry=("lang",))
    assert scored.count() == len(cases.ROWS) and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity_scores(docs, learn(docs, labels.limit(0))).where("score <> 0").count() == 0
    assert toxicity_scores(docs.limit(0), learn(docs, labels)).count() == 0


def test_language(spark):
    found = queries.op7_language_id(spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_equals_a_plain_loop(spark):
    """Prototypes and cosines against trigram by trigram sums over strings."""
    rng = np.random.default_rng(3)
    alphabet = list("abcdeÉßжλ 1.-\n日😀")
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 60))), ["aa", "bb", None][i % 3]) for i in range(120)]
    letter = lambda c: np.random.default_rng([ord(c), 271828]).integers(0, 2, 1024, dtype=np.int8).astype(int) * 2 - 1

    def vector(text):
        out, marked = np.zeros(1024), ["\0"]
        for c in text:
            c = c.lower() if c.isalpha() else "\0"
            if c != "\0" or marked[-1] != "\0":
                marked.append(c)
        marked.append("\0")
        for a, b, c in zip(marked, marked[1:], marked[2:]):
            if b != "\0":
                out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return out

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = prototypes(docs)
    plain = {lang: sum(vector(t) for _, t, own in rows if own == lang) for lang in ("aa", "bb")}
    plain = {lang: v / np.linalg.norm(v) for lang, v in plain.items()}
    assert all(np.allclose(known[lang], plain[lang], atol=1e-6) for lang in plain) and len(known) == 2
    found = {r["doc_id"]: r for r in identify(docs, known).collect()}
    for i, text, _ in rows:
        v = vector(text)
        cosines = {lang: float(p @ v / np.linalg.norm(v)) for lang, p in plain.items()} if v.any() else {}
        assert abs(found[i]["score"] - max(0.0, max(cosines.values(), default=0.0))) < 1e-5
        assert found[i]["lang_pred"] == (max(cosines, key=cosines.get) if cosines else "und") or abs(cosines["aa"] - cosines["bb"]) < 1e-5


def test_language_of_messy_rows(spark):
    docs = cases.messy(spark)
    known = prototypes(docs.withColumn("lang", F.lit("xx")))
    found = {r["doc_id"]: r for r in identify(docs, known).collect()}
    assert identify(docs, known).count() == len(cases.ROWS)
    assert {i for i, r in found.items() if r["lang_pred"] == "und"} >= {4, 5, 6, 20}
    assert found[0]["lang_pred"] == "xx" and found[0]["score"] > 0
    assert {r["lang_pred"] for r in identify(docs, prototypes(docs.limit(0))).collect()} == {"und"}
    assert identify(docs.limit(0), known).count() == 0


def test_pipeline(spark):
    """Each stage against what it should do with its own input; the end against a brute-force encoding."""
    from tokenizers import Tokenizer

    docs, columns = table(spark, "documents"), set(corpus_pipeline.COLUMNS)
    toxic = {r["doc_id"] for r in table(spark, "labels").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(docs.columns) == columns and after.keys() <= before.keys()
        if name == "toxicity":
            assert len(after.keys() & toxic) < 0.3 * len(toxic) and len(before) - len(after) < 1.2 * len(toxic) * len(before) / 399
        if name == "near duplicates":
            groups = cases.near_components(sorted(before.items()), 5, 80)
            assert after.keys() == {i for i, c in groups.items() if i == c}
        if name == "repeated passages":
            assert after == {i: kept if gone else before[i] for i, _, gone, kept in cases.repeats(sorted(before.items()), 13)}
        elif name != "toxicity":
            assert all(before[i] == t for i, t in after.items())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    packed = {}
    for r in rows:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == sizes
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * sum(sizes.values()) / 2048 + 2
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_near_dups_stage_tells_rows_of_one_id_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (None, b), (None, a + " tail"), (None, "none like it"), (7, None), (7, None)]
    docs = cases.messy(spark, rows).select(*corpus_pipeline.COLUMNS)
    kept = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, a), (5, b), (None, "none like it"), (7, None), (7, None)])


def test_stages_on_messy_rows(spark):
    docs = cases.messy(spark).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0, name
