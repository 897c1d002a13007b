"""Hard negatives, ranked search and order-sensitive fingerprints against plain versions and on odd tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epsforest.llm import hard_negatives, order_minhash, ranked_search
from epsforest.llm.textscan import U64, mix
from tests.llm.common import docs

VECTORS = "vec_id long, embedding array<float>, label int, score long, row long, bucket int"
ODD = [None, "", " \n ", "a", "Same words here", "Same words here", "same words HERE, twice: words", "ünï çödé 中文 words", "x" * 40, "short words " * 3000, "b a", "a b"]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 0, 0, 0) for i, v, y in rows], VECTORS)


def plain_negatives(rows, every=50):
    some = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        some.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, y, v) in enumerate(some):
        if i % every:
            continue
        score = [sum(p * q for p, q in zip(v, w, strict=False)) for _, _, w in some]
        others = sorted((-score[b], some[b][0], b) for b in range(len(some)) if b != a)
        for ps, pid, _ in [x for x in others if some[x[2]][1] == y][:5]:
            fit = [(n, -s) for s, n, b in others if some[b][1] != y and 50 * -ps <= 100 * -s <= 95 * -ps][:3]
            out += [(i, pid, k + 1, n, -ps, s) for k, (n, s) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(vectors(spark, rows), "vec_id", "embedding", label, F.col("vec_id") % 50 == 0, **sizes)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("sizes", [{}, {"bucket": 60, "block": 3}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(10, 6))
    rows = [(i, (centres[y := int(rng.integers(0, 10))] * 0.3 + rng.normal(size=6) * 0.2).tolist(), y) for i in range(420)]
    rows += [(k, [0.5] * 6, k % 3) for k in range(1000, 1030)]  # a common vector: ties
    want = plain_negatives(rows)
    assert len(want) > 60 and mined(spark, rows, **sizes) == want


def test_hard_negatives_on_odd_rows(spark):
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.4, 0.5], 1), (2, [0.3, 0.4], 2), (3, [0.3], 2), (4, None, 1), (5, [0.1, None], 1), (6, [float("nan"), 1.0], 2), (None, [0.1, 0.1], 1)]
    rows += [(8, [0.2, 0.2], None), (9, [], 2), (50, [-0.5, -0.5], 2), (51, [float("inf"), 0.0], 3), (52, [1e30, 0.0], 3), (53, [0.45, 0.45], 2), (53, [0.45, 0.45], 2)]
    assert mined(spark, rows) == plain_negatives([r for r in rows if r[0] != 52])  # too large to score exactly
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1)]) == [] and mined(spark, [(50, [0.5], 1)]) == []


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(texts, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in texts]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small_terms", [0, 10**6])
def test_ranked_search_equals_brute_force(spark, small_terms):
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)]
    draw = lambda n: " ".join(words[int(60 * x**3)] for x in rng.random(n))
    texts = [(i, draw(int(rng.integers(1, 60)))) for i in range(300)] + [(300 + i, t) for i, t in enumerate(ODD)] + [(5, "w1 w2 w3"), (None, "w1 w2 w50")]
    items = [(i, draw(12)) for i in range(12)] + [(12, None), (13, "unseen terms only?"), (14, "w59"), (14, "WORDS words a")]
    table = docs(spark, [t for _, t in texts], ids=[i for i, _ in texts]).repartition(5)
    found = ranked_search.search(table, spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1)), 7, small_terms)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(texts, items, 7)


def test_ranked_search_without_rows(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs(spark, []), items).count() == 0 and ranked_search.search(docs(spark, [None, "", "zz"]), items).count() == 0
    assert ranked_search.search(docs(spark, ["a b"]), items.limit(0)).count() == 0


def plain_signature(text):
    k, codes = order_minhash.KMER, order_minhash.codes_of(text)
    hashes = [int(order_minhash.kmer_hashes(codes[i : i + k])[0]) for i in range(len(codes) - k + 1)] if len(codes) >= k else [int(h) for h in order_minhash.short_hash(codes)] if len(codes) else []
    seen, elements = Counter(), []
    for h in hashes:
        elements.append(int(mix(np.full(1, h, U64) + U64(seen[h]) * np.full(1, order_minhash._OCCURRENCE))[0]))
        seen[h] += 1
    out = []
    for s in range(order_minhash.SKETCHES):
        a, b = int(order_minhash.SEEDS[2 * s]), int(order_minhash.SEEDS[2 * s + 1])
        least = sorted((((x >> 32) * a ^ (x & 0xFFFFFFFF) * b) & 0xFFFFFFFF, p, x) for p, x in enumerate(elements))[: order_minhash.TUPLE]
        h = np.zeros(1, U64)
        for x in [x for _, _, x in sorted(least, key=lambda e: e[1])] + [0] * (order_minhash.TUPLE - len(least)):
            h = mix(h * order_minhash._TUPLE + U64(x))
        out.append(int(h[0]) >> 32)
    return out


def plain_fingerprints(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    hexed = lambda s: "".join(f"{v:08x}" for v in s)
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    for (i, text), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, nxt = text or "", nxt or ""
        edited = text[: len(text) - len(text) // 4] + nxt[: len(text) // 4]
        a, b, c = map(plain_signature, (text, edited, nxt))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c)))
    return out


@pytest.mark.parametrize("rows_a_bucket", [3, 1000])
def test_fingerprints_equal_brute_force(spark, rows_a_bucket):
    rng = np.random.default_rng(13)
    texts = ODD + ["".join("abcd"[k] for k in rng.integers(0, 4, int(n))) for n in rng.integers(0, 90, 25)] + ["ab" * 40, "short", "\U0001f600 emoji \U0001f601" * 4]
    ids = [int(x) for x in rng.permutation(len(texts)) * 7 - 40]
    found = order_minhash.fingerprints(docs(spark, texts, ids=ids).repartition(4), rows_a_bucket)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, found.select(*names).collect())) == plain_fingerprints(list(zip(ids, texts, strict=True)))


def test_fingerprints_on_odd_tables(spark):
    assert order_minhash.fingerprints(docs(spark, [])).count() == 0
    one = order_minhash.fingerprints(docs(spark, ["The only text of its table, its own next."])).first()
    assert one["near_next"] == 1 and one["n_chars"] == 41
    same = order_minhash.fingerprints(docs(spark, ["again and again the same text"] * 40, ids=[7] * 40), 2).collect()  # an id that is all bounds at once
    assert len(same) == 40 and {r["near_next"] for r in same} == {1.0} and len({r["edited_sha256"] for r in same}) == 1
    nulls = order_minhash.fingerprints(docs(spark, ["first text of them all", "second text of them all", None], ids=[None, 1, 2]), 1).collect()
    assert {(r["doc_id"], r["n_chars"]) for r in nulls} == {(None, 22), (1, 23), (2, 0)}
    part = [(i, f"text number {i} of a hot id") for i in range(30)]
    hot = order_minhash.fingerprints(docs(spark, [t for _, t in part], ids=[5 if i % 3 else i for i, _ in part]), 1)
    assert hot.count() == 30


def test_fingerprints_follow_edits(spark):
    rng = np.random.default_rng(14)
    text = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400))
    moved = text[1400:] + text[:1400]
    a, b, c = (np.array(plain_signature(t)) for t in (text, text[:600] + "some words changed here" + text[620:], moved))
    assert (a == b).mean() > 0.8 > (a == c).mean() + 0.1  # moved halves keep the k-mers, not their order
