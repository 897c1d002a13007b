import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm.common import docs, lower, rows, words

from epsforest.llm import near_dedup as nd
from epsforest.llm.textscan import U64, word_shingles


def brute(texts, size):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sets, [root(i) for i in range(len(texts))]


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "one", "a b c", "A B  C", "é É", "long " * 30_000]
    for _ in range(2):
        hub = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(70):
            t = list(hub)
            for _ in range(rng.randrange(8)):
                t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t))
        texts += [texts[-1]] * 5
    sets, comp = brute(texts, 4)
    got = rows(nd.near_duplicates(docs(spark, texts), 4))
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (comp[i] == i) for i in got)


def test_odd_rows(spark):
    x = docs(spark, ["a b c d e", "a b c d e", "a b c d e", None], ids=[7, 7, None, 3])
    got = nd.near_duplicates(x, 4).collect()
    assert len(got) == 4 and {(r["doc_id"], r["component_id"]) for r in got} == {(7, 7), (None, None), (3, 3)}
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in nd.keep_one(x).collect()) == [(False, 3), (False, 7), (True, None)]
    assert nd.near_duplicates(x.limit(0)).count() == 0 and nd.keep_one(x.limit(0)).count() == 0


def test_unlike_texts_of_one_doc_id_stay_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    texts, ids = [a + " x", a, b, b + " y", None, "", a], [3, 7, 7, 5, 7, 7, 7]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(docs(spark, texts, ids=ids), 4).collect())
    assert got == sorted([(3, 38, 3), (7, 37, 3), (7, 37, 5), (5, 38, 5), (7, 0, 7), (7, 0, 7), (7, 37, 3)])
    x = docs(spark, texts, ids=ids).withColumn("_doc", F.lit(1)).withColumn("_TEXT", F.lit("q")).withColumn("node", F.lit(None)).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    kept = nd.keep_one(x, 4)
    assert kept.columns == x.columns and sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(3, a + " x"), (5, b + " y"), (7, ""), (7, "")])
    both = docs(spark, [a, b, a], sources=["s", "t", "r"], ids=[7, 7, 7])  # unlike texts under one id, and a repeated row
    for order in (both, both.orderBy("source"), both.orderBy(F.desc("source"))):
        assert sorted((r["text"], r["source"]) for r in nd.keep_one(order.coalesce(1), 4).collect()) == [(a, "r"), (b, "t")]


def family(rng, n, changes=14, size=150):
    """Texts around one hub, not all similar to each other."""
    hub = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        t = list(hub)
        for _ in range(rng.randrange(changes)):
            t[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_large_open_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "OPEN", 8)
    monkeypatch.setattr(nd, "MEMBERS_A_BLOCK", 8)
    monkeypatch.setattr(nd, "MEMBERS_A_SALT", 8)
    rng = random.Random(11)
    texts = family(rng, 60) + family(rng, 60)
    boilerplate = " ".join(f"b{k}" for k in range(120))
    texts += [boilerplate + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(80)) for _ in range(60)]
    _, comp = brute(texts, 4)
    got = rows(nd.near_duplicates(docs(spark, texts), 4))
    assert [got[i]["component_id"] for i in range(len(texts))] == comp


def test_unlike_texts_with_boilerplate_make_few_rows(spark, monkeypatch):
    """What the block comparison reads grows with the texts and not with their pairs."""
    made = []
    plain = nd._blocks
    monkeypatch.setattr(nd, "_blocks", lambda rest: made.append(plain(rest).count()) or plain(rest))
    monkeypatch.setattr(nd, "OPEN", 32)
    boilerplate = " ".join(f"b{k}" for k in range(60))
    read = []
    for n in (400, 1600):
        rng = random.Random(n)
        made.clear()
        texts = [boilerplate + " " + " ".join(f"y{rng.randrange(10**7)}" for _ in range(100)) for _ in range(n)]
        assert nd.near_duplicates(docs(spark, texts), 4).where("kept").count() == n
        read.append(sum(made) / n)
    assert read[1] < 2 * read[0] + 2, read


def test_sketches_estimate(spark):
    rng = np.random.default_rng(0)
    for j in (0.7, 0.8, 0.95):
        n, shared = 500, round(2 * 500 * j / (1 + j))
        common = rng.integers(0, 2**63, shared).astype(U64)
        sets = [np.concatenate([common, rng.integers(0, 2**63, n - shared).astype(U64)]) for _ in range(2)]
        s = nd.odd_sketch(nd.samples(np.concatenate(sets), np.array([n, n]), nd.FINE[0]), nd.FINE[1])
        apart = int(np.bitwise_count(s[0] ^ s[1]).sum())
        estimate = 1 + nd.FINE[1] / (4 * nd.FINE[0]) * np.log(1 - 2 * apart / nd.FINE[1])
        assert abs(estimate - shared / (2 * n - shared)) < 0.05
        if j >= 0.8:
            assert apart <= nd.most_apart(80, nd.FINE, 5)


def test_shingles_of_short_texts():
    data = np.frombuffer(b"a b ca b ca  b c d", np.uint8)
    sets, sizes = word_shingles(data, np.array([0, 5, 10, 10, 18]), 4)
    assert sizes.tolist() == [1, 1, 0, 1] and sets[0] == sets[1] != sets[2]
