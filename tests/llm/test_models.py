"""Language identification, perplexity, prediction by partial matching."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.common import docs, lower, rows, words

from epsforest.llm import kneser_ney as kn
from epsforest.llm import language_id as li
from epsforest.llm import ppm


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in li.new_network(3).items()}
    windows, y = rng.integers(0, 256, (3, 7)), np.array([0, 1, 2])
    windows[1, 5:] = li.PAD
    _, grads = li.loss_and_gradients(net, windows, y)
    for k in net:
        at = (windows[0, 2], 3) if k[0] == "x" else tuple(0 for _ in net[k].shape)
        ends = []
        for e in (1e-3, -1e-3):
            moved = {n: v.copy() for n, v in net.items()}
            moved[k][at] += e
            ends.append(li.loss_and_gradients(moved, windows, y)[0])
        assert abs((ends[0] - ends[1]) / 2e-3 - grads[k][at]) < 1e-5


def test_fast_pass_equals_training_pass():
    net = li.new_network(3)
    texts = [b"abc", b"", b"x" * 200]
    buf, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    windows, _ = li.cut_windows(buf, offs)
    p = li.position_probabilities(net, windows)
    loss, _ = li.loss_and_gradients(net, windows, np.zeros(len(windows), int))
    real = (windows != li.PAD).T
    assert abs(-(np.log(p[:, 0]) * real).sum() / real.sum() - loss) < 1e-4
    pooled = li.pooled(net, buf, offs)
    assert np.allclose(pooled.sum(axis=1), [1, 0, 1], atol=1e-5)


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "üx", "erg"]}
    texts, langs = [], []
    for k in range(160):
        lang = "ab"[k % 2] * 2
        texts.append(" ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(30)))
        langs.append(lang if k % 10 else None)
    texts += [None, "", "12 34 !", "karl " * 3000]
    langs += ["aa", "aa", "bb", None]
    got = rows(li.identify(docs(spark, texts, langs)))
    assert all(got[160 + k]["lang_pred"] == "und" and got[160 + k]["score"] == 0 for k in range(3)) and got[163]["lang_pred"] != "und"
    held = [k for k in range(160) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (k in held) for k in range(160))
    assert np.mean([got[k]["lang_pred"] == "ab"[k % 2] * 2 for k in held]) >= 0.95
    none = rows(li.identify(docs(spark, ["abc", None], [None, None])))
    assert none[0]["lang_pred"] == "und" and li.identify(docs(spark, texts, langs).limit(0)).count() == 0


def test_many_languages_share_the_sample(spark, monkeypatch):
    langs = ["a"] * 1000 + ["b"] * 1000 + ["c"] * 60
    taken = {}
    monkeypatch.setattr(li, "PER_LANGUAGE", 60)
    monkeypatch.setattr(li, "MOST_SAMPLED", 60)
    monkeypatch.setattr(li, "train", lambda windows, y, n: taken.update(collections.Counter(y.tolist())))
    li.fit(docs(spark, ["some words"] * len(langs), langs=langs))
    assert all(8 <= taken.get(k, 0) <= 40 for k in range(3)), taken


def test_weighed_gradients_equal_the_plain_ones():
    rng = np.random.default_rng(1)
    net, windows, y = li.new_network(3), rng.integers(0, 256, (9, 12)), rng.integers(0, 3, 9)
    windows[2, 5:] = li.PAD
    want, got = li.loss_and_gradients(net, windows, y)[1], li.gradients(net, windows, y, np.ones(9))
    assert sorted(want) == sorted(got)
    for k in want:
        assert np.allclose(want[k], got[k], rtol=1e-3, atol=1e-6), k


def test_all_whole_texts_train_the_network_of_the_pipeline(spark, monkeypatch):
    """More texts than the sample takes, and longer ones; what is learnt of them holds for texts that were not trained on."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("ab", "ba") if k % 2 else ("xy", "yx")) for _ in range(rng.randrange(20, 400))) for k in range(300)] + ["12 34", None]
    windows, gradients = spark.sparkContext.accumulator(0), li.gradients
    monkeypatch.setattr(li, "PER_LANGUAGE", 5)
    monkeypatch.setattr(li, "SHARE", 1 << 14)

    def counted(net, some, y, weight):
        windows.add(len(some))
        return gradients(net, some, y, weight)

    monkeypatch.setattr(li, "gradients", counted)
    x = docs(spark, texts, [("one", "two")[k % 2] for k in range(302)])
    monkeypatch.setattr(li, "STEPS", li.ROUNDS)  # no text is gone through twice
    assert li.keep_identified(x).count() == 300
    assert windows.value == sum(-(-len(t) // li.WINDOW) for t in texts[:300])
    monkeypatch.setattr(li, "STEPS", 60)
    net, languages = li.fit_all(x, held=2)
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2]
    buf = "".join(texts[k] for k in held).encode()
    offs = np.concatenate([[0], np.cumsum([len(texts[k]) for k in held])])
    right = li.pooled(net, np.frombuffer(buf, np.uint8), offs).argmax(axis=1) == np.array(held) % 2
    assert languages == ["one", "two"] and right.mean() >= 0.98


def plain_kneser_ney(train, text):
    """Probabilities by their textbook definition, from counts in dictionaries."""
    c3 = collections.Counter()
    for t in train:
        s = ["<", "<", *words(t), ">"]
        c3.update(tuple(s[i : i + 3]) for i in range(len(s) - 2))
    c2 = collections.Counter((v, w) for _, v, w in c3)
    c1 = collections.Counter(w for _, w in c2)

    def discount(c):
        n = collections.Counter(min(x, 5) for x in c.values())
        if not n[1] or not n[2]:
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.0 for k in (1, 2, 3)]
        return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]

    d3, d2, d1 = map(discount, (c3, c2, c1))
    off = lambda d, n: d[min(n, 3) - 1]

    def p1(w):
        total = sum(c1.values())
        gamma = sum(off(d1, n) for n in c1.values()) / total
        return (max(c1[w] - off(d1, c1[w]), 0) / total if c1[w] else 0) + gamma / (len(c1) + 1)

    def level(c, d, context, w, lower_p):
        own = [n for g, n in c.items() if g[:-1] == context]
        if not own:
            return lower_p
        n = c[(*context, w)]
        return ((n - off(d, n)) / sum(own) if n else 0) + sum(off(d, x) for x in own) / sum(own) * lower_p

    s, total = ["<", "<", *words(text), ">"], 0.0
    for i in range(2, len(s)):
        u, v, w = s[i - 2 : i + 1]
        total += math.log10(level(c3, d3, (u, v), w, level(c2, d2, (v,), w, p1(w))))
    return total


def test_perplexity_equals_the_definition(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    for t in [*texts[:5], "a z a", "", "q"]:
        data = np.frombuffer(t.encode(), np.uint8)
        got, n = kn.log_probabilities(model, data, np.array([0, len(data)]))
        assert n[0] == len(words(t)) + 1 and got[0] == pytest.approx(plain_kneser_ney(texts, t), rel=1e-4)


@pytest.mark.parametrize("head, bucket", [(1 << 20, 1 << 19), (64, 256)])
def test_all_trusted_texts_train(spark, monkeypatch, head, bucket):
    """More trusted texts than a model once took; weights that are broadcast, and ones that are met in buckets of several parts."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))) + f" own{k}" for k in range(4400)]
    half = lambda k: hashlib.md5(str(k).encode()).hexdigest()[-1] in "01234567"
    train = [t for k, t in enumerate(texts) if half(k)]
    assert len(train) > 2000
    monkeypatch.setattr(kn, "HEAD", head)
    monkeypatch.setattr(kn, "BUCKET", bucket)
    monkeypatch.setattr(kn, "MOST_WORDS", head)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    texts += ["w1 w2 never w3 w4", texts[1] + " " + texts[2], None]
    got = rows(kn.classify(docs(spark, texts), labels))
    for k in (*range(24), 4400, 4401, 4402):
        assert got[k]["log10_prob"] == pytest.approx(plain_kneser_ney(train, texts[k] or ""), rel=1e-4), k


def test_junk_is_rejected(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    good = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(200)]
    junk = [" ".join(f"#{rng.random()}" for _ in range(40)) for _ in range(10)]
    x = docs(spark, good + junk + [None, ""])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)] + [(k, 0, 0) for k in range(200, 210)] + [(5, 1, None), (999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(kn.classify(x, labels))
    assert sum(got[k]["kept"] for k in range(200)) >= 195 and not any(got[k]["kept"] for k in range(200, 212))
    assert kn.keep_good(x, labels).columns == x.columns
    free = rows(kn.classify(x, labels.limit(0)))
    assert all(free[k]["kept"] for k in range(210)) and not free[210]["kept"]
    assert kn.classify(x.limit(0), labels).count() == 0


def test_trusted_texts_are_taken_whole_and_by_row(spark, monkeypatch):
    long = " ".join(f"l{k}" for k in range(60_000))  # above 160,000 characters
    x = docs(spark, [long, "b one", "b one", "b two", "c", None], ids=[1, 2, 2, 2, 3, 4])
    good = spark.createDataFrame([(k,) for k in (*range(-50, 0), 1, 2, 4)], "_t long")  # most are absent
    monkeypatch.setattr(kn, "_half", lambda c: F.lit(True))
    assert sorted(r["text"] for r in kn.sample(x, good, 10).collect()) == sorted([long, "b one", "b two"])
    assert kn.sample(x, good, 1).count() == 1
    monkeypatch.setattr(kn, "TRUSTED_CHARS", 8)
    assert kn.sample(x, good, 10).count() == 1  # the long one is passed over, another fits


def test_thresholds_equal_a_plain_version(spark):
    rng = random.Random(9)
    words_ = {"aa": [f"w{k}" for k in range(40)], "bb": [f"v{k}" for k in range(400)]}
    langs = [rng.choice(["aa", "aa", "bb", None]) for _ in range(500)]
    texts = [" ".join(rng.choice(words_[x or "aa"]) for _ in range(rng.randrange(5, 40))) for x in langs]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 500, 2)] + [(k, 0, 1) for k in range(1, 100, 2)], "doc_id long, quality int, toxic int")
    got = rows(kn.classify(docs(spark, texts, langs), labels, quantile=0.9))
    half = lambda k: hashlib.md5(str(k).encode()).hexdigest()[-1] in "01234567"
    cost = {k: -got[k]["log10_prob"] / got[k]["n_tokens"] for k in got}
    bins = {k: math.ceil(cost[k] / kn.BIN) for k in range(0, 500, 2) if not half(k)}

    def limit(values):
        values = sorted(values)
        return values[math.ceil(0.9 * len(values) - 1e-9) - 1] * kn.BIN

    for lang in ("aa", "bb", None):
        own = [b for k, b in bins.items() if langs[k] == lang]
        want = limit(own) if len(own) >= kn.LEAST_CALIBRATION else limit(bins.values())
        for k in (k for k in got if langs[k] == lang):
            assert math.log10(got[k]["threshold"]) == pytest.approx(want) and got[k]["kept"] == (cost[k] <= want)


CLASH = ["_k", "_l", "_t", "_bad", "_kept", "_h", "_p", "_b", "_s", "_tokens", "_LOG10", "_limit", "_lang", "_letters", "_doc", "_text", "u", "p", "rank", "part", "words", "size", "score"]


def test_stages_keep_columns_and_rows_whatever_their_names(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) + str(rng.randrange(30)) for _ in range(30))
    same = text()
    texts = [text() for _ in range(40)] + [None, "", "12 34", same, same, "\u0001 junk#" * 40]
    x = docs(spark, texts, langs=["en"] * 44 + [None, "de"], ids=[*range(43), 43, 43, None])
    for k, name in enumerate(CLASH):
        x = x.withColumn(name, F.lit(None).cast("int") if k % 2 else F.lit("x"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    good = kn.keep_good(x, labels)
    known = li.keep_identified(x)
    for y in (good, known):
        assert y.dtypes == x.dtypes and y.exceptAll(x).count() == 0
    assert good.where("doc_id = 43").count() == 2 and good.where("text is null or text = ''").count() == 0
    assert known.where("doc_id = 43").count() == 2 and known.where("doc_id in (40, 41, 42)").count() == 0 and known.where("doc_id < 40").count() == 40
    assert kn.keep_good(x.limit(0), labels).count() == 0 and li.keep_identified(x.limit(0)).count() == 0


def plain_language(net, languages, data):
    """One text, window by window and byte by byte."""
    total = np.zeros(len(languages))
    sig = lambda a: 1 / (1 + np.exp(-a))
    H = li.HIDDEN
    for lo in range(0, len(data), li.WINDOW):
        part, logits = data[lo : lo + li.WINDOW], 0
        for d in "fb":
            h, out = np.zeros(H), [None] * len(part)
            padded = list(part) + [li.PAD] * (li.WINDOW - len(part))
            for i in range(li.WINDOW) if d == "f" else range(li.WINDOW - 1, -1, -1):
                gx, gh = net["x" + d][padded[i]].astype(float), h @ net["u" + d].astype(float)
                r, z = sig(gx[:H] + gh[:H]), sig(gx[H : 2 * H] + gh[H : 2 * H])
                h = (1 - z) * np.tanh(gx[2 * H :] + r * gh[2 * H :]) + z * h
                if i < len(part):
                    out[i] = h @ net["o" + d]
            logits = logits + np.array(out)
        e = np.exp(logits + net["bias"])
        total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
    return total / len(data)


def test_identify_equals_a_plain_network(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(1, 150))) + "x" for _ in range(40)]
    x = docs(spark, texts, ["aa" if k % 2 else "bb" for k in range(40)])
    net, languages = li.fit(x)
    got = rows(li.identify(x))
    for k, t in enumerate(texts):
        p = plain_language(net, languages, t.encode())
        assert got[k]["score"] == pytest.approx(p.max(), abs=1e-4)
        assert got[k]["lang_pred"] == languages[int(p.argmax())] or abs(p[0] - p[1]) < 1e-4


def test_rare_languages_keep_their_sample(spark, monkeypatch):
    """Many languages, some rare, and rows that repeat a doc_id: no language is cut for another's sake."""
    langs = [f"l{k % 38:02d}" for k in range(38 * 30)] + ["rare1"] * 9 + ["rare2"] * 9
    ids = [5] * 300 + list(range(300, len(langs)))
    taken = {}
    monkeypatch.setattr(li, "MOST_SAMPLED", 400)
    monkeypatch.setattr(li, "train", lambda windows, y, n: taken.update(collections.Counter(y.tolist())))
    li.fit(docs(spark, ["some words"] * len(langs), langs=langs, ids=ids))
    assert all(taken.get(k, 0) >= 1 for k in range(40)) and max(taken.values()) <= 20, taken


def plain_probability(counts, history, symbol, excluded=frozenset()):
    """Escapes from context to context, the textbook way; counts: those of each context."""
    seen = {s: n for s, n in counts.get(history, {}).items() if s not in excluded}
    total, distinct = sum(seen.values()), len(seen)
    if symbol in seen:
        return seen[symbol] / (total + distinct)
    escape = distinct / (total + distinct) if distinct else 1.0
    gone = excluded | seen.keys()
    if not history:
        return escape / (256 - len(gone))
    return escape * plain_probability(counts, history[1:], symbol, gone)


def plain_code(counts, text, learn=False):
    data, total = b"\xff" * 4 + text + b"\xff", 0.0
    for i in range(4, len(data)):
        total += math.log10(plain_probability(counts, data[i - 4 : i], data[i]))
        for k in range(5) if learn else ():
            counts.setdefault(data[i - k : i], collections.Counter())[data[i]] += 1
    return total


def counted(texts):
    out = {}
    for t in texts:
        data = b"\xff" * 4 + lower(t).encode() + b"\xff"
        for i in range(4, len(data)):
            for k in range(5):
                out.setdefault(data[i - k : i], collections.Counter())[data[i]] += 1
    return {c: s for c, s in out.items() if not c or sum(s.values()) >= ppm.LEAST}


def test_ppm_equals_plain_contexts(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "Été " * 5] + ["".join(rng.choice("ab c") for _ in range(rng.randrange(60))) for _ in range(80)]
    held = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 == 1]
    for k in held[:9]:
        texts[k] = "hotword unseen " * 30  # frequent in scored texts only: split keys
    monkeypatch.setattr(ppm, "ROWS_A_KEY", 16)
    monkeypatch.setattr(ppm, "HEAD", 8)
    got = rows(ppm.score_documents(docs(spark, texts)))
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1]
    counts, base = counted(train), collections.Counter()
    for t in train:
        base.update([*words(lower(t)), None])
    total, v = sum(base.values()), len(base)
    for k, t in enumerate(texts):
        tokens = [*words(lower(t)), None]
        assert got[k]["score"] == pytest.approx(plain_code(counts, lower(t).encode()), rel=1e-4)
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((base[w] + 0.5) / (total + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(tokens), sum(base[w] > 0 for w in tokens), total)
    for history in (b"\xff" * 4, b"ab c", b"zzzz"):
        assert sum(plain_probability(counts, history, s) for s in range(256)) == pytest.approx(1, abs=1e-9)
    assert ppm.score_documents(docs(spark, texts).limit(0)).count() == 0


def test_ppm_keeps_rare_contexts_of_a_large_corpus(spark, monkeypatch):
    rare = ["qzjkwv xqvkj", "qzjkwv xqvkj", "qzjkwv xqvkj zzz", "vkjq\u00e9"]
    texts = rare * 2 + ["".join("abc d"[(i * i + k) % 5] for i in range(40_000)) for k in range(12)]
    counts = counted(t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1)
    assert sum(counts[b""].values()) > 200_000
    for head in (1 << 20, 40, 0):  # all grams broadcast, some, none
        monkeypatch.setattr(ppm, "HEAD", max(head, 1))
        got = rows(ppm.score_documents(docs(spark, texts)))
        for k, t in enumerate(texts[: len(rare) * 2]):
            assert got[k]["score"] == pytest.approx(plain_code(counts, t.encode()), rel=1e-6)


def test_adaptive_coding_learns(spark):
    texts = ["abcd" * 50, "abcd", None, "Not so even, a text"]
    got = rows(ppm.score_adaptive(docs(spark, texts)))
    for k, t in enumerate(texts):
        assert got[k]["score"] == pytest.approx(plain_code({}, lower(t).encode(), True), rel=1e-9)
    assert got[0]["score"] / 200 > got[1]["score"] / 4 / 3 and got[2]["score"] < 0


def test_held_out_languages_of_the_given_documents(spark):
    x = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    got = li.identify(x).join(x.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    by = collections.Counter(r["lang"] for r in got)
    right = collections.Counter(r["lang"] for r in got if r["lang"] == r["lang_pred"])
    assert len(by) == 4 and all(right[k] >= 0.98 * n for k, n in by.items()), (by, right)


def test_sums_of_equal_texts_and_rows_of_meeting_weights(spark, monkeypatch):
    """Weights that are not broadcast: copies of a text get the text's own sum, and what buckets add is packed, not a row for each document and bucket."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(12)) for _ in range(60)]
    texts += [texts[3]] * 25 + [None, ""]
    monkeypatch.setattr(kn, "HEAD", 8)
    monkeypatch.setattr(kn, "BUCKET", 64)
    made, meet = spark.sparkContext.accumulator(0), kn.meet

    def counted(uses, table):
        out = meet(uses, table)
        made.add(len(out))
        return out

    monkeypatch.setattr(kn, "meet", counted)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    half = lambda k: hashlib.md5(str(k).encode()).hexdigest()[-1] in "01234567"
    train = [t for k, t in enumerate(texts[:60]) if half(k)]
    got = rows(kn.classify(docs(spark, texts).coalesce(1), labels))
    for k in (3, 4, 60, 84, 85, 86):
        assert got[k]["log10_prob"] == pytest.approx(plain_kneser_ney(train, texts[k] or ""), rel=1e-4), k
    assert len(got) == 87 and 0 < made.value < 500  # at most a row for each bucket and pack, and one for each pack's ids


def test_bigrams_go_as_packs_grow(spark, monkeypatch):
    """While trigrams are packed by their contexts, the bigrams of past rounds are no longer on disk, and a trigram takes few bytes."""
    rng = random.Random(8)
    texts = [" ".join(f"w{int(300 * rng.random() ** 3)}" for _ in range(200)) for _ in range(400)]
    cut_by, left, packed = kn.cut_by, [], []
    size = lambda table: sum(os.path.getsize(f.removeprefix("file://")) for f in table.inputFiles())

    def watched(df, name, column, n):
        out = cut_by(df, name, column, n)
        if name == "weighed":
            left.extend({os.path.dirname(f.removeprefix("file://")) for x in out for f in x.inputFiles()})
        if name == "packs":
            packed.append((sum(map(os.path.isdir, left)), sum(map(size, out))))
        return out

    monkeypatch.setattr(kn, "cut_by", watched)
    model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [n for n, _ in packed] == [4, 3, 2, 1]
    s = [["<", "<", *words(t), ">"] for t in texts]
    grams = [len({tuple(x[i : i + n]) for x in s for i in range(len(x) - n + 1)}) for n in (2, 3)]
    assert sum(b for _, b in packed) < 13 * grams[0] + 17 * grams[1]
    data = np.frombuffer(texts[0][:30].encode(), np.uint8)
    assert kn.log_probabilities(model, data, np.array([0, len(data)]))[0][0] == pytest.approx(plain_kneser_ney(texts, texts[0][:30]), rel=1e-4)


def test_no_texts_beside_scores_and_no_row_for_each_weight(spark, monkeypatch):
    """The quality stage writes no text but the trusted ones, Python gets small batches, and weights are packed; verdicts are by text and language."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(30)) for _ in range(80)] + [" ".join(f"#{rng.random()}" for _ in range(30))] * 2 + [None]
    cut, seen = kn.cut, []

    def watched(df, name="cut", by=None):
        out = cut(df, name, by)
        seen.append((name, out.columns, out.count(), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)))
        return out

    monkeypatch.setattr(kn, "cut", watched)
    monkeypatch.setattr(kn, "HEAD", 8)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    x = docs(spark, texts)
    good = {r["doc_id"] for r in kn.keep_good(x, labels).collect()}
    assert not good & {80, 81, 82} and len(good) >= 75
    assert [name for name, columns, *_ in seen if "text" in columns] == ["trusted"]
    assert sum(n for name, _, n, _ in seen if name == "weights") < 100  # of some thousand n-grams
    assert any(b == "4m" for name, *_, b in seen if name == "weights")


def test_hashes_of_words_whatever_their_place():
    some = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"\x01" * 16, b"\x01" * 17, b"x" * 64, b"x" * 65, b"x" * 200, b"\x01\x00"]
    ends = np.cumsum([len(x) + 1 for x in some]) - 1
    got = [kn.word_hashes(np.frombuffer(b"q" * k + b" ".join(some), np.uint8), ends - [len(x) for x in some] + k, ends + k) for k in range(9)]
    assert all((x == got[0]).all() for x in got) and len(set(got[0].tolist())) == len(some)
