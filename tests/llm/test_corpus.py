"""Chat trees, decontamination, mixing, the pipeline, and the registered queries against DuckDB."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.common import docs, rows, words

import __spark_entry__ as entry
from epsforest.llm import chat_tree as ct
from epsforest.llm import decontaminate as dc
from epsforest.llm import license_scan, mixing, quality_rules, queries


def chats(spark, rows_):
    return spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    rng = random.Random(1)
    odd = ["<|im_end|>", "\\", "<\\|", "a\nb", "", None, "<|im_start|>user\nx<|im_end|>\n", "é😀", "\\n<|"]
    data = []
    for conv in range(60):
        opening = rng.randrange(3)
        turns = [(k, ("user", "assistant")[k % 2], odd[(opening + k) % 9] if k < 3 else rng.choice(odd)) for k in range(rng.randrange(1, 7))]
        data += [(conv, *t) for t in turns]
    data += [(100, 0, "we\nird\\n<|", "x"), (101, 0, None, None), (None, 0, "user", "n"), (102, 0, "user", "r"), (102, 0, "user", "r")]
    packs = ct.pack_conversations(chats(spark, data), size=300)
    got = rows(ct.read_back(packs), "conv_id")
    want = {}
    for conv, turn, role, text in sorted(data, key=lambda r: (r[0] is not None, r[0], r[1], r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["loss_chars"]) == (len(turns), len(loss))
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert x["formatted_chars"] == sum(len(ct.segment(r, t)[0]) for r, t in turns)
    assert ct.read_back(ct.pack_conversations(chats(spark, data).limit(0))).count() == 0


def test_shared_turns_are_emitted_once(spark):
    data = [(c, t, "user", f"{t if t < 2 else (t, c)}") for c in range(20) for t in range(4)]
    packs = ct.pack_conversations(chats(spark, data).coalesce(1)).collect()
    nodes = [r for r in packs if not r["leaf"]]
    packs_used = len({r["pack"] for r in packs})
    assert len(nodes) <= 2 * packs_used + 40 and sum(r["leaf"] for r in packs) == 20
    by = {(r["pack"], r["node"]): r for r in nodes}
    for r in nodes:
        up, seen, position = r, set(), 0
        while up["parent"] is not None:
            up = by[(r["pack"], up["parent"])]
            seen |= set(range(up["start"], up["start"] + len(up["segment"])))
            position += len(up["segment"])
        assert seen == {k for x in r["attends"] for k in range(x["lo"], x["hi"])} and r["position"] == position


def plain_matches(texts, items, percent=80):
    tokens = lambda t: dc_words(t)
    out = {}
    for d, t in enumerate(texts):
        for i, item in items:
            a, b = tokens(t), tokens(item)
            if not b:
                continue
            gram = lambda x: [tuple(x[k : k + 5]) for k in range(len(x) - 4)] or [tuple(x)]
            g, best = gram(b), None
            for s in range(len(a) - len(b) + 1):
                h = gram(a[s : s + len(b)])
                both = sum(min(g.count(x), h.count(x)) for x in set(g))
                if 100 * both >= percent * (2 * len(g) - both) and (best is None or both > best[1]):
                    best = (s, both)
            if best:
                out[(d, i)] = best
    return out


def dc_words(t):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(15, 60)))) for k in range(12)]
    items += [(50, "Only Three words"), (51, "dup dup dup dup dup dup dup dup"), (52, None), (53, "")]
    texts = [None, "", "x"]
    for k in range(60):
        t = [word() for _ in range(rng.randrange(5, 200))]
        if k % 2:
            passage = dc_words(items[rng.randrange(12)][1])
            kind = rng.randrange(4)
            if kind == 1:
                passage[len(passage) // 2] = "changed"
            if kind == 2:
                del passage[len(passage) // 3]
            if kind == 3:
                passage = passage[2:]
            at = rng.randrange(len(t))
            t[at:at] = passage
        texts.append(" ".join(t).upper() if k % 5 == 0 else ", ".join(t))
    texts += ["say only, three; words now", "dup " * 9, texts[4], "é " * 20_000 + items[0][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["shared"]) for r in dc.matches(docs(spark, texts), bench).collect()}
    want = plain_matches(texts[:-1], items)
    want[(len(texts) - 1, 0)] = (20_000, len(dc_words(items[0][1])) - 4)
    assert got == want
    x = docs(spark, texts)
    clean = dc.keep_clean(x, bench)
    assert clean.columns == x.columns and clean.count() == len(texts) - len({d for d, _ in want})
    assert dc.matches(x, bench.limit(0)).count() == 0 and dc.matches(x.limit(0), bench).count() == 0


def test_decontamination_of_cut_and_reordered_items(spark):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(5000)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 59, 15, 45))]
    a, b, _, d = (dc_words(t) for _, t in items)
    other = [word() for _ in range(60)]
    texts = [a[4:] + other, other + a[:-4], b[29:] + b[:29], other + b[30:] + b[:30] + other, d[3:] + other, other, a[4:20] + other + a[20:]]
    texts = [" ".join(t) for t in texts]
    want = plain_matches(texts, items)
    assert {(0, 0), (1, 0), (2, 1), (3, 1), (4, 3)} == set(want)
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["shared"]) for r in dc.matches(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_decontamination_of_texts_shorter_than_an_item(spark):
    rng = random.Random(4)
    words_ = [[f"v{rng.randrange(5000)}" for _ in range(n)] for n in (50, 60, 12)]
    a, b, c = words_
    texts = [a[:-1], a[1:], a[:45], b[:20] + b[21:], c[:11], c[1:], a[:30], b[:48], ["other"] * 20]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words_)], "item_id long, text string")
    x = docs(spark, [" ".join(t) for t in texts])
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["shared"], round(r["similarity"], 9)) for r in dc.matches(x, bench).collect()}
    one = lambda shared, size, own: (0, size + 4, shared, round(shared / (size + own - shared), 9))
    assert got == {(0, 0): one(45, 45, 46), (1, 0): one(45, 45, 46), (2, 0): one(41, 41, 46), (3, 1): one(51, 55, 56), (4, 2): one(7, 7, 8), (5, 2): one(7, 7, 8)}
    assert sorted(r["doc_id"] for r in dc.keep_clean(x, bench).collect()) == [6, 7, 8]


def test_decontamination_of_long_items_and_clashing_columns(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(4000)}"
    item = [word() for _ in range(20_000)]
    changed = item[:]
    for k in range(0, 20_000, 500):
        changed[k] = "changed"
    other = [word() for _ in range(300)]
    texts = [other + changed + other, other, item[:9_000], item[:18_500], ["dup"] * 3_000, item[:40] * 30]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[:40])), (9, "dup " * 40)], "item_id long, text string").withColumns({"row": F.lit(1), "w": F.lit(2), "gram": F.lit(3)})
    x = docs(spark, [" ".join(t) for t in texts] * 2, ids=list(range(12))).withColumns({"row": F.lit(1), "n": F.lit(2), "p": F.lit(3), "k": F.lit(4), "words_": F.lit(5), "at": F.lit(6)})
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["shared"]) for r in dc.matches(x, bench).collect()}
    lost = 5 * 40 - 4  # shingles with a changed word, of which the first is in one only
    want = {(0, 7): (300, 19_996 - lost), (3, 7): (0, 18_496), (4, 9): (0, 36), (5, 8): (0, 36)}
    want |= {(d, 8): (0, 36) for d in (2, 3)}
    assert got == {(d + k, i): v for (d, i), v in want.items() for k in (0, 6)} | {(d, 8): got[d, 8] for d in (0, 6)}
    clean = dc.keep_clean(x, bench)
    assert clean.columns == x.columns and sorted(r["doc_id"] for r in clean.select("doc_id").collect()) == [1, 7]


def test_multi_index_finds_the_whole_ball():
    rng = random.Random(0)
    width = 64 // dc.BLOCKS
    for _ in range(300):
        x, y = rng.getrandbits(63), 0
        for b in rng.sample(range(63), rng.randrange(dc.RADIUS + 1)):
            y |= 1 << b
        assert any(((y >> width * k) & ((1 << width) - 1)).bit_count() <= dc.RADIUS // dc.BLOCKS for k in range(dc.BLOCKS)), x


def test_items_and_documents_that_share_an_id(spark):
    rng = random.Random(14)
    word = lambda: f"v{rng.randrange(5000)}"
    a, b, c = ([word() for _ in range(n)] for n in (30, 45, 60))
    bench = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, None), (None, "some other item of seven words")], "item_id long, text string")
    x = docs(spark, [" ".join(t) for t in (c + a, c, c + b[:-1] + c, a + b, c)], ids=[7, 7, None, 8, None])
    got = sorted(((r["doc_id"] or -1, r["item_id"], r["start_word"], r["n_words"]) for r in dc.matches(x, bench).collect()))
    assert got == [(-1, 1, 59, 45), (7, 1, 60, 30), (8, 1, 30, 45)]
    for name in ("_text_key", "_BAD", "doc", "w", "h", "words", "start"):
        x = x.withColumn(name, F.lit("clash"))
    clean = dc.keep_clean(x, bench)
    assert clean.columns == x.columns and sorted((r["doc_id"] or -1) for r in clean.collect()) == [-1, 7]


def test_bitmap_has_no_false_negatives(spark):
    grams = spark.range(5000).select(F.xxhash64("id").alias("gram"))
    others = spark.range(5000, 25_000).select(F.xxhash64("id").alias("gram"))
    words = dc.cut(dc.bitmap(grams, 1 << 18), "words")
    hits = lambda x: x.withColumn("words", words.scalar()).withColumn("ok", dc._in("words", F.col("gram"), 1 << 18)).where("ok").count()
    assert hits(grams) == 5000 and hits(others) < 100


def test_simhash_counts_every_word(spark):
    rng = random.Random(5)
    for n in (1, 2, 63, 1000, 70_000):
        few = [rng.randrange(-(2**63), 2**63) for _ in range(min(n, 1000))]
        h = [few[k % len(few)] for k in range(n)]
        got = dc.with_simhash(spark.createDataFrame([(h,)], "h array<long>"), "h", "fp").first()["fp"]
        assert got == sum((2 * sum(x >> b & 1 for x in h) > n) << b for b in range(63))


def test_recall_of_the_radius_on_edited_windows(spark):
    """Items with one run replaced at the start, inside or at the end, as far as the similarity allows."""
    rng = random.Random(21)
    word = lambda: f"v{rng.randrange(20_000)}"
    items = [[word() for _ in range((20, 60, 150)[k % 3])] for k in range(90)]
    texts = []
    for k, w in enumerate(items):
        lost = (len(w) - 4) // 9 - 4 * (k // 3 % 3 == 1)  # shingles of a run inside also cover four words before it
        at = (0, len(w) // 2, len(w) - max(lost, 0))[k // 3 % 3]
        t = list(w)
        t[at : at + max(lost, 0)] = [word() for _ in range(max(lost, 0))]
        texts.append(" ".join([word() for _ in range(30)] + t + [word() for _ in range(30)]))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.matches(docs(spark, texts), bench).collect()}
    assert got <= {(k, k) for k in range(90)} and len(got) >= 88


def test_radius_spares_windows_cut_at_one_end():
    rng = random.Random(1)
    majority = lambda h: [2 * sum(x >> b & 1 for x in h) > len(h) for b in range(63)]
    for _ in range(500):
        a = [rng.getrandbits(63) for _ in range(59)]
        x, y = majority(a), majority(a[6:] + [rng.getrandbits(63) for _ in range(6)])
        assert sum(p != q for p, q in zip(x, y, strict=True)) <= dc.RADIUS


def dense_rates(size, source, target, x, most=2):
    """The dual's solution by plain gradient and full Newton steps over all multipliers at once."""
    names = [s for s in target if 0 < target[s] < most * sum(n for n, t in zip(size, source, strict=True) if t == s)]
    full = np.array([target[s] > 0 and s not in names for s in source])
    size, n, k = np.array(size, float), len(size), x.shape[1]
    features = np.concatenate([np.array([[float(s == name) for name in names] for s in source]).reshape(n, -1), x], axis=1)
    goal = np.concatenate([[target[s] for s in names], np.zeros(k)])
    ridge = np.concatenate([np.zeros(len(names)), np.full(k, mixing.RIDGE * sum(target.values()))])
    m = np.zeros(len(goal))
    live = np.array([target[s] > 0 for s in source])

    def parts(m):
        tilt = features @ m
        rate = np.where(full, most, np.minimum(most, np.exp(np.minimum(tilt, 50)))) * live
        value = np.where(tilt < np.log(most), np.exp(np.minimum(tilt, 50)), most * (1 + tilt - np.log(most)))
        value = np.where(full, most * (x @ m[len(names) :]), value) * live
        return rate, size @ value - m @ goal + ridge @ (m * m) / 2, features.T @ (size * rate) - goal + ridge * m, size * rate * (rate < most) * ~full

    for _ in range(400):
        rate, value, slope, bend = parts(m)
        move = np.linalg.solve(features.T @ (bend[:, None] * features) + np.diag(ridge + 1e-12), -slope)
        part = 1.0
        while parts(m + part * move)[1] > value + 1e-9 * abs(value) and part > 1e-12:
            part /= 2
        m = m + part * move
    return parts(m)[0]


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    texts = [None, "", *(" ".join("w" * 1 for _ in range(rng.randrange(1, 60) * (1 + 9 * (k % 3 == 0)))) for k in range(600))]
    sources = [None if k % 17 == 0 else f"s{min(k % 9, 4)}" for k in range(602)]
    out = mixing.mix(docs(spark, texts, sources=sources))
    got = rows(out)
    size = {k: len(words(t)) for k, t in enumerate(texts)}
    names = sorted({s for s in sources if s is not None}) + [None]
    by = {s: sum(size[k] for k in size if sources[k] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, full = {}, set()
    while True:
        level = (1.5 * sum(by.values()) - sum(2 * by[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level >= 2 * by[s]}
        if not more:
            break
        full |= more
    for s in names:
        want[s] = 2 * by[s] if s in full else weight[s] * level
    sizes = np.array([size[k] for k in range(602)], float)
    x = np.stack([np.log1p(sizes), np.log1p(sizes) ** 2], axis=1)
    mean = (sizes @ x) / sizes.sum()
    x = (x - mean) / np.sqrt((sizes @ x**2) / sizes.sum() - mean**2)
    rate = dense_rates(sizes, sources, want, x)
    assert full and len({round(r, 3) for r, s in zip(rate, sources, strict=True) if s == "s4"}) > 20  # tilts differ inside a source
    for s in names:
        own = [k for k in size if sources[k] == s]
        assert abs(sum(got[k]["rate"] * size[k] for k in own) / want[s] - 1) < 1e-5
        assert abs(sum(got[k]["taken"] for k in own) - want[s]) <= max(5, mixing.LEFT * want[s])
        for k in own:
            assert got[k]["target"] == pytest.approx(want[s]) and got[k]["size"] == size[k] and got[k]["taken"] <= 2 * size[k]
            assert got[k]["rate"] == pytest.approx(rate[k], abs=2e-5), (k, s)
            assert got[k]["copies"] - got[k]["rate"] < 1.0001 or size[k] <= mixing.LEFT * want[s]
    profile = lambda r: (sizes * r) @ x / (sizes @ r)
    flat = np.array([want[s] / by[s] for s in sources])
    tilted = np.array([got[k]["rate"] for k in range(602)])
    assert np.abs(profile(tilted)).max() < 0.2 * np.abs(profile(flat)).max()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, mixing.mix(docs(spark, texts, sources=sources).repartition(7)).collect()), key=repr)
    assert mixing.mix(docs(spark, texts).limit(0)).count() == 0
    zero = mixing.mix(docs(spark, [None, ""])).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 and r["rate"] == 0 for r in zero)


def test_mixing_comes_nearest_to_its_target(spark):
    sizes = {"a": [40_000, 40_003], "b": [30, 50, 7] * 400, "c": [9_000, 11_000, 3], "d": [0, 0]}
    rows = [("w " * n, s) for s, own in sizes.items() for n in own]
    got = mixing.mix(docs(spark, [t for t, _ in rows], sources=[s for _, s in rows])).collect()
    for s, own in sizes.items():
        mine = [r for r in got if r["source"] == s]
        off = sum(r["taken"] for r in mine) - mine[0]["target"]
        assert all(r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in mine) and len(mine) == len(own)
        assert all(abs(off + r["size"]) >= abs(off) for r in mine if r["copies"] < 2), s  # no copy more is nearer


def test_source_targets_against_sql(spark, tmp_path):
    docs(spark, ["w " * n for n in (5, 900, 40, 3, 0, 7)], sources=["a", "b", None, "a", "z", "z"]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        got = queries.source_targets(spark, d).collect()
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet{'/*.parquet' if d[:5] != '/root' else ''}')")
        want = db.execute(queries.SOURCE_TARGETS_SQL).fetchall()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_mixing_without_covariates_is_the_quotient(spark):
    texts = [" ".join("w" * n) for n in (5, 9, 30, 4, 4, 4, 60)] + [" ".join("w" * 30_000)]
    sources = ["a", "a", "a", "b", "b", "b", None, None]
    x = docs(spark, texts + texts[:2], sources=sources + ["a", "a"], ids=[*range(8), 0, 0]).withColumn("size", F.lit("mine")).withColumn("rate", F.lit(1))
    got = mixing.mix(x, covariates=[]).collect()
    assert len(got) == 10 and all(r["rate"] == pytest.approx(r["target"] / r["source_size"], abs=1e-6) for r in got)
    assert len(mixing.mix(x).collect()) == 10


SMALL = "/root/testdata/sf0.001"
CHECKED = ["op1_minhash_near_dedup", "op11_pivot_hard_negatives", "op12_threshold_seeded_search", "source_targets", "op2_license_scan", "op4_chat_prefix_tree", "op6_simhash_decontamination", "op8_line_frequency_rules"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    plain = lambda x: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x)
    assert plain(got.select(*columns).collect()) == plain(want)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "source_mixing"] and cp.STAGES[2][1] is cp.near_duplicates
    x = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = x.count()
    for name, stage in cp.STAGES[:-1]:
        y = cp.cut(stage(spark, x, SMALL), name)
        assert y.columns == x.columns and 0 < y.count() <= before and y.exceptAll(x).count() == 0
        x, before = y, y.count()
    out = cp.source_mixing(spark, x, SMALL)
    assert out.count() == before
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def written(folder, spark, texts, langs, sources, items):
    """A folder of the tables that the pipeline reads."""
    docs(spark, texts, langs=langs, sources=sources).select("doc_id", "text", "lang", "source", "n_chars").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    good = [(i, 1, 0) for i, t in enumerate(texts) if t and i % 3 == 0]
    spark.createDataFrame(good, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_whole_pipeline_against_plain_versions(spark, tmp_path):
    import corpus_pipeline as cp
    from epsforest.llm import kneser_ney, language_id
    from tests.llm.test_near_dedup import brute

    rng = random.Random(21)
    syllables = {"en": ["the", "ing", "and", "er", "wh"], "fr": ["eau", "que", "é", "oux", "le"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4)))
    text = lambda lang, n: [word(lang) for _ in range(n)]
    langs = [rng.choice(["en", "fr"]) for _ in range(90)]
    parts = [text(x, rng.randrange(40, 90)) for x in langs]
    for k in range(60, 75):  # near copies
        parts[k] = parts[k - 30][:]
        parts[k][5], langs[k] = "changed", langs[k - 30]
    items = [(k, " ".join(text("en", 30))) for k in range(4)]
    for k in range(75, 85):
        parts[k] += items[k % 4][1].split()
    texts = [" ".join(p) for p in parts] + [None, "", "  ", "12 34", "zq " * 50]
    langs += ["en"] * 5
    folder = written(tmp_path, spark, texts, langs, ["s" if k % 3 else "t" for k in range(len(texts))], items)
    x = spark.read.parquet(f"{folder}/documents.parquet")
    kept = sorted(r["doc_id"] for r in language_id.keep_identified(kneser_ney.keep_good(x, spark.read.parquet(f"{folder}/labels.parquet"))).select("doc_id").collect())
    _, comp = brute([texts[i] for i in kept], 5)
    one = [i for k, i in enumerate(kept) if comp[k] == k]
    hit = {one[d] for d, _ in plain_matches([texts[i] for i in one], items)}
    left = [i for i in one if i not in hit]
    got = {r["doc_id"]: r for r in cp.run(spark, folder).collect()}
    assert sorted(got) == left and len(kept) > len(one) > len(left) > 30
    sizes = {i: len(words(texts[i])) for i in left}
    assert {i: r["size"] for i, r in got.items()} == sizes and all(0 <= r["taken"] <= 2 * sizes[i] for i, r in got.items())
    total = sum({r["source"]: r["target"] for r in got.values()}.values())
    assert total == pytest.approx(1.5 * sum(sizes.values())) and abs(sum(r["taken"] for r in got.values()) - total) < 60


def test_quality_stage_trains_on_all_trusted_texts(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    from epsforest.llm import kneser_ney

    rng = random.Random(23)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(20)) for _ in range(121)] + [" ".join(f"#{rng.random()}" for _ in range(20))]
    folder = written(tmp_path, spark, texts, ["en"] * len(texts), ["s"] * len(texts), [(0, "x")])
    taken, weights = [], kneser_ney.weights
    monkeypatch.setattr(kneser_ney, "TRUSTED_CHARS", 100)
    monkeypatch.setattr(kneser_ney, "weights", lambda x: taken.extend(r["doc_id"] for r in x.collect()) or weights(x))
    kept = {r["doc_id"] for r in cp.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert sorted(taken) == [k for k in range(0, 121, 3) if hashlib.md5(str(k).encode()).hexdigest()[-1] in "01234567"]
    assert len(kept) > 100 and 121 not in kept


@pytest.mark.parametrize("texts", [[], [None, "", " "]])
def test_pipeline_without_documents(spark, tmp_path, texts):
    import corpus_pipeline as cp

    folder = written(tmp_path, spark, texts, ["en"] * len(texts), ["s"] * len(texts), [(1, None)])
    assert cp.run(spark, folder).count() <= len(texts)


def test_columns_that_clash_change_nothing(spark):
    texts = ["licensed cc by and all rights reserved", None, "", *(f"line one\nline {k}\n" + f"common line of a host with words {k % 2}\n" * 3 for k in range(30))]
    x = docs(spark, texts)
    names = ["n_words", "labels", "score", "row", "row_id", "host", "hk", "line", "norm", "kept", "n", "size", "gone", "h", "_s", "Score", "base_failed", "t", "ws", "ls"]
    more = x.withColumns({c: F.lit(7) for c in names if c.lower() not in {n.lower() for n in names[: names.index(c)]}})
    for run in (license_scan.scan_licenses, quality_rules.apply_rules):
        columns = sorted(run(x).columns)
        rows_of = lambda df: sorted(map(repr, df.select(*columns).collect()))  # noqa: B023, E731
        assert rows_of(run(x)) == rows_of(run(more))
