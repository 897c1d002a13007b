"""MinHash near-duplicates with odd sketches.

Every text becomes a MinHash sample over its word shingles. Bands of the sample propose candidates; an odd sketch (the
sample folded into a parity bitmap) estimates a candidate pair's similarity by the population count of the XOR of two
bitmaps; the pairs that pass are confirmed on their full shingle sets. Components of confirmed links are the result.

How groups stay bounded: equal shingle sets are one class from the start, and a node of the graph. Members of a band's
bucket are compared with the bucket's most central member first, which is linear in the bucket. Where a bucket still holds
several components after that, and is large (more than ``OPEN`` members), its members get ``SUB[0]`` further bands of
``SUB[1]`` samples each, which part texts that only share some boilerplate, and again meet the most central member of
those buckets. Only what is open then is compared: the members outside a bucket's largest component with all others, in
blocks of bounded probes and bounded targets, by the sketch and then by a finer one that only such texts get; pairs that a sketch
turns down are never emitted. Buckets, leaders and classes that are hot are dealt to several tasks.

What is exact and what is probable: a link is confirmed on full sets. A pair of similarity 0.8 shares no band with probability 5e-8; members of
a large open bucket that its most central member does not link meet in a further band but with probability 9e-8 (samples are independent, so both follow from
the numbers of bands). There is no exact way behind these bounds.

Defined results: a null, empty or blank text has the empty set and is linked with nothing. A text with fewer words than
a shingle is one shingle. Rows that repeat a doc_id stay rows of their own, whatever their texts: each belongs to its text's
component. A row without doc_id is returned as it is, with a null component and kept; it links nothing. Other columns of
the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsforest.llm.textscan import U64, mix, pieces, tidy, unused, word_shingles
from epsforest.operators.components import connected_components
from epsforest.operators.skew import copied, hot_keys, salted, split_join
from epsforest.runtime import cut

BANDS, ROWS = 32, 4
#: Samples and bits of the sketch that every text has, and of the finer one of texts whose groups stay open.
COARSE, FINE = (192, 1024), (4096, 8192)
#: Bands and samples of each for texts of open buckets with more than OPEN members: a pair of similarity 0.8 misses all with probability 9e-8.
SUB, OPEN = (88, 8), 8192
#: Members of a bucket that a task gets.
PART = 1024
MEMBERS_A_SALT, MEMBERS_A_BLOCK = 256, 256
COLUMNS = ("probe", "minor", "node", "comp", "sketch", "fine", "bands")


def most_apart(percent: int, sketch: tuple[int, int], deviations: float) -> int:
    """The largest Hamming distance of two odd sketches that a pair of ``percent`` similarity plausibly has.

    So many samples differ: the mean and some deviations of a binomial count. Each puts two flips on the bitmaps; what
    flips that meet take away again deviates by about the root of twice the number of meetings.
    """
    (n, bits), j = sketch, percent / 100
    differ = n * (1 - j) + deviations * (n * j * (1 - j)) ** 0.5
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    return int(min(bits, expected + 2 * 2 * (2 * differ * differ / bits) ** 0.5))


def samples(shingles: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """n MinHash samples (n x rows with shingles) of the joined sets."""
    sizes = sizes[sizes > 0]
    firsts = np.cumsum(sizes) - sizes
    seeds = (mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)
    hi, lo = (shingles >> U64(32)).astype(np.uint32), shingles.astype(np.uint32)
    out = np.empty((n, len(sizes)), np.uint32)
    a, b = np.empty_like(hi), np.empty_like(hi)
    for k in range(n):
        np.multiply(hi, seeds[2 * k], out=a)
        np.multiply(lo, seeds[2 * k + 1], out=b)
        np.bitwise_xor(a, b, out=a)
        np.minimum.reduceat(a, firsts, out=out[k])
    return out


def bands_of(sample: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """rows of the sample x bands 64-bit keys."""
    out = np.empty((sample.shape[1], bands), U64)
    for band in range(bands):
        h = np.full(sample.shape[1], band + 1, U64)
        for row in range(rows):
            h = mix(h * U64(0xD6E8FEB86659FD93) + sample[band * rows + row].astype(U64))
        out[:, band] = h
    return out


def odd_sketch(sample: np.ndarray, bits: int) -> np.ndarray:
    """rows x bits/64 words: the parity of how many samples fall on each bit."""
    n = sample.shape[1]
    odd = np.zeros((n, bits), np.uint8)
    for k in range(sample.shape[0]):
        where = mix(sample[k].astype(U64) + (U64(k) << U64(32))) % U64(bits)
        odd[np.arange(n), where.astype(np.int64)] ^= 1
    return np.packbits(odd, axis=1).view(U64)


def _long_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().view(np.int64)))


def features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, end, buf, offs in pieces(batch.column(1), 1 << 19):
                shingles, sizes = word_shingles(buf, offs, size)
                some = sizes > 0
                firsts = (np.cumsum(sizes) - sizes)[some]
                key = np.zeros((len(sizes), 2), U64)
                for k, salt in enumerate((U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179))):
                    if len(firsts):
                        key[some, k] = np.add.reduceat(mix(shingles ^ salt), firsts)
                bands, sketch = np.zeros((len(sizes), BANDS), U64), np.zeros((len(sizes), COARSE[1] // 64), U64)
                if len(firsts):
                    sample = samples(shingles, sizes, COARSE[0])
                    bands[some], sketch[some] = bands_of(sample), odd_sketch(sample, COARSE[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row), batch.column(2).slice(row, end - row), pa.array(sizes), *(pa.array(key[:, k].view(np.int64)) for k in (0, 1)), _long_lists(bands), _long_lists(sketch)],
                    ["doc_id", "text_key", "n_shingles", "k1", "k2", "bands", "sketch"],
                )

    return tidy(run)


def fine_sketches(size: int):
    """(node, fine, sub) of (node, text, wide): the finer sketch, and for ``wide`` rows the further bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for row, end, buf, offs in pieces(batch.column(1), 1 << 18):
                shingles, sizes = word_shingles(buf, offs, size)
                sample = samples(shingles, sizes, FINE[0])
                some = sizes > 0
                broad = wide[row:end][some]
                keys = bands_of(sample[:, broad], *SUB).ravel().view(np.int64)
                sub = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(broad * SUB[0])).astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row).filter(pa.array(some)), _long_lists(odd_sketch(sample, FINE[1])), sub], ["node", "fine", "sub"])

    return tidy(run)


def confirm(size: int, percent: int):
    """Streams rows sorted by group with the group's target first; holds one target's set and one row's at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, known = None, None
        for batch in batches:
            t, m, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            a, b = [], []
            for row, end, buf, offs in pieces(batch.column(3)):
                shingles, sizes = word_shingles(buf, offs, size)
                stops = np.cumsum(sizes)
                for i in range(row, end):
                    own = shingles[stops[i - row] - sizes[i - row] : stops[i - row]]
                    if first[i]:
                        if target != t[i]:  # rows that repeat a target have the same set
                            target, known = t[i], own.copy()
                        continue
                    if target != t[i]:
                        continue
                    small, large = (own, known) if len(own) < len(known) else (known, own)
                    if 100 * len(small) < percent * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                    if both and 100 * both >= percent * (len(own) + len(known) - both):
                        a.append(m[i])
                        b.append(t[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tidy(run)


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (m, t) whose full sets are similar. A target of many members is dealt to several salts."""
    pairs = cut(pairs, "pairs")
    targets = pairs.groupBy("t").agg(F.count("*").alias("n"))
    hot = hot_keys(targets, ["t"], pairs.count(), MEMBERS_A_SALT)
    first = copied(targets.select("t"), ["t"], hot).join(texts, F.col("node") == F.col("t")).select("t", "_salt", F.col("node").alias("m"), F.lit(True).alias("first"), "text")
    rest = salted(pairs, ["t"], hot).join(texts, F.col("node") == F.col("m")).select("t", "_salt", "m", F.lit(False).alias("first"), "text")
    dealt = first.unionByName(rest).repartition("t", "_salt").sortWithinPartitions("t", "_salt", F.desc("first"))
    return cut(dealt.select("t", "m", "first", "text").mapInArrow(confirm(size, percent), "a long, b long").distinct(), "links")


def _apart(x: str, y: str):
    """Population count of the XOR of two sketches, inside generated code."""
    n = F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0]))
    for k in range(1, COARSE[1] // 64):
        n = n + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return n


def across(most: int, most_fine: int):
    """Streams rows sorted by bucket and block; emits probe and target pairs of different components that both sketches let pass.

    Of two probes only the larger emits their pair. A pair that meets in several buckets of the first bands is emitted in the first of them only.
    """

    def close(band: int, rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        probe, minor, node, comp, sketch, fine, bands = (np.concatenate(rows[k]) for k in COLUMNS)
        p, t = np.flatnonzero(probe), np.flatnonzero(~probe)
        for lo in range(0, len(p), 64):
            u = p[lo : lo + 64]
            apart = np.bitwise_count(sketch[u][:, None, :] ^ sketch[t][None, :, :]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero((apart <= most) & (comp[u][:, None] != comp[t][None, :]))
            for at in range(0, len(i), 4096):
                a, b = u[i[at : at + 4096]], t[j[at : at + 4096]]
                once = ~minor[b] | (node[a] > node[b])
                a, b = a[once], b[once]
                same = bands[a] == bands[b]
                first = same.argmax(axis=1)
                once = (bands[a, first] == band) | ~(bands[a] == band).any(axis=1)
                a, b = a[once], b[once]
                ok = np.bitwise_count(fine[a] ^ fine[b]).sum(axis=1, dtype=np.int64) <= most_fine
                a, b = node[a[ok]], node[b[ok]]
                yield np.maximum(a, b), np.minimum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, None
        out = lambda m, t: pa.RecordBatch.from_arrays([pa.array(m), pa.array(t)], ["m", "t"])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            block = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            probe, minor, node, comp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
            sketch, fine, bands = (batch.column(i).flatten().to_numpy().reshape(n, -1) for i in (7, 8, 9))
            values = (probe.astype(bool), minor.astype(bool), node, comp, sketch.view(U64), fine.view(U64), bands)
            edge = np.flatnonzero(np.append(True, (block[1:] != block[:-1]).any(axis=1))).tolist()
            for lo, hi in zip(edge, [*edge[1:], n], strict=True):
                now = tuple(block[lo].tolist())
                if key != now:
                    if rows:
                        for m, t in close(key[0], rows):
                            yield out(m, t)
                    key, rows = now, {x: [] for x in COLUMNS}
                for x, v in zip(COLUMNS, values, strict=True):
                    rows[x].append(v[lo:hi].copy())
        if rows:
            for m, t in close(key[0], rows):
                yield out(m, t)

    return tidy(run)


def _members(dealt: DataFrame) -> DataFrame:
    """(band, node, n) of the buckets of ``dealt`` (node, band) with several members."""
    several = cut(dealt.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = several.agg(F.sum("n")).first()[0] or 0
    return cut(split_join(dealt, several, ["band"], several, total), "members")


def _by_bucket(members: DataFrame, other: DataFrame) -> DataFrame:
    """members (band, node, n, ..) with the columns of ``other`` (band, n, ..); large buckets are dealt to several tasks."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    left = members.withColumn("_salt", F.pmod(F.xxhash64("node"), parts).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return left.join(right, ["band", "_salt"]).drop("_salt")


def _stars(members: DataFrame) -> DataFrame:
    """The distinct pairs (m, t) of a bucket's member and its most central one. Where members have a ``comp``, only of different ones."""
    central = members.groupBy("node").agg(F.sum("n").alias("score"))
    keep = ["comp"] if "comp" in members.columns else []
    best = F.max(F.struct("score", (-F.col("node")).alias("minus"), *keep)).alias("top")
    leaders = members.join(central, "node").groupBy("band").agg(F.first("n").alias("n"), best)
    leaders = leaders.select("band", "n", (-F.col("top.minus")).alias("t"), *(F.col("top.comp").alias("other") for _ in keep))
    pairs = _by_bucket(members, leaders).where("node != t and comp != other" if keep else "node != t")
    return pairs.select(F.col("node").alias("m"), "t").distinct()


def _near(pairs: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """The pairs (m, t) whose sketches are close. A pair has few partners as m, and may have many as t."""
    pairs = cut(pairs, "stars")
    left, right = sketches.select(F.col("node").alias("m"), F.col("sketch").alias("sm")), sketches.select(F.col("node").alias("t"), F.col("sketch").alias("st"))
    counts = pairs.groupBy("t").agg(F.count("*").alias("n"))
    return split_join(pairs.join(left, "m"), right, ["t"], counts, pairs.count()).where(_apart("sm", "st") <= most).select("m", "t")


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(band, node, n, comp, main, minors) of the buckets that hold several components; main: the largest of them."""
    placed = members.join(comps, F.col("node") == F.col("id"), "left").select("band", "node", "n", F.coalesce("comp", "node").alias("comp"))
    parts = placed.groupBy("band", "comp").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    several = parts.groupBy("band").agg(F.first("n").alias("n"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k")).where("k > 1")
    several = several.select("band", "n", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.c")).alias("minors"))
    return cut(_by_bucket(placed, several), "open")


def _blocks(rest: DataFrame) -> DataFrame:
    """Rows for ``across``: bounded blocks of probes meet bounded blocks of targets."""
    rest = rest.withColumn("minor", F.col("comp") != F.col("main"))
    probes, targets = (F.ceil(F.col(c) / MEMBERS_A_BLOCK).cast("long") for c in ("minors", "n"))
    own = lambda parts: F.pmod(F.xxhash64("node"), parts)
    all_ = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    left = rest.where("minor").select("band", own(probes).alias("p"), all_(targets).alias("t"), F.lit(True).alias("probe"), *COLUMNS[1:])
    right = rest.select("band", all_(probes).alias("p"), own(targets).alias("t"), F.lit(False).alias("probe"), *COLUMNS[1:])
    return left.unionByName(right).repartition("band", "p", "t").sortWithinPartitions("band", "p", "t")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_key, n_shingles, k1, k2); and the classes (k1, k2, rows, component_id, component_key), doc_id and text key that stand for the component."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"
    found = cut(texts.mapInArrow(features(shingle), schema), "minhash")
    real = found.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed by writing them
    members = _members(classes.select("node", F.explode("bands").alias("band")))
    sketches = classes.select("node", "sketch")
    most = most_apart(percent, COARSE, 6.5)

    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "rep.doc_id", "rep.text_key")
    bodies = cut(texts.join(wanted, ["doc_id", "text_key"]).select("node", "text"), "bodies")
    links = _links(_near(_stars(members), sketches, most), bodies, shingle, percent)
    comps = connected_components(links)
    rest = _open(members, comps)
    if not rest.isEmpty():
        wide = rest.groupBy("node").agg(F.max(F.col("n") > OPEN).alias("wide"))
        open_texts = bodies.join(wide, "node").select("node", "text", "wide").repartition("node")
        fine = open_texts.mapInArrow(fine_sketches(shingle), "node long, fine array<long>, sub array<long>")
        fine = cut(fine.groupBy("node").agg(F.first("fine").alias("fine"), F.first("sub").alias("sub")), "fine")
        rest = rest.where(F.col("n") <= OPEN)
        large = cut(fine.where(F.size("sub") > 0).select("node", F.explode("sub").alias("band")), "sub")
        if not large.isEmpty():
            sub = _members(large)
            placed = sub.join(comps, F.col("node") == F.col("id"), "left").select("band", "node", "n", F.coalesce("comp", "node").alias("comp"))
            links = links.unionByName(_links(_near(_stars(placed), sketches, most), bodies, shingle, percent))
            comps = connected_components(links)
            rest = _open(members.where(F.col("n") <= OPEN), comps).unionByName(_open(sub, comps))
        rest = rest.join(classes.select("node", "sketch", "bands"), "node").join(fine.select("node", "fine"), "node")
        more = _blocks(rest).mapInArrow(across(most, most_apart(percent, FINE, 5)), "m long, t long").distinct()
        comps = connected_components(links.unionByName(_links(more, bodies, shingle, percent)))

    placed = classes.join(comps, F.col("node") == F.col("id"), "left").select("k1", "k2", "rows", "rep", F.coalesce("comp", "node").alias("comp"))
    placed = cut(placed, "placed")
    groups = cut(placed.groupBy("comp").agg(F.min("rep").alias("top"), F.count("*").alias("n")), "groups")
    joined = split_join(placed.drop("rep"), groups.select("comp", "top"), ["comp"], groups.select("comp", "n"), groups.agg(F.sum("n")).first()[0] or 0)
    return found, joined.select("k1", "k2", "rows", F.col("top.doc_id").alias("component_id"), F.col("top.text_key").alias("component_key"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    found, classes = _grouped(docs, shingle, percent)
    classes = cut(classes, "components")
    linked = F.col("n_shingles") > 0
    real = found.where(linked & F.col("doc_id").isNotNull()).select("doc_id", "n_shingles", "k1", "k2")
    total = classes.agg(F.sum("rows")).first()[0] or 0
    out = split_join(real, classes.select("k1", "k2", "component_id"), ["k1", "k2"], classes.select("k1", "k2", F.col("rows").alias("n")), total)
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = found.where(~linked | F.col("doc_id").isNull())
    return out.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group: of each component one row, with its smallest doc_id (and text key).

    Rows without words or without doc_id stay. Of rows that repeat that doc_id and that text, the least in the order of their columns stays.
    """
    _, classes = _grouped(docs, shingle, percent)
    one = classes.select("component_id", "component_key").distinct()
    doc, text = unused(docs, "_doc"), unused(docs, "_text")
    one = one.select(F.col("component_id").alias(doc), F.col("component_key").alias(text))
    words = F.coalesce(docs["text"].cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & docs["doc_id"].isNotNull()
    keyed = docs.where(words).withColumns({doc: F.col("doc_id").cast("long"), text: F.xxhash64(F.col("text").cast("string"))})
    order = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(*(F.col(f"`{c}`") for c in order))).alias("row")
    kept = keyed.join(one, [doc, text]).groupBy(doc, text).agg(row).select("row.*")
    return kept.unionByName(docs.where(~words))
