"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

For every benchmark item, windows of the item's own length are laid over the documents. A window's SimHash (63 bits, the
majority over its words) is matched with the items' by a multi-index: the fingerprint is cut in BLOCKS parts, and of two
fingerprints at most RADIUS bits apart some part is at most RADIUS // BLOCKS apart, so probing each part's ball finds all
fingerprints within the radius, guaranteed. Matches are verified exactly: shingles weighted by how often they occur, the
weights' overlap over their union at least ``percent``.

What is moved are places: the shingles of a text that a bitmap of the benchmark's shingles lets through (a Bloom filter of BITS bits a shingle with
two probes, at most MOST_BITS bits), so documents are read in place; then those that are shingles of items of some length. A place
lies in the windows that begin in an interval, so a sweep over the ends of the intervals counts the places of all windows at once.
Windows are laid where places enter that hold enough of them to be similar; of the windows of long items, the best of each run of a
PER_ITEM-th of the length. Their texts are read once more, and bits are added up between the windows' ends, so that overlapping windows share the sums. The exact
weights are a sweep as well: a place adds to the windows that hold fewer equal ones before it than the item has. Work and memory grow
with texts and places, not with the items' length; the best window is the best of all starts. Equal texts are searched once,
windows of equal fingerprints are matched once.

A text that is shorter than an item but has ``percent`` of its shingles' number is one window as a whole. Words are runs of letters
and digits, lower-cased. An item with fewer words than a shingle has its whole sequence as its only shingle. A benchmark
of more than ``MOST_BITS / LEAST_BITS`` shingles is taken in several rounds of whole items.

Defined results: items without words match nothing. Null texts have no words. Rows without doc_id are checked and
reported under a null doc_id. Repeated rows and repeated places give one row a document and item: the best window, of
equal ones the first. Rows that share an item_id are items of their own, reported under that id, best first; rows that
share a doc_id are texts of their own, and ``keep_clean`` drops only those that hold an item. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epsforest.llm.textscan import unused
from epsforest.operators.skew import split_join
from epsforest.runtime import cut

SHINGLE, RADIUS, BLOCKS = 5, 20, 7
BITS, LEAST_BITS, MOST_BITS = 32, 8, 1 << 28
#: Windows of an item's length begin at most so often in a length; rows that are broadcast at most.
PER_ITEM, SMALL = 64, 100_000
LANES = 31
COUNTERS, TOPS = 1 | 1 << LANES, 1 << (LANES - 1) | 1 << (2 * LANES - 1)


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(h: str | Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` word hashes, in order; of the whole sequence if it is shorter."""
    h = F.col(h) if isinstance(h, str) else h
    n = F.size(h)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, size)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<long>"))


_LANE = [*range(LANES), 2 * LANES]


def lanes(h: str) -> list[Column]:
    """Sums of the bits of an array of word hashes: each of LANES sums packs two counters of LANES bits, the last bit has a sum of its own."""

    def lane(k: int) -> Column:
        mask = 1 if k == 2 * LANES else COUNTERS
        return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(mask)).alias(f"_l{k}")

    return [lane(k) for k in _LANE]


def majority(sums: dict[int, Column], size: Column) -> Column:
    """The fingerprint: a counter plus ``2**(LANES-1) - 1 - half`` has its top bit set exactly if it is more than half of the words."""
    t = F.lit((1 << (LANES - 1)) - 1) - F.floor(size / 2)
    bits = F.shiftleft(F.shiftrightunsigned(sums[2 * LANES] + t, LANES - 1), 2 * LANES)
    for k in range(LANES):
        bits = bits.bitwiseOR(F.shiftrightunsigned((sums[k] + t * F.lit(COUNTERS)).bitwiseAND(TOPS), LANES - 1 - k))
    return bits


def with_simhash(df: DataFrame, h: str, out: str) -> DataFrame:
    """Adds the majority bits over an array of word hashes."""
    summed = df.select("*", *lanes(h))
    return summed.withColumn(out, majority({k: F.col(f"_l{k}") for k in _LANE}, F.size(h))).drop(*(f"_l{k}" for k in _LANE))


def parts(fingerprint: str) -> Column:
    """An array of (block, part)."""
    width = 64 // BLOCKS
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(fingerprint), width * b).bitwiseAND((1 << width) - 1).alias("part")) for b in range(BLOCKS)))


def index(benchmark: DataFrame) -> DataFrame:
    """item (a key of id and words), item_id, h, w (words), item_fp of every item with words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("h"))
    items = items.withColumn("w", F.size("h")).where("w > 0").withColumn("item", F.xxhash64("item_id", "h")).dropDuplicates(["item"])
    return with_simhash(items, "h", "item_fp")


def _probes(gram: Column, bits: int) -> Column:
    return F.array(gram.bitwiseAND(bits - 1), F.shiftrightunsigned(gram, 32).bitwiseAND(bits - 1))


def bitmap(grams: DataFrame, bits: int) -> DataFrame:
    """One row with ``words``: the bits of all ``gram``, 64 a word. bits: a power of two, at least 64."""
    at = grams.select(F.explode(_probes(F.col("gram"), bits)).alias("p"))
    some = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    every = grams.sparkSession.range(bits // 64).join(some, F.col("id") == F.col("word"), "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("words"))


def _in(words: str, gram: Column, bits: int) -> Column:
    return F.forall(_probes(gram, bits), lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)


def _texts(docs: DataFrame) -> DataFrame:
    """row (a key of the text), doc_id, text."""
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, n, w, k, p, gram: the places p of a text of n words at which a shingle (of k words) of items of w words stands."""
    grams = cut(items.select("w", F.least("w", F.lit(SHINGLE)).alias("k"), F.explode(shingles("h")).alias("gram")).distinct(), "grams")
    found = docs.sparkSession.createDataFrame([], "row long, n int, p int, gram long, w int, k int")
    for k, many in sorted((r["k"], r["n"]) for r in grams.groupBy("k").agg(F.count("*").alias("n")).collect()):  # one unless items are shorter than a shingle
        bits = min(MOST_BITS, max(1 << 12, 1 << (BITS * many - 1).bit_length()))
        words = cut(bitmap(grams.where(F.col("k") == k), bits), "bitmap")
        x = _texts(docs).select("row", word_hashes(F.col("text")).alias("h")).withColumn("g", shingles("h", k))
        # read once in the projection, so that the optimiser leaves it out of the rows
        x = x.withColumn("words", words.scalar())
        seems = F.transform("g", lambda v, i: F.when(_in("words", v, bits), F.struct(i.alias("p"), v.alias("gram"))))  # noqa: B023
        x = x.select("row", F.size("h").alias("n"), F.filter(seems, lambda s: s.isNotNull()).alias("at"))
        # explode_outer: for explode the optimiser adds a filter that evaluates all of the above once more
        x = x.select("row", "n", F.explode_outer("at").alias("c")).where(F.col("c").isNotNull()).select("row", "n", "c.p", "c.gram")
        side = grams.where(F.col("k") == k)
        if many <= SMALL:
            x = x.join(F.broadcast(side), "gram")
        else:
            x = cut(x.distinct(), "seeming")
            counts = cut(x.groupBy("gram").agg(F.count("*").alias("n")), "counts")
            x = split_join(x, side, ["gram"], counts, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        found = found.unionByName(x)
    return cut(found.distinct(), "places")  # equal texts once


def _sweep(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., s, covered): in how many of the intervals lo .. hi of a key s lies, at each s where one begins."""
    ends = spans.select(*keys, F.col("lo").alias("s"), F.lit(1).alias("d")).unionAll(spans.select(*keys, F.col("hi") + 1, F.lit(-1)))
    ends = ends.groupBy(*keys, "s").agg(F.sum("d").alias("d"), F.max("d").alias("begins"))
    run = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumn("covered", F.sum("d").over(run)).where("begins = 1").drop("d", "begins")


def _starts(percent: int) -> tuple[Column, Column, Column, Column]:
    """Of a place: the words and shingles of its windows, the item's shingles, and the last start."""
    wide = F.least("w", "n")
    return wide, wide - (F.col("k") - 1), F.col("w") - (F.col("k") - 1), F.col("n") - wide


def _windows(places: DataFrame, percent: int) -> DataFrame:
    """row, w, start, wide: the windows of ``w`` words (or a shorter text) that hold enough shared shingles for an item of ``w`` words."""
    wide, size, own, last = _starts(percent)
    at = places.select("row", "n", "w", "k", "p").distinct().where(100 * size >= percent * own)
    spans = at.select("row", "n", "w", "k", F.greatest(F.col("p") - size + 1, F.lit(0)).alias("lo"), F.least("p", last).alias("hi")).where("lo <= hi")
    held = _sweep(spans, ["row", "n", "w", "k"]).where((100 + percent) * F.col("covered") >= percent * (size + own))
    every = F.greatest(F.expr(f"w div {PER_ITEM}"), F.lit(1))
    best = F.max(F.struct("covered", (-F.col("s")).alias("minus"))).alias("m")
    return held.groupBy("row", "n", "w", F.floor(F.col("s") / every).alias("run")).agg(best).select("row", "w", (-F.col("m.minus")).cast("int").alias("start"), F.least("w", "n").alias("wide"))


def _with_fingerprints(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with ``fp``: bits are summed between the ends of a text's windows, and running sums give those of each window."""
    edges = F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("start", F.col("start") + F.col("wide"))))))
    marks = cut(windows.groupBy("row").agg(edges.alias("edges")), "marks")
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS * max(1, marks.count()) - 1).bit_length()))
    words = cut(bitmap(marks.select(F.col("row").alias("gram")), bits), "bitmap")
    texts = _texts(docs).select("row", "text").withColumn("words", words.scalar()).where(_in("words", F.col("row"), bits)).drop("words")
    x = texts.groupBy("row").agg(F.first("text").alias("text")).join(marks, "row").select("row", "edges", word_hashes(F.col("text")).alias("h"))
    # the words from each edge to the next; none from the last
    parts_of = F.transform("edges", lambda e, i: F.struct(e.alias("at"), F.slice("h", e + 1, F.coalesce(F.get("edges", i + 1), e) - e).alias("x")))
    x = x.select("row", F.explode_outer(parts_of).alias("c")).select("row", "c.at", "c.x").select("row", "at", *lanes("x"))
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    x = cut(x.select("row", "at", *(F.coalesce(F.sum(f"_l{k}").over(before), F.lit(0)).alias(f"_l{k}") for k in _LANE)), "sums")
    a, b = (x.select("row", F.col("at").alias(c), *(F.col(f"_l{k}").alias(f"{c}{k}") for k in _LANE)) for c in ("start", "end"))
    y = windows.withColumn("end", F.col("start") + F.col("wide")).join(a, ["row", "start"]).join(b, ["row", "end"])
    return y.select("row", "w", "start", majority({k: F.col(f"end{k}") - F.col(f"start{k}") for k in _LANE}, F.col("wide")).alias("fp"))


def _best(places: DataFrame, items: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """row, item_id, start_word, n_words, shared, all: the best window of each pair (row, item, w) that is similar enough."""
    grams = items.select("item", "item_id", F.explode(shingles("h")).alias("gram")).groupBy("item", "item_id", "gram").agg(F.count("*").cast("int").alias("c"))
    at = places.join(pairs, ["row", "w"]).join(grams, ["item", "gram"])
    keys = ["row", "item", "item_id", "n", "w", "k"]
    at = cut(at.withColumn("r", F.row_number().over(Window.partitionBy("row", "item", "gram").orderBy("p"))), "weighed")
    # a place counts in windows that hold fewer than c equal ones before it
    earlier = at.select("row", "item", "gram", (F.col("r") + F.col("c")).alias("r"), F.col("p").alias("before"))
    _, size, own, last = _starts(percent)
    spans = at.join(earlier, ["row", "item", "gram", "r"], "left")
    spans = spans.select(*keys, F.greatest(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("p") - size + 1, F.lit(0)).alias("lo"), F.least("p", last).alias("hi")).where("lo <= hi")
    best = _sweep(spans, keys).groupBy(*keys).agg(F.max(F.struct("covered", (-F.col("s")).alias("minus"))).alias("m"))
    shared = F.col("m.covered")
    best = best.select("row", "item_id", (-F.col("m.minus")).cast("long").alias("start_word"), F.least("w", "n").cast("long").alias("n_words"), shared.cast("long").alias("shared"), (size + own - shared).alias("all"))
    return best.where(100 * F.col("shared") >= percent * F.col("all"))


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, start_word, n_words, shared, similarity: a row a document and item found in it. docs: (doc_id, text)."""
    items = cut(index(benchmark), "items")
    rounds = max(1, -(-(items.agg(F.sum("w")).first()[0] or 0) * LEAST_BITS // MOST_BITS))
    out = None
    for r in range(rounds):
        part = items if rounds == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r)
        one = _matches(docs, part, percent)
        out = one if out is None else out.unionByName(one)
    if rounds > 1:  # an id's items may be dealt to several rounds
        best = F.max(F.struct("shared", (-F.col("start_word")).alias("minus"), "n_words", "similarity")).alias("m")
        out = out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.minus")).alias("start_word"), "m.n_words", "m.shared", "m.similarity")
    return out


def _matches(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    places = _places(docs, items)
    windows = cut(_windows(places, percent), "windows")
    windows = cut(_with_fingerprints(docs, windows), "fingerprints")

    width = 64 // BLOCKS
    ball = [m for m in range(1 << width) if m.bit_count() <= RADIUS // BLOCKS]
    probes = items.select("item", "w", "item_fp", F.explode(parts("item_fp")).alias("b"))
    probes = probes.select("item", "w", "item_fp", "b.block", F.explode(F.transform(F.lit(ball), lambda m: m.cast("long").bitwiseXOR(F.col("b.part")))).alias("part"))
    keys = windows.select("w", "fp").distinct().select("w", "fp", F.explode(parts("fp")).alias("b")).select("w", "fp", "b.block", "b.part")
    near = keys.join(probes, ["w", "block", "part"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = cut(near.select("w", "fp", "item").distinct(), "near")
    counts = windows.groupBy("w", "fp").agg(F.count("*").alias("n"))
    pairs = split_join(windows, near, ["w", "fp"], counts, windows.count()).select("row", "item", "w").distinct()

    found = cut(_best(places, items, cut(pairs, "pairs"), percent), "found")
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS * max(1, found.count()) - 1).bit_length()))
    words = cut(bitmap(found.select(F.col("row").alias("gram")), bits), "bitmap")
    named = _texts(docs).select("row", "doc_id").withColumn("words", words.scalar()).where(_in("words", F.col("row"), bits)).drop("words")
    held = named.distinct().join(found, "row")
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("shared", (-F.col("start_word")).alias("minus"), "n_words", "all")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.minus")).alias("start_word"), "m.n_words", "m.shared", (F.col("m.shared") / F.col("m.all")).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found; told by the text, not by its id."""
    key, bad = unused(docs, "_text_key"), unused(docs, "_bad")
    found = matches(docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text"), benchmark, percent)
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(found.select(F.col("doc_id").alias(bad)).distinct(), F.col(key) == F.col(bad), "left_anti").drop(key)
