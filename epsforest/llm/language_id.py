"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions, labels every byte position, and a document's probabilities
are the mean over all its positions. It is trained in numpy by backpropagation through time on a bounded sample: about
``PER_LANGUAGE`` training documents of each language, in the order of a hash, and of each one passage of ``PASSAGE``
characters (``fit``, for op5). The pipeline's network learns from every whole text that has a language and a letter (``fit_all``): in
each of ``ROUNDS`` rounds a share of the texts, told by a hash, is dealt to tasks, each of which goes on from the round's network through all
its windows, and the networks' mean, weighed by windows, begins the next round. Prediction reads whole texts; its windows are steps of one matrix each, so a block of text takes WINDOW steps.
Both in training and in prediction a window starts from an empty state: backpropagation and context end at its edges.

Defined results: a null text, or one without a letter, is ``und`` with score 0. A row without language is never trained
on. With a single training language, or none, every text with letters gets that language, or ``und``. Languages with
the same probability: the first in code point order. Repeated rows get the same result. A null doc_id counts as ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epsforest.llm.textscan import pieces, tidy, unused
from epsforest.runtime import brief_shuffles

HIDDEN, WINDOW, PAD = 8, 64, 256
PER_LANGUAGE, MOST_SAMPLED, PASSAGE = 800, 20_000, 256
STEPS, BATCH, RATE, LEAST_SCORE = 240, 256, 0.02, 0.3
#: Of training on all texts: rounds, bytes of a task in a round, windows of a step, groups in which networks are averaged, a language's largest weight.
ROUNDS, SHARE, LEARN, LANES, MOST_WEIGHT = 4, 1 << 22, 1024, 32, 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_network(languages: int, seed: int = 7) -> dict[str, np.ndarray]:
    """x: gates by byte, u: gates by state, o: logits by state; f and b for the two directions; gates are reset, update, new."""
    rng = np.random.default_rng(seed)
    net = {"bias": np.zeros(languages, np.float32)}
    for d in "fb":
        net["x" + d] = rng.normal(0, 0.3, (PAD + 1, 3 * HIDDEN)).astype(np.float32)
        net["u" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        net["o" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, languages)).astype(np.float32)
    return net


def loss_and_gradients(net: dict[str, np.ndarray], windows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of all positions (PAD left out) and its gradients, by backpropagation through time. windows: batch x time."""
    n, time, H = len(windows), windows.shape[1], HIDDEN
    kept, logits = {}, np.zeros((time, n, len(net["bias"])), np.float32) + net["bias"]
    for d in "fb":
        h, steps = np.zeros((n, H), np.float32), []
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            gx, gh = net["x" + d][windows[:, t]], h @ net["u" + d]
            rz = _sigmoid(gx[:, : 2 * H] + gh[:, : 2 * H])
            r, z = rz[:, :H], rz[:, H:]
            new = np.tanh(gx[:, 2 * H :] + r * gh[:, 2 * H :])
            steps.append((t, h, r, z, new, gh[:, 2 * H :]))
            h = (1 - z) * new + z * h
            logits[t] += h @ net["o" + d]
            steps[-1] += (h,)
        kept[d] = steps
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    real = (windows != PAD).T
    count = max(1, int(real.sum()))
    loss = -float((np.log(np.maximum(p[:, np.arange(n), y], 1e-12)) * real).sum()) / count
    p[:, np.arange(n), y] -= 1
    p *= real[:, :, None] / np.float32(count)
    grads = {"bias": p.sum(axis=(0, 1))}
    for d in "fb":
        du, do, dh = np.zeros_like(net["u" + d]), np.zeros_like(net["o" + d]), np.zeros((n, H), np.float32)
        dx, where = np.empty((time * n, 3 * H), np.float32), np.empty(time * n, np.int64)
        for i, (t, before, r, z, new, ghn, after) in enumerate(reversed(kept[d])):
            do += after.T @ p[t]
            dh = dh + p[t] @ net["o" + d].T
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dnew * ghn * r * (1 - r)
            dg = np.concatenate([dr, dz, dnew * r], axis=1)
            dx[i * n : (i + 1) * n] = np.concatenate([dr, dz, dnew], axis=1)
            where[i * n : (i + 1) * n] = windows[:, t]
            du += before.T @ dg
            dh = dh * z + dg @ net["u" + d].T
        grads["u" + d], grads["o" + d] = du, do
        grads["x" + d] = np.stack([np.bincount(where, weights=dx[:, k], minlength=PAD + 1) for k in range(3 * H)], axis=1).astype(np.float32)
    return loss, grads


def gradients(net: dict[str, np.ndarray], windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """As ``loss_and_gradients``, with a weight for each window; features x batch, as in prediction."""
    n, time, H = len(windows), windows.shape[1], HIDDEN
    steps, L = np.ascontiguousarray(windows.T), len(net["bias"])
    logits, kept = np.zeros((time, L, n), np.float32) + net["bias"][:, None], {}
    for d in "fb":
        x, u, o = (np.ascontiguousarray(net[k + d].T) for k in "xuo")
        gates, new, own, states = (np.empty((time + (k == H), w, n), np.float32) for k, w in ((0, 2 * H), (0, H), (0, H), (H, H)))
        order = list(range(time)) if d == "f" else list(range(time - 1, -1, -1))
        states[0] = 0
        for i, t in enumerate(order):
            gx, gh, h = np.take(x, steps[t], axis=1, mode="clip"), u @ states[i], states[i + 1]
            np.add(gx[: 2 * H], gh[: 2 * H], out=gates[i])
            gates[i] *= 0.5
            np.tanh(gates[i], out=gates[i])
            gates[i] *= 0.5
            gates[i] += 0.5
            own[i] = gh[2 * H :]
            np.multiply(gates[i, :H], own[i], out=new[i])
            new[i] += gx[2 * H :]
            np.tanh(new[i], out=new[i])
            np.subtract(states[i], new[i], out=h)
            h *= gates[i, H:]
            h += new[i]
            logits[t] += o @ h
        kept[d] = order, gates, new, own, states
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    real = steps != PAD
    logits[:, y, np.arange(n)] -= 1
    logits *= (real * (weight / max(1, int(real.sum()))).astype(np.float32))[:, None, :]
    grads, where = {"bias": logits.sum(axis=(0, 2))}, steps.reshape(-1)
    for d in "fb":
        order, gates, new, own, states = kept[d]
        u, o = net["u" + d], net["o" + d]
        du, do, dh, dx, dg = np.zeros_like(u), np.zeros_like(o), np.zeros((H, n), np.float32), np.empty((3 * H, time, n), np.float32), np.empty((3 * H, n), np.float32)
        for i in range(time - 1, -1, -1):
            t, before, r, z = order[i], states[i], gates[i, :H], gates[i, H:]
            do += states[i + 1] @ logits[t].T
            dh += o @ logits[t]
            through = dh * z
            dnew = (dh - through) * (1 - new[i] * new[i])
            np.multiply(through * (before - new[i]), 1 - z, out=dg[H : 2 * H])
            np.multiply(dnew, r, out=dg[2 * H :])
            np.multiply(dg[2 * H :] * own[i], 1 - r, out=dg[:H])
            dx[: 2 * H, t], dx[2 * H :, t] = dg[: 2 * H], dnew
            du += before @ dg.T
            dh = through + u @ dg
        grads["u" + d], grads["o" + d] = du, do
        grads["x" + d] = np.stack([np.bincount(where, weights=dx[k].reshape(-1), minlength=PAD + 1) for k in range(3 * H)], axis=1).astype(np.float32)
    return grads


def train(windows: np.ndarray, y: np.ndarray, languages: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over seeded batches that take each language alike."""
    net, rng = new_network(languages, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    weight = 1.0 / np.bincount(y, minlength=languages)[y]
    weight /= weight.sum()
    for step in range(1, steps + 1):
        take = rng.choice(len(y), min(BATCH, len(y)), p=weight)
        _, grads = loss_and_gradients(net, windows[take], y[take])
        rate = RATE * min(1, 2 * (1 - (step - 1) / steps))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net[k] = (net[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def cut_windows(buf: np.ndarray, offs: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The windows lo to hi of all rows (each row's last one padded), batch x time, and their rows."""
    many = -(-np.diff(offs) // WINDOW)
    stops = np.cumsum(many)
    hi = int(stops[-1]) if hi is None else hi
    index = np.arange(lo, hi)
    row = np.searchsorted(stops, index, "right")
    start = offs[row] + (index - (stops - many)[row]) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offs[row + 1][:, None]
    return np.where(inside, buf[np.minimum(at, len(buf) - 1)].astype(np.int32), np.int32(PAD)), row


def position_probabilities(net: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """time x languages x batch: the probabilities of every position."""
    n, H = len(windows), HIDDEN
    steps = np.ascontiguousarray(windows.T)
    logits = np.empty((WINDOW, len(net["bias"]), n), np.float32)
    gx, gh, rz, new, h = (np.empty((k, n), np.float32) for k in (3 * H, 3 * H, 2 * H, H, H))
    for d in "fb":
        x, u, o = (np.ascontiguousarray(net[k + d].T) for k in "xuo")
        x, u = x.copy(), u.copy()
        x[: 2 * H] *= 0.5  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
        u[: 2 * H] *= 0.5
        h[:] = 0
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            np.take(x, steps[t], axis=1, out=gx, mode="clip")
            np.matmul(u, h, out=gh)
            np.add(gx[: 2 * H], gh[: 2 * H], out=rz)
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            np.multiply(rz[:H], gh[2 * H :], out=new)
            new += gx[2 * H :]
            np.tanh(new, out=new)
            h -= new
            h *= rz[H:]
            h += new
            if d == "f":
                np.matmul(o, h, out=logits[t])
            else:
                logits[t] += o @ h
    logits += net["bias"][None, :, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def pooled(net: dict[str, np.ndarray], buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """rows x languages: the mean over positions; zero for rows without bytes."""
    n = len(offs) - 1
    out = np.zeros((n, len(net["bias"])))
    total = int((-(-np.diff(offs) // WINDOW)).sum())
    for lo in range(0, total, 2048):
        windows, row = cut_windows(buf, offs, lo, min(lo + 2048, total))
        p = position_probabilities(net, windows)
        p *= (windows.T != PAD)[:, None, :]
        sums = p.sum(axis=0)
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(row, weights=sums[k], minlength=n)
    return out / np.maximum(np.diff(offs), 1)[:, None]


def best_of(model, languages: list[str], buf: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and score of each row of a block."""
    if not languages:
        return ["und"] * len(letters), np.zeros(len(letters))
    p = pooled(model, buf, offs)
    best = p.argmax(axis=1)
    names = [languages[k] if s else "und" for k, s in zip(best.tolist(), letters.tolist(), strict=True)]
    return names, np.where(letters, np.minimum(p[np.arange(len(p)), best], 1), 0)


def predictor(model, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for row, end, buf, offs in pieces(batch.column(1), 1 << 19):
                names, score = best_of(model, languages, buf, offs, letters[row:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return tidy(run)


def keeper(model, languages: list[str], text: int, least: float):
    """Passes the rows on whose language is known well enough; the last column says whether there are letters, and is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            keep = np.zeros(batch.num_rows, bool)
            for row, end, buf, offs in pieces(batch.column(text), 1 << 19):
                names, score = best_of(model, languages, buf, offs, letters[row:end])
                keep[row:end] = [n != "und" and s >= least for n, s in zip(names, score.tolist(), strict=True)]
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(keep))

    return tidy(run)


def fold(modulus: int = 4):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def fit(docs: DataFrame, modulus: int = 4, held: int = 2) -> tuple[dict[str, np.ndarray], list[str]]:
    """The network and its languages, from rows outside the held-out fold: about PER_LANGUAGE texts a language, or MOST_SAMPLED shared alike."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id"))), 1, 8), 16, 10).cast("long")
    rows = docs.where(F.col("lang").isNotNull() & (fold(modulus) != held)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text", u.alias("u"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return new_network(1), []
    each = max(1, min(PER_LANGUAGE, MOST_SAMPLED // len(languages)))  # alike for all languages
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 32, int((1 << 32) * each / n) + 1))])
    length = F.length("text")
    passage = F.substr("text", F.pmod(F.col("u"), F.greatest(length - PASSAGE + 1, F.lit(1))).cast("int") + 1, F.lit(PASSAGE))
    some = rows.where(F.col("u") < F.element_at(limit, F.col("lang"))).where(F.col("text").rlike(r"\p{L}"))
    ranked = some.select("u", "doc_id", "lang", passage.alias("p")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "p")))
    got = ranked.where(F.col("rank") <= 2 * each).orderBy("u", "doc_id", "p").toArrow()  # twice what is expected of a language: only reached by rows that repeat a doc_id
    texts = [t.encode() for t in got["p"].to_pylist()]
    if not texts:
        return new_network(1), []
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    windows, row = cut_windows(np.frombuffer(b"".join(texts), np.uint8), offs)
    y = np.array([languages.index(x) for x in got["lang"].to_pylist()])[row]
    return train(windows, y, len(languages)), languages


def learner(nets: list[dict[str, np.ndarray]], taken: int, languages: list[str], balance: np.ndarray, round_: int):
    """Goes on from a network (and its means of gradients and of their squares, after ``taken`` steps) through all windows of a task's (lang, text): (part, lane, windows, steps, nets)."""
    at = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, first, second = ({k: v.copy() for k, v in x.items()} for x in nets)
        part = TaskContext.get().partitionId()
        rng, rate, steps, seen, kept = np.random.default_rng([round_, part]), RATE * (1 - round_ / ROUNDS), 0, 0, []

        def learn(windows: np.ndarray, y: np.ndarray) -> int:
            splits = np.array_split(rng.permutation(len(y)), -(-len(y) // LEARN))
            for k, some in enumerate(splits, taken + steps + 1):
                for name, g in gradients(net, windows[some], y[some], balance[y[some]]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    net[name] = (net[name] - rate * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
            return len(splits)

        for batch in batches:
            langs = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            for row, end, buf, offs in pieces(batch.column(1), 1 << 19):
                windows, rows = cut_windows(buf, offs)
                y = langs[row:end][rows]
                if steps < STEPS // ROUNDS:  # few texts are gone through again
                    kept.append((windows, y))
                steps += learn(windows, y)
                seen += len(y)
        while kept and steps < STEPS // ROUNDS:
            for some in kept:
                steps += learn(*some)
        if seen:
            flat = np.concatenate([x[k].astype(np.float32).reshape(-1) for x in (net, first, second) for k in sorted(x)])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, part % LANES, seen, taken + steps)] + [pa.array([flat.tobytes()], pa.binary())], ["part", "lane", "windows", "steps", "nets"])

    return tidy(run)


LEARNT = "part long, lane long, windows long, steps long, nets binary"


def averaged(table: pa.Table) -> pa.Table:
    """One row: the mean of the networks by windows, summed in the order of their parts."""
    table = table.sort_by("part")
    windows = np.array(table["windows"].to_pylist(), float)
    nets = sum(w * np.frombuffer(x, np.float32) for w, x in zip(windows / windows.sum(), table["nets"].to_pylist(), strict=True))
    steps = int(np.dot(windows, table["steps"].to_pylist()) / windows.sum())
    return pa.table({"part": [table["part"][0].as_py()], "lane": [table["lane"][0].as_py()], "windows": [int(windows.sum())], "steps": [steps], "nets": pa.array([nets.astype(np.float32).tobytes()], pa.binary())})


def fit_all(docs: DataFrame, modulus: int = 4, held: int | None = None) -> tuple[dict[str, np.ndarray], list[str]]:
    """The network and its languages, from all whole texts with a language and a letter (outside a fold, if ``held`` names one)."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (fold(modulus) if held is not None else F.lit(-1)).alias("fold"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.col("fold") != F.lit(-2 if held is None else held)))
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}  # one row a language
    languages, total = sorted(sizes), sum(sizes.values())
    net, steps = new_network(max(1, len(languages))), 0
    if not languages:
        return net, []
    balance = np.minimum([total / len(languages) / sizes[x] for x in languages], MOST_WEIGHT)
    nets = [net, *({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))]
    with brief_shuffles(docs.sparkSession):
        for k in range(ROUNDS):
            some = rows.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k).select("lang", "text").repartition(max(1, -(-total // (ROUNDS * SHARE))))
            got = some.mapInArrow(learner(nets, steps, languages, balance, k), LEARNT).groupBy("lane").applyInArrow(averaged, LEARNT).toArrow()  # at most LANES rows
            if len(got):
                got = averaged(got)
                steps, flat, at = got["steps"][0].as_py(), np.frombuffer(got["nets"][0].as_py(), np.float32), 0
                for x in nets:
                    for name in sorted(x):
                        x[name] = flat[at : at + x[name].size].reshape(x[name].shape).copy()
                        at += x[name].size
    return nets[0], languages


def identify(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    net, languages = fit(docs, modulus, held)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = texts.mapInArrow(predictor(net, languages), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(modulus) == held).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` in a language that the network knows, each by its own text; no row of the result is moved."""
    net, languages = fit_all(docs)
    at = [c.lower() for c in docs.columns].index("text")
    x = docs.withColumn(unused(docs, "_letters"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    return x.mapInArrow(keeper(net, languages, at, least), docs.schema)
