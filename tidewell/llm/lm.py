"""Language-model scores of documents: a word unigram base and a causal self-attention model.

The base counts words over all training documents.  Counts live in a table,
keyed by 64-bit word hashes; the words that make up at least one part in
FREQUENT of all tokens (so at most FREQUENT words) are looked up where the
text is, all others by a join.

The model is one block of causal self-attention over subword ids with a
feed-forward layer.  Its output distribution is factored: a softmax over
classes, then the id within its class by smoothed counts.  Frequent ids are
classes of their own.  Ranks, classes and counts are of the subwords of all
training documents.  The network is trained with Adam in numpy on all of
them, dealt into parts: each part is one task that takes each of its windows
at least once, and parameters and moments are averaged over the parts several
times on the way.  A text is cut into overlapping windows; all windows of
a batch go through masked attention at once, and each token is scored in
exactly one window, with the window's earlier tokens as context.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, removed, text_bytes, text_chunks, written

#: Documents of one part that the network is trained on (expected number, dealt by a hash of the id); the parts hold all training documents.
TRAIN_DOCUMENTS = 4000
#: Times that the parts' networks are averaged; rows that the averages of a round reach the driver in, at least (more for over 64 parts: the root of their number).
ROUNDS, AVERAGES = 4, 8
#: Window, tokens that later windows newly score, width, feed-forward width, input ids, classes.
WINDOW, STRIDE, WIDTH, HIDDEN, INPUTS, CLASSES = 40, 32, 24, 48, 2048, 96
#: Steps of a part, at least; windows of a step.
STEPS, BATCH, RATE = 600, 64, 4e-3
#: Windows of one batch when scoring; bytes of text of one round; exponents up to this size neither over- nor underflow in sums.
SCORE_BATCH, SCORE_BYTES, SAFE = 64, 1 << 18, 80
#: Bytes of ids of one row of a part; a part of longer texts has several rows, each trained on by itself.
PART_BYTES = 1 << 26
#: Spans whose subwords a worker keeps, for speed only; a round's own spans may be more.
CACHED = 1 << 19
#: At most so many words are looked up without a join.
FREQUENT = 200_000
END_HASH = np.uint64(0x452821E638D01377)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def window_counts(counts: np.ndarray) -> np.ndarray:
    """How many windows id sequences of some lengths have."""
    return np.maximum(1, 1 - (WINDOW - counts) // STRIDE)


def windows(ids: np.ndarray, counts: np.ndarray, begin: int, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, scored, text) of the windows of several id sequences, or of those with some numbers; -1 pads the targets."""
    n = window_counts(counts)
    text = np.repeat(np.arange(len(counts)), n)
    pick = np.arange(len(text)) if pick is None else pick
    text = text[pick]
    nth = pick - (np.cumsum(n) - n)[text]
    start = (np.cumsum(counts) - counts)[text] + nth * STRIDE
    inside = np.arange(WINDOW) < (counts[text] - nth * STRIDE)[:, None]
    targets = ids[np.where(inside, start[:, None] + np.arange(WINDOW), 0)]
    inputs = np.empty_like(targets)
    inputs[:, 1:] = targets[:, :-1]
    inputs[:, 0] = np.where(nth == 0, begin, ids[np.maximum(start - 1, 0)])
    inputs[~inside], targets[~inside] = begin, -1
    scored = inside.copy()
    scored[nth > 0, : WINDOW - STRIDE] = False
    return inputs, targets, scored, text


@dataclass
class AttentionModel:
    """Parameters and tables; ids outside the tables of a class share it by smoothed counts."""

    input_of: np.ndarray
    class_of: np.ndarray
    within: np.ndarray
    p: dict[str, np.ndarray]
    rooms: dict[str, np.ndarray] = field(default_factory=dict, repr=False, compare=False)

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to, the same memory for each call of a name: fresh pages cost more than the work on them."""
        size, kind = math.prod(shape), self.p["e"].dtype
        held = self.rooms.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self.rooms[name] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def hidden(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """Everything from the embeddings to the last layer's exponents and their sums, a row for each token but for the weights ``a``; good until the next call."""
        p, (n, t), room = self.p, inputs.shape, self.room
        x = np.take(p["e"], inputs.reshape(-1), axis=0, out=room("x", n * t, WIDTH), mode="clip")
        x.reshape(n, t, WIDTH)[...] += p["pos"][:t]
        # one product for a matrix of all tokens costs far less than one for each window
        w = np.hstack([p["q"] / np.float32(math.sqrt(WIDTH)), p["k"], p["v"]])
        qkv = np.matmul(x, w, out=room("qkv", n * t, 3 * WIDTH)).reshape(n, t, 3 * WIDTH)
        q, k, v = (qkv[:, :, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
        s = np.matmul(q, k.transpose(0, 2, 1), out=room("a", n, t, t))
        past = np.tril(np.ones((t, t), s.dtype))
        if max(s.max(), -s.min()) > SAFE:
            s -= np.where(past > 0, s, -np.inf).max(axis=2, keepdims=True)
            np.minimum(s, 0, out=s)  # those above are of later tokens
        a = np.exp(s, out=s)
        a *= past  # no token sees a later one
        a /= (a.reshape(-1, t) @ np.ones(t, a.dtype)).reshape(n, t, 1)
        c = np.matmul(a, v, out=room("c", n, t, WIDTH)).reshape(-1, WIDTH)
        h = np.matmul(c, p["o"], out=room("h", n * t, WIDTH))
        h += x
        u = np.matmul(h, p["w1"], out=room("act", n * t, HIDDEN))
        u += p["b1"]
        np.maximum(u, 0, out=u)
        f = np.matmul(u, p["w2"], out=room("f", n * t, WIDTH))
        f += h
        z = np.matmul(f, p["u"], out=room("z", n * t, CLASSES))
        z += p["ub"]
        if max(z.max(), -z.min()) > SAFE:
            z -= z.max(axis=1, keepdims=True)
        e = np.exp(z, out=room("exp", n * t, CLASSES))
        total = e @ np.ones(CLASSES, z.dtype)
        return {"x": x, "w": w, "qkv": qkv, "a": a, "c": c, "h": h, "act": u, "f": f, "z": z, "exp": e, "total": total}

    def forward(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        """``z``: the classes' log probabilities, for windows of input numbers."""
        m = self.hidden(inputs)
        return {"z": (m["z"] - np.log(m["total"])[:, None]).reshape(*inputs.shape, CLASSES)}

    def gradients(self, inputs: np.ndarray, classes: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, gradient of each parameter); class -1 doesn't count."""
        p, m, (n, t), room = self.p, self.hidden(inputs), inputs.shape, self.room
        at = np.flatnonzero(classes.reshape(-1) >= 0)
        goal, count = classes.reshape(-1)[at], max(1, len(at))
        loss = (np.log(m["total"][at]) - m["z"][at, goal]).sum() / count
        d = m["exp"]
        share = np.zeros(n * t, d.dtype)
        share[at] = 1 / count
        d *= (share / m["total"])[:, None]
        d[at, goal] -= d.dtype.type(1 / count)
        sums = np.ones(n * t, d.dtype)
        g = {"u": m["f"].T @ d, "ub": sums @ d}
        df = np.matmul(d, p["u"].T, out=room("df", n * t, WIDTH))
        g["w2"] = m["act"].T @ df
        du = np.matmul(df, p["w2"].T, out=room("du", n * t, HIDDEN))
        du *= np.sign(m["act"], out=m["act"])
        g["w1"], g["b1"] = m["h"].T @ du, sums @ du
        dh = np.matmul(du, p["w1"].T, out=room("dh", n * t, WIDTH))
        dh += df
        g["o"] = m["c"].T @ dh
        dc, a = np.matmul(dh, p["o"].T, out=room("dc", n * t, WIDTH)).reshape(n, t, WIDTH), m["a"]
        q, k, v = (m["qkv"][:, :, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
        back = room("back", n, t, 3 * WIDTH)
        dq, dk, dv = (back[:, :, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
        np.matmul(a.transpose(0, 2, 1), dc, out=dv)
        ds = np.matmul(dc, v.transpose(0, 2, 1), out=room("ds", n, t, t))
        # a row's weighted mean of ``ds`` is that of its context
        ds -= (np.multiply(m["c"], dc.reshape(-1, WIDTH), out=m["c"]) @ np.ones(WIDTH, d.dtype)).reshape(n, t, 1)
        ds *= a
        np.matmul(ds, k, out=dq)
        np.matmul(ds.transpose(0, 2, 1), q, out=dk)
        back = back.reshape(-1, 3 * WIDTH)
        dw = m["x"].T @ back
        g["q"], g["k"], g["v"] = dw[:, :WIDTH] / np.float32(math.sqrt(WIDTH)), dw[:, WIDTH : 2 * WIDTH], dw[:, 2 * WIDTH :]
        dx = np.matmul(back, m["w"].T, out=room("dx", n * t, WIDTH))
        dx += dh
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:t] = (np.ones(n, d.dtype) @ dx.reshape(n, -1)).reshape(t, WIDTH)
        g["e"] = np.zeros_like(p["e"])
        order = np.argsort(inputs.reshape(-1), kind="stable")
        which = inputs.reshape(-1)[order]
        first = np.flatnonzero(np.diff(which, prepend=-1))
        g["e"][which[first]] = np.add.reduceat(np.take(dx, order, axis=0, out=room("df", n * t, WIDTH), mode="clip"), first, axis=0)
        return float(loss), g

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each id sequence: ``forward`` with fewer passes, its last layer for the scored places only."""
        p, out = self.p, np.zeros(len(counts))
        inputs, targets, scored, text = windows(ids, counts, -1)
        inputs = np.where(inputs < 0, len(p["e"]) - 1, self.input_of[np.maximum(inputs, 0)])
        # an embedding is a token's row plus a position's, so queries, keys and values are sums of rows of small tables
        one = np.zeros((WIDTH, 1), dtype=np.float32)
        tables = [(p["e"] @ w, p["pos"] @ w) for w in (p["q"] / np.float32(math.sqrt(WIDTH)), p["k"], np.hstack([p["v"], one]))]
        tables[2][1][:, WIDTH] = 1  # a last value of 1 sums the weights
        longest = [np.linalg.norm(x, axis=1).max() + np.linalg.norm(y, axis=1).max() for x, y in tables[:2]]
        small = longest[0] * longest[1] < SAFE  # no weight can overflow
        first, last = np.vstack([p["w1"], p["b1"]]), np.vstack([p["u"], p["ub"]])
        past, ones = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32)), np.ones(CLASSES, dtype=np.float32)
        room = lambda *shape: np.empty(shape, dtype=np.float32)
        later = ~scored[:, 0]
        for begin, those in ((0, np.flatnonzero(~later)), (WINDOW - STRIDE, np.flatnonzero(later))):  # no query where nothing is scored
            # arrays that are used again: fresh pages cost more than the work on them
            n, size, half = min(SCORE_BATCH, len(those)), WINDOW - begin, (begin + WINDOW) // 2
            qkv, c = [room(n, t, x.shape[1]) for t, (x, _) in zip((size, WINDOW, WINDOW), tables, strict=True)], room(n, size, WIDTH + 1)
            spaces = [room(n, half - begin, half), room(n, WINDOW - half, WINDOW)]
            hs, us, zs = room(n * size, WIDTH + 1), room(n * size, HIDDEN), room(n * size, CLASSES)
            for i in range(0, len(those), SCORE_BATCH):
                part = those[i : i + SCORE_BATCH]
                own, m = inputs[part], len(part)
                q, k, v = (x[:m] for x in qkv)
                for y, (rows, place) in zip((q, k, v), tables, strict=True):
                    np.take(rows, own[:, WINDOW - y.shape[1] :], axis=0, out=y, mode="clip")
                    y += place[WINDOW - y.shape[1] :]
                for (lo, hi), space in zip(((begin, half), (half, WINDOW)), spaces, strict=True):  # the first half sees no key of the second
                    s = np.matmul(q[:, lo - begin : hi - begin], k[:, :hi].transpose(0, 2, 1), out=space[:m])
                    if not small:
                        s -= np.where(past[lo:hi, :hi] > 0, s, -np.inf).max(axis=2, keepdims=True)
                        np.minimum(s, 0, out=s)  # those above are of later tokens
                    np.exp(s, out=s)
                    s *= past[lo:hi, :hi]
                    np.matmul(s, v[:, :hi], out=c[:m, lo - begin : hi - begin])
                seen, h, goal = c[:m].reshape(-1, WIDTH + 1), hs[: m * size], targets[part, begin:].reshape(-1)
                seen /= seen[:, WIDTH:]
                h[:, :WIDTH] = seen[:, :WIDTH] @ p["o"]
                h[:, :WIDTH] += np.take(p["e"], own[:, begin:].reshape(-1), axis=0)
                h.reshape(m, size, -1)[:, :, :WIDTH] += p["pos"][begin:]
                h[:, WIDTH] = 1  # takes the biases along
                u = np.matmul(h, first, out=us[: m * size])
                np.maximum(u, 0, out=u)
                h[:, :WIDTH] += u @ p["w2"]
                z = np.matmul(h, last, out=zs[: m * size])
                value = z[np.arange(len(z)), self.class_of[goal]].astype(np.float64)
                if z.max() > SAFE or z.min() < -SAFE:
                    top = z.max(axis=1, keepdims=True)
                    z -= top
                    value -= top[:, 0]
                np.exp(z, out=z)
                value += self.within[goal] - np.log(z @ ones)
                value[goal < 0] = 0  # after the text's end
                at = text[part]
                total = np.bincount(at - at[0], weights=value.reshape(m, size).sum(1))
                out[at[0] : at[0] + len(total)] += total
        return out / math.log(10)


def untrained(times: np.ndarray, seed: int = 5) -> AttentionModel:
    """The model before its first step; ranks, classes and counts within them follow from how often each id occurs."""
    rng, vocabulary = np.random.default_rng(seed), len(times)
    seen = times.astype(np.float64) + 1.0
    rank = np.empty(vocabulary, dtype=np.int64)
    rank[np.argsort(-seen, kind="stable")] = np.arange(vocabulary)
    own = CLASSES - CLASSES // 4
    # frequent ids alone; the others dealt over the remaining classes by bands of falling frequency
    band = np.minimum((np.log2(1 + np.maximum(rank - own, 0)) * 2).astype(np.int64), CLASSES // 4 - 1)
    class_of = np.where(rank < own, rank, own + band)
    mass = np.bincount(class_of, weights=seen, minlength=CLASSES)
    within = np.log(seen / mass[class_of])
    input_of = np.minimum(rank, INPUTS - 1)
    f = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
    p = {"e": 0.3 * f(1, INPUTS + 1, WIDTH)[0], "pos": 0.1 * f(1, WINDOW, WIDTH)[0], "q": f(WIDTH, WIDTH), "k": f(WIDTH, WIDTH), "v": f(WIDTH, WIDTH), "o": 0.5 * f(WIDTH, WIDTH), "w1": f(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": 0.5 * f(HIDDEN, WIDTH), "u": f(WIDTH, CLASSES), "ub": np.log(mass / mass.sum() + 1e-9).astype(np.float32)}
    return AttentionModel(input_of, class_of, within, {k: v.astype(np.float32) for k, v in p.items()})


def moments(model: AttentionModel) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Adam's moments before the first step."""
    return tuple({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))


def fit(model: AttentionModel, m1: dict[str, np.ndarray], m2: dict[str, np.ndarray], ids: np.ndarray, counts: np.ndarray, rounds: tuple[int, int], steps: int, seed: tuple[int, ...]) -> int:
    """Takes the steps of one of some rounds (number, of how many) on id sequences (one after another, with their lengths), in place; the number of windows.

    All rounds take ``steps`` steps at least, and each window once before any
    again: the windows pass in shuffled order, BATCH a step.
    """
    total = int(window_counts(counts).sum())
    steps = max(steps, math.ceil(total / BATCH))
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(total) for _ in range(math.ceil(steps * BATCH / total))])
    done, last = (steps * (rounds[0] + i) // rounds[1] for i in range(2))
    # the windows of this round alone
    inputs, targets, _, _ = windows(ids, counts, -1, order[done * BATCH : last * BATCH])
    inputs = np.where(inputs < 0, INPUTS, model.input_of[np.maximum(inputs, 0)]).astype(np.int16)
    goals = np.where(targets >= 0, model.class_of[np.maximum(targets, 0)], -1)
    names = sorted(model.p)
    # one array for all parameters: a few passes a step instead of a few for each parameter
    flat, one, two = (flattened(held) for held in (model.p, m1, m2))
    for held, of in ((model.p, flat), (m1, one), (m2, two)):
        held.update(views(of, held))
    own, change = np.empty_like(flat), np.empty_like(flat)
    for step in range(done + 1, last + 1):
        part = slice((step - done - 1) * BATCH, (step - done) * BATCH)
        _, g = model.gradients(inputs[part], goals[part])
        np.concatenate([g[k].reshape(-1) for k in names], out=own)
        rate = RATE * min(1, step / 30) * (1 - 0.9 * step / steps)
        one *= np.float32(0.9)
        one += np.multiply(own, np.float32(0.1), out=change)
        two *= np.float32(0.99)
        np.square(own, out=own)
        two += np.multiply(own, np.float32(0.01), out=own)
        np.sqrt(two, out=change)
        change *= np.float32(1 / math.sqrt(1 - 0.99**step))
        change += np.float32(1e-8)
        np.divide(one, change, out=change)
        change *= np.float32(rate / (1 - 0.9**step))
        flat -= change
    model.rooms.clear()
    return total


def train(ids: np.ndarray, counts: np.ndarray, vocabulary: int, steps: int = STEPS, seed: int = 5) -> AttentionModel:
    """Fits the model on id sequences (one after another, with their lengths)."""
    model = untrained(np.bincount(ids, minlength=vocabulary), seed)
    if len(ids):
        fit(model, *moments(model), ids, counts, (0, 1), steps, (seed,))
    return model


def parts_of(documents: int, size: int, share: float = 1 / 32) -> int:
    """The parts of about ``size`` documents that hold a share of the documents (scores take all of them), and one part at least."""
    return max(1, math.ceil(documents * share / size))


def flattened(*groups: dict[str, np.ndarray]) -> np.ndarray:
    """All arrays of some dictionaries of parameters, one after another."""
    return np.concatenate([g[k].reshape(-1) for g in groups for k in sorted(g)])


def views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A dictionary with the shapes of ``like`` over the memory of ``flattened``."""
    names = sorted(like)
    ends = np.cumsum([like[k].size for k in names]).tolist()
    return {k: flat[end - like[k].size : end].reshape(like[k].shape) for k, end in zip(names, ends, strict=True)}


def restored(flat: np.ndarray, like: dict[str, np.ndarray], n: int) -> list[dict[str, np.ndarray]]:
    """``n`` dictionaries with the shapes of ``like`` from ``flattened``."""
    return [views(own.astype(np.float32), like) for own in np.split(flat, n)]


def mean_of(states: pa.Table) -> tuple[int, np.ndarray]:
    """(windows, mean of the states weighted by them) of rows part, nth, windows, state."""
    total, mean = 0, 0.0
    for row in sorted(states.to_pylist(), key=lambda row: (row["part"], row["nth"])):
        mean = mean + row["windows"] * np.frombuffer(row["state"], np.float32).astype(np.float64)
        total += row["windows"]
    return total, (mean / total).astype(np.float32)


def fit_parts(model: AttentionModel, learned: DataFrame, parts: int, dtype: np.dtype, steps: int) -> AttentionModel:
    """The model after ``steps`` steps at least on each part of ``learned`` (part, pieces), averaged over the parts ROUNDS times."""
    spark, m1, m2 = learned.sparkSession, *moments(model)
    groups = max(AVERAGES, math.isqrt(parts))
    schema = "part int, nth int, windows bigint, state binary"

    def average(states: pa.Table) -> pa.Table:
        total, mean = mean_of(states)
        return pa.table([pa.array([min(states.column("part").to_pylist())], pa.int32()), pa.array([0], pa.int32()), pa.array([total], pa.int64()), pa.array([mean.tobytes()], pa.binary())], names=["part", "nth", "windows", "state"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's texts in one row, or in several of about PART_BYTES."""
        texts, part = [], None
        for batch in batches:
            texts += batch.column("pieces").to_pylist()
            part = batch.column("part")[0].as_py() if batch.num_rows else part
        texts.sort()  # rows come in any order: sorted, so that training repeats
        held = np.cumsum([0, *map(len, texts)])
        for nth, own in enumerate(np.split(np.arange(len(texts)), np.flatnonzero(np.diff(held[:-1] // PART_BYTES)) + 1) if texts else ()):
            some = [texts[i] for i in own.tolist()]
            sizes = np.array([len(x) // dtype.itemsize for x in some], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([sizes.tobytes()], pa.binary()), pa.array([b"".join(some)], pa.binary())], names=["part", "nth", "sizes", "pieces"])

    # one part is one partition, and one task; dealt once, for all rounds
    dealt = written(learned.repartitionById(parts, F.col("part")).mapInArrow(packed, "part int, nth int, sizes binary, pieces binary"), "lm")
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, m1, m2))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, r: int = r) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, nth, sizes, pieces in zip(*(batch.column(n) for n in ("part", "nth", "sizes", "pieces")), strict=True):
                    start, one, two = shared.value
                    own, one, two = AttentionModel(start.input_of, start.class_of, start.within, dict(start.p)), dict(one), dict(two)
                    n = fit(own, one, two, np.frombuffer(pieces.as_buffer(), dtype).astype(np.int64), np.frombuffer(sizes.as_buffer(), np.int64), (r, ROUNDS), steps, (5, part.as_py(), nth.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([nth.as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([flattened(own.p, one, two).tobytes()], pa.binary())], names=["part", "nth", "windows", "state"])

        states = written(dealt.mapInArrow(learn, schema), "lm")
        means = states.groupBy(F.pmod("part", F.lit(groups))).applyInArrow(average, schema).toArrow()  # at most so many rows
        removed(states)
        if not means.num_rows:
            break
        p, m1, m2 = restored(mean_of(means)[1], model.p, 3)
        model = AttentionModel(model.input_of, model.class_of, model.within, p)
    removed(dealt)
    return model


_encoders: dict[str, tuple] = {}


def encoder(path: str) -> tuple:
    """(tiktoken encoding, end id) of a file of byte-pair ranks."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _encoders[path]


class Pieces:
    """Subword ids of texts, cut before each run of white space; the spans of this worker's last texts are looked up by their hashes."""

    def __init__(self, path: str):
        self.encoding, self.end = encoder(path)
        self.width = np.array([len(self.encoding.decode_single_token_bytes(i)) for i in range(self.end)])
        self.forget()

    def forget(self) -> None:
        """Knows the end only."""
        self.keys, self.first, self.size = np.array([END_HASH]), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([self.end], dtype=np.int64)

    def encode(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans, number of ids of each), in one call where its pieces end where the spans end."""
        together = self.encoding.encode_to_numpy(b"".join(spans).decode(), disallowed_special=()).astype(np.int64)
        stops = np.cumsum(self.width[together])
        last = np.searchsorted(stops, np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans))))
        if (stops[np.minimum(last, len(stops) - 1)] == np.cumsum([len(x) for x in spans])).all():
            return together, np.diff(last + 1, prepend=0)
        return self.each(spans)

    def each(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans, number of ids of each), in a call each."""
        lists = [self.encoding.encode_ordinary(x.decode()) for x in spans]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size

    def learn(self, keys: np.ndarray, spans: list[bytes]) -> None:
        """Adds spans by their hashes, in order; none of them is known."""
        plain = np.fromiter((x[0] == 32 and x[1:2] not in (b"", b" ", b"\t", b"\n", b"\v", b"\f", b"\r") for x in spans), bool, len(spans))
        size, parts = np.zeros(len(spans), np.int64), [self.ids]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        for way, which in ((self.encode, np.flatnonzero(plain)), (self.each, np.flatnonzero(~plain))):  # those that begin otherwise may join what is before them
            if len(which):
                ids, size[which] = way([spans[i] for i in which.tolist()])
                parts.append(ids)
        first = np.empty(len(spans), np.int64)
        first[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self.ids = np.concatenate(parts)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = (np.insert(old, at, more) for old, more in ((self.keys, keys), (self.first, first), (self.size, size)))

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(subword ids of all texts with an end id each, number of ids)."""
        w = Words(buf, offsets)
        begin, stop = np.zeros(len(w.start), np.int64), w.end
        begin[1:] = w.end[:-1]
        lead = w.lo[:-1][w.count > 0]
        begin[lead] = offsets[:-1][w.count > 0]
        done = offsets[:-1].copy()
        done[w.count > 0] = w.end[w.lo[1:][w.count > 0] - 1]
        rest = np.flatnonzero(done < offsets[1:])  # white space after the last word
        h = np.concatenate([w.span_hash(begin, stop), w.span_hash(done[rest], offsets[1:][rest]), np.full(len(w.count), END_HASH)])
        begin, stop = np.concatenate([begin, done[rest]]), np.concatenate([stop, offsets[1:][rest]])
        place = np.argsort(np.concatenate([w.doc() * 3, rest * 3 + 1, np.arange(len(w.count)) * 3 + 2]), kind="stable")
        keys, at, of = np.unique(h, return_index=True, return_inverse=True)
        for turn in range(2):
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[found] != keys)
            if not len(new):
                break
            if turn == 0 and len(self.keys) + len(new) > CACHED:
                self.forget()
                new = np.flatnonzero(keys != END_HASH)
            raw = buf.tobytes()
            self.learn(keys[new], [raw[a:b] for a, b in zip(begin[at[new]].tolist(), stop[at[new]].tolist(), strict=True)])
        size, first = self.size[found][of][place], self.first[found][of][place]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        spans = w.count + 1 + np.bincount(rest, minlength=len(w.count))
        return ids, np.diff(np.concatenate([[0], ends[np.cumsum(spans) - 1]])) if len(spans) else np.zeros(0, np.int64)


_pieces: dict[str, Pieces] = {}


def piece_ids(path: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Pieces`` of a file of ranks, kept for this worker's next texts."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path](buf, offsets)


def id_type(path: str) -> np.dtype:
    """The smallest type that holds all ids."""
    return np.dtype(np.min_scalar_type(encoder(path)[1]))


def stored_ids(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """``piece_ids`` of a column of written ids."""
    raw, offsets = text_bytes(column)
    return raw.view(dtype).astype(np.int64), np.diff(offsets) // dtype.itemsize


def piece_counts(pieces: DataFrame, path: str) -> np.ndarray:
    """How often each subword id occurs in a table of written ids."""
    size, dtype = encoder(path)[1] + 1, id_type(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in text_chunks(batch, "pieces"):
                times += np.bincount(stored_ids(part.column(0), dtype)[0], minlength=size)
        at = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(times[at])], names=["piece", "c"])

    found = pieces.mapInArrow(count, "piece bigint, c bigint").groupBy("piece").agg(F.sum("c").alias("c")).toArrow()  # a row for each id of the vocabulary at most
    out = np.zeros(size, dtype=np.int64)
    out[found.column("piece").to_numpy()] = found.column("c").to_numpy()
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, count) of the words and ends of all texts of a partition, summed in part."""
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, back = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(back, weights=np.concatenate(times)).astype(np.int64)

    for batch in batches:
        for part in text_chunks(batch, "text"):
            buf, offsets = text_bytes(part.column(0))
            k, n = np.unique(Words(lowered(buf), offsets).hashes(), return_counts=True)
            keys += [k, np.array([END_HASH])]
            times += [n, np.array([part.num_rows])]
            size += len(k) + 1
            if size > 2_000_000:
                k, n = merged()
                keys, times, size = [k], [n], len(k)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["h", "c"])
                    keys, times, size = [], [], 0
    if keys:
        k, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["h", "c"])


def score_documents(docs: DataFrame, training: Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score, score.

    ``training`` is a condition on ``id_col`` that tells which rows are
    learned from (null: not).  ``base_score`` is the sum over words and the end
    of log10((c + 1) / (N + V + 1)); ``score`` is the model's log10 probability
    of the lower-cased text's subwords and end, from subword counts over all
    training documents and a network trained on all of them, in parts of about
    ``train_documents`` (see ``parts_of``).  A null text counts as empty:
    one token, the end.  Equal rows get equal results, one row each; other
    columns don't matter.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rows that are equal have one key
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).isNull(), id_col, text).alias("doc"), F.coalesce(training, F.lit(False)).alias("learn"), text.alias("text"))
    dtype = id_type(tokenizer)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text", SCORE_BYTES):
                raw, offsets = text_bytes(part.column(2))
                ids, lengths = piece_ids(tokenizer, lowered(raw), offsets)
                ends = np.concatenate([[0], np.cumsum(lengths)]) * dtype.itemsize
                pieces = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.astype(dtype).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pieces], names=["doc", "learn", "pieces"])

    pieces = written(texts.select("doc", "learn", "text").mapInArrow(encoded, "doc bigint, learn boolean, pieces binary"), "lm")
    learned = pieces.where("learn")
    counts = written(texts.where("learn").select("text").mapInArrow(_word_counts, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "lm")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    frequent = counts.where(F.col("c") * FREQUENT >= n).toArrow()  # at most FREQUENT rows
    hashes = frequent.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    known = spark.sparkContext.broadcast((hashes[order], frequent.column("c").to_numpy()[order]))
    ends = counts.where(F.col("h") == int(END_HASH.view(np.int64))).first()
    base = math.log10(n + v + 1) if n else 0.0
    end_count = int(ends["c"]) if ends else 0
    documents = end_count
    model = untrained(piece_counts(learned.select("pieces"), tokenizer))
    if documents:
        parts = parts_of(documents, train_documents, 1)
        place = F.pmod(F.xxhash64(F.lit("lm"), "doc"), F.lit(1 << 24))
        dealt = learned.select(F.floor(place * parts / (1 << 24)).cast("int").alias("part"), "pieces")
        model = fit_parts(model, dealt, parts, dtype, STEPS)
    shared = spark.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "pieces", SCORE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(*stored_ids(part.column(1), dtype)))], names=["doc", "score"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with what the frequent words give, and one for each other word of it."""
        some, their = known.value
        for batch in batches:
            for part in text_chunks(batch, "text", SCORE_BYTES):
                raw, offsets = text_bytes(part.column(2))
                w = Words(lowered(raw), offsets)
                h, size, doc = w.hashes(), part.num_rows, w.doc()
                at = np.minimum(np.searchsorted(some, h), max(len(some) - 1, 0))
                hit = some[at] == h if len(some) else np.zeros(len(h), dtype=bool)
                value = np.bincount(doc[hit], weights=np.log10(their[at[hit]] + 1.0) - base, minlength=size) + (math.log10(end_count + 1.0) - base)
                found = np.bincount(doc[hit], minlength=size) + int(end_count > 0)
                rare, text = h[~hit], doc[~hit]
                order = np.lexsort((rare, text))
                rare, text = rare[order], text[order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (rare[1:] != rare[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                k, key = len(first), part.column(1).to_numpy()
                columns = (np.concatenate([key, key[text[first]]]), np.concatenate([key, rare[first].view(np.int64)]), np.concatenate([np.zeros(size, np.int32), np.diff(np.append(first, len(rare))).astype(np.int32)]))
                own = (part.column(0), pa.array(np.ones(size, np.int64)), pa.array(w.count.astype(np.int64) + 1), pa.array(found.astype(np.int64)), pa.array(value))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.concat_arrays([x, pa.nulls(k, x.type)]) for x in own)], names=["doc", "h", "times", "id", "rows", "n_tokens", "m_known", "m_base"])

    # a text's own row goes through the join with its key for a word, so that such rows spread; its ``times`` are 0
    found = texts.select("id", "doc", "text").mapInArrow(words, f"doc bigint, h bigint, times int, id {docs.schema[id_col].dataType.simpleString()}, rows bigint, n_tokens bigint, m_known bigint, m_base double").join(counts, "h", "left")
    times, none = F.col("times").cast("long"), lambda kind: F.lit(None).cast(kind)
    found = found.select("doc", "id", "rows", "n_tokens", "m_known", "m_base", F.when(F.col("c").isNotNull(), times).otherwise(0).alias("known"), (times * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - F.lit(base))).alias("base"), none("double").alias("score"))
    scored = pieces.select("doc", "pieces").mapInArrow(scores, "doc bigint, score double")
    scored = scored.select("doc", none(found.schema["id"].dataType).alias("id"), *(none("long").alias(c) for c in ("rows", "n_tokens", "m_known")), none("double").alias("m_base"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "score")
    gathered = found.unionByName(scored).groupBy("doc").agg(*(F.max(c).alias(c) for c in ("id", "n_tokens", "m_known", "m_base", "score")), F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.sum("base").alias("base"))
    # rows that are equal were summed together: share out again
    return gathered.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("m_known") + (F.col("known") / F.col("rows")).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("m_base") + F.col("base") / F.col("rows")).alias("base_score"),
        "score",
    )
