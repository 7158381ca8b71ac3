"""Quality of texts by attention-based multiple-instance learning.

A text is a bag of passages.  Each passage is encoded (byte counts and statistics of its words, through a learned
layer), gated attention gives each its weight within the text, and the weighted sum of the encodings is scored.  Labels
are those of whole texts only; which passages matter is learned.  The model is fitted by one task on a sample of at most
SAMPLE labelled texts of SAMPLE_BYTES together; every text is then encoded whole and scored by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import bound_batches

#: Words of a passage; the last one of a text may be shorter.
PASSAGE = 64
#: Most texts that a model is fitted on, those with the smallest hashes of their ids; their bytes together, and of one.
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 4096, 16 << 20, 1 << 20
#: Buckets of byte pairs; numbers besides the counts of bytes and pairs.
PAIRS, STATISTICS = 128, 8
INPUTS, HIDDEN, GATE = 256 + PAIRS + STATISTICS, 32, 16
#: Passes over the sample, texts of a step, its size, decay of weights.
EPOCHS, BATCH, RATE, DECAY = 24, 64, 0.003, 1e-4
PREDICTED = 0.7
#: Passages encoded at once.
BLOCK = 4096


def blocks(text: bytes) -> Iterator:
    """(passages, INPUTS) numbers of a whole text, at most BLOCK passages at a time; one row of zeros if it has no word."""
    import numpy as np

    words = text.split()
    if not words:
        yield np.zeros((1, INPUTS), dtype=np.float32)
    for at in range(0, len(words), PASSAGE * BLOCK):
        yield _block([b" ".join(words[i : i + PASSAGE]) for i in range(at, min(at + PASSAGE * BLOCK, len(words)), PASSAGE)])


def passages(text: bytes):
    """All of ``blocks``."""
    import numpy as np

    return np.concatenate(list(blocks(text)))


def _block(parts: list[bytes]):
    import numpy as np

    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    row = np.repeat(np.arange(len(parts)), sizes)
    single = np.bincount(row * 256 + data, minlength=len(parts) * 256).reshape(-1, 256).astype(np.float32)
    # No pair reaches the next passage.
    inside = np.flatnonzero(row[:-1] == row[1:])
    pair = (data[inside] * 31 + data[inside + 1] * 7) % PAIRS
    double = np.bincount(row[inside] * PAIRS + pair, minlength=len(parts) * PAIRS).reshape(-1, PAIRS).astype(np.float32)
    counts = [p.split(b" ") for p in parts]
    n = np.array([len(c) for c in counts], dtype=np.float32)
    distinct = np.array([len(set(c)) for c in counts], dtype=np.float32)
    adjacent = np.array([len(set(zip(c, c[1:], strict=False))) for c in counts], dtype=np.float32)
    one = np.array([sum(len(w) == 1 for w in c) for c in counts], dtype=np.float32)
    upper, lower, digit = single[:, 65:91].sum(1), single[:, 97:123].sum(1), single[:, 48:58].sum(1)
    total = sizes.astype(np.float32)
    told = np.stack([np.log1p(n), distinct / n, adjacent / np.maximum(n - 1, 1), total / n / 8, one / n, upper / total, lower / total, digit / total], axis=1)
    return np.concatenate([np.sqrt(single / total[:, None]), np.sqrt(double / total[:, None]), told], axis=1).astype(np.float32)


@dataclass
class Model:
    """Weights: centre and spread of inputs, encoder, both halves of the gate, attention, score."""

    weights: dict

    @staticmethod
    def fresh(seed: int = 7) -> Model:
        import numpy as np

        r = np.random.default_rng(seed)
        shapes = {"E": (INPUTS, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,)}
        weights = {k: r.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()} | {"e": np.zeros(HIDDEN), "v": np.zeros(GATE), "u": np.zeros(GATE), "b": np.zeros(1)}
        return Model(weights | {"centre": np.zeros(INPUTS), "spread": np.ones(INPUTS)})

    def encoded(self, x):
        """(encodings, both halves of the gate, attention before it sums to 1) of passages."""
        import numpy as np

        w = self.weights
        h = np.tanh(((x - w["centre"]) / w["spread"]) @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"] + w["v"]), _sigmoid(h @ w["U"] + w["u"])
        return h, t, g, (t * g) @ w["w"]

    def weighed(self, x, starts):
        """Of the passages of several texts: all of ``encoded``, their weights, the texts' representations and scores."""
        import numpy as np

        h, t, g, a = self.encoded(x)
        sizes = np.diff(np.append(starts, len(x)))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, _sigmoid(z @ self.weights["c"] + self.weights["b"]), sizes

    def score(self, text: bytes) -> tuple[float, list[float]]:
        """(score of the whole text, weight of each passage)."""
        import numpy as np

        found = [self.encoded(x) for x in blocks(text)]
        h, a = np.concatenate([f[0] for f in found]), np.concatenate([f[3] for f in found])
        a = np.exp(a - a.max())
        a /= a.sum()
        return float(_sigmoid(a @ h @ self.weights["c"] + self.weights["b"])[0]), a.tolist()

    def gradients(self, x, starts, y):
        """Gradients of the mean log loss over texts with labels ``y``."""
        import numpy as np

        w = self.weights
        h, t, g, a, z, p, sizes = self.weighed(x, starts)
        d = (p - y) / len(y)
        own = np.repeat(d, sizes)[:, None] * w["c"]
        # Through the weights: each passage's own share against the text's mean.
        da = (own * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
        dh = (a[:, None] * own + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        xs = (x - w["centre"]) / w["spread"]
        return {"E": xs.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ dg, "u": dg.sum(0), "w": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(bags: list, labels: list[int], seed: int = 7) -> Model:
    """A model of bags (arrays of passages) and labels of 0 and 1; by Adam, in an order that the seed sets."""
    import numpy as np

    model, r = Model.fresh(seed), np.random.default_rng(seed)
    if not bags:
        return model
    every, y = np.concatenate(bags), np.array(labels, dtype=np.float64)
    model.weights["centre"], model.weights["spread"] = every.mean(0), every.std(0) + 1e-2
    share = min(max(y.mean(), 0.01), 0.99)
    model.weights["b"][0] = np.log(share / (1 - share))
    moved = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items() if k not in ("centre", "spread")}
    step = 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = [len(bags[i]) for i in chosen]
            found = model.gradients(np.concatenate([bags[i] for i in chosen]), np.cumsum([0, *sizes[:-1]]), y[chosen])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, d in found.items():
                m, v = moved[k]
                d = d + (DECAY * model.weights[k] if k in "EVUwc" else 0)
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                model.weights[k] = model.weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id):
    """Whether a row is only scored: crc32 of its id as text is 2 modulo 4; without an id it is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labelled texts outside of the held-out rows.

    Ids with different labels, null labels, and texts without an id teach nothing; nor do texts of over TEXT_BYTES.  Of
    rows with one id the text that is last in order counts.  Without any labelled text the model is the untaught one.
    """
    import pickle

    bound_batches(docs.sparkSession)
    said = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    clear = said.agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").drop("_y")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    first = clear.join(sizes, "doc_id").where(F.col("size") <= TEXT_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    running = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = first.withColumn("_n", running).where(F.col("_n") <= SAMPLE_BYTES).select("doc_id", F.col("y").cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))

    def fit(batches):
        import pyarrow as pa

        got = []
        for batch in batches:
            got += [(k, y, passages(t)) for k, y, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        got.sort(key=lambda r: r[0])
        model = fitted([r[2] for r in got], [r[1] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.weights)], type=pa.binary())], names=["model"])

    one = rows.select("doc_id", "y", F.col("text").cast("binary").alias("text")).repartition(1)
    made = one.mapInArrow(fit, "model binary").first()
    return Model.fresh() if made is None else Model(pickle.loads(made["model"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (score >= PREDICTED) and n_passages, top_passage (the one of most weight).

    Null texts count as empty, and an empty text has one empty passage.  Columns of these names are replaced, others are
    kept.  Rows are scored one by one, whole, whatever their ids; an empty table gives an empty one.
    """
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted", "n_passages", "top_passage")]
    at = kept.index("text")

    def run(batches):
        for batch in batches:
            found = [model.score((t or "").encode("utf-8", "replace")) for t in batch.column(at).to_pylist()]
            p = [round(s, 6) for s, _ in found]
            more = [pa.array(p, type=pa.float64()), pa.array([int(x >= PREDICTED) for x in p], type=pa.int32()), pa.array([len(a) for _, a in found], type=pa.int32()), pa.array([max(range(len(a)), key=a.__getitem__) for _, a in found], type=pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "score", "predicted", "n_passages", "top_passage"])

    shape = docs.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "n_passages": F.lit(0), "top_passage": F.lit(0)}).schema
    return docs.select(*kept).mapInArrow(run, shape)
