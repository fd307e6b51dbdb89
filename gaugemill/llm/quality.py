"""Quality classifier: gated-attention multiple-instance learning over the passages of a text.

A passage is encoded by the mean of learned word vectors, one per bucket of a word hash, beside
measures of its form; encoder and attention are trained together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .textops import slices, span_hashes, words

PASSAGE_WORDS = 64
HIDDEN, ATTENTION = 32, 16
#: Byte classes of the encoder: each ASCII punctuation sign, digits, lower and upper case, other
#: controls, line ends, blanks, and bytes beyond ASCII.
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
N_CLASSES = len(_SIGNS) + 7
N_FORM = N_CLASSES + 8
#: Buckets and width of the word vectors; what the attention reads is the form and the mean word vector.
BUCKETS, WIDTH = 4096, 16
N_FEATURES = N_FORM + WIDTH


def _byte_classes() -> np.ndarray:
    t = np.full(256, len(_SIGNS), np.int64)
    t[_SIGNS] = np.arange(len(_SIGNS))
    for k, (a, b) in enumerate(((48, 58), (97, 123), (65, 91), (10, 11), (32, 33), (128, 256)), len(_SIGNS) + 1):
        t[a:b] = k
    return t


_CLASS = _byte_classes()


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Form of every passage of ``size`` words (the last of a text may be shorter) and the number
    of its text; then the bucket of every word, in order, and how many words each passage has. A text
    without words has one passage, all zeros.

    Shares of byte classes; mean and spread of word length; shares of words that repeat the word
    before or the one before that, of distinct words, of words in capitals, of words with a capital
    first; log of the number of words.
    """
    n_texts = len(offsets) - 1
    starts, ends, text = words(data, offsets)
    per_text = np.bincount(text, minlength=n_texts)
    n_pass = np.maximum(1, -(-per_text // size))
    first_pass = np.concatenate(([0], np.cumsum(n_pass)))
    owner = np.repeat(np.arange(n_texts), n_pass)
    first_word = np.concatenate(([0], np.cumsum(per_text)))
    within = np.arange(len(text)) - first_word[text]
    passage = first_pass[text] + within // size
    p, out = len(owner), np.zeros((len(owner), N_FORM))
    if not len(text):
        return out, owner, np.zeros(0, np.int64), np.zeros(p, np.int64)
    begin = np.flatnonzero(within % size == 0)  # first word of each passage that has words
    at = np.searchsorted(starts[begin], np.arange(len(data)), "right") - 1
    at = np.maximum(at, 0)
    mass = np.bincount(passage[begin][at] * N_CLASSES + _CLASS[data], minlength=p * N_CLASSES).reshape(p, N_CLASSES).astype(float)
    out[:, :N_CLASSES] = mass / np.maximum(mass.sum(1, keepdims=True), 1)
    h, length = span_hashes(data, starts, ends), (ends - starts).astype(float)
    count = np.maximum(np.bincount(passage, minlength=p), 1)
    mean = lambda x: np.bincount(passage, x, minlength=p) / count
    same = lambda k: np.concatenate((np.zeros(min(k, len(h))), ((h[k:] == h[:-k]) & (text[k:] == text[:-k])).astype(float)))
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data < 91))))
    capitals = upper[ends] - upper[starts]
    order = np.lexsort((h, passage))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
    distinct = np.bincount(passage[order], new, minlength=p) / count
    m = mean(np.minimum(length, 64))
    values = (m, np.sqrt(np.maximum(mean(np.minimum(length, 64) ** 2) - m * m, 0)), mean(same(1)), mean(same(2)), distinct, mean((capitals * 2 > length).astype(float)), mean((upper[starts + 1] > upper[starts]).astype(float)), np.log1p(count))
    for k, v in enumerate(values):
        out[:, N_CLASSES + k] = v
    lower = span_hashes(data, starts, ends, lower=True)
    return out, owner, (lower % np.uint64(BUCKETS)).astype(np.int64), np.bincount(passage, minlength=p)


def _mean_words(table: np.ndarray, words_: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean word vector of each passage; zeros for one without words."""
    out = np.zeros((len(counts), table.shape[1]))
    has = np.flatnonzero(counts)
    if len(has):
        first = np.concatenate(([0], np.cumsum(counts[has])[:-1]))
        out[has] = np.add.reduceat(table[words_], first, axis=0) / counts[has][:, None]
    return out


class AttentionMIL:
    """x = form of a passage, scaled, and the mean of its words' vectors (rows of E); z = sum_k a_k h_k over passages k, h = tanh(x W + b), a = softmax over the text's passages of
    w . (tanh(h V) * sigmoid(h U)); the score is sigmoid(z . c + d). Trained by Adam on cross-entropy."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        s = lambda *n: g.normal(0, 1 / np.sqrt(n[0]), n)
        self.shift, self.scale, self.E = np.zeros(N_FORM), np.ones(N_FORM), np.zeros((BUCKETS, WIDTH))
        self.p = {"W": s(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": s(HIDDEN, ATTENTION), "U": s(HIDDEN, ATTENTION), "w": s(ATTENTION), "c": s(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": score}

    def scores(self, raw: np.ndarray, owner: np.ndarray, words_: np.ndarray, per: np.ndarray, n_texts: int) -> np.ndarray:
        counts = np.bincount(owner, minlength=n_texts)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        return self.forward(np.concatenate((self._scaled(raw), _mean_words(self.E, words_, per)), axis=1), starts, counts)["score"]

    def _scaled(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.shift) / self.scale, -8, 8)

    def fit(self, raw: np.ndarray, owner: np.ndarray, words_: np.ndarray, per: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 11) -> AttentionMIL:
        self.shift, self.scale = raw.mean(0), np.maximum(raw.std(0), 1e-3)
        x, g = self._scaled(raw), np.random.default_rng(seed)
        self.E[:] = g.normal(0, 0.1, self.E.shape)
        counts = np.bincount(owner, minlength=len(y))
        begin = np.concatenate(([0], np.cumsum(counts)))
        word = np.concatenate(([0], np.cumsum(per)))
        base = np.clip(y.mean(), 0.02, 0.98)
        self.p["d"][:] = np.log(base / (1 - base))
        all_ = {**self.p, "E": self.E}
        m, v = ({k: np.zeros_like(a) for k, a in all_.items()} for _ in range(2))
        epochs, step = -(-steps * batch // max(len(y), batch)), 0
        for epoch in range(epochs):
            order = g.permutation(len(y))
            for i in range(0, len(y), batch):
                docs = order[i : i + batch]
                n = counts[docs]
                rows = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
                own = np.concatenate([words_[word[begin[d]] : word[begin[d + 1]]] for d in docs])
                grad, dx = self._backward(np.concatenate((x[rows], _mean_words(self.E, own, per[rows])), axis=1), n, y[docs])
                share = np.repeat(dx[:, N_FORM:] / np.maximum(per[rows], 1)[:, None], per[rows], axis=0)
                grad["E"] = np.stack([np.bincount(own, share[:, k], minlength=BUCKETS) for k in range(WIDTH)], axis=1)
                step += 1
                r = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, d in grad.items():
                    if k != "E":  # Adam would shrink the vectors of rare words to nothing
                        d = d + decay * all_[k]
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    all_[k] -= r * m[k] / (np.sqrt(v[k]) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict:
        return self._backward(x, n, y)[0]

    def _backward(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean cross-entropy by the parameters and by the input."""
        p, starts = self.p, np.concatenate(([0], np.cumsum(n)[:-1]))
        f = self.forward(x, starts, n)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        d = (f["score"] - y) / len(y)
        dz = np.repeat(np.outer(d, p["c"]), n, axis=0)
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), n))
        dg = np.outer(de, p["w"])
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ d, "d": np.array([d.sum()])}
        return grad, dh @ p["W"].T


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_documents: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionMIL:
    """Fits on at most ``max_documents`` labelled documents that are not held out, chosen by a hash of
    the id, and on every passage of each: that bound, on labelled rows, is the only one, and
    scoring reads all documents whole. Labels other than 0 and 1, null ids, ids with more than one
    label and ids of several documents are left out. Without labelled documents every score is 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
    known = known.where((F.col("_y") == F.col("_z")) & ~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(max_documents)
    chosen = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("_id", F.col("_y").cast("int"), "_text")

    def encode(batches):
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(2)):
                x, owner, words_, per = passages(data, offsets)
                at = np.searchsorted(owner, np.arange(j - i + 1))
                word = np.concatenate(([0], np.cumsum(per)))[at]
                keep = [(x[a:b].astype("<f4").tobytes(), per[a:b].astype("u1").tobytes(), words_[c:d].astype("<u2").tobytes()) for a, b, c, d in zip(at, at[1:], word, word[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *(pa.array([k[c] for k in keep], pa.binary()) for c in range(3))], names=["id", "y", "x", "per", "words"])

    rows = chosen.mapInArrow(encode, "id long, y int, x binary, per binary, words binary")
    if chosen.groupBy("_id").count().where("count > 1").limit(1).count():
        once = chosen.groupBy("_id").count().where("count = 1").select(F.col("_id").alias("id"))
        rows = rows.join(F.broadcast(once), "id", "left_semi")
    rows = rows.toArrow().sort_by("id")
    model = AttentionMIL()
    if not rows.num_rows:
        model.p["c"][:] = 0
        return model
    bags = [np.frombuffer(b, "<f4").reshape(-1, N_FORM) for b in rows["x"].to_pylist()]
    per, words_ = (np.frombuffer(b"".join(rows[c].to_pylist()), kind).astype(np.int64) for c, kind in (("per", "u1"), ("words", "<u2")))
    return model.fit(np.concatenate(bags).astype(float), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), words_, per, rows["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: AttentionMIL, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` from every passage of every whole text (null: as empty); a column of that
    name is replaced. Only the model, half a megabyte, is sent to the tasks; nothing is shuffled. A
    very long text is scored in one task, in memory of some hundred bytes per word."""
    docs = docs.drop(score_col)
    at, names = docs.columns.index(text_col), [*docs.columns, score_col]
    docs = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold any character
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in slices(batch.column(at)):
                out[i:j] = model.scores(*passages(data, offsets), j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.names)

    return docs.mapInArrow(run, schema).toDF(*names)


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    # The text goes no further than the task that reads it: mapInArrow gets it, and only the id and the score come back.
    scored = scores_only(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def scores_only(docs: DataFrame, model: AttentionMIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the score alone, for readers that do not need the texts again."""

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in slices(batch.column(1)):
                out[i:j] = model.scores(*passages(data, offsets), j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[id_col, "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} long, score double")


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
