"""Language identification: a byte convolutional network, trained in numpy on labelled text, applied to fixed-length windows of whole texts.

Bytes are embedded; filters of several widths slide over a window, the largest response of each filter is kept, a softmax over those gives the
languages. A document is cut into windows of WINDOW bytes; all of them are judged, in batches, and their log probabilities are summed by length,
so a long text is decided by all of it. Letters are folded to lower case first and whatever is no letter counts as a space.

A filter of width w at a place is the sum of w rows of a table (byte -> responses), so the network is applied by look-ups, without matrices.

Training takes at most TRAIN_A_LANG documents of a language, those with the smallest hashes of doc_id and text, and a window at a hashed place of each;
only these windows reach the driver. The model, a few kB, goes to the workers in the function's closure.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the language first by name; with no labelled rows at all
every text is ``und``; null languages aren't learnt from; repeated rows are judged alike; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table
from .workers import trimmed

WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 16, 8
TRAIN_A_LANG, EPOCHS, BATCH, RATE, SEED = 1500, 8, 64, 0.004, 11
UND = "und"
#: A text of a whole window or more of which no language is likelier than all others together is in none, for ``kept``. On held-out rows of the
#: test tables it rejects one in 600, texts of one word over and over; clean ones are above 0.95.
LEAST_SCORE = 0.5
#: Documents whose lower-cased bytes are windowed at once.
BATCH_DOCS = 128
#: Windows that go through the network at once: their responses stay in the cache.
BATCH_WINDOWS = 32
SPACE = 32
#: Bytes that are no letters -> space; A-Z -> a-z; others (UTF-8 of other letters) stay.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else SPACE for b in range(256)], np.uint8)


def folded(data: bytes) -> np.ndarray:
    return FOLD[np.frombuffer(data, np.uint8)]


def windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last filled with spaces, and the bytes that each holds of it."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, SPACE, np.uint8)
    out[: len(data)] = data
    held = np.full(n, WINDOW, np.float32)
    held[-1] = len(data) - (n - 1) * WINDOW
    return out.reshape(n, WINDOW), held


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: dict[int, np.ndarray]  # width -> width x EMBED x FILTERS
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    dense: np.ndarray  # len(WIDTHS) * FILTERS x langs
    dense_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [(self.embed @ f[j]).astype(np.float32) for j in range(w)] for w, f in self.filters.items()}

    def log_probs(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Of windows (n x WINDOW)."""
        best, x = [], x.astype(np.intp)
        for w, rows in tables.items():
            n = x.shape[1] - w + 1
            total = rows[0].take(x[:, :n], axis=0)
            for j in range(1, w):
                total += rows[j].take(x[:, j : j + n], axis=0)
            best.append(total.max(axis=1))
        z = np.maximum(np.concatenate(best, axis=1) + self.bias, 0) @ self.dense + self.dense_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(texts: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Windows of labelled text -> model, by Adam on the cross entropy; languages weigh alike. Rows are sorted first: their order doesn't matter."""
    langs = sorted(set(labels))
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    x = np.stack([windows(folded(texts[i][:WINDOW]))[0][0] for i in order])
    y = np.array([langs.index(labels[i]) for i in order])
    rnd = np.random.default_rng(seed)
    width = len(WIDTHS) * FILTERS
    p = {"embed": rnd.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(width), "dense": rnd.normal(0, 0.2, (width, len(langs))), "dense_bias": np.zeros(len(langs))}
    p |= {f"f{w}": rnd.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))).astype(np.float32)
    step = 0
    for _ in range(epochs):
        turn = rnd.permutation(len(y))
        for at in range(0, len(y), BATCH):
            i = turn[at : at + BATCH]
            bx, by, n = x[i], y[i], len(i)
            tables = {w: [p["embed"] @ p[f"f{w}"][j] for j in range(w)] for w in WIDTHS}
            top, where = [], []
            for w in WIDTHS:
                last = WINDOW - w + 1
                total = sum(tables[w][j][bx[:, j : j + last]] for j in range(w))
                where.append(total.argmax(axis=1))
                top.append(np.take_along_axis(total, where[-1][:, None, :], 1)[:, 0])
            h = np.concatenate(top, axis=1) + p["bias"]
            z = np.maximum(h, 0) @ p["dense"] + p["dense_bias"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), by] -= 1
            q *= weight[by][:, None] / n
            g = {"dense": np.maximum(h, 0).T @ q, "dense_bias": q.sum(axis=0)}
            gh = (q @ p["dense"].T) * (h > 0)
            g["bias"] = gh.sum(axis=0)
            g["embed"] = np.zeros_like(p["embed"])
            for k, w in enumerate(WIDTHS):
                gw, gf = gh[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(p[f"f{w}"])
                for j in range(w):
                    seen = np.take_along_axis(bx, where[k] + j, 1)  # the byte under each filter's best place
                    gf[j] = np.einsum("nfe,nf->ef", p["embed"][seen], gw)
                    np.add.at(g["embed"], seen, gw[:, :, None] * p[f"f{w}"][j].T[None])
                g[f"f{w}"] = gf
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    f32 = {k: v.astype(np.float32) for k, v in p.items()}
    return Model(langs, f32["embed"], {w: f32[f"f{w}"] for w in WIDTHS}, f32["bias"], f32["dense"], f32["dense_bias"])


def predict(model: Model | None, texts: list[str | None], tables=None) -> tuple[list[str], list[float]]:
    """The language of each whole text, and the mean probability that its windows give it."""
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if model is None or not use:
        return langs, scores
    tables = tables or model.tables()
    xs, held, owner = [], [], []
    for i in use:
        x, n = windows(folded(texts[i].encode()))
        xs.append(x)
        held.append(n)
        owner += [i] * len(n)
    x, held, owner = np.concatenate(xs), np.concatenate(held), np.array(owner)
    total = np.zeros((len(texts), len(model.langs)))
    mass = np.zeros(len(texts))
    for at in range(0, len(x), BATCH_WINDOWS):
        now = slice(at, at + BATCH_WINDOWS)
        np.add.at(total, owner[now], model.log_probs(x[now], tables) * held[now, None])
        np.add.at(mass, owner[now], held[now])
    for i in use:
        mean = np.exp((total[i] - total[i].max()) / mass[i])
        k = int(np.argmax(total[i]))
        langs[i], scores[i] = model.langs[k], float(mean[k] / mean.sum())
    return langs, scores


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, most: int = TRAIN_A_LANG) -> Model | None:
    """docs (doc_id, text, lang) -> model, from a bounded sample: the documents of each language with the smallest hashes, one window of each."""
    docs = docs.select("doc_id", "text", "lang")
    by = F.xxhash64(F.lit("train"), "doc_id", "text")
    n = F.length("text")
    start = F.pmod(F.xxhash64(F.lit("place"), "doc_id", "text"), F.greatest(n - WINDOW // 2, F.lit(1)))
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~is_held_out(F.col("doc_id")), F.lit(True)) & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    # rows of hashes below three times the share that is wanted: enough for the rank below, and as many for any size of the corpus
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 3 * most / n)) for k, n in counts.items()], "lang string, share double")
    few = known.withColumn("by", by).join(F.broadcast(share), "lang").filter(F.pmod("by", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    ranked = few.select("lang", "by", F.substring(F.col("text"), start.cast("int") + 1, F.lit(WINDOW)).alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("by", "part"))
    rows = ranked.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "part").collect()  # most windows a language
    return train([r.part.encode() for r in rows], [r.lang for r in rows]) if rows else None


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                langs, scores = predict(model, part.column(1).to_pylist(), tables)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double")


def rejected(text: str | None, lang: str, score: float, least: float = LEAST_SCORE) -> bool:
    """Whether no language can be told: und, or a score below least on at least WINDOW bytes (shorter texts say too little against them)."""
    return lang == UND or score < least and len(text.encode()) >= WINDOW


def kept(docs: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, that are not ``rejected``; without a model, und alone says so. No shuffle: rows are judged where they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(start, BATCH_DOCS)
                texts = part.column(at).to_pylist()
                yield part.filter(pa.array([not rejected(t, *x, least) for t, *x in zip(texts, *predict(model, texts, tables), strict=True)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, fit(docs))
    return out.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
