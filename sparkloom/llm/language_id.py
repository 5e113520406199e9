"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letters are lower-cased; all else is a word boundary. The character 2- to 4-grams of
the words, boundaries included, are hashed to rows of an embedding table; their average goes
through a linear layer. Table and layer are trained together by stochastic gradient descent in
numpy, on random stretches of a bounded sample of labelled texts, so that short texts are
learned as well. On a part of that sample which isn't trained on, a temperature is fitted by
likelihood, and the least score is chosen from which predictions are accepted.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, small_side
from sparkloom.llm.shingles import _splitmix, stream

BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
#: Labelled rows that are fitted at most, and the bytes of their texts at most.
TRAIN_ROWS, TRAIN_BYTES = 6000, 48 << 20
EPOCHS, RATE = 6, 0.5
#: Share of errors among accepted predictions that calibration aims at.
ERRORS = 0.01

_LETTER = np.array([chr(i).isalpha() for i in range(0x32400)])
_MIX = stream(max(ORDERS), 77) | np.uint64(1)


def subwords(text: str) -> np.ndarray:
    """Hashed subwords in text order; empty if the text has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(codes), bool)
    low = codes < len(_LETTER)
    letter[low] = _LETTER[codes[low]]
    if not letter.any():
        return np.empty(0, np.int64)
    # Each run of other characters is one boundary, 0; there is one at either end.
    c = np.zeros(len(codes) + 2, np.uint64)
    c[1:-1] = np.where(letter, codes, 0)
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    out = []
    with np.errstate(over="ignore"):
        inner = c != 0
        for n in ORDERS:
            if len(c) < n:
                continue
            m = len(c) - n + 1
            whole = inner[: m].copy() if n == 2 else np.ones(m, bool)
            for k in range(1, n - 1):
                whole &= inner[k : k + m]
            if n == 2:
                whole |= inner[1 : 1 + m]
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h += c[k : k + m] * _MIX[k]
            out.append((_splitmix(h) >> np.uint64(48)).astype(np.int64)[whole])
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, h: np.ndarray) -> np.ndarray:
        return self.table[h].mean(axis=0) @ self.weights + self.bias

    def compiled(self) -> np.ndarray:
        """Of embedding table and layer, one table if that is narrower."""
        return (self.table @ self.weights).astype(np.float32) if len(self.languages) <= DIM else self.table


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], languages: list[str], seed: int = 7) -> Model | None:
    rows = [(h, lang) for h, lang in ((subwords(t), lang) for t, lang in zip(texts, languages, strict=True)) if len(h)]
    if not rows:
        return None
    names = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    y = np.array([names.index(lang) for _, lang in rows])
    model = Model(names, rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32))
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :] if len(rows) >= 5 else order
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(used):
            h = rows[i][0]
            size = min(len(h), int(2 ** rng.uniform(2, 12)))
            at = rng.integers(0, len(h) - size + 1)
            idx, n = np.unique(h[at : at + size], return_counts=True)
            share = (n / n.sum()).astype(np.float32)
            mean = share @ model.table[idx]
            slope = _softmax(mean @ model.weights + model.bias)
            slope[y[i]] -= 1
            back = model.weights @ slope
            model.weights -= rate * np.outer(mean, slope)
            model.bias -= 0.1 * rate * slope
            # A subword's step is divided by its share's root, so rare ones learn as well.
            model.table[idx] -= (rate * 4) * np.outer(np.sqrt(share) / np.sqrt(len(share)), back)
    if len(held):
        z = np.array([model.logits(rows[i][0]) for i in held])
        right = y[held]
        model.temperature = float(min((0.05 * 1.25**k for k in range(24)), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), right] + 1e-12).mean()))
        p = _softmax(z / model.temperature)
        by = np.argsort(-p.max(axis=1))
        wrong = np.cumsum(p.argmax(axis=1)[by] != right[by]) / np.arange(1, len(by) + 1)
        sure = np.flatnonzero(wrong <= ERRORS)
        model.least = float(p.max(axis=1)[by][sure[-1]]) if len(sure) else 1.0
    return model


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """text, lang of the documents that are fitted: `rows` at most, with `size` bytes of text at most.

    Documents that may be learned from have a language, a text and an identifier whose checksum isn't
    divisible by 5. Of each language an equal number is drawn, those whose identifier and text have the least
    hashes; a language with fewer gives all it has. Languages take turns, so that the bounds cut the last
    turns and not a language while there are fewer languages than rows. Rows that repeat are one. Which rows
    are drawn depends on nothing but the rows."""
    code = F.xxhash64(F.lit("language"), F.col(id_col), F.col(text_col))
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    known = known.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), code.alias("code"))
    counts = materialise(known.groupBy("lang").agg(F.approx_count_distinct("code", 0.05).alias("n")), "language-counts")
    languages = counts.count()
    # Hashes are even, so this share of them has `each` rows of a language and enough to spare for the error of the
    # estimate; small languages go whole.
    each = max(1, rows // max(1, languages))
    share = F.least(F.lit(1.0), F.lit(1.4 * each + 6 * each**0.5 + 20) / F.col("n"))
    marked = known.join(small_side(counts, 200_000), "lang").where(F.pmod("code", F.lit(1 << 40)) < share * (1 << 40))
    near = materialise(marked.select("lang", "code", F.octet_length("text").cast("long").alias("size"), "text").dropDuplicates(["lang", "code"]), "language-near")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("code", F.lit(1 << 40)), "code"))
    first = near.select("lang", "code", "size", turn.alias("turn")).where(F.col("turn") <= each)
    first = first.orderBy("turn", "lang").limit(rows)
    taken = F.sum("size").over(Window.orderBy("turn", "lang").rowsBetween(Window.unboundedPreceding, 0))  # `rows` rows at most
    chosen = materialise(first.withColumn("taken", taken).where(F.col("taken") <= size).select("lang", "code"), "language-drawn")
    return near.join(small_side(chosen, rows), ["lang", "code"]).select("text", "lang")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model | None:
    """The model of the documents that `draw` takes; None if there are none with a letter. Only these go to the driver."""
    got = draw(docs, id_col, text_col, lang_col, rows, size).toArrow()
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    return train([t for t, _ in pairs], [x for _, x in pairs])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, lang_pred, score, accepted.

    Only the text decides. A text that is null or has no letter, and every text if nothing
    was learned, is `und` with score 0. accepted: the score reaches the calibrated least. Of languages
    with equal scores the first by name is taken. A row without an identifier isn't held out, nor learned
    from. Rows that repeat get the same answer each; other columns are ignored, whatever their names; an
    empty table gives an empty result."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps((model.languages, model.compiled(), model.weights, model.bias, model.temperature, model.least) if model else None))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = pickle.loads(shared.value)
        for batch in batches:
            names, scores, sure = [], [], []
            for text in batch.column(2):
                t = text.as_py()
                h = subwords(t) if t and learned else ()
                if not len(h):
                    names.append("und"), scores.append(0.0), sure.append(False)
                    continue
                languages, table, weights, bias, temperature, least = learned
                z = table[h].mean(axis=0)
                z = (z if table.shape[1] == len(languages) and len(languages) <= DIM else z @ weights) + bias
                p = _softmax(z.astype(np.float64) / temperature)
                k = int(p.argmax())
                names.append(languages[k]), scores.append(float(p[k])), sure.append(bool(p[k] >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], names=["id", "held_out", "lang_pred", "score", "accepted"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    narrow = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(predicted, f"id {kind}, held_out boolean, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)
