"""Quality classifier: hashed word n-grams, logistic regression by FTRL.

A text's words and runs of punctuation, and pairs of neighbours, are hashed
into 2**BITS buckets; each counts with its share of the text. A word equal to
the one before it, or to the last but one, is also hashed as just "same again",
so that repetition counts alike whatever is repeated. Weights are
learned with follow-the-regularised-leader (per-coordinate steps, L1 and L2)
on a bounded sample of labelled rows: the sample is dealt to ``SHARDS`` groups
that learn side by side, and their weights are averaged. The model has
2**BITS + 1 numbers; a score is the sparse dot product of a text's buckets.

The sample holds about ``SAMPLE_ROWS`` labelled rows, drawn by a hash of the
id, or all rows where there are fewer; that bound is the only one.

Defined results: a null text counts as empty and gets the intercept's score;
rows with a null id or label are not learned from; without labels every score
is 0.5; repeated rows are scored alike; an empty table gives no rows; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import byte_hash, mix, mod_of_id, pick, read_table, runs, segment_sums, slices, utf8

#: Hash buckets: 2**BITS.
BITS = 18
#: Labelled rows to learn from, about.
SAMPLE_ROWS = 12_000
#: Groups that learn side by side, and passes over each group's rows.
SHARDS, EPOCHS = 6, 4
#: FTRL: step size and its offset, L1 and L2.
STEP, OFFSET, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: A bucket counts with this times its share of the text.
SCALE = 10.0
#: Scores from here on are predicted to be label 1.
THRESHOLD = 0.3

#: Kinds of bytes: 0 white space, 1 of words (ASCII letters and digits, all beyond ASCII), 2 the rest.
_KIND = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.int8)

#: Buckets of "same as the word before" and "same as the last but one".
_SAME = (mix(np.arange(1, 3, dtype=np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and pairs of each text in turn, and how many each text has."""
    kind = _KIND[raw]
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    starts, ends = runs(kind.astype(np.int64) + 3 * owner)
    words = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[words], ends[words]
    of = owner[starts]
    one = byte_hash(raw, starts, ends)
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    pair = of[:-1] == of[1:]
    bucket = np.full((len(one), 3), 1 << BITS, np.int64)
    bucket[:, 0] = (one >> np.uint64(64 - BITS)).astype(np.int64)
    bucket[:-1, 1][pair] = (two >> np.uint64(64 - BITS)).astype(np.int64)[pair]
    for back, same in ((2, _SAME[1]), (1, _SAME[0])):
        bucket[back:, 2][(one[back:] == one[:-back]) & (of[back:] == of[:-back])] = same
    flat = bucket.ravel()
    used = flat < 1 << BITS
    return flat[used], np.bincount(np.repeat(of, 3)[used], minlength=len(off) - 1).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the intercept) from (buckets, values, label) rows."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(z, n):
        w = (np.sign(z) * L1 - z) / ((OFFSET + np.sqrt(n)) / STEP + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    for _ in range(epochs):
        for at, x, label in rows:
            w = weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / STEP * w
            n[at] += g * g
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from labelled rows of ``docs``; zeros where there are none."""
    usable = labels.select(F.col(id_col).alias("_q_id"), F.col(label_col).alias("_q_label")).where(F.col("_q_id").isNotNull() & F.col("_q_label").isNotNull())
    rate = sample_rows / max(1, usable.count())
    draw = F.pmod(F.xxhash64(F.col("_q_id").cast("string"), F.lit("sample")), F.lit(1 << 20))
    sample = usable.where(draw < int(min(1.0, rate) * (1 << 20)))
    # the sample has about sample_rows small rows, so it is sent to the scan of the texts
    texts = docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_text")).join(F.broadcast(sample), "_q_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_q_text"):
            buckets, counts = features(*utf8(pick(batch, "_q_text")))
            at = np.concatenate([[0], np.cumsum(counts)])
            rows = [np.unique(buckets[a:b], return_counts=True) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "_q_id").cast(pa.string()), pick(batch, "_q_label").cast(pa.int64()),
                 pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()),
                 pa.array([(r[1] * (SCALE / max(1, r[1].sum()))).astype("<f4").tobytes() for r in rows], pa.binary())],
                names=["id", "label", "at", "x"])

    def learn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("at").to_pylist(), mix(np.array([hash_of(x) for x in group.column("id").to_pylist()], np.uint64))))
        at, x, y = (group.column(c).to_pylist() for c in ("at", "x", "label"))
        bias = np.array([1 << BITS])
        w = ftrl([(np.concatenate([np.frombuffer(at[i], "<i4"), bias]), np.concatenate([np.frombuffer(x[i], "<f4"), [1.0]]), y[i]) for i in order])
        used = np.flatnonzero(w)
        return pa.table({"bucket": used, "w": w[used]})

    def hash_of(text: str) -> int:
        import xxhash
        return xxhash.xxh64_intdigest(text, 7)

    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(SHARDS))
    rows = texts.mapInArrow(sparse, "id string, label long, at binary, x binary").withColumn("shard", shard)
    found = rows.groupBy("shard").applyInArrow(learn, "bucket long, w double")
    mean = found.groupBy("bucket").agg((F.sum("w") / SHARDS).alias("w")).toPandas()  # 2**BITS + 1 rows at most
    out = np.zeros((1 << BITS) + 1)
    out[mean["bucket"].to_numpy(np.int64)] = mean["w"].to_numpy()
    return out


def predict(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` plus the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in slices(batches, text_col):
            buckets, counts = features(*utf8(pick(batch, text_col)))
            dot = segment_sums(w[buckets], counts) * (SCALE / np.maximum(1, counts)) + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-dot)))], names=[*batch.schema.names, score_col])

    if score_col in docs.columns:
        raise ValueError(f"column {score_col} is there already")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return mod_of_id(id_col, 5) == 0


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    weights = train(docs, labels.where(~held_out()))
    scored = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted to be of good quality."""
    weights = train(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return predict(docs, weights, "text", "_q_score").where(F.col("_q_score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
