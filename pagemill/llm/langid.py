"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts by (language, bucket) are gathered in Spark. The model, one row of log
probabilities per language, has languages x 2**BITS numbers whatever the size
of the corpus, and is broadcast; texts are scored in batches, each a sparse sum
of its n-grams' rows.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text where nothing could be learned; of equally likely
languages the first in order wins; rows with a null language or id are not
learned from; repeated rows count as often as they occur; an empty table gives
no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import mix, mod_of_id, pick, segment_sums, slices

#: Hash buckets: 2**BITS.
BITS = 15
#: Lengths of the character n-grams.
SIZES = (1, 2, 3)
#: Added to every count.
ALPHA = 0.1
#: The answer where there is nothing to go by.
UNKNOWN = "und"


def grams(texts: list[str | None], bits: int = BITS, sizes=SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and how many each text has.

    A text gets a blank before and after it; n-grams do not cross texts.
    """
    padded = [f" {t.lower()} " if t else "" for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner_end = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(chars))
    found, counts, h = [], np.zeros(len(padded), np.int64), np.zeros(len(chars), np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[:len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1:] + np.uint64(n) if len(chars) >= n else h[:0]
        if n in sizes:
            ok = place[:len(h)] + n <= owner_end[:len(h)]
            found.append(np.where(ok, mix(h) >> np.uint64(64 - bits), np.uint64(1 << bits)).astype(np.int64))
    # the n-grams of a text together: one column per size, unused places last
    width = np.full((len(chars), len(sizes)), 1 << bits, np.int64)
    for k, b in enumerate(found):
        width[:len(b), k] = b
    flat = width.ravel()
    used = flat < 1 << bits
    counts = segment_sums(used.reshape(-1, len(sizes)).sum(axis=1, dtype=np.int64), lengths)
    return flat[used], counts


@dataclass
class Model:
    """Languages in order and their log probabilities, (buckets, languages)."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        buckets, counts = grams(texts)
        sums = segment_sums(self.logp[buckets], counts) + self.prior
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, share, 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows of ``docs`` with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, text_col):
            langs = pick(batch, lang_col).to_pylist()
            buckets, counts = grams(pick(batch, text_col).to_pylist())
            owner = np.repeat(np.arange(len(langs)), counts)
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])
            seen = np.bincount(which[owner] * (1 << BITS) + buckets, minlength=len(names) << BITS).reshape(len(names), -1)
            for k, name in enumerate(names):
                own = total.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
                own[:-1] += seen[k]
                own[-1] += int((which == k).sum())  # documents, for the prior
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col), F.col(text_col)).where(F.col(lang_col).isNotNull())
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one packed row per language: languages x 2**BITS numbers at most
    table = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toPandas().sort_values("lang")
    langs = table["lang"].tolist()
    full = np.zeros((len(langs), (1 << BITS) + 1))
    for k, (b, n) in enumerate(zip(table["b"], table["n"])):
        full[k, np.asarray(b, np.int64)] = np.asarray(n)
    grams_of, docs_of = full[:, :-1] + ALPHA, full[:, -1]
    prior = np.log(docs_of / docs_of.sum()) if len(langs) else np.zeros(0)
    return Model(langs, np.ascontiguousarray((np.log(grams_of) - np.log(grams_of.sum(axis=1, keepdims=True))).T), prior)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` without its text, plus the predicted language and its posterior probability."""
    rest = [f for f in docs.schema.fields if f.name != text_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            langs, scores = sent.value.score(pick(batch, text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pick(batch, f.name) for f in rest), pa.array(langs, pa.string()), pa.array(scores)], names=[*(f.name for f in rest), lang_col, score_col])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    held_out = mod_of_id("doc_id", 4) == 2
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
