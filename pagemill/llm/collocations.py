"""Frequent phrases that hang together, by Rabin-Karp fingerprints of all n-grams.

Texts are split into pieces and words. The prefix polynomial of a batch's bytes,
with one space between words, gives the fingerprint of any n-gram by one
subtraction; the text's language is mixed in.

1. Fingerprints of one and two words are counted: a slice of text combines its
   own, Spark combines what a task has seen before the shuffle, and each
   fingerprint comes with a pointer, the number of a document that holds it.
   Those seen ``least`` times at least are frequent.
2. Longer n-grams are counted in the same way, but only where every two
   neighbouring words are a frequent fingerprint: no other can be frequent.
   Workers look that up in sorted files of the shared folder, which they map.
3. The pointers of the frequent fingerprints go to the tasks that scan their
   documents; each cuts out its phrases. Only frequent phrases become text.
4. All texts are scanned once more and every occurrence of a frequent
   fingerprint is compared, byte by byte and with its language, with the phrase
   cut out for it. Occurrences that differ (collisions) are counted by their
   text and taken off, so all counts are exact.
5. Cuts, containment and ranks are joins, aggregates and a window over the
   table of frequent phrases.

Counts of parts are those of frequent phrases: a part is at least as frequent
as the whole. The shared folder must be mounted on all machines, since files
are mapped.

Defined results: a null text is empty, a null language is ``und``; ids are not
looked at, and repeated rows count as often as they occur; texts without
frequent phrases and empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import beside, local_path, materialise, mix, own_rows, pick, prefix_hashes, range_hashes, ranges, shared_path, slices, utf8, with_rid
from pagemill.llm.lm import _open, _save

#: Occurrences of a candidate, its most words, and phrases returned of each language.
LEAST, MOST, FIRST = 100, 5, 2000
#: A candidate goes if a longer phrase around it has this share (percent) of its occurrences.
SHARE = 100
#: Frequent fingerprints in a file.
FILE_KEYS = 1 << 16
#: The language of texts without one.
NO_LANG = "und"

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_CUT = np.array([b in b".,;:!?\n\x0b\x0c\r" for b in range(256)])
_WORD = np.array([b not in b".,;:!?\n\x0b\x0c\r \t" for b in range(256)])


class Words:
    """The words of a batch of texts: their bytes with a space before each, where
    each starts and ends there, its text and its piece."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        raw = _LOWER[raw]
        word = _WORD[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[off] = True
        before = np.concatenate([[False], word[:-1]]) if len(raw) else word
        starts = np.flatnonzero(word & (~before | first[:-1]))
        self.text = np.searchsorted(off, starts, side="right") - 1
        self.piece = (np.cumsum(_CUT[raw]) if len(raw) else np.zeros(0, np.int64))[starts] + self.text
        upto = np.append(np.concatenate([[0], np.cumsum(word)])[starts], np.count_nonzero(word))
        length = np.diff(upto)
        self.end = np.cumsum(length + 1)
        self.start = self.end - length
        self.raw = np.full(int(self.end[-1]) if len(starts) else 0, 32, np.uint8)
        self.raw[ranges(self.start, length)] = raw[word]

    def __len__(self) -> int:
        return len(self.start)

    def together(self, n: int) -> np.ndarray:
        """Which words begin n words of one piece."""
        return np.flatnonzero(self.piece[n - 1:] == self.piece[:len(self) - n + 1]) if len(self) >= n else np.zeros(0, np.int64)


def fingerprint(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(sums, starts, ends)


def _seeds(langs: list[str]) -> np.ndarray:
    of = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([of[x] for x in langs], np.uint64)


def grams(words: Words, langs: list[str], lengths: tuple[int, ...], known: Callable | None, prints: Callable = fingerprint) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words, fingerprints) of all n-grams of these lengths. Those of three
    words and more only where ``known`` has all pairs of neighbouring words."""
    sums, seeds = prefix_hashes(words.raw), _seeds(langs)

    def of(at: np.ndarray, n: int) -> np.ndarray:
        found = mix(prints(sums, words.start[at], words.end[at + n - 1]) ^ seeds[words.text[at]])
        return found >> np.uint64(1) << np.uint64(1) | np.uint64(n > 2)  # the last bit tells the two counts apart

    pairs = None
    for n in lengths:
        at = words.together(n)
        if n > 2:
            if pairs is None:
                two = words.together(2)
                good = np.zeros(len(words) + 1, bool)
                good[two[known(of(two, 2))]] = True
                pairs = np.concatenate([[0], np.cumsum(good)])
            at = at[pairs[at + n - 1] - pairs[at] == n - 1]
        yield n, at, of(at, n)


class Table:
    """Sorted fingerprints in mapped files, one for each range of keys, and what stands beside them."""

    def __init__(self, folder: str, n_ranges: int):
        self.folder, self.edges, self.open = folder, edges_of(n_ranges), {}

    def file(self, name: str, kind: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = _open(self.folder, name, kind)
        return self.open[name]

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, which of the keys, their places there) of those that are in the table."""
        order = np.argsort(keys)
        at = np.append(np.searchsorted(keys[order], self.edges), len(keys))
        at[0] = 0
        for r in np.flatnonzero(np.diff(at)).tolist():
            table, own = self.file(f"key-{r}", "<u8"), order[at[r]:at[r + 1]]
            if len(table):
                place = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
                hit = table[place] == keys[own]
                yield r, own[hit], place[hit]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for _, own, _ in self.find(keys):
            out[own] = True
        return out


def edges_of(n_ranges: int) -> np.ndarray:
    return (np.arange(n_ranges, dtype=object) * (1 << 64) // n_ranges).astype(np.uint64)


def _table(rows: DataFrame, n: int, columns: str) -> Table:
    """Writes rows of ``_cl_fp`` (and ``lang``, ``phrase``) as a table of so many ranges."""
    n_ranges = max(1, -(-n // FILE_KEYS))
    edges = edges_of(n_ranges)
    folder = local_path(shared_path(rows.sparkSession, "phrases"))

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pick(batch, "_cl_fp").to_numpy().view(np.uint64)
            yield batch.append_column("r", pa.array((np.searchsorted(edges, fp, side="right") - 1).astype(np.int32)))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)  # of one range
        if not own:
            return
        held = pa.Table.from_batches(own)
        r = held.column("r")[0].as_py()
        fp = held.column("_cl_fp").to_numpy().view(np.uint64)
        order = np.argsort(fp)
        os.makedirs(folder, exist_ok=True)
        if "phrase" in held.schema.names:
            raw, off = utf8(held.column("phrase").take(pa.array(order)))
            _save(folder, f"end-{r}", off[1:].astype("<u8"))
            _save(folder, f"text-{r}", raw)
            _save(folder, f"lang-{r}", _seeds(held.column("lang").take(pa.array(order)).to_pylist()).astype("<u8"))
        _save(folder, f"key-{r}", fp[order].astype("<u8"))
        yield pa.RecordBatch.from_arrays([pa.array([held.num_rows], pa.int64())], names=["n"])

    saved = rows.mapInArrow(range_of, f"{columns}, r int").repartitionById(n_ranges, F.col("r")).mapInArrow(save, "n long")
    if (saved.agg(F.sum("n")).first()[0] or 0) != n:
        raise RuntimeError("the table of phrases is not whole")
    return Table(folder, n_ranges)


def _count(rows: DataFrame, lengths: tuple[int, ...], known: Table | None, least: int, prints: Callable) -> DataFrame:
    """Fingerprints seen ``least`` times at least, with how often, and a document's number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_cl_text"):
            words = Words(*utf8(pick(batch, "_cl_text")))
            rid = pick(batch, "_cl_rid").to_numpy()
            for _, at, fp in grams(words, pick(batch, "_cl_lang").to_pylist(), lengths, known, prints):
                distinct, first, times = np.unique(fp, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct.view(np.int64)), pa.array(times), pa.array(rid[words.text[at[first]]])], names=["_cl_fp", "_cl_times", "_cl_rid"])

    found = rows.mapInArrow(run, "_cl_fp long, _cl_times long, _cl_rid long")
    # of all documents the one whose scan is nearest to bits of the fingerprint: each scan gets its share of pointers
    bits = F.shiftleft(F.shiftrightunsigned("_cl_fp", 34), 33)
    found = found.withColumn("_cl_rid", F.col("_cl_rid").bitwiseXOR(bits)).groupBy("_cl_fp").agg(F.sum("_cl_times").alias("_cl_times"), F.min("_cl_rid").alias("_cl_rid")).where(F.col("_cl_times") >= least)
    return materialise(found.withColumn("_cl_rid", F.col("_cl_rid").bitwiseXOR(bits)), "fingerprints")


def _cut_out(rows: DataFrame, frequent: DataFrame, lengths: tuple[int, ...], known: Table, prints: Callable) -> DataFrame:
    """(_cl_fp, lang, phrase): the text of each frequent fingerprint, from the document it points to."""
    wanted = beside(frequent.select("_cl_rid", "_cl_fp"), "_cl_rid", "pointers-by-scan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in slices(batches, "_cl_text"):
            rid = pick(batch, "_cl_rid").to_numpy()
            if mine is None:
                mine = own_rows(wanted, int(rid[0] >> 33))
                if mine is None:
                    return
                mine = mine.sort_by([("_cl_rid", "ascending"), ("_cl_fp", "ascending")])
                owner, keys = mine.column("_cl_rid").to_numpy(), mine.column("_cl_fp").to_numpy().view(np.uint64)
            a, b = np.searchsorted(owner, rid[0]), np.searchsorted(owner, rid[-1], side="right")
            if a == b:
                continue
            langs, words = pick(batch, "_cl_lang").to_pylist(), Words(*utf8(pick(batch, "_cl_text")))
            found_fp, found_at, found_n = [], [], []
            for n, at, fp in grams(words, langs, lengths, known, prints):
                here = np.isin(fp, keys[a:b])
                found_fp.append(fp[here])
                found_at.append(at[here])
                found_n.append(np.full(int(here.sum()), n))
            fp, at, size = (np.concatenate(x) for x in (found_fp, found_at, found_n))
            # one occurrence for each pair of document and fingerprint that is asked for
            order = np.lexsort((at, fp, rid[words.text[at]]))
            fp, at, size, doc = fp[order], at[order], size[order], rid[words.text[at]][order]
            ask = {(x, y) for x, y in zip(owner[a:b].tolist(), keys[a:b].tolist())}
            one = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])])) if len(fp) else np.zeros(0, np.int64)
            one = one[np.fromiter(((x, y) in ask for x, y in zip(doc[one].tolist(), fp[one].tolist())), bool, len(one))]
            start, end = words.start[at[one]], words.end[at[one] + size[one] - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[one].view(np.int64)), pa.array([langs[t] for t in words.text[at[one]].tolist()], pa.string()),
                 pa.array([words.raw[x:y].tobytes().decode() for x, y in zip(start.tolist(), end.tolist())], pa.string())], names=["_cl_fp", "lang", "phrase"])

    return materialise(rows.mapInArrow(run, "_cl_fp long, lang string, phrase string"), "phrases")


def _differing(rows: DataFrame, table: Table, lengths: tuple[int, ...], known: Table, prints: Callable) -> DataFrame:
    """(fp, lang, phrase, times): occurrences of frequent fingerprints whose text or
    language is another than the phrase of the fingerprint; and each language's
    words as rows without a phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_cl_text"):
            langs, words = pick(batch, "_cl_lang").to_pylist(), Words(*utf8(pick(batch, "_cl_text")))
            seeds, other = _seeds(langs), Counter()
            for t, k in enumerate(np.bincount(words.text, minlength=len(langs)).tolist()):
                other[(0, langs[t], None)] += k
            for n, at, fp in grams(words, langs, lengths, known, prints):
                start, end = words.start[at], words.end[at + n - 1]
                for r, own, place in table.find(fp):
                    ends, text = table.file(f"end-{r}", "<u8"), table.file(f"text-{r}", "u1")
                    to = ends[place].astype(np.int64)
                    size = to - np.where(place > 0, ends[np.maximum(place, 1) - 1].astype(np.int64), 0)
                    same = (end[own] - start[own] == size) & (table.file(f"lang-{r}", "<u8")[place] == seeds[words.text[at[own]]])
                    k = np.flatnonzero(same)
                    differ = words.raw[ranges(start[own[k]], size[k])] != text[ranges(to[k] - size[k], size[k])]
                    same[k] = np.bincount(np.repeat(np.arange(len(k)), size[k]), differ, len(k)) == 0
                    for x in own[~same].tolist():
                        other[(int(fp[x:x + 1].view(np.int64)[0]), langs[words.text[at[x]]], words.raw[start[x]:end[x]].tobytes().decode())] += 1
            keys = list(other)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(other.values()), pa.int64())],
                names=["_cl_fp", "lang", "phrase", "times"])

    found = rows.mapInArrow(run, "_cl_fp long, lang string, phrase string, times long")
    return materialise(found.groupBy("_cl_fp", "lang", "phrase").agg(F.sum("times").alias("times")), "differing")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = MOST, prints: Callable = fingerprint) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``most`` words that occur
    ``least`` times at least in a language, and (lang, n): the languages' words."""
    rows = with_rid(docs.select(F.col(text_col).alias("_cl_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("_cl_lang")), "_cl_rid")
    every = tuple(range(1, most + 1))
    short = _count(rows, every[:2], None, least, prints)
    known = _table(short.select("_cl_fp"), short.count(), "_cl_fp long")
    frequent = short
    if most > 2:
        frequent = short.unionByName(_count(rows, every[2:], known, least, prints))
    phrases = _cut_out(rows, frequent, every, known, prints)
    table = _table(phrases, phrases.count(), "_cl_fp long, lang string, phrase string")
    differing = _differing(rows, table, every, known, prints)
    return _counted(frequent, phrases, differing, least), differing.where("phrase IS NULL").select("lang", F.col("times").alias("n"))


def _counted(frequent: DataFrame, phrases: DataFrame, differing: DataFrame, least: int) -> DataFrame:
    """Exact counts: those of the fingerprints without what differs, and what differs by its text."""
    other = differing.where("phrase IS NOT NULL")
    off = other.groupBy("_cl_fp").agg(F.sum("times").alias("off"))
    cut = phrases.join(frequent, "_cl_fp").join(off, "_cl_fp", "left").select("lang", "phrase", (F.col("_cl_times") - F.coalesce("off", F.lit(0))).alias("f"))
    both = cut.unionByName(other.select("lang", "phrase", F.col("times").alias("f")))
    out = both.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    words = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
    return materialise(out.select("lang", "phrase", words.alias("words"), "f"), "frequent-phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most: int = MOST, first: int = FIRST, share: int = SHARE, prints: Callable = fingerprint) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    phrases, total = frequent_phrases(docs, text_col, lang_col, least, most, prints)
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = phrases.select("lang", F.col("phrase").alias("part"), "f")
    split = F.split("phrase", " ")

    def words(start, length) -> F.Column:
        return F.array_join(F.slice(split, start, length), " ")

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", words(F.lit(1), F.col("k")).alias("head"), words(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "tail", "r"), ["lang", "tail"]).join(total, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731 - exact: products pass 64 bits
    cuts = cuts.withColumn("over", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(17,0)"))).withColumn("under", whole("l") * F.col("r").cast("decimal(18,0)"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("best"))

    inner = candidates.where("words > 2").select("lang", "words", "a", split.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    stays = best.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stays.select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x != '') AS w FROM pieces
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size)
), f AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM f WHERE size > 1)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n,
         CAST((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail JOIN total t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + size2 - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(generate_series(1, size - size2 + 1)) AS i
        FROM (SELECT *, unnest(generate_series(2, size - 1)) AS size2 FROM f WHERE size > 2))
  GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE around IS NULL OR 100 * around < 100 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
