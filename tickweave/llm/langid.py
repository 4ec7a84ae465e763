"""Language identification by words first, then ever shorter character n-grams.

A word that the model knows scores its per-language log frequency. An unseen word backs off
to its character n-grams, ``LONGEST`` letters first, and takes the first length at which any
n-gram is known. The model comes from a bounded, hash-spread sample of the labelled rows of
each language: its words are counted first, then every distinct word's n-grams once, with the
word's count. Every labelled language is learned. The model is broadcast, so its size is
checked: beyond ``MOST_ENTRIES`` counts its use ends with an error instead of leaving
anything out.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, cut, field_of, small_batches

#: Most rows of a language (in expectation) that a fit reads; the sample is by hash of the id.
SAMPLE_ROWS = 8_000
#: Most counts of a model that is broadcast (about 40 bytes each in a worker), and most languages of a plan.
MOST_ENTRIES, MOST_LANGUAGES = 6_000_000, 2_000
#: Most frequencies of a size: its words or n-grams times the languages.
MOST_CELLS = 50_000_000
LONGEST = 5
#: Added to each count, and the default of the count below which a word or n-gram is no entry (its occurrences still count in the total).
SMOOTH, LEAST = 0.5, 2
#: Seed of Spark's ``xxhash64``.
HASH_SEED = 42
#: Bytes of known words' scores, and counts, that a task holds.
CACHE_BYTES, CACHE_COUNTS = 16 << 20, 60_000
#: Words that are looked up at once.
PIECE_WORDS = 40_000
UNKNOWN = "und"

#: ASCII marks, digits and controls become spaces; letters and all longer characters stay.
_SPLIT = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def _count_words(batches):
    """``lang, word, n`` of a batch."""
    from collections import Counter

    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by_lang.items():
            found = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), found, pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])


def _count_grams(batches):
    """``lang, size, gram, n``: each word under size 0, and its n-grams with the word's count."""
    from collections import Counter

    def out(counts):
        keys = list(zip(*counts)) if counts else [(), (), ()]
        kinds = (pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, kinds)), pa.array(counts.values(), pa.int64())], names=["lang", "size", "gram", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            counts[lang, 0, word] += n
            padded = f" {word} "
            for size in range(1, LONGEST + 1):
                for i in range(len(padded) - size + 1):
                    counts[lang, size, padded[i : i + size]] += n
            if len(counts) > CACHE_COUNTS:
                yield out(counts)
                counts.clear()
    if counts:
        yield out(counts)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """Counts ``lang, size, gram, n, total`` (size 0: words); rows without text or language are left out.

    Words and n-grams seen fewer than ``least`` times in a language's sample are no entries.
    More than ``MOST_LANGUAGES`` languages, or a model of more than ``MOST_ENTRIES`` counts
    (seen when it is used), are an error.
    """
    small_batches(train.sparkSession)
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return train.sparkSession.createDataFrame([], "lang string, size int, gram string, n bigint, total bigint")
    shares = train.sparkSession.createDataFrame([(r[0], min(1 << 30, int(SAMPLE_ROWS / r[1] * (1 << 30)))) for r in sizes], "lang string, share bigint")
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30))
    own = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), spot.alias("spot"))
    sample = own.join(F.broadcast(shares), "lang").where("spot < share").select("text", "lang")  # one row per language
    # few bytes but much work, which adaptive execution would put into one task
    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = sample.mapInArrow(_count_words, "lang string, word string, n bigint").repartition(tasks, "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = cut(words.mapInArrow(_count_grams, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    return counts.where(F.col("n") >= least).join(totals, ["lang", "size"])


def tables_of(found: pa.Table) -> tuple[list, list, list]:
    """Languages; by size, the sorted hashes of words or n-grams; by size, their log frequencies per language."""
    langs = sorted(found.column("lang").unique().to_pylist())
    tables, logs = [], []
    for size in range(LONGEST + 1):
        part = found.filter(pc.equal(found.column("size"), size))
        lang = pc.index_in(part.column("lang"), pa.array(langs, pa.string())).to_numpy()
        keys, at = np.unique(part.column("hash").to_numpy().view(np.uint64), return_inverse=True)
        if len(keys) * len(langs) > MOST_CELLS:
            raise ValueError(f"a model of more than {MOST_CELLS} frequencies; fit with a higher least count")
        totals = np.ones(len(langs))
        totals[lang] = part.column("total").to_numpy()
        counts = np.full((len(keys), len(langs)), SMOOTH)
        np.add.at(counts, (at, lang), part.column("n").to_numpy())
        tables.append(keys)
        logs.append(np.log(counts / (totals + SMOOTH * (len(counts) + 1))))
    return langs, tables, logs


class Model:
    """Scores of words from the tables of a fit."""

    def __init__(self, langs: list, tables: list, logs: list):
        self.langs, self.tables, self.logs = langs, tables, logs

    def _known(self, size: int, grams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which of them are entries, and where these are."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(HASH_SEED)), np.uint64, len(grams))
        table = self.tables[size]
        at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
        known = table[at] == keys if len(table) else np.zeros(len(grams), bool)
        return known, at[known]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Scores per language of each word: its own, or the mean of its known n-grams of the greatest length that has any."""
        out = np.zeros((len(words), len(self.langs)))
        texts = [w.decode("utf-8", "replace") for w in words]
        known, at = self._known(0, [t.encode() for t in texts])
        out[known] = self.logs[0][at]
        left = np.flatnonzero(~known)
        for size in range(LONGEST, 0, -1):
            grams = [[p[i : i + size].encode() for i in range(len(p) - size + 1)] for p in (f" {texts[i]} " for i in left.tolist())]
            owner = np.repeat(np.arange(len(left)), list(map(len, grams)))
            known, at = self._known(size, [g for own in grams for g in own])
            counts = np.bincount(owner[known], minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, owner[known], self.logs[size][at])
            some = counts > 0
            out[left[some]] = sums[some] / counts[some, None]
            left = left[~some]
            if not len(left):
                break
        return out


def _pieces(texts: list, most: int):
    """Lists of ``(text's place, words)`` with at most ``most`` words in all; long texts come in parts."""
    group, held = [], 0
    for at, text in enumerate(texts):
        words = words_of(text)
        for begin in range(0, len(words), most):
            part = words[begin : begin + most]
            if held + len(part) > most:
                yield group
                group, held = [], 0
            group.append((at, part))
            held += len(part)
    if group:
        yield group


def _predict(tables, text_col):
    def run(batches):
        own = Model(*tables.value)
        most = max(1_000, CACHE_BYTES // (8 * max(1, len(own.langs)) + 150))  # words held, with their scores
        rows = np.zeros((most, max(1, len(own.langs))))
        seen: dict[bytes, int] = {}
        for batch in batches:
            texts = field_of(batch, text_col).to_pylist()
            total, sizes = np.zeros((len(texts), max(1, len(own.langs)))), np.zeros(len(texts))
            for group in _pieces(texts, min(PIECE_WORDS, most // 2)) if own.langs else ():
                words = [w for _, part in group for w in part]
                new = list(set(words).difference(seen))
                if len(seen) + len(new) > most:
                    seen.clear()
                    new = list(set(words))
                if new:
                    rows[len(seen) : len(seen) + len(new)] = own.words(new)
                    seen.update(zip(new, range(len(seen), len(seen) + len(new))))
                at = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                lengths = np.fromiter((len(part) for _, part in group), np.int64, len(group))
                places = np.fromiter((i for i, _ in group), np.int64, len(group))
                np.add.at(total, places, np.add.reduceat(rows[at], np.cumsum(lengths) - lengths, axis=0))
                np.add.at(sizes, places, lengths)
            share = total / np.maximum(1.0, np.sqrt(sizes))[:, None]
            share = np.exp(share - share.max(axis=1, keepdims=True))
            best = share.argmax(axis=1)
            score = share[np.arange(len(texts)), best] / share.sum(axis=1)
            told = [bool(own.langs) and any(map(str.isalpha, t or "")) for t in texts]
            langs = [own.langs[b] if t else UNKNOWN for b, t in zip(best.tolist(), told)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string()), pa.array(np.where(told, score, 0.0), pa.float64())], names=["row", "lang_pred", "score"])
        pa.default_memory_pool().release_unused()  # what follows in this worker has the room

    return run


def predict(docs: DataFrame, counts: DataFrame, text_col: str | tuple[str, ...] = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``text_col`` is a column, or the path of a field in one. ``score`` is the predicted
    language's share of a softmax over the words' summed log frequencies, divided by the root
    of their number. Texts that are null or hold no letter get ``und`` and 0; so does every
    text if nothing was learned. Ties go to the language that sorts first. Repeated rows are
    predicted alike; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    # n-grams travel as hashes of 64 bits: what is not known is taken for known once in some 10 ** 13 look-ups
    found = counts.select("lang", "size", F.xxhash64("gram").alias("hash"), "n", "total").limit(MOST_ENTRIES + 1).toArrow()
    if found.num_rows > MOST_ENTRIES:
        raise ValueError(f"a model of more than {MOST_ENTRIES} counts; fit with a higher least count")
    tables = tables_of(found)
    packed = as_row(docs, "lang_pred", "score")
    schema = packed.select("row").schema.add("lang_pred", "string").add("score", "double")
    return packed.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(tables), text_col), schema).select("row.*", "lang_pred", "score")
