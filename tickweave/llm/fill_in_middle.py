"""Fill-in-the-middle: a document cut in three by token, and put together in another order.

Tokens are the isolated matches of a pattern by the tokenizers library's ``Split``
pre-tokenizer, which needs no vocabulary; it gives their places in code points. The array of
places says how many tokens there are, and two ranks in it where to slice the text. All draws
come from a hash of seed and id, so a run can be repeated and a row judged alone.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: White space and the word behind it, or white space alone.
PATTERN = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that go to the pre-tokenizer at once; longer texts are cut where a word ends.
BLOCK = 1 << 16
_WORD_END = re.compile("[^\\x20\\x09-\\x0D](?=[\\x20\\x09-\\x0D])")


@cache
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), behavior="isolated")


def token_places(text: str) -> np.ndarray:
    """Where each token begins, in code points."""
    found, begin = [], 0
    while begin < len(text):
        end = len(text)
        if end - begin > BLOCK:
            match = _WORD_END.search(text, begin + BLOCK)
            end = match.end() if match else end
        tokens = _splitter().pre_tokenize_str(text[begin:end])
        found.append(np.fromiter((place[0] for _, place in tokens), np.int64, len(tokens)) + begin)
        begin = end
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _cut(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        first, second = (batch.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
        sizes, parts = [], []
        for text, a, b in zip(texts, first.tolist(), second.tolist()):
            places = np.append(token_places(text), len(text))
            sizes.append(len(places) - 1)
            low, high = sorted((a % len(places), b % len(places)))
            parts.append((text[: places[low]], text[places[low] : places[high]], text[places[high] :]))
        columns = [pa.array(x, pa.string()) for x in zip(*parts)] if parts else [pa.array([], pa.string())] * 3
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h3"), batch.column("h4"), pa.array(sizes, pa.int64()), *columns], names=["id", "h3", "h4", "n", "p", "m", "s"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, percent_spm: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n, form, prefix, middle, suffix, output``.

    The first four groups of eight digits of the hex SHA-256 of ``seed:id`` are h1 to h4. Of n
    tokens the prefix takes the smaller of h1 and h2 modulo n + 1, the middle goes on to the
    larger, the suffix is the rest. ``form`` is ``psm`` (prefix, suffix, middle, each behind its
    mark), ``spm`` (suffix, prefix, middle) where h4 modulo 100 is below ``percent_spm``, or
    ``plain``: the text as it is, where h3 modulo 100 is not below ``percent``, where the text
    is empty, and where it holds a mark already, so that ``restored`` always gives it back. A
    plain row's parts are null.

    A null text is an empty one. A null id is hashed as an empty one; rows that repeat an id
    draw alike; other columns are ignored and may have any name; an empty table gives an
    empty result. Long texts are tokenised in blocks; a task holds one text and its places.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.sha2(key.cast("binary"), 256).alias("hash"))
    draws = [F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    cut = rows.select("id", "text", *draws).mapInArrow(_cut, f"id {kind}, h3 bigint, h4 bigint, n bigint, p string, m string, s string")
    text = F.concat("p", "m", "s")
    marked = F.greatest(*[F.instr(text, mark) for mark in (PREFIX, SUFFIX, MIDDLE)]) > 0
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < percent_spm, "spm").otherwise("psm")
    prefix, middle, suffix = F.concat(F.lit(PREFIX), "p"), F.concat(F.lit(MIDDLE), "m"), F.concat(F.lit(SUFFIX), "s")
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.concat(prefix, suffix, middle))
    shown = [F.when(F.col("form") != "plain", F.col(c)).alias(name) for c, name in (("p", "prefix"), ("m", "middle"), ("s", "suffix"))]
    return cut.withColumn("form", form).select(F.col("id").alias(id_col), "n", "form", *shown, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts stand between marks that no part holds."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
