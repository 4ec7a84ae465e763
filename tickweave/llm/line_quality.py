"""Line-first cleaning: rules on each line, then a verdict on what the document has lost.

A line without words is neither judged nor lost. A line goes if any of these rules fails it:

* navigation: at least two separators, and one to every four words;
* punctuation: it has fewer than ``SHORT`` words and no sentence end, or at least
  ``SYMBOLS`` symbols and more than three of them to ten words;
* boilerplate: at most ``NOTICE`` words, with one of ``PHRASES`` in it.

A document is rejected if the lines that went held more than half of its word characters, or
by the base rules: too few words, or too many inside repeated windows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .word_arrays import WordIds, group_starts, numbered, order_of, slices

#: Words of a window (a power of two); the least words of a text; the most percent of its words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SHORT, SYMBOLS, NOTICE = 5, 3, 25
#: Of 100 word characters, the most that removed lines may have held.
MOST_LOST = 50

#: Phrases of boilerplate, in lower case.
PHRASES = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "privacy policy",
    "read more", "share this", "sign in", "sign up for our newsletter", "skip to content", "terms of service", "terms of use", "this site uses cookies",
)
#: Marks that end a sentence, what may close it behind them, separators of menus, and symbols.
ENDS, CLOSERS, SEPARATORS, SYMBOL_MARKS = ".!?…:;。！？", "\"')]»”’", "|»›•·", "#*$%&|<>"

_END = re.compile(f"[{ENDS}][{re.escape(CLOSERS)}]*[\\x20\\x09-\\x0D]*\\Z")
_SEPARATOR = re.compile(f"[{SEPARATORS}]")
_SYMBOL = re.compile(f"[{re.escape(SYMBOL_MARKS)}]")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)), re.IGNORECASE | re.ASCII)
#: The words' white space; str.split takes more.
_SPACE = dict.fromkeys([32, *range(9, 14)])


def failed_rule(line: str, n_words: int) -> str | None:
    """The first rule that fails a line of ``n_words`` words, or None."""
    separators = len(_SEPARATOR.findall(line))
    if separators >= 2 and 4 * separators >= n_words:
        return "navigation"
    symbols = len(_SYMBOL.findall(line))
    if n_words < SHORT and not _END.search(line) or symbols >= SYMBOLS and 10 * symbols > 3 * n_words:
        return "punctuation"
    if n_words <= NOTICE and _PHRASE.search(line):
        return "boilerplate"
    return None


def repeated_words(symbols: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of ``window`` words (a power of two) that its text holds twice or more.

    Texts are closed by ``window`` zeros each; equal windows get equal numbers by doubling, so
    nothing hangs on a hash.
    """
    name = owner * (int(symbols.max()) + 1) + symbols
    size = 1
    while True:
        order = order_of(name)
        start = group_starts(name[order])
        if size == window:
            break
        name = np.empty(len(symbols), np.int64)
        name[order] = start
        name = name * len(symbols) + np.append(name[size:], np.zeros(min(size, len(name)), np.int64))
        size *= 2
    more = np.bincount(start, minlength=len(symbols))[start] > 1
    whole = np.append(symbols[window - 1 :], np.zeros(window - 1, np.int64)) != 0
    at = order[more]
    at = at[whole[at]]
    change = np.zeros(len(symbols) + window + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return np.cumsum(change)[: len(symbols)] > 0


def _cleaned(text: str) -> tuple[str, int, int, int, dict[str, int]]:
    """Kept lines; word characters, characters lost with lines, repeated lines; lines gone by rule."""
    held = lost = again = 0
    kept, seen, gone = [], set(), {}
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        if not words:
            kept.append(line)
            continue
        if line in seen:
            again += 1
        seen.add(line)
        size = len(line.translate(_SPACE))
        held += size
        rule = failed_rule(line, len(words))
        if rule is None:
            kept.append(line)
        else:
            lost += size
            gone[rule] = gone.get(rule, 0) + 1
    return "\n".join(kept), held, lost, again, gone


def _judge(batches):
    ids = WordIds()
    for batch in batches:
        at = 0
        for part in slices(batch.column("text")):
            symbols, begins = numbered([t.split() if t else [] for t in part], ids, gap=WINDOW)
            sizes = np.diff(begins)
            n_words = sizes - WINDOW
            marked = repeated_words(symbols, np.repeat(np.arange(len(part)), sizes))
            texts = [t.decode("utf-8", "replace") if t else "" for t in part]
            found = [_cleaned(t) for t in texts]
            counts = [
                n_words, [f[1] for f in found], [len(_SYMBOL.findall(t)) for t in texts], [f[3] for f in found], np.add.reduceat(marked.astype(np.int64), begins[:-1]),
                [f[2] for f in found], *[[f[4].get(rule, 0) for f in found] for rule in ("navigation", "punctuation", "boilerplate")],
            ]
            cleaned = pa.array([f[0] if t is not None else None for f, t in zip(found, part)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(part)), *[pa.array(c, pa.int64()) for c in counts], cleaned], names=["id", *COUNTS, "cleaned"])
            at += len(part)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "n_navigation", "n_punctuation", "n_boilerplate"]


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, counts, ``cleaned``, ``base_failed``, ``kept``.

    Counts are of the whole text as it stands: words ``[^\\x20\\x09-\\x0D]+``, their characters,
    symbols, lines with a word that equal an earlier line, words inside repeated windows;
    then the word characters that went with failed lines, and the lines that each rule took
    (the first that fails, in the order of the module's text). ``cleaned`` is the text without
    those lines.

    A null text counts as empty, and its ``cleaned`` is null; texts without words fail the
    base rules. A row without id keeps its null, repeated rows are judged each, other columns
    are ignored and may have any name, and an empty table gives an empty result. A text is
    worked on as a whole in one task, in memory of about 100 bytes a word.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_judge, ", ".join([f"id {kind}", *[f"{c} bigint" for c in COUNTS], "cleaned string"]))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > MOST_LOST * F.col("word_chars")
    return out.select(F.col("id").alias(id_col), *COUNTS, "cleaned", base_failed.alias("base_failed"), (~base_failed & ~lost).alias("kept"))
