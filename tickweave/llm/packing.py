"""Order-preserving packing of documents into training sequences by dynamic programming.

Each task streams the documents of its partition in stored order as one line of tokens and
cuts it into windows of at most ``SEQUENCE`` tokens. Cuts lie at document ends (free), at
sentence ends (``SENTENCE_CUT`` per cut) or, in a run of tokens without either, at fixed
steps (``HARD_CUT``); a window is padded up to ``SEQUENCE`` unless its length is a power of
two. The cheapest cuts are found over a horizon of ``HORIZON`` windows: padding is linear in
the window's start, so the best start is the head of a monotone queue, and the starts at a
power of two before a place are looked up beside it. Nothing is shuffled and a task holds one
horizon and one document, so a lost task is simply run again with the same result.
"""

from __future__ import annotations

import codecs
import itertools
import os
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SEQUENCE = 2048
HORIZON = 64
#: Penalties and the cost of one more sequence, in tokens of padding.
SENTENCE_CUT, HARD_CUT, SEQUENCE_COST = 2, 24, 4
#: Window lengths below SEQUENCE that need no padding.
POWERS = tuple(1 << i for i in range(SEQUENCE.bit_length() - 1))
#: Longest run of tokens without a place to cut.
HARD_STEP = 256
END_ID = 1
#: White-space-free chunks whose ids a task keeps; bytes of text that are split at once.
CACHE, SLICE = 300_000, 1 << 20

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def sentence_ends(tokenizer) -> np.ndarray:
    """By token id, whether a sentence can end with the token."""
    vocab = tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 2, bool)
    for token, i in vocab.items():
        ends[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return ends


#: Marks that neither start a special token nor an English contraction.
PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
MARKS = frozenset(PUNCTUATION.encode())
#: Printable stand-ins of the bytes that byte-level BPE vocabularies do not write as themselves.
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_LEVEL = "".join(chr(256 + _UNPRINTED.index(b)) if b in _UNPRINTED else chr(b) for b in range(256))


class ChunkIds:
    """Token ids of texts, by white-space-free chunks: no token of this tokenizer spans white space.

    A chunk of Latin-1 letters with punctuation around it, the usual case, needs no
    normaliser or splitting rule but lower case, so its letters go to the BPE model at once;
    any other chunk goes through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.tails = tokenizer, {"": b""}
        # of each table a full generation is set aside, from which what is met again comes back
        self.known, self.before = {}, {}
        self.words, self.words_before = {}, {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.words_before.get(word)
            if found is None:
                spelled = word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", BYTE_LEVEL)[0]
                found = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
            self.words[word] = found
        return found

    def _run(self, marks: str) -> bytes:
        if marks not in self.tails:
            self.tails[marks] = self._ids(marks)
        return self.tails[marks]

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) > CACHE:
            self.before, self.known = self.known, {}
        if len(self.words) > CACHE:
            self.words_before, self.words = self.words, {}
        known, before = self.known, self.before
        back = chunks & before.keys()
        for chunk in back:
            known[chunk] = before.pop(chunk)
        new = [c for c in chunks if c not in known]
        if len(self.tails) > 1000:
            self.tails = {"": b""}
        for chunk in new:
            if chunk.isalpha():  # ASCII letters alone
                known[chunk] = self._word(chunk.lower().decode())
                continue
            if chunk[:-1].isalpha() and chunk[-1] in MARKS:  # and one mark behind them
                known[chunk] = self._word(chunk[:-1].lower().decode()) + self._run(chr(chunk[-1]))
                continue
            text = chunk.decode()
            head = text.lstrip(PUNCTUATION)
            core = head.rstrip(PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                ids = self._word(core.lower())
                if len(core) < len(text):
                    ids = self._run(text[: len(text) - len(head)]) + ids + self._run(head[len(core) :])
                known[chunk] = ids
            else:
                known[chunk] = self._ids(text)

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [t.split() if t else [] for t in texts]
        self.learn(set(itertools.chain.from_iterable(split)))
        known, end = self.known, np.array([END_ID], "<u4").tobytes()
        return [np.frombuffer(b"".join([known[c] for c in s]) + end, "<u4") for s in split]


#: Texts on which chunk-wise ids must equal the tokenizer's own, or the whole tokenizer is used.
PROBES = ("A bc, d'ef!\tGhi\n\njk  L-m 12 3.", "(\u00c9t\u00e9) \u00fcber-Na\u00efve; it's caf\u00e9...", "x  y\r\nz \u65e5\u672c \u2603 <|endoftext|>")


class WholeIds:
    """Token ids of texts by a tokenizer that may look across white space."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array([*f.ids, END_ID], "<u4") for f in found]


def splits_at_spaces(path: str) -> bool:
    """Whether the ids of a text are those of its white-space-free chunks."""
    tokenizer = load_tokenizer(path)
    whole, chunks = WholeIds(tokenizer), ChunkIds(tokenizer)
    probes = [p.encode() for p in PROBES]
    words = (t.removesuffix("</w>") for t in whole.tokenizer.get_vocab())
    spans = any(c.isspace() or c in "\u0120\u2581" for w in words if len(w) > 1 for c in w)
    try:
        return not spans and all(np.array_equal(a, b) for a, b in zip(whole.of(probes), chunks.of(probes)))
    except Exception:  # a model without chunk-wise access
        return False


def cut_places(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (tokens before the cut) and penalties of one document, its end included."""
    at = np.flatnonzero(ends[ids]) + 1
    at = at[at < len(ids) - 1]  # the closing id stays with its last sentence
    at = np.append(at, len(ids))
    gaps = np.diff(at, prepend=0)
    cost = np.full(len(at), SENTENCE_CUT)
    cost[-1] = 0
    if (gaps > HARD_STEP).any():
        extra = np.concatenate([np.arange(e - g + HARD_STEP, e, HARD_STEP) for e, g in zip(at[gaps > HARD_STEP], gaps[gaps > HARD_STEP])])
        at, cost = np.append(at, extra), np.append(cost, np.full(len(extra), HARD_CUT))
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


def padding(length: int) -> int:
    return 0 if length & (length - 1) == 0 else SEQUENCE - length


def best_cuts(places: np.ndarray, penalties: np.ndarray, last: bool) -> list[int]:
    """Cheapest cuts of the tokens up to the last place, as places; the line starts at 0.

    Not ``last``: the end stays open, and cuts are given up to the best one within the last window.
    """
    at = np.concatenate([[0], places])
    exact: dict[int, list[int]] = {}  # by place, the starts at a power of two before it
    for length in POWERS:
        j = np.minimum(np.searchsorted(at, at - length), len(at) - 1)
        hit = np.flatnonzero(at[j] == at - length)
        for i, start in zip(hit.tolist(), j[hit].tolist()):
            exact.setdefault(i, []).append(start)
    pos, pen = at.tolist(), [0, *penalties.tolist()]
    cost, back, key = [0] * len(pos), [0] * len(pos), [0] * len(pos)
    queue: deque[int] = deque([0])  # starts by rising cost + place
    for i, here in enumerate(pos):
        if not i:
            continue
        low = here - SEQUENCE
        while pos[queue[0]] < low:
            queue.popleft()
        j = queue[0]
        best = key[j] - low
        for p in exact.get(i, ()):
            if cost[p] < best:
                best, j = cost[p], p
        best += pen[i] + SEQUENCE_COST
        cost[i], back[i] = best, j
        best += here
        key[i] = best
        while queue and key[queue[-1]] >= best:
            queue.pop()
        queue.append(i)
    i = len(pos) - 1
    if not last:
        first = int(np.searchsorted(pos, pos[-1] - SEQUENCE, side="right"))
        i = min(range(max(first, 1), len(pos)), key=lambda x: (cost[x] - pos[x] // 256, -x)) if first < len(pos) else i
    found = []
    while i:
        found.append(pos[i])
        i = back[i]
    return found[::-1]


class Packer:
    """Packs a stream of (id, token ids); holds the tokens that no finished sequence has."""

    def __init__(self, first_sequence: int, ends: np.ndarray):
        self.sequence, self.ends = first_sequence, ends
        self.docs: deque[tuple] = deque()  # key, ids, place of its first token, tokens already out
        self.places, self.costs = [], []
        self.tokens = 0

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        at, cost = cut_places(ids, self.ends)
        self.docs.append((key, ids, self.tokens))
        self.places.append(at + self.tokens)
        self.costs.append(cost)
        self.tokens += len(ids)
        out = []
        if self.tokens >= HORIZON * SEQUENCE:
            out = self.flush(last=False)
        return out

    def flush(self, last: bool) -> list[tuple]:
        if not self.tokens:
            return []
        places, costs = np.concatenate(self.places), np.concatenate(self.costs)
        cuts = best_cuts(places, costs, last)
        out, begin = [], 0
        for end in cuts:
            at = begin
            while at < end:
                key, ids, base = self.docs[0]
                start, stop = at - base, min(len(ids), end - base)
                crc = zlib.crc32(ids[start:stop])
                out.append((key, max(start, 0), stop - start, crc, len(ids), self.sequence, at - begin))
                at = base + stop
                if stop == len(ids):
                    self.docs.popleft()
            self.sequence += 1
            begin = end
        keep = places > begin
        self.places, self.costs = [places[keep] - begin], [costs[keep]]
        self.docs = deque((k, ids, base - begin) for k, ids, base in self.docs)
        self.tokens -= begin
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _pack(path: str, by_chunks: bool):
    def run(batches):
        tokenizer = load_tokenizer(path)
        found = (ChunkIds if by_chunks else WholeIds)(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 36, sentence_ends(tokenizer))
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            size, begin = 0, 0
            for i, length in enumerate(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])):
                size += int(length)
                if size >= SLICE or i + 1 == len(texts):
                    keys = batch.column("doc_id").slice(begin, i + 1 - begin).to_pylist()
                    rows: list[tuple] = []
                    for key, ids in zip(keys, found.of(texts.slice(begin, i + 1 - begin).to_pylist())):
                        rows += packer.add(key, ids)
                    size, begin = 0, i + 1
                    if rows:
                        yield _batch(rows)
        if rows := packer.flush(last=True):
            yield _batch(rows)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids followed by id 1; null and empty texts are that id alone.
    ``start`` is the piece's place in its document and ``offset`` its place in the sequence,
    both gapless from 0; every token lies in one piece. A row without id is packed with a
    null ``doc_id``, repeated rows are packed each, other columns are ignored, and an empty
    table gives an empty result. Documents keep the order in which the table stores them
    within a partition; each partition begins a sequence of its own.

    The cuts are the cheapest ones of each horizon of ``HORIZON`` windows at document ends,
    sentence ends and, in runs of more than ``HARD_STEP`` tokens without either, at steps of
    ``HARD_STEP``; a longer horizon or a finer step could only save padding at their seams.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pack(tokenizer_path, splits_at_spaces(tokenizer_path)), PIECES)
