"""SentencePiece BPE encoding over a relational lattice, and decoding.

Each task walks its documents once and nothing is shuffled. Texts fall into stretches, cut
wherever no piece of the model holds the two characters that meet there, so that no merge can
reach across. Each stretch that is new to the task becomes a row; its substrings of at most
the longest piece's length are exploded and equi-joined to the piece table, the edges found
are grouped by stretch, and a Viterbi fold walks them with ``aggregate``. The document rows
follow the stretches they need, so the ids found are put in their places in the same pass.

In a BPE model one piece can end the encoding of a prefix, namely that which no merge across
its start would have broken up earlier. Grouping writes this into the edges: ``bad`` has a bit
for every edge ending at an edge's start after which it cannot stand, since some lattice edge
across that place comes before the merges that made the two neighbours. The fold keeps the
edge of each end that stands after the edge kept at its start. The result is the library's
own encoding, unlike a plain sum of scores.

The piece table is the vocabulary, bounded by ``MOST_PIECES``, and is broadcast. The order of
rows within a task matters (stretches, then the documents that hold them); explode, a
broadcast join from the left and Arrow maps all keep it, and a stretch that were missing or
incomplete would end the job with an error.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Most entries of a vocabulary that is broadcast; longest piece (bits of ``bad``).
MOST_PIECES, MOST_LENGTH = 1_000_000, 62
NEVER = 2**31 - 1
#: Stretches, and characters of them, that a task knows at a time; then it starts anew. Most of them in a dictionary.
HELD_STRETCHES, HELD_CHARS, RECENT = 1_000_000, 32_000_000, 50_000
#: Characters of a row that is exploded; ends of a block that is folded at a time.
WINDOW, BLOCK = 128, 256
#: Text read, edges grouped, and ids written, at a time.
SLICE_CHARS, GROUP_EDGES, SLICE_IDS = 1 << 17, 30_000, 1 << 17
#: Base of the polynomial hash by which a task tells stretches apart (modulo 2**64).
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load(path: str):
    """The model file's processor; BPE models with byte fallback are what this module reads."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def merges(word: str, rank: dict[str, int]) -> tuple[list[str], dict[str, tuple[str, str]]]:
    """Pieces of a word by greedy merging, and the two halves of every piece that was merged."""
    parts, halves = list(word), {}
    while True:
        found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not found:
            return parts, halves
        i = min(found)[1]
        whole = parts[i] + parts[i + 1]
        halves[whole] = (parts[i], parts[i + 1])
        parts[i : i + 2] = [whole]


class Pieces:
    """A model's pieces: ``rows`` of (piece, id), and by id the merge ``rank`` and the two spines.

    ``left[id, n]`` is the rank of the merge that ends the leading part of n characters of a
    piece (``NEVER`` for the piece itself), or -1 if no such part arises while it is merged;
    ``right`` says so of trailing parts. Pieces that merging never yields are left out.
    ``bonds`` are the character pairs inside pieces.
    """

    def __init__(self, path: str):
        model = load(path)
        count = model.get_piece_size()
        if count > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.first_byte = next((i for i in range(count) if model.is_byte(i)), -1)
        if self.first_byte < 0:
            raise ValueError("a model without byte pieces")
        names = {i: model.id_to_piece(i) for i in plain}
        rank = {names[i]: int(-model.get_score(i)) for i in plain}
        split: dict[str, tuple[str, str]] = {}
        for piece in names.values():
            if len(piece) > 1:
                parts, halves = merges(piece, rank)
                if parts == [piece]:
                    split[piece] = halves[piece]
        self.rows = [(piece, i) for i, piece in names.items() if len(piece) == 1 or piece in split]
        self.longest = max(len(piece) for piece, _ in self.rows)
        if self.longest > MOST_LENGTH:
            raise ValueError(f"a piece of more than {MOST_LENGTH} characters")
        self.bonds = {piece[j : j + 2] for piece, _ in self.rows for j in range(len(piece) - 1)}
        self.rank = np.zeros(count, np.int32)
        self.left, self.right = (np.full((count, self.longest + 1), -1, np.int32) for _ in range(2))
        for piece, i in self.rows:
            self.rank[i] = rank[piece]
            for side, spine in ((0, self.left), (1, self.right)):
                part, spine[i, len(piece)] = piece, NEVER
                while part in split:
                    ended, part = rank[part], split[part][side]
                    spine[i, len(part)] = ended


class Bonds:
    """Which characters of a model's pieces stand next to each other in some piece."""

    def __init__(self, table: Pieces):
        chars = sorted({c for pair in table.bonds for c in pair})
        self.of = np.zeros(ord(chars[-1]) + 2 if chars else 1, np.int32)  # 0: in no bond
        self.of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.many = len(chars) + 1
        self.bound = np.zeros(self.many * self.many, bool)
        for pair in table.bonds:
            a, b = (int(self.of[ord(c)]) for c in pair)
            self.bound[a * self.many + b] = True

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Places at which a stretch begins, the first one included."""
        kind = self.of[np.minimum(points, len(self.of) - 1)]
        return np.concatenate([[0], np.flatnonzero(~self.bound[kind[:-1] * self.many + kind[1:]]) + 1])


class _Held:
    """Number of each stretch by its 64-bit hash, in order of appearance; ``new`` are those not yet passed on."""

    def __init__(self):
        self.new, self.count, self.chars = [], 0, 0
        self.recent: dict[int, int] = {}  # joins the sorted arrays once there are many
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int32)

    def of(self, text: str, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the stretches of a text that begin at ``starts``."""
        sizes = np.diff(starts, append=len(points))
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        power = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
        hashes = np.add.reduceat((points + np.uint64(1)) * power[place], starts) ^ (sizes.astype(np.uint64) << np.uint64(40))
        coded = pa.array(hashes).dictionary_encode()
        codes, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        at = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == found if len(self.hashes) else np.zeros(len(found), bool)
        out = np.empty(len(found), np.int32)
        out[known] = self.numbers[at[known]]
        rest = np.flatnonzero(~known)
        for i, h in zip(rest.tolist(), found[rest].tolist()):
            number = self.recent.get(h)
            if number is None:
                self.recent[h] = number = self.count
                self.count += 1
                begin, size = int(starts[first[i]]), int(sizes[first[i]])
                self.new.append((number, text[begin : begin + size]))
                self.chars += size
            out[i] = number
        if len(self.recent) > RECENT:
            merged = np.concatenate([self.hashes, np.fromiter(self.recent.keys(), np.uint64)])
            numbers = np.concatenate([self.numbers, np.fromiter(self.recent.values(), np.int32)])
            order = np.argsort(merged)
            self.hashes, self.numbers, self.recent = merged[order], numbers[order], {}
        return out[codes]


#: ``doc`` packs a document's id (and whether it has one), its crc32 and its stretch numbers.
READ = "no int, base int, own int, text string, doc binary"
LATTICE = "no int, chars int, blocks array<array<struct<at:int,k:int,size:int,id:int,bad:bigint>>>, doc binary"
_HEAD = "<?qq"
_HEAD_BYTES = struct.calcsize(_HEAD)


def _lists(values: np.ndarray, lengths) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int32()))


def _read_batch(new: list[tuple[int, str]], done: list[bytes], longest: int) -> pa.RecordBatch:
    """Rows of the new stretches, long ones in overlapping windows, then rows of documents."""
    cut = []
    for number, stretch in new:
        for base in range(0, len(stretch), WINDOW):
            own = stretch[base : base + WINDOW]
            cut.append((number, base, len(own), stretch[base : base + len(own) + longest - 1]))
    columns = list(zip(*cut)) or [()] * 4
    front = [pa.concat_arrays([pa.array(c, k), pa.nulls(len(done), k)]) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
    return pa.RecordBatch.from_arrays([*front, pa.concat_arrays([pa.nulls(len(cut), pa.binary()), pa.array(done, pa.binary())])], names=["no", "base", "own", "text", "doc"])


def _numbered(held: _Held, ids: list, texts: list[str], bonds: Bonds) -> list[bytes]:
    """Packed documents of some texts."""
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    ends = np.cumsum([len(m) for m in marked])
    heads = [struct.pack(_HEAD, i is not None, i or 0, zlib.crc32(t.encode("utf-8", "surrogatepass"))) for i, t in zip(ids, texts)]
    whole = "".join(marked)
    if not whole:
        return heads
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.unique(np.concatenate([[0], ends[ends < len(whole)]]))
    starts = np.union1d(bonds.starts(points), begin)
    seq = held.of(whole, points, starts)
    until = np.searchsorted(starts, ends)
    return [h + seq[a:b].tobytes() for h, a, b in zip(heads, [0, *until[:-1]], until)]


def _read(bonds, longest: int):
    def run(batches):
        held = _Held()
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            sizes = np.asarray(pc.fill_null(pc.utf8_length(texts), 0))
            begin, chars = 0, 0
            for i, size in enumerate(sizes.tolist()):
                chars += size
                if chars > SLICE_CHARS or i + 1 == len(sizes):
                    if held.count > HELD_STRETCHES or held.chars > HELD_CHARS:
                        held = _Held()
                    done = _numbered(held, ids[begin : i + 1], [t or "" for t in texts.slice(begin, i + 1 - begin).to_pylist()], bonds.value)
                    yield _read_batch(held.new, done, longest)
                    held.new, begin, chars = [], i + 1, 0

    return run


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, the group and the place in it of each member."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def lattice_of(no: np.ndarray, start: np.ndarray, size: np.ndarray, piece: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers, lengths and edge blocks of stretches, from the edges of whole stretches in order.

    Edges are sorted by their end; ``k`` is an edge's place among those with the same end,
    ``at`` the place (from 1) of its start among the ends folded so far, 0 at the beginning.
    """
    first = np.flatnonzero(np.diff(no, prepend=no[0] - 1))
    word = np.repeat(np.arange(len(first)), np.diff(first, append=len(no)))
    chars = np.maximum.reduceat(start + size, first)
    base = np.cumsum(chars + 1) - (chars + 1)
    begin = base[word] + start
    order = np.argsort(begin + size, kind="stable")
    word, start, size, piece, begin = (x[order] for x in (word, start, size, piece, begin))
    end = begin + size
    nodes = np.arange(base[-1] + chars[-1] + 2)
    ending = np.searchsorted(end, nodes)
    by_begin = np.argsort(begin, kind="stable")
    starting = np.searchsorted(begin[by_begin], nodes)
    k = np.arange(len(end)) - ending[end]
    known, rank = np.maximum(piece, 0), table.rank

    merge = np.flatnonzero(size > 1)  # every edge of two characters or more is a merge
    group, place = _repeated(size[merge] - 1)
    merge, node = merge[group], begin[merge][group] + 1 + place  # a merge and a node inside it
    group, place = _repeated(ending[node + 1] - ending[node])
    x = ending[node][group] + place
    free = table.right[known[x], (node - begin[merge])[group]] > rank[known[merge]][group]
    after = np.zeros(len(merge), np.int64)  # of the edges ending at the node, those that the merge would have broken up
    np.bitwise_or.at(after, group[free], np.int64(1) << k[x[free]].astype(np.int64))
    merge, node, after = (v[after != 0] for v in (merge, node, after))
    group, place = _repeated(starting[node + 1] - starting[node])
    y = by_begin[starting[node][group] + place]
    free = table.left[known[y], (end[merge] - node)[group]] >= rank[known[merge]][group]
    bad = np.zeros(len(end), np.int64)
    np.bitwise_or.at(bad, y[free], after[group[free]])

    # edges that stand after none of those before them lead nowhere
    every = (np.int64(1) << (ending[begin + 1] - ending[begin]).astype(np.int64)) - 1
    live = (start == 0) | (bad != every)
    word, start, size, piece, k, bad = (v[live] for v in (word, start, size, piece, k, bad))
    block = (start + size - 1) // BLOCK
    at = np.where(block > 0, start - block * BLOCK + table.longest, start)
    cut = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(block, prepend=0) != 0))
    edges = pa.StructArray.from_arrays(
        [pa.array(c, t) for c, t in ((at, pa.int32()), (k, pa.int32()), (size, pa.int32()), (piece, pa.int32()), (bad, pa.int64()))], names=["at", "k", "size", "id", "bad"]
    )
    inner = pa.ListArray.from_arrays(pa.array(np.append(cut, len(word)), pa.int32()), edges)
    outer = pa.array(np.concatenate([[0], np.cumsum(-(-chars // BLOCK))]), pa.int32())
    return no[first], chars, pa.ListArray.from_arrays(outer, inner)


def _runs(batch: pa.RecordBatch, column: str):
    """Slices of a batch's rows that are all of stretches or all of documents: (is of documents, rows)."""
    doc = np.asarray(batch.column(column).is_null())
    edges = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip([0, *edges], [*edges, len(doc)]):
        if b > a:
            yield bool(doc[a]), batch.slice(a, b - a)


def _unpacked(edge: np.ndarray) -> list[np.ndarray]:
    """Number, start, size and piece of packed edges."""
    return [edge[:, 0] >> 32, edge[:, 0] & 0xFFFFFFFF, edge[:, 1] >> 32, (edge[:, 1] & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)]


def _grouped(table):
    names = ["no", "chars", "blocks", "doc"]
    kind = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("k", pa.int32()), ("size", pa.int32()), ("id", pa.int32()), ("bad", pa.int64())])))

    def laid(held: list[np.ndarray]) -> pa.RecordBatch:
        no, chars, blocks = lattice_of(*_unpacked(np.concatenate(held)), table.value)
        return pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(chars, pa.int32()), blocks.cast(kind), pa.nulls(len(no), pa.binary())], names=names)

    def run(batches):
        held: list[np.ndarray] = []  # edges of stretches, the last of which may go on in the next batch
        rows_held = 0
        for batch in batches:
            for docs, rows in _runs(batch, "whose"):
                if docs:
                    if held:
                        yield laid(held)
                        held, rows_held = [], 0
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, kind), rows.column("doc")], names=names)
                    continue
                new = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("whose", "what")], axis=1)
                numbers = new[:, 0] >> 32
                last = int(np.searchsorted(numbers, numbers[-1]))
                if rows_held + last > GROUP_EDGES and (last or held[-1][-1, 0] >> 32 != numbers[0]):
                    held.append(new[:last])
                    yield laid(held)
                    held, rows_held, new = [], 0, new[last:]
                held.append(new)
                rows_held += len(new)
        if held:
            yield laid(held)

    return run


class _Known:
    """Ids of the stretches known so far, by number."""

    def __init__(self):
        self.ids, self.filled = np.zeros(1024, np.int32), 0
        self.first, self.count, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0

    @staticmethod
    def _room(column: np.ndarray, need: int) -> np.ndarray:
        return column if need <= len(column) else np.concatenate([column, np.zeros(max(need - len(column), len(column)), column.dtype)])

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = self.size, len(counts)
        self.ids = self._room(self.ids, self.filled + len(ids))
        self.first, self.count = self._room(self.first, n + m), self._room(self.count, n + m)
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.count[n : n + m] = counts
        self.first[n : n + m] = self.filled + np.cumsum(counts) - counts
        self.filled, self.size = self.filled + len(ids), n + m

    def of(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of stretches, and how many each has."""
        if len(seq) and seq.max() >= self.size:
            raise RuntimeError("a document came before its stretches")
        counts = self.count[seq]
        group, place = _repeated(counts)
        return self.ids[self.first[seq][group] + place], counts


def _back(sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, chars: np.ndarray, longest: int, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of stretches, and how many each has, from the edges kept at all of their ends."""
    group, place = _repeated(lengths)
    own = (place < BLOCK) | ((place - BLOCK) % (BLOCK + longest) >= longest)  # later blocks begin with the last ends before them
    sizes, ids = sizes[own], ids[own]
    if not np.array_equal(np.bincount(group[own], minlength=len(chars)), chars):
        raise RuntimeError("a stretch without a path")
    offset = np.cumsum(chars) - chars
    at, live = chars.copy(), np.arange(len(chars))
    steps = []
    while len(live):
        edge = offset[live] + at[live] - 1
        steps.append((live, ids[edge]))
        at[live] -= sizes[edge]
        live = live[at[live] > 0]
    word = np.concatenate([w for w, _ in steps])
    counts = np.bincount(word, minlength=len(chars))
    step = np.repeat(np.arange(len(steps)), [len(w) for w, _ in steps])
    found = np.empty(len(word), np.int64)
    found[(np.cumsum(counts) - 1)[word] - step] = np.concatenate([i for _, i in steps])
    unknown = np.flatnonzero(found < 0)
    if len(unknown):
        spelled = [chr(-1 - int(found[i])).encode("utf-8", "surrogatepass") for i in unknown]
        width = np.ones(len(found), np.int64)
        width[unknown] = [len(s) for s in spelled]
        counts = np.bincount(np.repeat(np.arange(len(chars)), counts), weights=width, minlength=len(chars)).astype(np.int64)
        spread = np.repeat(found, width)
        spread[np.repeat(found < 0, width)] = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64) + first_byte
        found = spread
    return found.astype(np.int32), counts


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _placed(longest: int, first_byte: int):
    def run(batches):
        known = _Known()
        for batch in batches:
            for docs, rows in _runs(batch, "no"):
                if not docs:
                    if rows.column("no")[0].as_py() == 0:
                        known = _Known()
                    sizes, lengths = _flat(rows.column("sizes"))
                    ids, _ = _flat(rows.column("pieces"))
                    chars = rows.column("chars").to_numpy(zero_copy_only=False).astype(np.int64)
                    known.add(*_back(sizes, ids, lengths, chars, longest, first_byte))
                    continue
                packed = rows.column("doc").to_pylist()
                lengths = [(len(p) - _HEAD_BYTES) // 4 for p in packed]
                begin, filled = 0, 0
                for i, length in enumerate(lengths):
                    filled += length
                    if filled > SLICE_IDS // 4 or i + 1 == len(lengths):
                        part = packed[begin : i + 1]
                        ids, counts = known.of(np.frombuffer(b"".join([p[_HEAD_BYTES :] for p in part]), np.int32))
                        of_doc = np.bincount(np.repeat(np.arange(len(part)), lengths[begin : i + 1]), weights=counts, minlength=len(part)).astype(np.int64)
                        heads = [struct.unpack_from(_HEAD, p) for p in part]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([h[1] if h[0] else None for h in heads], pa.int64()), _lists(ids, of_doc), pa.array([h[2] for h in heads], pa.int64())], names=["id", "ids", "text_crc32"]
                        )
                        begin, filled = i + 1, 0

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, text_crc32`` for every row of ``docs``: its SentencePiece ids.

    Null and empty texts have no ids. Rows that repeat, or lack an id, are encoded each; other
    columns are ignored; an empty table gives an empty result. ``text_crc32`` is that of the
    text in UTF-8, by which a decoded text can be checked. A task holds the longest stretch of
    its documents, a text without any cut at worst; work is linear in it. Each task encodes
    a stretch once, so fewer, larger tasks have less to do.
    """
    small_batches(docs.sparkSession)
    table = Pieces(path)
    longest, context = table.longest, docs.sparkSession.sparkContext
    pieces = docs.sparkSession.createDataFrame(table.rows, "piece string, piece_id int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = rows.mapInArrow(_read(context.broadcast(Bonds(table)), longest), READ)
    edges = (
        read.select("no", "base", "own", "text", "doc", F.explode_outer(F.sequence(F.lit(0), F.col("own") - 1)).alias("from"))
        .select("no", "base", "text", "doc", "from", F.explode_outer(F.sequence(F.lit(1), F.when(F.col("own").isNotNull(), F.least(F.lit(longest), F.length("text") - F.col("from"))))).alias("size"))
        .select("no", "doc", (F.col("base") + F.col("from")).alias("start"), "size", F.substring("text", F.col("from") + 1, F.col("size")).alias("piece"))
        .join(F.broadcast(pieces), "piece", "left")  # at most MOST_PIECES rows
        .where(F.col("piece_id").isNotNull() | (F.col("size") == 1) | F.col("no").isNull())
    )
    pair = lambda high, low: F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(0xFFFFFFFF))
    packed = edges.select(
        pair(F.col("no"), F.col("start")).alias("whose"), pair(F.col("size"), F.coalesce("piece_id", -1 - F.ascii("piece"))).alias("what"), "doc"
    )
    lattice = packed.mapInArrow(_grouped(context.broadcast(table)), LATTICE)
    none = F.array().cast("array<struct<at:int,k:int,size:int,id:int,bad:bigint>>")

    def stands(taken, edge):
        return F.coalesce(F.getbit(edge["bad"], F.get(taken, edge["at"] - 1)["k"]), F.lit(0).cast("byte")) == 0

    def fold(block, before):
        return F.aggregate(block, before, lambda taken, edge: F.when(stands(taken, edge), F.concat(taken, F.array(edge))).otherwise(taken))

    # a block of ends at a time, so that long stretches are not copied at each end
    blocks = F.aggregate("blocks", F.array(none), lambda done, block: F.concat(done, F.array(fold(block, F.slice(F.element_at(done, -1), -longest, longest)))))
    taken = lattice.select("no", "chars", F.flatten(blocks).alias("taken"), "doc")
    kept = taken.select("no", "chars", F.col("taken.size").alias("sizes"), F.col("taken.id").alias("pieces"), "doc")
    placed = kept.mapInArrow(_placed(longest, table.first_byte), "id bigint, ids array<int>, text_crc32 bigint")
    return placed.select(F.col("id").alias(id_col), "ids", "text_crc32")


def _decoded(table, ids_col: str):
    def run(batches):
        spelled, first, count = table.value
        for batch in batches:
            column = batch.column("row").field(ids_col)
            ids, lengths = _flat(column)
            begin, until = 0, np.cumsum(lengths)
            while begin < len(lengths):
                before = until[begin] - lengths[begin]
                end = max(begin + 1, int(np.searchsorted(until, before + SLICE_IDS, side="right")))
                part = ids[before : until[end - 1]]
                group, place = _repeated(count[part])
                text = spelled[first[part][group] + place].tobytes()
                stop = np.concatenate([[0], np.cumsum(count[part])])[until[begin:end] - before].tolist()
                there = column.slice(begin, end - begin).is_valid().to_pylist()
                texts = [text[a:b].decode("utf-8", "replace")[1:] if ok else None for a, b, ok in zip([0, *stop[:-1]], stop, there)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(begin, end - begin), pa.array(texts, pa.string())], names=["row", "decoded"])
                begin = end

    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids as ``decoded``; null ids give null, no ids an empty text.

    Byte pieces are put together to characters; word marks become spaces and the first one
    goes. A text that holds the mark itself comes back with a space for it.
    """
    model = load(path)
    pieces = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode()
        for i in range(model.get_piece_size())
    ]
    count = np.array([len(p) for p in pieces], np.int64)
    table = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(count) - count, count
    plain = encoded.drop("decoded")
    packed = plain.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("row"))
    schema = packed.select("row").schema.add("decoded", "string")
    return packed.mapInArrow(_decoded(encoded.sparkSession.sparkContext.broadcast(table), ids_col), schema).select("row.*", "decoded")
