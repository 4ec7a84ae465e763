"""MinHash near-dedup by a signature-coordinate inverted join.

Texts become sets of hashed word shingles; equal sets form one class, and classes are the
nodes from here on, so copies never meet each other. Each class posts itself under its
``COORDINATES`` (coordinate, minimum) pairs. A pair must collide on ``MATCHES`` of them:

* prefix: with the coordinates of a class ordered from rare to frequent, two such classes
  share one among the first ``COORDINATES - MATCHES + 1`` of each; a coordinate that no
  other class has leads nowhere, so most classes drop out at once;
* skip: inside a posting list every class is first counted against the list's head only.
  Lists whose classes are then all in one component are skipped whole. The other lists
  are merged: every pair across components is counted, short lists by a join on the key,
  long ones, put together by their head, in blocks that emit only links between
  components, so at most one per class.

Survivors are confirmed on their full shingle sets, then joined to components. With 48
coordinates and 26 matches a pair at a similarity of exactly 0.8 is missed with a
probability of about 2e-5, a closer one with less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized, small_batches, words_of
from .graph import connected_components

COORDINATES = 48
MATCHES = 26
#: Longest posting list whose pairs are joined on the key; longer ones go in blocks.
SHORT_LIST = 64
#: Rows, and shingles in all, of a block of a long posting list.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Word hashes kept in a task.
CACHE = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = rng.integers(0, 2**63, size=(2, COORDINATES), dtype=np.uint64)
    return (draw[0] << np.uint64(1)) | np.uint64(1), draw[1]


def shingle_set(text: bytes | None, width: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    ids = np.array([cache[w] for w in words], np.uint64)
    span = min(width, len(ids))
    out = np.full(len(ids) - span + 1, span, np.uint64)
    for j in range(span):
        out = (out ^ ids[j : j + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's hash over the set, as 32 bits."""
    low = np.full(len(mult), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        block = shingles[at : at + 1024][None, :] * mult[:, None] + add[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _binary(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def _signatures(width: int):
    def run(batches):
        cache, (mult, add) = _WordHashes(), _coefficients()
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for text in _binary(batch.column("text")):
                found = shingle_set(text, width, cache)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found, mult, add) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                names=["id", "n", "digest", "sig"],
            )

    return run


def _sets(width: int):
    def run(batches):
        cache = _WordHashes()
        for batch in batches:
            found = [shingle_set(t, width, cache) for t in _binary(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
                names=["digest", "shingles"],
            )

    return run


def _digests(width: int):
    def run(batches):
        cache = _WordHashes()
        for batch in batches:
            found = [shingle_set(t, width, cache) for t in _binary(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found], pa.binary())], names=["row", "digest"]
            )

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]).astype(int)


def _block_links(num: int, den: int):
    """Links that join two components among the pairs of two blocks of one posting list."""

    def run(table: pa.Table) -> pa.Table:
        digests = table.column("digest").to_pylist()
        side, lo, hi = (table.column(c).to_numpy() for c in ("block", "lo", "hi"))
        sig = _lists(table.column("sig"))[0].reshape(len(digests), -1)
        values, offsets = _lists(table.column("shingles"))
        sizes = np.diff(offsets)
        _, values = np.unique(values, return_inverse=True)
        names = {r: i for i, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
        root = np.array([names[r] for r in table.column("root").to_pylist()])
        mark = np.zeros(values.max() + 1, np.int32)
        own, other = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        found: list[tuple] = []
        for i in own:
            at = other[root[other] != root[i]]
            small, large = np.minimum(sizes[at], sizes[i]), np.maximum(sizes[at], sizes[i])
            at = at[den * small >= num * large]
            at = at[(sig[at] == sig[i]).sum(axis=1) >= MATCHES]
            if not len(at):
                continue
            mark[values[offsets[i] : offsets[i + 1]]] = 1
            cells = np.concatenate([values[offsets[j] : offsets[j + 1]] for j in at])
            shared = np.add.reduceat(mark[cells], np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
            mark[values[offsets[i] : offsets[i + 1]]] = 0
            for j in at[den * shared >= num * (sizes[i] + sizes[at] - shared)]:
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    found.append((digests[i], digests[j]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return run


def _shingles(classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``digest, shingles`` of the named classes (``digest, id``), from the text of the row that stands for each.

    A class that holds no id is found by its digest among the rows without id; these are read
    only if there is such a class.
    """
    schema = "digest binary, shingles array<bigint>"
    sets = texts.join(classes.where("id is not null").select("id").distinct(), "id", "left_semi").select("text").mapInArrow(_sets(width), schema)
    nameless = classes.where("id is null").select("digest").distinct()
    if nameless.limit(1).count():
        sets = sets.union(texts.where("id is null").select("text").mapInArrow(_sets(width), schema).join(nameless, "digest", "left_semi"))
    return sets.groupBy("digest").agg(F.any_value("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs that collide on MATCHES coordinates and are similar on their full sets."""
    a = classes.select(F.col("digest").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"), F.col("id").alias("id_a"))
    b = classes.select(F.col("digest").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"), F.col("id").alias("id_b"))
    same = F.size(F.filter(F.arrays_zip("sig_a", "sig_b"), lambda z: z["sig_a"] == z["sig_b"]))
    likely, _ = sized(
        pairs.join(a, "a").join(b, "b")
        .where((den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")) & (same >= MATCHES))
        .select("a", "b", "n_a", "n_b", "id_a", "id_b")
    )
    sides = [likely.select(F.col(x).alias("digest"), F.col(f"id_{x}").alias("id")) for x in ("a", "b")]
    sets = cut(_shingles(sides[0].union(sides[1]), texts, width))
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return (
        likely.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("s_a")), "a")
        .join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("s_b")), "b")
        .withColumn("shared", shared)
        .where(den * F.col("shared") >= num * (F.col("n_a") + F.col("n_b") - F.col("shared")))
        .select("a", "b")
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """``id, n, digest`` of each row, and ``digest, component_id, copies, first, members`` of each class.

    Classes are compared by their digests, whether or not a row of theirs has an id;
    ``component_id`` is the least id of the class's component, ``first`` its least digest, ``members`` its rows.
    """
    num, den = similarity
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut(texts.mapInArrow(_signatures(width), "id bigint, n bigint, digest binary, sig array<int>"))
    classes = cut(
        rows.where("n > 0").groupBy("digest")
        .agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    )
    posts = classes.select("digest", F.posexplode("sig").alias("at", "low")).select(
        "digest", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("low").cast("long")).alias("key")
    )
    often = posts.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ordered = (
        posts.join(often, "key").groupBy("digest")
        .agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("keys"))
        .where(F.size("keys") >= MATCHES)
    )
    prefix, _ = sized(
        ordered.select("digest", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (MATCHES - 1))).alias("k"))
        .select("digest", F.col("k.key").alias("key"))
    )
    heads, _ = sized(prefix.groupBy("key").agg(F.min("digest").alias("head"), F.count(F.lit(1)).alias("length")).where("length > 1"))
    first = prefix.join(heads, "key").where("digest <> head").select(F.col("head").alias("a"), F.col("digest").alias("b")).distinct()
    links, _ = sized(_confirmed(first, classes, texts, width, num, den))
    trees, _ = sized(connected_components(links))

    rooted = prefix.join(heads, "key").join(trees.select(F.col("node").alias("digest"), F.col("component")), "digest", "left").select(
        "key", "length", "head", "digest", F.coalesce("component", "digest").alias("root")
    )
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    open_lists, _ = sized(rooted.join(mixed, "key", "left_semi"))
    short = open_lists.where((F.col("length") <= SHORT_LIST) & (F.col("digest") != F.col("head")))
    joined = (
        short.select("key", F.col("digest").alias("a"), F.col("root").alias("ra"))
        .join(short.select("key", F.col("digest").alias("b"), F.col("root").alias("rb")), "key")
        .where("a < b and ra <> rb").select("a", "b")
    )
    # lists with the same head hold much the same classes, so these meet once per head and not once per list
    far = cut(
        open_lists.where(F.col("length") > SHORT_LIST).select(F.col("head").alias("key"), "digest", "root").distinct()
        .join(classes.select("digest", "id", "n", "sig"), "digest")
    )
    weight = far.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.sum("n").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("length") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    long = (
        far.join(weight, "key").join(_shingles(far, texts, width), "digest")
        .withColumn("block", F.pmod(F.xxhash64("digest"), blocks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "digest", "root", "sig", "shingles")
        .groupBy("key", "lo", "hi").applyInArrow(_block_links(num, den), "a binary, b binary")
    )
    more, _ = sized(_confirmed(joined.distinct(), classes, texts, width, num, den).union(long).distinct())
    trees = connected_components(links.union(more))

    placed = classes.select("digest", "id", "copies").join(trees.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "root", F.coalesce("component", "digest")
    )
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"), F.min("digest").alias("first"), F.sum("copies").alias("members"))
    return rows, placed.join(least, "root").select("digest", "component_id", "copies", "first", "members")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100)
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept, copies``.

    Rows are linked when ``den * |A & B| >= num * |A | B|`` for their shingle sets and
    ``similarity = (num, den)``; ``component_id`` is the least id reachable by links,
    ``kept`` says whether the row holds it, and ``copies`` counts the rows with the same
    set. A text without words (or null) has no shingles, is linked with nothing and is
    kept. A row without id is compared like any other but never names a component; if all
    rows of a component lack one, ``component_id`` is null, and such rows are not kept
    unless they stand alone. Rows that repeat an id are each judged by their own text.
    Other columns of ``docs`` are ignored; an empty table gives an empty result. A text's set
    is made as a whole in one task, in memory of about 100 bytes a word.
    """
    rows, named = _classes(docs, id_col, text_col, width, similarity)
    out = rows.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    alone = (F.col("n") == 0) | (F.col("members") == 1) & F.col("component_id").isNull()
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, alone).alias("kept"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100)
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns kept.

    The row with the group's least id stays. Rows that repeat an id and its text count as
    one; of rows that share an id but not the text each stays that its id would keep. A row
    without id goes if its group holds an id; of a group without any, one row of the class
    with the least digest stays. Texts without words all stay, and columns may have any name.
    """
    rows, named = _classes(docs, id_col, text_col, width, similarity)
    found = rows.join(named, "digest", "left").where("id is not null and (n = 0 or id = component_id)")
    stays = found.select(F.col("id").alias(id_col)).distinct()
    times, hashed = _fresh(docs, "times"), _fresh(docs, "text_hash")
    again = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias(times)).where(f"{times} > 1").select(id_col)
    left = docs.join(stays, id_col, "left_semi")
    once = left.join(again, id_col, "left_anti")
    # only repeated ids pay for a shuffle of their texts
    repeated = left.join(again, id_col, "left_semi").withColumn(hashed, F.sha2(F.col(text_col).cast("binary"), 256))
    kept = once.union(repeated.dropDuplicates([id_col, hashed]).drop(hashed)).select(*[F.col(f"`{c}`") for c in docs.columns])
    nameless = docs.where(F.col(id_col).isNull())
    if not nameless.limit(1).count():
        return kept
    packed = nameless.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    told = packed.mapInArrow(_digests(width), packed.select("row").schema.add("digest", "binary"))
    heads = named.where("component_id is null and digest = first").select("digest")
    one = told.where("digest is not null").join(heads, "digest", "left_semi").dropDuplicates(["digest"]).select("row.*")
    return kept.union(told.where("digest is null").select("row.*")).union(one)
