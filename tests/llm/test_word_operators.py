"""Periodic runs, line-first quality rules and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import pytest

pytest.importorskip("tickweave.llm")
from pyspark.sql import functions as F  # noqa: E402

from tickweave.llm import fill_in_middle, line_quality, periodic_runs, queries, word_arrays  # noqa: E402

DOCS = "doc_id long, text string, id long, n int, h1 string, runs string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, 7, 1, "x", "y", 2) for i, t in rows], DOCS)


def runs_by_hand(words, least, times):
    out = {}
    for period in range(1, len(words) // times + 1):
        at = 0
        while at + period < len(words):
            if words[at] != words[at + period]:
                at += 1
                continue
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if length >= max(least, times * period):
                out.setdefault((at, length), period)
            at = end + 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def random_words(rng, most=70):
    size, letters = rng.randint(0, most), rng.randint(1, 4)
    words = [str(rng.randrange(letters)) for _ in range(size)]
    if words and rng.random() < 0.6:
        begin, period = rng.randrange(size), rng.randint(1, 9)
        for i in range(begin + period, min(size, begin + rng.randint(1, 8) * period)):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("leaps", [0, 24])
def test_runs_equal_brute_force(leaps, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LEAPS", leaps)
    rng = random.Random(leaps)
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        least, times = rng.choice([1, 4, 24]), rng.choice([2, 3, 4])
        symbols, begins = word_arrays.numbered([[w.encode() for w in t] for t in texts], word_arrays.WordIds())
        found = [[] for _ in texts]
        for text, *run in zip(*(x.tolist() for x in periodic_runs.runs_of(symbols, begins, least, times))):
            found[text].append(tuple(run))
        assert found == [runs_by_hand(t, least, times) for t in texts]


def test_long_keys_and_orders():
    import numpy as np

    keys = np.array([5, 1 << 61, 5, 0, 1 << 61, 3])
    assert word_arrays.order_of(keys).tolist() == [3, 5, 0, 2, 1, 4]
    assert periodic_runs.next_smaller(np.array([3, 5, 4, 1, 2])).tolist() == [3, 2, 3, 5, 5]


def test_periodic_runs_of_a_table(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(random_words(rng, 200))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "far " * 30_000), (503, "far " * 30_000), (None, "a b " * 20), (504, "ß\u2028x " * 30)]
    for size in (1 << 20, 64):  # the second puts most texts into slices of their own
        monkeypatch.setattr(word_arrays.slices, "__defaults__", (size,))
        out = periodic_runs.periodic_runs(docs(spark, rows))
        assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
        found = out.select("*", periodic_runs.runs_text(F.col("runs")).alias("listed"), periodic_runs.strongest(F.col("runs")).alias("best")).collect()
        assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
        by = {r.doc_id: r for r in found}
        for i, text in rows[:-4] + rows[-2:]:
            words = WORD.findall(text or "")
            runs = runs_by_hand(words, 24, 3)
            dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
            assert by[i].n_words == len(words) and [tuple(r) for r in by[i].runs] == runs
            assert by[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in dropped)
            assert by[i].listed == "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
            assert (by[i].best and tuple(by[i].best)) == best
        assert [tuple(r) for r in by[503].runs] == [(0, 30_000, 1)] and by[503].collapsed == "far"
    assert periodic_runs.periodic_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs(spark, []), times=1)


def quality_by_hand(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_rules(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b", "c|", "d.", "e#", "é", "\u2028"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9)))) for i in range(200)]
    prose = "One sentence of a good many plain words stands here, and it ends as it should."
    lines = [f"Line {i} has words {i}a {i}b {i}c of its own and ends {i}d." for i in range(5)]
    menu = "Home | News | Sport | Weather | Travel | Contact"
    rows += [(500, None), (501, ""), (502, " \n\t"), (None, prose), (503, "far " * 60_000), (504, "\n".join([*lines, menu, "Sign in", "We accept cookies and All Rights Reserved."]))]
    rows += [(505, "\n".join([menu] * 9 + [prose])), (506, "\n".join(f"buy### this$$$ {i}&&& now*** or%%% never|||" for i in range(9))), (507, prose.rstrip(".") + " " + prose.rstrip("."))]
    out = line_quality.clean_lines(docs(spark, rows))
    assert out.columns == ["doc_id", *line_quality.COUNTS, "cleaned", "base_failed", "kept"]
    found = {r.doc_id: r for r in out.collect()}
    for i, text in rows:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_by_hand(text), (i, text)
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and 2 * r.lost_chars <= r.word_chars)
    assert found[500].cleaned is None and found[501].cleaned == "" and not found[500].kept
    assert found[504].kept and found[504].cleaned == "\n".join(lines)
    assert (found[504].n_navigation, found[504].n_punctuation, found[504].n_boilerplate) == (1, 1, 1)
    assert not found[505].kept and not found[506].kept and not found[506].base_failed
    assert line_quality.clean_lines(docs(spark, [])).count() == 0


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_by_hand(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_fill_in_middle(spark, monkeypatch, block):
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice([" ", "\n", "\x0b", "a", "é", "😀", "\x85", "<", ">", "P", "\u2028"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "  \n"), (None, "one two three"), (503, "a <P> b"), (504, "far " * 40_000), (505, "x" * 100_000), (505, "other text")]
    out = fill_in_middle.fill_in_middle(docs(spark, rows)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    found = [(r.doc_id, r.n, r.form, r.prefix, r.middle, r.output, r.back) for r in out.collect()]
    assert sorted(found, key=repr) == sorted(((i, *middle_by_hand(i, t), t or "") for i, t in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(docs(spark, [])).count() == 0


def test_planted_runs(spark):
    import zlib

    rows = [(i, "\t".join(f"w{k % 37}" for k in range(i))) for i in range(300)] + [(None, "a b"), (3001, None)]
    for r in queries.with_planted_runs(docs(spark, rows)).collect():
        text = dict(rows)[r.doc_id]
        h, words = zlib.crc32(str(r.doc_id).encode()), WORD.findall(text or "")
        if r.doc_id is None or h % 10 or not words:
            assert r.text == text
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.text.split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
