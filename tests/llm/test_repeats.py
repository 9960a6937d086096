import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hazardspark.llm import repeats, suffixes
from tests.llm.helpers import DATA, ODD_TEXTS, documents, local_rows, table


def brute(texts, length):
    """n_bytes, n_removed, n_spans, kept of each text, by counting all its strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), kept))
    return out


def removed(docs, length):
    rows = repeats.remove_repeats(docs, length).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=repr)


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(256)), b"\x00\xff"])
def test_suffix_array_and_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(150):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        strings += [s[rng.randint(0, 3) :] for s in strings if rng.random() < 0.3]
        c = suffixes.Collection(strings)
        t = c.symbols.tolist()
        order = suffixes.suffix_array(c)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        if not len(order):
            continue
        before, prefix = suffixes.common_prefixes(c, order)
        for p, i in zip(order, order[1:]):
            same = next(k for k in range(len(t)) if t[i + k] != t[p + k])
            assert (before[i], prefix[i]) == (p, same)


def test_direct_sort_is_of_type_b_only():
    c = suffixes.Collection([b"banana bandana", b"aaab", b"zzzy"])
    t = c.symbols.tolist()
    flags = suffixes.smaller_than_next(c.symbols)
    assert flags[:-1].tolist() == [t[i:] < t[i + 1 :] for i in range(len(t) - 1)]
    assert 0 < flags.sum() < len(t) / 2 + 3


def test_runs_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "_STEP", 700)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    edges = np.array([0, 10, 60, 1500, 1550, 5000])
    ends = np.repeat(edges[1:], np.diff(edges))
    length, seen = 50, Counter()
    for start, count, gram, h in repeats.window_runs(data, ends, length):
        for s, n, g, x in zip(start, count, gram, h):
            seen.update(range(s, s + n))
            assert s + n - 1 <= g <= s + length - repeats.GRAM
            assert x == repeats._gram_hashes(data[g : g + repeats.GRAM])[0]
    assert seen == Counter(i for i in range(5000) if ends[i] - i >= length)


def _corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 7)))
    words = [word() for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = text(40), text(150)
    texts = [text(rng.randint(0, 120)) for _ in range(60)]
    texts += [text(30) + shared + text(30) for _ in range(20)]
    for _ in range(25):  # near copies
        copy = base.split()
        copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [base] * 5 + ["ab" * 300, "x" * 500, "x" * 63, "x" * 64, "y" * 65] + [shared + "-" + shared]
    return texts + ODD_TEXTS


@pytest.mark.parametrize("crowd", [repeats.CROWD, 3])
def test_against_brute_force(spark, monkeypatch, crowd):
    """Copies, near copies, shared passages, periodic texts; crowded grams go the split way."""
    monkeypatch.setattr(repeats.repeated_in, "__defaults__", (crowd, repeats.BLOCKS))
    texts = _corpus()
    want = sorted(((i, *row) for i, row in enumerate(brute(texts, 64))), key=repr)
    assert removed(documents(spark, texts).repartition(5), 64) == want


def test_whole_table_against_brute_force(spark):
    rows = local_rows("documents")
    want = sorted(((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], 400))), key=repr)
    assert any(w[2] for w in want)
    assert removed(table(spark, "documents", DATA), 400) == want


def test_ids_repeats_and_clashing_columns(spark):
    long = " ".join(str(i) for i in range(200))
    texts = [long, long, long[50:] + "tail", None, "other", long[:300]]
    ids = [7, 7, None, None, 7, 1]
    docs = documents(spark, texts, ids=ids).selectExpr("*", "1 as h", "2 as k1", "'x' as kept")
    want = sorted(((i, *row) for i, row in zip(ids, brute(texts, 400))), key=repr)
    assert removed(docs, 400) == want


def test_a_full_sieve_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_BITS", 16)  # two pages
    keys = spark.range(3000).selectExpr("id * 7 as k")
    bits = repeats.sieve(keys.where("k % 3 = 0"), "k")
    kept = repeats.sifted(keys, bits, "k")
    assert bits.count() <= 2
    assert kept.where("k % 3 = 0").count() == keys.where("k % 3 = 0").count() and kept.count() < 1500


def test_empty_table(spark):
    assert removed(documents(spark, []), 400) == []
    assert removed(documents(spark, [None, "", "a"]), 400) == [(0, 0, 0, 0, b""), (1, 0, 0, 0, b""), (2, 1, 0, 0, b"a")]


def test_short_length_is_refused(spark):
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents(spark, ["a"]), 20)


def test_stretches_without_a_shared_window_are_not_sorted():
    rng = random.Random(8)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    length, gram = 100, noise(repeats.GRAM)
    rest = length - repeats.GRAM
    rows, want = {}, set()
    for k in range(40):  # alone: all have the gram, and up to 30 bytes before it
        near = noise(30)
        for side in (noise(60), noise(60)):
            rows[1, len(rows)] = (1, side + near + gram + noise(rest), 90)
    for before in range(0, rest + 1, 7):  # pairs that share one window
        window = noise(before) + gram + noise(rest - before)
        for tail in (noise(5), noise(9)):
            want.add((1, len(rows)))
            rows[1, len(rows)] = (1, tail + window + noise(3), len(tail) + before)
    want.add((1, len(rows)))
    rows[1, len(rows)] = (2, noise(40) + gram + noise(rest), 40)
    rows[2, 0] = (1, rows[1, 100][1], rows[1, 100][2])  # of another gram
    assert set(repeats.sharing(rows, length)) == want
