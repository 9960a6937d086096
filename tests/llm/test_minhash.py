import hashlib

import numpy as np

from hazardspark.llm import minhash as mh
from tests.llm.helpers import ODD_TEXTS, documents, local_rows


def jaccard(a, b):
    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_likeness_estimates_the_shared_shingles():
    maker, rng = mh.Fingerprinter(), np.random.default_rng(1)
    errors = []
    for size in (30, 200, 1500, 6000):
        for share in (0.2, 0.5, 0.9, 1.0):
            words = [f"w{i}" for i in rng.integers(0, 10**9, size)]
            other = words[: int(size * share)] + [f"v{i}" for i in rng.integers(0, 10**9, size - int(size * share))]
            a, b = " ".join(words), " ".join(other)
            errors.append(abs(maker.likeness(maker.minima(a), maker.minima(b)) - jaccard(a, b)))
    assert np.mean(errors) < 0.05 and max(errors) < 0.2


def test_hashes_do_not_depend_on_the_piece(monkeypatch):
    text = " ".join(r[1] for r in local_rows("documents")[:20])
    whole = mh.Fingerprinter().word_hashes(text.encode())
    monkeypatch.setattr(mh, "PIECE", 1000)
    assert np.array_equal(whole, mh.Fingerprinter().word_hashes(text.encode()))
    assert len(whole) == len(text.encode().split())


def test_packing_and_short_texts():
    maker = mh.Fingerprinter()
    for text in ("one", "a b c", "a b c d e f g", "word " * 9):
        low = maker.minima(text)
        assert np.array_equal(maker.unpack(maker.pack(low)), low) and len(maker.pack(low)) == 256
    assert maker.fingerprint(None) == maker.fingerprint(" \n") == mh.NONE
    assert maker.likeness(None, None) == 1.0 and maker.likeness(None, maker.minima("x")) == 0.0


def brute(rows):
    """Each row with the next in id order."""
    maker = mh.Fingerprinter()
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = maker.minima(text), maker.minima(changed), maker.minima(following)
        out[i] = (
            len(text), hashlib.sha256(changed.encode()).hexdigest(), maker.pack(a), maker.pack(b),
            maker.likeness(a, b), maker.likeness(a, c),
        )
    return out


def test_next_documents(spark):
    texts = ODD_TEXTS + [r[1] for r in local_rows("documents")][:80]
    ids = [None] + [3 * i - 40 for i in range(1, len(texts))]
    docs = documents(spark, texts, ids=ids).repartition(5).withColumnsRenamed({"lang": "run", "source": "guest"})
    rows = mh.compare_with_next(docs).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == brute(list(zip(ids, texts))) and len(rows) == len(texts)


def test_small_tables(spark):
    assert mh.compare_with_next(documents(spark, [])).count() == 0
    (one,) = mh.compare_with_next(documents(spark, ["a b c d"])).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()
    same = mh.compare_with_next(documents(spark, ["x y z", "x y z", "q"], ids=[1, 1, 1])).collect()
    assert len(same) == 3 and len({r["fingerprint"] for r in same}) == 2
    assert mh.fingerprints(documents(spark, ODD_TEXTS)).count() == len(ODD_TEXTS)
