import random

import numpy as np
import pytest

from hazardspark.llm import sentencepiece as sp
from tests.llm.helpers import ODD_TEXTS, documents, local_rows


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(sp.Vocabulary.load())


def whole_text_score(v, text):
    """Best sum of scores by a table over the whole text."""
    best, longest = [0.0] + [float("-inf")] * len(text), v.longest
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            known = v.scores.get(text[start:end])
            score = known[1] if known else v.unknown_score if end - start == 1 else float("-inf")
            best[end] = max(best[end], best[start] + score)
    return best[-1]


_tables = {}


def score_of(v, ids):
    if id(v) not in _tables:
        _tables[id(v)] = dict(v.scores.values()), {b: k for k, b in enumerate(v.byte_ids)}
    (by_id, byte_ids), total, waiting = _tables[id(v)], 0.0, b""
    for i in ids:
        if i in byte_ids:
            waiting += bytes([byte_ids[i]])
            try:
                waiting.decode()
            except UnicodeDecodeError:
                continue
            total, waiting = total + v.unknown_score, b""
        else:
            total += by_id[i]
    return total


def test_best_score_and_round_trip(encoder):
    rng = random.Random(3)
    texts = [t for t in ODD_TEXTS if t] + [r[1][:1500] for r in local_rows("documents")][:30]
    texts += ["".join(rng.choice("ab  \n▁é日🜁\x00") for _ in range(80)) for _ in range(60)]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        marked = sp.MARK + text.replace(" ", sp.MARK)
        assert score_of(encoder.v, ids.tolist()) == pytest.approx(whole_text_score(encoder.v, marked))
        assert encoder.decode(ids) == text.replace(sp.MARK, " ")


def test_streaming_equals_one_feed_and_keeps_a_short_window(encoder):
    text = "".join(r[1] for r in local_rows("documents")[:20]).replace(" ", "").replace("\n", "")  # one word
    stream, ids = sp.StreamingViterbi(encoder.v), []
    for start in range(0, len(text), 7):
        ids += stream.feed(text[start : start + 7])
    kept = stream.most_kept
    ids += stream.finish()
    once = sp.StreamingViterbi(encoder.v)
    assert ids == once.feed(text) + once.finish()
    assert len(text) > 10_000 and kept < 20 * encoder.v.longest


def test_table_equals_streaming(encoder):
    words = sorted({w for r in local_rows("documents")[:40] for w in encoder.words.findall(sp.MARK + r[1].replace(" ", sp.MARK))})
    words += ["▁", "▁▁▁", "🜁", "a\x00b", "x" * 64, "y" * 65, "▁" * 40 + "z"]
    assert encoder.table.encode(words) == [encoder.table._slow(w) for w in words]


def test_words_equal_the_library(encoder):
    """The same vocabulary as a unigram model of the library: never a better score."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(sp.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    words = sorted({w for r in local_rows("documents")[:60] for w in r[1].split()})
    theirs, ours = [library.encode(w) for w in words], [i.tolist() for i in encoder.encode_all(words)]
    assert all(score_of(encoder.v, a) >= score_of(encoder.v, b) for a, b in zip(ours, theirs))
    assert sum(a == b for a, b in zip(ours, theirs)) > 0.99 * len(words)


def test_tables(spark):
    docs = documents(spark, ODD_TEXTS).withColumnsRenamed({"n_chars": "n_ids"})
    coded = sp.encode(docs, verify=True)
    rows = coded.collect()
    assert len(rows) == len(ODD_TEXTS) and all(r["round_trip"] in (True, None) for r in rows)
    assert [r["ids"] for r in rows if r["doc_id"] == 0] == [None] and [r["n_ids"] for r in rows if r["doc_id"] == 1] == [0]
    back = {r["doc_id"]: r["text"] for r in sp.decode(coded.select("doc_id", "ids")).collect()}
    assert back == dict(enumerate(ODD_TEXTS))
    assert sp.encode(docs.limit(0)).count() == 0


def test_cache_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(sp, "CACHE", 50)
    fresh = sp.Encoder(encoder.v)
    for k in range(20):
        text = " ".join(f"w{k}{i}" for i in range(20)) + " " + "long" * 40
        assert np.array_equal(fresh.encode(text), encoder.encode(text))
        assert len(fresh.known) <= 50


def test_table_equals_streaming_on_all_words_of_the_table(encoder):
    texts = [sp.MARK + r[1].replace(" ", sp.MARK) for r in local_rows("documents") if r[1]]
    words = sorted(w for w in set().union(*map(encoder.words.findall, texts)) if len(w) <= sp.CACHED_LENGTH)
    assert len(words) > 3000
    assert encoder.table.encode(words) == [encoder.table._slow(w) for w in words]
