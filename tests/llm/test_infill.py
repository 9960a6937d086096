import hashlib
import re

import numpy as np
import pytest

from hazardspark.llm import infill
from tests.llm.helpers import ODD_TEXTS, documents, local_rows, table

TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    """The rewriting by its definition, without an index."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("error", [1, 7, 126])
def test_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(3)
    for steps in ([1] * 5000, rng.integers(1, 9, 4000), rng.geometric(0.001, 3000), [1, 10**9, 1, 1]):
        offsets = np.concatenate([[0], np.cumsum(steps)])
        index = infill.BoundaryIndex(offsets, error)
        assert [index.cut(k) for k in range(len(offsets))] == offsets.tolist()
        assert np.abs(index.residuals.astype(int)).max() <= error + 1
    assert len(infill.BoundaryIndex(np.arange(10**5), error).starts) == 1


def test_index_refuses_an_error_beyond_a_byte():
    with pytest.raises(ValueError):
        infill.BoundaryIndex(np.arange(3), 127)


def test_boundaries_are_those_of_the_pattern():
    for text in [t or "" for t in ODD_TEXTS] + [" a  b", "  lead", "trail \n", "a\x00b c"]:
        ends = np.cumsum([0] + [len(t) for t in TOKEN.findall(text)])
        assert infill.token_boundaries(text).tolist() == ends.tolist()


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_round_trip_with_partial_markers(form):
    for parts in [("<", "P>", ""), ("<S", ">", "<M"), ("", "", ""), ("a<", "<P", "M>")]:
        assert infill.restore(form, infill.rewrite(form, *parts)) == "".join(parts)


def test_whole_table_against_the_definition(spark):
    rows = {r["doc_id"]: r for r in infill.fill_in_middle(table(spark, "documents")).collect()}
    texts = {r[0]: r[1] for r in local_rows("documents")}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        r = rows[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(i, text)
        assert r.restored == (text or "")
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    texts = ODD_TEXTS * 4 + ["with <P> inside", "word " * 200_000]
    ids = [None, *range(len(texts) - 2), 0]  # a null id and an id of two rows
    docs = documents(spark, texts, ids=ids).selectExpr("*", "1 AS n", "'x' AS form")
    rows = infill.fill_in_middle(docs).collect()
    got = [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in rows]
    want = [(*expected(i, t), t or "") for i, t in zip(ids, texts)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_digests(spark):
    assert infill.fill_in_middle(documents(spark, []), digests=True).collect() == []
    row = infill.fill_in_middle(documents(spark, [None]), digests=True).first()
    assert row.output == row.restored == hashlib.sha256(b"").hexdigest()
