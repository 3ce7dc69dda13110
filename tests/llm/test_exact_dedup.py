import hashlib
import re
from collections import Counter, defaultdict

from brookspan.llm import exact_dedup as E
from hypothesis import given
from hypothesis import strategies as st


@given(st.binary(max_size=300), st.binary(max_size=300), st.binary(max_size=50))
def test_fingerprints_combine_in_any_grouping(a, b, c):
    h = [E.fingerprint(x) for x in (a, b, c)]
    assert E.combined(E.combined(h[0], h[1]), h[2]) == E.combined(h[0], E.combined(h[1], h[2])) == E.fingerprint(a + b + c)


def test_long_texts_are_chunked():
    data = bytes(range(256)) * 1000
    assert E.fingerprint(data) == E.combined(E.fingerprint(data[: E.CHUNK + 5]), E.fingerprint(data[E.CHUNK + 5 :]))


def wanted(rows):
    classes = defaultdict(list)
    for i, t in rows:
        classes[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for text, ids in classes.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_awkward_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(E.exact_duplicates(odd_documents)) == wanted(rows)
    assert E.exact_duplicates(no_documents).count() == 0


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(E, "fingerprints", lambda docs, *a, real=E.fingerprints: real(docs, *a).selectExpr("doc_id", "1L AS print", "1L AS n_bytes", "sha256"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c"), (6, None)]
    assert found(E.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == wanted(rows)


def test_kept_rows_have_their_columns(odd_documents):
    kept = E.without_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 1, 60} <= set(ids) and not {5, 61, 63} & set(ids)


def test_null_and_shared_identifiers_lose_no_text(spark):
    rows = [(None, "a b"), (None, "c"), (None, "c"), (None, "d"), (1, "d"), (2, "e x"), (2, "f"), (3, "f"), (2, "e  x"), (4, "g"), (4, "g")]
    kept = sorted(map(repr, (tuple(r) for r in E.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert len(kept) == 6
    assert {k for k in kept if "e" not in k.replace("None", "")} == {"(None, 'a b')", "(None, 'c')", "(1, 'd')", "(2, 'f')", "(4, 'g')"}
