"""The corpus pipeline: each stage against a plain version on its own input."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

import corpus_pipeline as P  # noqa: E402
from mirage.llm import op3_quality, op8_mixing  # noqa: E402
from test_operators import SF_SMALL, brute_components, check_packing, pairs  # noqa: E402


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The input and every stage's output, written and reread in turn."""
    out = [spark.read.parquet(f"{SF_SMALL}/documents.parquet")]
    for k, (_, stage) in enumerate(P.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, out[-1], SF_SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(written):
    for df in written[1:-1]:
        assert df.columns == P.COLUMNS and df.dtypes == written[0].dtypes


def test_quality(spark, written, duck):
    kept = duck.execute(f"WITH {op3_quality.verdict_sql('documents')} SELECT doc_id FROM q_out WHERE kept").fetchall()
    assert sorted(map(tuple, written[1].collect())) == sorted(
        tuple(r) for r in written[0].collect() if (r["doc_id"],) in set(kept))


def test_near_duplicates(written):
    keep = {d for d, _, c in brute_components(pairs(written[1])) if d == c}
    assert sorted(map(tuple, written[2].collect())) == sorted(tuple(r) for r in written[1].collect() if r["doc_id"] in keep)


def test_passages(written):
    rows = sorted(pairs(written[2]))
    first = {}
    for d, t in rows:
        w = t.encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), d)
    want = {}
    for d, t in rows:
        w = t.encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < d:
                keep[k:k + 50] = [False] * 50
        left = [x for x, y in zip(w, keep, strict=True) if y]
        if left or not w:
            want[d] = t if len(left) == len(w) else b" ".join(left).decode()
    got = {r["doc_id"]: r for r in written[3].collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_mixing(written):
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in op8_mixing.mix(written[3], total="cover").collect()}
    got = sorted(map(tuple, written[4].collect()))
    assert got == sorted(tuple(r) for r in written[3].collect() for _ in range(copies[r["doc_id"], r["source"]]))
    assert {r[0] for r in got} == {r["doc_id"] for r in written[3].collect()}


def test_packing(written):
    check_packing(written[5].collect(), pairs(written[4]))


def test_run_and_odd_inputs(spark, written):
    assert P.run(spark, SF_SMALL).count() == written[5].count()
    for rows in ([], [(None, None, None, None, None)], [(1, "word " * 60, "en", None, 0)] * 3 + [(2, "", None, "s", None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF_SMALL)
        docs.collect()


def test_rows_without_id_and_texts_of_one_id(spark):
    """Every row is judged and linked by its own text."""
    def prose(tag, n=120):
        return " ".join(f"{tag}{k}" for k in range(n))

    junk, passage = "word " * 60, prose("p", 60)
    rows = [(None, prose("a"), "en", "s", 1), (None, prose("b"), "en", "s", 2), (None, prose("b"), "en", "s", 2), (None, junk, "en", "s", 3),
            (3, prose("c"), "en", "s", 4), (5, prose("c") + " c120", "en", "s", 5), (5, prose("d") + " " + passage, "en", "s", 6),
            (5, prose("d") + " " + passage, "en", "s", 6), (5, junk, "en", "s", 7), (4, passage + " " + prose("e"), "en", "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def got(df):
        return sorted(map(tuple, df.collect()), key=str)

    good = [r for r in rows if r[1] != junk]
    assert got(P.quality(spark, docs, "")) == sorted(good, key=str)
    unlinked = [r for r in dict.fromkeys(good) if r[4] != 5] + [rows[2]]
    assert got(P.near_duplicates(spark, spark.createDataFrame(good, docs.schema), "")) == sorted(unlinked, key=str)
    both = [(4, passage, "en", "s", 1), (5, passage + " " + prose("f"), "en", "s", 2), (5, prose("g"), "en", "s", 3), (None, passage, "en", "s", 4)]
    left = [both[0], (5, prose("f"), "en", "s", len(prose("f"))), both[2], both[3]]
    assert got(P.repeated_passages(spark, spark.createDataFrame(both, docs.schema), "")) == sorted(left, key=str)
