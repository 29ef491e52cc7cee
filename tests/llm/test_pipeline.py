"""The pipeline's stages, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from fedloom.llm import mixing
from fedloom.plans.session import read_table, work_table

from .conftest import ODD, documents
from .test_corpus_operators import brute_join
from .test_text_operators import brute_spans


@pytest.fixture(scope="module")
def steps(package, data):
    """The input of each stage, and the last one's result."""
    found = [read_table(package, data, "documents")]
    for name, stage in cp.STAGES:
        found.append(work_table(package, stage(package, found[-1], data), f"test-{name}"))
    return found


def test_stages_return_document_columns(steps):
    for df in steps[:-1]:
        assert tuple(df.columns) == cp.COLUMNS
    assert len(cp.STAGES) == 5


def test_quality_keeps_clean_documents(package, steps, data):
    labels = {r["doc_id"]: r["quality"] for r in read_table(package, data, "labels").collect()}
    before, after = ({r["doc_id"] for r in df.collect()} for df in steps[:2])
    assert after <= before
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in good) >= 0.95 * len(good)


def test_one_of_each_group_stays(steps):
    rows = sorted((r["doc_id"], r["text"]) for r in steps[1].collect())
    want = {rows[k][0] for k, (_, root) in enumerate(brute_join([t for _, t in rows])) if k == root}
    assert {r["doc_id"] for r in steps[2].collect()} == want and steps[2].count() == len(want)


def test_personal_data_goes(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    for r in steps[3].collect():
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute_spans(before[r["doc_id"]]) and "token" not in before[r["doc_id"]].lower():
            assert r["text"] == before[r["doc_id"]]


def test_mix_repeats_what_it_takes(package, steps):
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(package, steps[3]).collect() if r["taken"]}
    assert Counter(r["doc_id"] for r in steps[4].collect()) == want


def test_tokens_equal_the_library(steps):
    import sentencepiece

    from fedloom.llm.piece_codec import default_model

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r["ids"] == sp.encode(texts[r["doc_id"]])


#: Of ODD: all rows without words, and one of each group.
ONE_OF_EACH = Counter()
for _k, (_, _root) in enumerate(brute_join([t for _, t in ODD])):
    _same = [i for i, (_, r) in enumerate(brute_join([t for _, t in ODD])) if r == _root]
    if _k == min(_same, key=lambda i: (ODD[i][0] is None, ODD[i][0] or 0)):
        ONE_OF_EACH[ODD[_k][0]] += 1


def test_rows_of_one_id_are_judged_by_their_texts(package, data):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    df = package.createDataFrame([(1, a, "x"), (1, b, "x"), (1, b, "w"), (None, a, "x"), (None, None, "x"), (None, "", "y"), (None, " ", "z"), (None, "", "y")], "doc_id bigint, text string, lang string")
    df = df.selectExpr("*", "'s' AS source", "1L AS n_chars")
    got = Counter((r["doc_id"], r["text"], r["lang"]) for r in cp.drop_near_duplicates(package, df, data).collect())
    assert got == Counter({(1, a, "x"): 1, (1, b, "w"): 1, (None, None, "x"): 1, (None, "", "y"): 2, (None, " ", "z"): 1})


def test_stages_take_odd_and_empty_tables(package, data):
    odd, none = documents(package, ODD, extra=True), package.createDataFrame([], documents(package, []).schema)
    for name, stage in cp.STAGES:
        assert stage(package, none, data).count() == 0, name
    ids = Counter(r["doc_id"] for r in cp.drop_near_duplicates(package, odd, data).collect())
    assert ids == ONE_OF_EACH
    assert cp.redact_personal_data(package, odd, data).count() == len(ODD)
    assert cp.judge_quality(package, odd, data).columns == list(cp.COLUMNS)
