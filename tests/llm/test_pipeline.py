"""The pipeline's stages, each against what its operator decides."""

import collections

import corpus_pipeline
import pytest
from framewarden.llm import mixing, ngram_jaccard, pii, sentencepiece, toxicity
from framewarden.llm.common import table, written

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF_DIR, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF_DIR), name.replace(" ", "-")))
    return docs


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_toxic_documents_go(spark, steps):
    scores = toxicity.toxicity(steps[0], table(spark, SF_DIR, "labels")).collect()
    assert ids(steps[1]) == collections.Counter(r.doc_id for r in scores if not r.predicted)


def test_one_document_of_each_group_stays(steps):
    classes = ngram_jaccard.jaccard_join(steps[1]).collect()
    assert ids(steps[2]) == collections.Counter({r.component_id for r in classes})


def test_personal_data_is_replaced(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    after = {r.doc_id: r for r in steps[3].collect()}
    found = {r.doc_id: r.spans for r in pii.personal_data(steps[2]).collect()}
    assert before.keys() == after.keys()
    for doc, text in before.items():
        parts, at = [], 0
        for start, kind, stop in found[doc]:
            if start >= at:
                parts += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
            at = max(at, stop)
        assert after[doc].text == "".join(parts) + text[at:] and after[doc].n_chars == len(after[doc].text)


def test_documents_are_taken_as_mixed(steps):
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mixed_counts(steps[3]).collect() if r.taken}
    assert ids(steps[4]) == collections.Counter(taken)


def test_ids_of_every_document(spark, steps):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count() and all(r.ids == model.encode(texts[r.doc_id]) for r in rows)
    ran = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, rows))
