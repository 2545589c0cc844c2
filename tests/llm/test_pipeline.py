"""The pipeline against plain Python on a small table, and the registration of the queries."""

from __future__ import annotations

import re

import pytest
import sentencepiece
import public_tokenizers

import corpus_pipeline
from folioweave.llm import queries
from tests.llm.test_exact_ops import brute_components, brute_fingerprint, brute_lines
from tests.llm.test_learned_ops import smith_waterman

EN = "the cat sat on the warm mat near number {k} and looked at {j} other cats with some interest in what they were doing all day"
DE = "die katze {k} schläft auf dem sofa und der hund {j} bellt laut in den dunklen garten hinaus bis alle nachbarn davon wach werden"


def documents():
    rows = [(k, (EN if k % 2 else DE).format(k=k * k, j=k * 7 + 3) + "\nzeile eins\nline two\nzeile drei\n" + f"end of {k}", "en" if k % 2 else "de", "s", 1) for k in range(20)]
    rows += [(20, rows[3][1], "en", "s", 1), (21, "12345 67890", None, "s", 1), (22, None, "en", "s", 1), (23, "ЖЖЖ ЩЩЩ ЫЫЫ ЭЭЭ", None, "s", 1)]
    rows += [(24, "so we " + "alpha beta gamma delta epsilon zeta eta theta iota kappa" + " and that is the end of it all day", "en", "s", 1)]
    return rows


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta, eta theta iota kappa")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_matches_brute_force(spark, folder):
    docs = {r[0]: r[1] for r in documents() if r[0] not in (21, 22, 23)}
    docs = {i: t for i, (_, _, t) in brute_lines(list(docs.items())).items()}
    ids = sorted(docs)
    group = brute_components([brute_fingerprint(docs[i]) for i in ids])
    docs = {i: docs[i] for k, i in enumerate(ids) if group[k] == k}
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs = {i: t for i, t in docs.items() if smith_waterman(item, re.findall(r"[a-z0-9]+", t.lower())) < 10}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.TOKENIZER))
    got = {r.doc_id: (r.decoded, r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: (t, library.encode(t)) for i, t in docs.items()} and 24 not in got and len(got) > 10


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
