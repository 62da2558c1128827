"""Every operator on a table that has columns with all names the operators use themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import collocations, decontaminate, filter_audit, fingerprints, jaccard_join, language_id, passage_dedup, quality_classifier, quality_rules, sentence_pieces
from tests.llm.conftest import make_docs

#: Names of columns inside the operators, and awkward ones.
NAMES = """
    own_text own_spans own_score own_predicted spans items longest n_words n_hit n_items items_sha256 contaminated score predicted label s x b part text_key class n bits often times
    list range a members doc component component_id gone_id gone_text rest cut_id cut_text cut_spans begin end fingerprint guest block edited_sha256 key mask good toxic part_ word h f
    phrase rank ids n_ids lang_pred held_out kept base_failed source n_chars
""".split()  # fmt: skip


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [r for r in make_docs() if r[0] is not None][:34]
    rows = [*rows, rows[2], rows[2]]
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    return docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES], F.create_map(F.lit("k"), "doc_id").alias("a map"), F.lit(2).alias("Own 1")).repartition(2)


def same_rows(found, docs):
    """What came out are rows that went in, with all their columns."""
    assert found.columns == docs.columns
    went_in = {repr(r) for r in docs.collect()}
    came_out = [repr(r) for r in found.collect()]
    assert came_out and set(came_out) <= went_in


def test_filters_keep_all_columns(spark, crowded):
    items = spark.createDataFrame([(1, make_docs()[8][1])], "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in (5, 6)), 0) for i in range(20)], "doc_id long, quality int, toxic int")
    cleaned = decontaminate.decontaminate(crowded, items)
    same_rows(cleaned, crowded)
    assert 8 not in {r["doc_id"] for r in cleaned.select("doc_id").collect()}
    same_rows(jaccard_join.keep_first(crowded), crowded)
    same_rows(quality_classifier.keep_accepted(crowded, quality_classifier.train(crowded, labels)), crowded)
    cut = passage_dedup.cut_passages(crowded, passage_dedup.find_passages(crowded))
    assert cut.columns == crowded.columns and cut.drop("text", "n_chars").schema == crowded.drop("text", "n_chars").schema
    names = [c for c in crowded.columns if c not in ("text", "n_chars", "a map")]
    went_in = {repr(r) for r in crowded.select(*names).collect()}
    assert {repr(r) for r in cut.select(*names).collect()} <= went_in


def test_other_operators_read_their_own_columns(spark, crowded):
    plain = crowded.select("doc_id", "text", "lang")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, make_docs()[8][1], "x", "y")], "item_id long, text string, spans string, id string")
    runs = [
        lambda d: decontaminate.judge(decontaminate.find_contamination(d, items, keep=["doc_id"])).select("doc_id", "n_words", "n_hit", "n_items", "contaminated"),
        lambda d: jaccard_join.near_duplicates(d),
        lambda d: passage_dedup.find_passages(d),
        lambda d: filter_audit.audit(d, labels),
        lambda d: fingerprints.tail_edits(d),
        lambda d: fingerprints.fingerprints(d),
        lambda d: collocations.collocations(d, min_count=3),
        lambda d: language_id.held_out_identification(d),
        lambda d: quality_rules.score_quality(d, quality_rules.train(d, labels)),
        lambda d: quality_classifier.classify(d, quality_classifier.train(d, labels), keep=["doc_id"]),
    ]
    for run in runs:
        assert sorted(map(repr, run(crowded).collect())) == sorted(map(repr, run(plain).collect()))


def test_pieces_and_stages(spark, crowded, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    wanted = sentence_pieces.encode_pieces(crowded.select("doc_id", "text"), path)
    assert sorted(map(repr, sentence_pieces.encode_pieces(crowded, path).collect())) == sorted(map(repr, wanted.collect()))
    spark.createDataFrame([(i, int(i not in (5, 6)), 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, make_docs()[8][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = crowded.drop("a map")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == [c for c in crowded.columns if c != "a map"] and now.count() > 0
