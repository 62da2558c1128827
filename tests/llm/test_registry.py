"""The registered queries on the test tables, against SQL where there is some; the pipeline stage by stage."""

from __future__ import annotations

import zlib
from collections import defaultdict
from html.parser import HTMLParser

import pytest

import corpus_pipeline
from tessera.llm import decontaminate, jaccard_join, registry
from tests.conftest import DATA
from tests.llm.conftest import make_docs
from tests.llm.test_pairs import repeated_words
from tests.llm.test_texts import brute_counts

pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(name, spark, same_as_sql):
    same_as_sql(registry.queries()[name](spark, DATA), registry.oracle_sql()[name])


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    rows = [r[:5] for r in make_docs()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in (5, 6)), 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[8][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in now.collect()}
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = before - {r["doc_id"] for r in now.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    assert 8 in seen["benchmark decontamination"] and not seen["SentencePiece encoding"]
    assert now.columns == ["doc_id", "ids", "n_ids"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, now.collect()))


def test_pipeline_stages_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, "documents").select("doc_id", "text").collect()}


def run(spark, name):
    return registry.queries()[next(n for n in registry.queries() if n.startswith(f"{name}_"))](spark, DATA).collect()


class Article(HTMLParser):
    """Blocks of the article of the test pages, by another reader than the operator's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "h2", "li", "ul", "article") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "h2", "li", "ul", "article") else []

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_op4_on_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, "pages").collect()}
    found = run(spark, "op4")
    assert len(found) == len(pages)
    for r in found:
        reader = Article()
        reader.feed(pages[r["page_id"]] or "")
        reader.close()
        assert r["text"] == "\n".join(b for b in (" ".join(x.split()) for x in reader.blocks) if b) and r["n_chars"] == len(r["text"])


def test_op5_on_all_documents(spark, texts):
    rows, lang = run(spark, "op5"), {r["doc_id"]: r["lang"] for r in table(spark, "documents").collect()}
    assert len(rows) == len(texts) and {"doc_id", "held_out", "lang_pred", "score"} <= set(rows[0].asDict())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    known = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in known) >= 0.95 * len(known) > 10


def test_op6_on_all_documents(spark, texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = run(spark, "op6")
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == model.encode(texts[r["doc_id"]] or "") and r["n_ids"] == len(r["ids"])


def test_op7_on_all_documents(spark, texts):
    rows = run(spark, "op7")
    assert len(rows) == len(texts)
    for r in rows:
        counts = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["base_failed"] and r["kept"])


def test_op8_on_all_documents(spark, texts):
    covered = defaultdict(set)
    for r in run(spark, "op8"):
        covered[r["doc_id"]].update(range(r["begin"], r["end"]))
    need = repeated_words(list(texts.items()))
    assert need and all(words <= covered[i] for i, words in need.items())


def test_op9_on_all_documents(spark, texts):
    rows, quality = run(spark, "op9"), {r["doc_id"]: r["quality"] for r in table(spark, "labels").collect()}
    assert len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.9 * len(held) > 5


def test_op10_on_all_documents(spark, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, start = {r["doc_id"]: r for r in run(spark, "op10")}, 0
    assert len(rows) == len(texts)
    for i in sorted(texts):
        ids = [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
