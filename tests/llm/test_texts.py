"""Chat formatting, pages, languages, pieces, quality and token files."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import boosted, chat_format, html_wrapper, language_id, quality_classifier, quality_rules, sentence_pieces, token_files
from tests.llm.conftest import make_docs

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "a\\nb", "\n\n", "", None, "<|im_start|>", "😀\\|"]
    rows = [(c, i, ["user", "assistant", "sys\ntem", "r<|ole\\n", None][(c + i) % 5], nasty[(c * 3 + i) % len(nasty)], "x") for c in range(12) for i in range(c + 1)]
    rows += [(3, 1, "assistant", "again", "x"), (None, 0, "user", "hi", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string").repartition(4)
    examples = chat_format.format_chat(table)
    talks = defaultdict(list)
    for c, turn, role, text, _ in rows:
        talks[c].append((turn, role or "", text or ""))
    for r in chat_format.digest(examples).collect():
        turns = sorted(talks[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in examples.collect():
        assert e["text"].count("<|im_start|>") == e["text"].count("<|im_end|>") == e["n_turns"]
        assert e["text"][e["loss_end"] :] == "<|im_end|>\n"
    replies = sum(role == "assistant" for t in talks.values() for _, role, _ in t)
    open_ends = sum(sorted(t)[-1][1] != "assistant" for t in talks.values())
    assert examples.count() == replies + open_ends
    assert chat_format.format_chat(table.where("false")).collect() == []


PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>{0}</h1>{1}<aside>side</aside><div id="comments"><p>nice</p></div></article><form>f</form><footer>&copy; foot</footer></body></html>'


def test_pages(spark):
    bodies = ["<p>One &amp; two</p>", "<p>a<br>b</p><p> x \n y </p><ul><li>l1<li>l2</ul>", "<h2>s</h2><p>1</p><h2>t</h2><p>2</p>", "<p>unclosed <b>bold<p>next"]
    expected = ["T\nOne & two", "T\na b\nx y\nl1\nl2", "T\ns\n1\nt\n2", "T\nunclosed bold\nnext"]
    rows = [(i, f"http://h.example/{i}", PAGE.format("T", b)) for i, b in enumerate(bodies)]
    rows += [(10, "http://h.example/10", None), (11, None, "plain text"), (12, "bad url", ""), (13, "https://u@M.Example:80/x", "<div class=menu>m</div><div id=content><p>Hello <b>w</b>orld<p>two</div><div class='footer'>f</div>"), (14, "http://h.example/14", "<p>" * 3000 + "deep"), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, paths string").repartition(3)
    found = html_wrapper.extract_main_text(table)
    got = defaultdict(list)
    for r in found.collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert [got[i][0] for i in range(4)] == expected and got[0] == [expected[0]] * 2
    assert got[10] == [""] and got[11] == ["plain text"] and got[12] == [""] and got[13] == ["Hello world\ntwo"] and got[14] == ["deep"]
    assert html_wrapper.extract_main_text(table.where("false")).collect() == []


def test_wrappers_fold_and_align():
    pages = [PAGE.format("A", "<p>x</p>" * n) for n in (1, 3)]
    one, three = map(html_wrapper.page_wrapper, pages)
    merged = html_wrapper.merge(one, three)
    text = html_wrapper.expression(merged)
    assert "(<p>#fixed</>)+" in text and html_wrapper.main_paths(merged) == [["html", "body", "article"]]
    assert html_wrapper.expression(html_wrapper.merge(merged, one)) == text  # nothing new in a page seen before
    json.dumps(merged)
    pairs = html_wrapper.page_wrapper("<div>" + "<h2>a</h2><p>b</p>" * 3 + "</div>")
    assert "(<h2>#fixed</> <p>#fixed</>)+" in html_wrapper.expression(pairs)
    assert "(<footer>" in html_wrapper.expression(html_wrapper.merge(html_wrapper.page_wrapper("<p>a</p><footer>z</footer>"), html_wrapper.page_wrapper("<p>b</p>")))


def texts_of(pages, host="http://h.example/"):
    """The main texts of pages of one host, without Spark."""
    wrapper = html_wrapper.page_wrapper(pages[0])
    for p in pages[1:]:
        wrapper = html_wrapper.merge(wrapper, html_wrapper.page_wrapper(p))
    roots = html_wrapper.main_paths(wrapper)
    template = frozenset(map(tuple, html_wrapper.template_paths(wrapper, roots)))
    return [html_wrapper.main_text(p, roots, template) for p in pages]


def test_names_inside_an_article_need_evidence():
    own = ['<div class="post related-work"><p>own {0}</p></div>', '<div class="social-history"><p>own {0}</p></div>', '<section id="discussion"><p>own {0}</p></section>', '<p class="notice">own {0}</p>', '<h2 id="share">own {0}</h2>', '<div class="ad-hoc"><p>own {0}</p></div>']
    for body in own:
        pages = [f"<body><article><h1>t{i}</h1>{body.format(i)}<p>more {i}</p></article></body>" for i in range(4)]
        assert texts_of(pages) == [f"t{i}\nown {i}\nmore {i}" for i in range(4)], body
        assert texts_of(pages[:1]) == ["t0\nown 0\nmore 0"], body
    gone = ['<div class="ad">buy {0}</div>', '<div id="comments"><p>nice {0}</p></div>', '<div class="comment-list"><p>nice {0}</p></div>', '<div class="share-buttons">Share this</div>', '<div class="related"><a href="/{0}">see also {0}</a></div>', "<nav>menu {0}</nav>", "<aside>side {0}</aside>", "<form>mail {0}</form>", "<footer>foot {0}</footer>"]
    for body in gone:
        pages = [f"<body><article><h1>t{i}</h1>{body.format(i)}<p>more {i}</p></article></body>" for i in range(4)]
        assert texts_of(pages) == [f"t{i}\nmore {i}" for i in range(4)], body


def test_same_texts_of_a_host_without_regions():
    pages = [f"<body><p>Welcome to our site</p><p>story {i} goes on and on</p>{'<p>extra</p>' if i == 2 else ''}<p>All rights reserved</p></body>" for i in range(5)]
    wrapper = html_wrapper.page_wrapper(pages[0])
    for p in pages[1:]:
        wrapper = html_wrapper.merge(wrapper, html_wrapper.page_wrapper(p))
    assert all(f"story {i} goes" in t for i, t in enumerate(texts_of(pages)))


def test_alignment_keeps_a_longest_common_part():
    from functools import cache

    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("pqrs") for _ in range(rng.randint(0, 9))] for _ in range(2))

        @cache
        def common(i, j):
            return 0 if i == len(a) or j == len(b) else max(common(i + 1, j), common(i, j + 1), 1 + common(i + 1, j + 1) if a[i] == b[j] else 0)

        one, two = ([[k, "", [["#", "", [], 1, 1, 0, n]], 1, 0, 0, None] for n, k in enumerate(side)] for side in (a, b))
        made = []
        original, html_wrapper._fold_run = html_wrapper._fold_run, lambda items: items
        try:
            made = html_wrapper.align(one, two, True)
        finally:
            html_wrapper._fold_run = original
        both = [x for x in made if x[3] == 2]
        assert len(both) == common(0, 0) and len(made) == len(a) + len(b) - len(both)
        for side in (a, b):  # each side is the whole, without some optional ones
            rest = iter(made)
            assert all(any(x[0] == k for x in rest) for k in side)
        assert all(x[1] == "?" for x in made if x[3] == 1)


def test_wrappers_do_not_grow_with_the_pages():
    rng, sizes, wrapper = random.Random(3), [], None
    for n in range(120):
        body = "".join(f'<{t} class="k{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}">text {rng.random()}</{t}>' for t in rng.choices(["div", "ul", "section", "dl"], k=40))
        one = html_wrapper.page_wrapper(PAGE.format("A", body))
        wrapper = html_wrapper.merge(wrapper, one) if wrapper else one
        sizes.append(len(json.dumps(wrapper)))
    assert max(sizes[60:]) < 1.5 * sizes[40] and html_wrapper.main_paths(wrapper) == [["html", "body", "article"]]


def test_very_deep_pages(spark):
    deep = {"div": "<div>" * 100_000 + "deep", "ul": "<ul><li>" * 20_000 + "deep", "named": '<div class="ax">' * 5000 + "deep", "closed": "<article>" + "<div><p>x</p>" * 3000 + "</div>" * 3000, "never": "<div>" * 500 + "<nav>menu</nav><p>deep"}
    table = spark.createDataFrame([(i, "http://deep.example/", h) for i, h in enumerate(deep.values())], "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_main_text(table).collect()}
    assert [got[i] for i in (0, 1, 2, 4)] == ["deep"] * 4
    assert got[3] == "\n".join(["x"] * 3000)


def test_hosts_with_many_partial_wrappers(spark, monkeypatch):
    monkeypatch.setattr(html_wrapper, "FAN", 2)
    rows = [(i, "http://big.example/x", PAGE.format(f"T{i}", f"<p>text {i}</p>")) for i in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    assert html_wrapper.infer_wrappers(table).count() == 1
    assert {r["page_id"]: r["text"] for r in html_wrapper.extract_main_text(table).collect()} == {i: f"T{i}\ntext {i}" for i in range(40)}


def test_languages(spark):
    rng = random.Random(3)
    letters = {"en": "etaoinshr th", "fr": "éeauxoniqu l", "de": "ßüenrstich d"}
    rows = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(80, 300))), lang) for i in range(150) for lang in [list(letters)[i % 3]]]
    table = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "en"), (902, "123 !?", "fr"), (903, "é", None), (None, rows[0][1], "en")], "doc_id long, text string, lang string").repartition(3)
    found = {r["doc_id"]: r for r in language_id.held_out_identification(table).collect()}
    assert len(found) == 155 and found[900]["lang_pred"] == found[901]["lang_pred"] == found[902]["lang_pred"] == "und" and found[903]["lang_pred"] in letters
    held = [(r[2], found[r[0]]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(f["held_out"] for _, f in held) and sum(lang == f["lang_pred"] for lang, f in held) >= 0.97 * len(held)
    assert all(0 <= f["score"] <= 1 for f in found.values())
    blind = language_id.identify(table, language_id.train(table.where("false")))
    assert {r["lang_pred"] for r in blind.collect()} == {"und"}
    single = language_id.identify(table, language_id.train(table.where("lang = 'en'"))).where("doc_id < 100")
    assert {r["lang_pred"] for r in single.collect()} == {"en"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = language_id.codewords(n)
        apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert code.shape[0] == n and apart >= max(1, code.shape[1] // 4)


BPE = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_the_librarys():
    model = sentence_pieces.SentencePieces(BPE, cache=50)
    rng = random.Random(5)
    parts = [" ", "  ", "a", "b", "the", "ing", "\n", "\t", "é", "漢", "😀", ".", "..", ",", "12", "    ", "tion", "▁", "S"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)] + [r[1] or "" for r in make_docs()] + ["ab" * 4000]
    for t in texts:
        ids = model.encode(t)
        assert ids.tolist() == model.model.encode(t)
        assert model.decode(ids) == model.model.decode(ids.tolist())
    assert len(model.search("quickbrown漢" * 300)) > 10  # long texts are committed bit by bit


def test_unigram_paths_are_the_best_of_all():
    """The same pieces with their scores as a unigram model, against every way to cut short words."""
    model = sentence_pieces.SentencePieces(BPE)
    model.unigram = True

    def cuts(word):
        yield [word]
        for k in range(1, len(word)):
            for rest in cuts(word[k:]):
                yield [word[:k], *rest]

    def worth(parts):
        return sum(model.scores.get(p, model.floor if len(p) == 1 else -1e12) for p in parts)

    words = ["▁the", "▁thinking", "▁rivers", "▁zqxj", "▁in漢", "été"]
    together = dict(model.search_words(words))
    for word in words:
        best = max(cuts(word), key=worth)
        for ids in (together[word], model._search_alone(word)):
            got = [model.pieces[i] for i in np.frombuffer(b"".join(ids), "<i4") if i not in model.bytes.values()]
            assert got == [p for p in best if p in model.ids]


def test_long_words_are_searched_alike(monkeypatch):
    """Thousands of stops and other words without a space, one by one and all at once, against the library."""
    model, rng = sentence_pieces.SentencePieces(BPE), random.Random(4)
    words = ["." * 600, "!" * 5001, "." * 100_000, "漢字" * 700, "".join(rng.choice("etaoin漢.") for _ in range(3000)), "=" * 70, "ab" * 40]
    for few in (32, 0):
        monkeypatch.setattr(sentence_pieces, "FEW", few)
        model.release()
        for w, ids in zip(words, model.encode_all(words if few else [w[:6000] for w in words])):
            assert ids.tolist() == model.model.encode(w if few else w[:6000])
    assert len(model.search("quickbrown漢" * 300)) > 10


def test_pairs_of_pieces_stay_apart_as_merging_says():
    model, rng = sentence_pieces.SentencePieces(BPE), random.Random(6)
    ids, n = sorted(model.ids.values()), len(model.pieces)
    pairs = [(rng.choice(some) + 1) * n + rng.choice(some) for some in (ids, ids[:600]) for _ in range(4000)] + [(i + 1) * n + i for i in ids[::7]] + ids[::5]
    pairs += [(int(i) + 1) * n + rng.choice(ids) for i in np.flatnonzero(model._odd)] + [(n + 0x6F22 + 1) * n + rng.choice(ids) for _ in range(20)]
    assert model._may_follow(np.array(pairs)).tolist() == [model._stay_apart(p) for p in pairs]


def test_dots_through_spark(spark):
    texts = ["." * 100_000, "x" + "!" * 700, "a. " * 300, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(docs, BPE, keep=["doc_id", "text"]), BPE).collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == {i: t or "" for i, t in enumerate(texts)}


def test_pieces_of_tables(spark, docs, no_docs):
    encoded = sentence_pieces.encode_pieces(docs, BPE, keep=["doc_id", "text", "score"])
    back = sentence_pieces.decode_pieces(encoded, BPE)
    rows = back.collect()
    assert len(rows) == docs.count() and all((r["text"] or "") == r["decoded"] and r["n_ids"] == len(r["ids"]) for r in rows)
    assert sentence_pieces.encode_pieces(no_docs, BPE).collect() == []
    assert sentence_pieces.model_kind(BPE) == 2


def brute_counts(text):
    w, windows, covered, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text or ""), defaultdict(list), set(), set(), 0
    for k in range(len(w) - 2):
        windows[tuple(w[k : k + 3])].append(k)
    for places in windows.values():
        if len(places) > 1:
            covered.update(k + j for k in places for j in range(3))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules(spark, docs, no_docs, labels):
    forest = quality_rules.train(docs, labels)
    found = quality_rules.score_quality(docs, forest).collect()
    got = sorted(((r["doc_id"], *(r[c] for c in quality_rules.COUNTS)) for r in found), key=repr)
    assert got == sorted(((r[0], *brute_counts(r[1])) for r in make_docs()), key=repr)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.5)
    assert quality_rules.score_quality(no_docs, forest).collect() == []
    blind = quality_rules.train(docs, labels.where("false"))
    assert {r["score"] for r in quality_rules.score_quality(docs, blind).collect()} == {0.5}


def test_boosted_trees_keep_their_order():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 - x[:, 2] + rng.normal(size=3000) * 0.3) > 0).astype(float)
    monotone = np.array([1, 0, -1, 1])
    forest = boosted.fit(x[:2000], y[:2000], monotone)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    for f in np.flatnonzero(monotone):
        at = np.repeat(x[:50], 40, axis=0)
        at[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(forest.margin(at).reshape(50, 40), axis=1)
        assert (steps * monotone[f] >= -1e-9).all()
    one = forest.margin(x[:1])[0]
    node_by_node = forest.base
    for root in forest.roots:  # the flat arrays say what walking the trees says
        n = root
        while forest.left[n] != n:
            n = forest.left[n] if x[0, forest.feature[n]] <= forest.threshold[n] else forest.right[n]
        node_by_node += forest.value[n]
    assert one == pytest.approx(node_by_node)


def test_quality_classifier(spark, docs, no_docs, labels):
    rng = random.Random(8)
    good = [(i, " ".join(rng.choice(["river", "stone", "wind"]) + rng.choice("abc") for _ in range(60)), 1) for i in range(0, 200, 2)]
    bad = [(i, " ".join(rng.choice(["river", "stone"]) + "%%" for _ in range(60)) if i % 4 == 1 else "spam " * 60, 0) for i in range(1, 200, 2)]
    table = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in good + bad], "doc_id long, quality int")
    from tessera.llm.shared import remainder

    model = quality_classifier.train(table, marks, remainder("doc_id", 3) != 1)
    found = {r["doc_id"]: r["predicted"] for r in quality_classifier.classify(table, model).collect()}
    held = [r for r in good + bad if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 20 and all(found[r[0]] == r[2] for r in held)
    odd = quality_classifier.classify(docs, model, keep=["doc_id", "text"]).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in odd)
    assert len({r["score"] for r in odd if not r["text"]}) == 1  # the intercept alone
    assert quality_classifier.classify(no_docs, model).collect() == []
    assert {r["score"] for r in quality_classifier.classify(docs, quality_classifier.train(docs, labels.where("false"))).collect()} == {0.5}


GPT = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("shards", [1, 4])
def test_token_files(spark, docs, tmp_path, shards):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(GPT)
    index = token_files.write_token_files(docs, f"file://{tmp_path}/t", GPT, end_id=2, shards=shards)
    found = token_files.read_token_files(spark, f"file://{tmp_path}/t").collect()
    ids = [(r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in make_docs()]
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=repr)
    assert got == sorted(((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids), key=repr)
    order = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0] + [r["n_tokens"] for r in order])[:-1].tolist()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert keys == sorted(keys) and sum(s["ids"] for s in index["shards"]) == sum(len(x) for _, x in ids)


def test_token_files_of_nothing(spark, no_docs, tmp_path):
    index = token_files.write_token_files(no_docs, f"file://{tmp_path}/t", GPT, end_id=2)
    assert index["shards"] == [] and token_files.read_token_files(spark, f"file://{tmp_path}/t", index).collect() == []


def test_piece_encoder_is_the_librarys():
    encode = token_files.PieceEncoder(GPT, cache=40)
    rng = random.Random(2)
    parts = [" ", "  ", "a", "the", "ing", "\n", "\t", "é", "漢", "😀", ".", ",", "1", "    ", "'s", "'", "\xa0", "ª", "٣", "<|endoftext|>", "S,", "d."]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encode(t), encode.dtype).tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


def test_strings_of_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    encode, plain = token_files.PieceEncoder(GPT), Tokenizer.from_file(GPT)
    for t in ("hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b c", "no <|endoftext| > here", "plain words, only"):
        assert np.frombuffer(encode(t), encode.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encode("hello <|endoftext|> world"), encode.dtype)


def test_any_white_space_at_line_breaks():
    """200,000 random texts have the ids that the library gives them."""
    rng = random.Random(11)
    signs = [" "] * 4 + ["\n"] * 3 + [*" \t\r\x0b\x1c\x85 　.'saZéß漢字яع7٣½_-!​́😀", "re", "<|endoftext|>"]
    encode = token_files.PieceEncoder(GPT)
    assert encode("x a\n  b") == encode.whole("x a\n  b")
    for _ in range(20):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(10_000)]
        assert encode.encode_all(texts) == [encode.whole(t) for t in texts]
