"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from pairwright.llm import (decontamination, embedding_dedup, html_main, packing, secret_scan, sharding, simhash,
                            substring_dedup, token_counts, toxicity)

SCHEMA = "doc_id long, text string, lang string, k long, id string, number int, score double, words array<string>, _id int, doc string"
LONG = "lorem ipsum dolor " * 30_000
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (None, "null id " * 30), (4, "same words here again " * 20),
         (4, "same words here again " * 20), (5, "same words here again " * 20), (6, LONG), (7, "é 日本語 x\x00y"), (8, "one")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, "x", 2, None, ["w"], 3, "d") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return frame(spark, TEXTS if request.param == "rows" else [])


def ids(df):
    return sorted(str(r[0]) for r in df.select("doc_id").collect())


def test_token_counts(docs):
    out = token_counts.section_tokens(docs).collect()
    total = {}
    for r in out:
        total.setdefault((r.doc_id, r.doc_tokens), []).append(r.n_tokens)
    assert sum(r.section == 0 for r in out) == docs.count()
    assert all(sum(v) % k[1] == 0 if k[1] else not sum(v) for k, v in total.items())


def test_packing(docs):
    out = packing.pack_documents(docs)
    assert sorted(str(r[0]) for r in out.filter("start = 0").select("doc_id").collect()) == ids(docs)
    assert all(r.doc_tokens == 1 for r in out.filter("doc_id in (1, 2)").collect())


def test_secret_scan(docs):
    model = secret_scan.train(docs)
    assert model is None
    out = docs.select("doc_id", secret_scan.spans("text", model).alias("s")).collect()
    assert len(out) == docs.count() and not any(r.s for r in out)
    assert docs.select(secret_scan.redacted("text", None)).exceptAll(docs.select("text")).count() == 0


def test_substring_dedup(docs):
    out = {(r.doc_id, r.n_words): r for r in substring_dedup.without_repeats(docs).collect()}
    assert len(substring_dedup.without_repeats(docs).collect()) == docs.count()
    if out:
        assert out[5, 80].n_removed == 80 and out[1, 0].n_removed == 0
        assert out[4, 80].n_removed == 80 - 4       # the words before the first repeated window stay
        assert out[6, 90_000].n_removed == 90_000 - 3


def test_sharding(docs):
    out = sharding.shard_records(docs, [1.0, 2.0, 1.0])
    assert ids(out) == ids(docs)
    for shard in out.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect():
        assert shard.s == list(range(len(shard.s)))
    assert {r["size"] for r in out.filter("doc_id in (1, 2)").collect()} <= {16}


def test_toxicity(docs, spark):
    none = spark.createDataFrame([(2, 1), (None, 0), (9, None), (8, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert not model.trained
    labels = spark.createDataFrame([(i, y) for i in range(1, 9) for y in [i % 2]], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = docs.select("doc_id", toxicity.score("text", model).alias("s"), toxicity.threshold("lang", model).alias("t")).collect()
    assert len(out) == docs.count() and all(0 <= r.s <= 1 and r.t == 0.5 for r in out)


def test_decontamination(docs, spark):
    items = spark.createDataFrame([("a", "same words here again " * 5), ("b", None), (None, "null id " * 7), ("c", "ONE"),
                                   ("c", "one"), ("d", "")], "item_id string, text string")
    out = {(r.doc_id, r.n_words): r for r in decontamination.contamination(docs, items).collect()}
    assert decontamination.contamination(docs, items).count() == docs.count()
    nothing = decontamination.contamination(docs, items.limit(0))
    assert nothing.filter("n_hit > 0").count() == 0 and nothing.count() == docs.count()
    clean = decontamination.uncontaminated(docs, items)
    assert clean.columns == docs.columns
    if out:
        assert out[4, 80].n_hit == 80 and out[4, 80].item_ids == ["a"]
        assert out[8, 1].n_hit == 1 and out[8, 1].item_ids == ["c"]
        assert out[None, 60].n_hit == 60 and out[None, 60].item_ids == []
        assert out[1, 0].n_hit == 0
        assert ids(clean) == ["1", "2", "3", "6", "7"]


def test_decontamination_beyond_the_broadcast_bound(docs, spark):
    items = spark.createDataFrame([("a", "same words here again " * 5), ("c", "ONE")], "item_id string, text string")
    near = decontamination.contamination(docs, items)
    far = decontamination.contamination(docs, items, broadcast_rows=0)
    assert sorted(map(repr, near.collect())) == sorted(map(repr, far.collect()))


def test_simhash(docs):
    out = simhash.near_duplicates(docs)
    assert ids(out) == ids(docs)
    of = {r.doc_id: r for r in out.collect()}
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    if of:
        assert of[1].fingerprint == "0" * 16 and of[1].component_id == of[2].component_id == of[3].component_id == 1
        assert of[5].component_id == 4
        assert ids(one) == ["1", "4", "6", "7", "8", "None"]


def test_html(spark):
    rows = [(1, None, None), (None, "http://a.example/x", "<p>one"), (2, "http://a.example/y", ""),
            (2, "http://a.example/y", ""), (3, "strange", "<article><p>" + "long " * 50_000), (4, "", "<a <b>>&#x110000; &lt")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, paths string")
    out = {r.page_id: r for r in html_main.main_text(pages).collect()}
    assert html_main.main_text(pages).count() == 6 and html_main.main_text(pages.limit(0)).count() == 0
    assert html_main.main_text(pages, broadcast_hosts=0).count() == 6
    assert out[1].text == out[2].text == "" and out[None].text == "one" and out[3].n_chars == 5 * 50_000 - 1


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.001]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, n int")
    out = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(vectors).collect())
    assert out == [(0, 4, 7), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 4, 7), (8, 4, 7), (9, 4, 7),
                   (9, 4, 7), (10, 0, 10), (11, 0, 11)]
    assert embedding_dedup.near_vectors(vectors.limit(0)).count() == 0
