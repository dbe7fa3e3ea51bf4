import corpus_pipeline
from govspark.llm import additive, simhash, substrings
from llm import brute


def test_stages_on_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in additive.score_documents(docs, labels).collect() if r["score"] >= 0.3}
    first = corpus_pipeline.quality(spark, docs, sf_dir)
    assert {r["doc_id"] for r in first.collect()} == good and first.columns == docs.columns

    items = sorted((r["doc_id"], brute.simhash(r["text"])) for r in first.collect())
    second = corpus_pipeline.near_duplicates(spark, first, sf_dir)
    assert {r["doc_id"] for r in second.collect()} == set(brute.components(items, lambda a, b: (a ^ b).bit_count() <= 2))

    third = corpus_pipeline.passages(spark, second, sf_dir)
    texts = {r["doc_id"]: r for r in third.collect()}
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    for (doc, _), (w, gone) in zip(rows, brute.removed(rows), strict=True):
        assert texts[doc]["text"].split() == " ".join(x for x, g in zip(w, gone, strict=True) if not g).split()
        assert texts[doc]["n_chars"] == len(texts[doc]["text"])

    fourth = corpus_pipeline.mix(spark, third, sf_dir)
    assert fourth.columns == docs.columns
    words = lambda df: sum(len(brute.words(r["text"])) for r in df.collect())
    assert abs(words(fourth) / (1.5 * words(third)) - 1) < 0.1
    assert all(r["round_trip"] for r in corpus_pipeline.piece_ids(spark, fourth, sf_dir).collect())


def test_stages_on_edge_documents(spark, edge_docs, tables):
    sf = tables(documents=edge_docs, labels=spark.createDataFrame([(7, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int"))
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edge_docs.columns
    assert len(corpus_pipeline.run(spark, sf).collect()) == docs.count()
    empty = edge_docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    """Row 5 is there as a copy of row 1 and with a text of its own; the copy goes."""
    text, own = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (5, text), (5, own), (6, own), (5, own), (None, text), (7, None), (8, "")], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, text), (5, own), (5, own), (7, "")]


def test_modules_are_the_stages_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mix", "piece_ids"]
    assert substrings.WINDOW == 20 and simhash.MAX_BITS == 2
