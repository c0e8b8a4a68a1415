"""The corpus pipeline stage by stage, and the queries of the subpackage."""

import random

import corpus_pipeline
from repalign.llm import queries

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, folder):
    rng = random.Random(3)
    words = "the of and river stone light green under house walk seven paper north cloud table".split()
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n))
    texts = {k: prose(50) for k in range(150)}
    for k in range(0, 150, 5):
        texts[k] += " you zorgle fool"
    texts[201] = texts[1] + " more"
    texts[202] = texts[1]
    item = prose(20)
    texts[203] = f"{prose(30)} {item} {prose(30)}"
    texts[204] = f"{prose(30)} mail me at jo.doe@mail.example.com soon"
    texts.update({205: None, 206: "", 207: prose(9_000)})
    rows = [(k, t, "en", None, len(t) if t is not None else None) for k, t in texts.items()]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 2), int(k % 5 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_run(spark, tmp_path):
    texts = _tables(spark, str(tmp_path))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {k for k in range(0, 150, 5)}
    assert set(got) == set(texts) - toxic - {201, 202, 203}
    assert got[204].text.endswith("mail me at <EMAIL> soon") and got[204].n_chars == len(got[204].text)
    assert all(got[k].text == texts[k] for k in set(got) - {204}) and got[205].n_pieces == 0 and got[207].n_pieces > 9_000
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "benchmark_decontamination", "personal_data", "sentence_pieces"]


def test_stages_of_an_empty_table(spark, tmp_path):
    _tables(spark, str(tmp_path))
    none = spark.createDataFrame([], SHAPE)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_toxic_documents_go_whatever_the_columns_are_named(spark, tmp_path):
    _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    more = docs.union(docs.where("doc_id in (1, 5, 205)")).union(docs.limit(1).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    more = more.selectExpr("*", "doc_id as score", "'p' as predicted", "1 as held_out", "2 as row")
    got = corpus_pipeline.remove_toxic(spark, more, str(tmp_path))
    assert got.columns == more.columns
    rows = got.collect()
    assert all(r.score == r.doc_id and r.predicted == "p" and r.row == 2 for r in rows)
    assert sorted((r.doc_id for r in rows), key=str) == sorted((r.doc_id for r in more.collect() if not "you zorgle" in (r.text or "")), key=str)


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
