"""Language ID and toxicity: held-out accuracy and defined cases."""

from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity
from tidemark.llm.common import fold, table

SF01 = "/root/testdata/sf0.1"
SF001 = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF001, "documents")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 4) == 2)
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.99 and r[1] <= 0.01 and 0 <= r[2] <= r[3] <= 1


def test_language_rejects_what_it_cannot_read(spark, make_docs, edge_rows):
    docs = table(spark, SF001, "documents")
    model = langid.train(docs)
    rows = make_docs(edge_rows)
    got = langid.predict(rows, model).collect()
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 8):
        assert by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0
    assert by[7]["lang_pred"] in model.langs  # one letter is enough for a prediction
    kept = langid.identified(rows, model)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["rejected"]}
    nothing = langid.predict(rows, langid.train(make_docs([]))).collect()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in nothing)
    assert langid.predict(make_docs([]), model).count() == 0


def test_ngrams_have_no_inner_border():
    import numpy as np
    at, _ = langid.ngrams(langid.LETTER_BYTES[np.frombuffer(b" ab c ", np.uint8)])
    # " a", "ab", "b ", " c", "c "; " ab", "ab ", " c "; " ab "
    assert sorted(at) == [0, 0, 0, 1, 1, 2, 3, 3, 4]


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    lexicon = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    got = toxicity.score(docs, lexicon).join(labels, "doc_id").where(fold("doc_id", 5) == 0)
    c = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert c.get((1, 1), 0) >= 0.85 * (c.get((1, 1), 0) + c.get((1, 0), 0))
    assert c.get((0, 1), 0) <= 0.03 * (c.get((0, 1), 0) + c.get((0, 0), 0))


def test_folding():
    plain = toxicity.fold_text("stupid idiot")
    for text in ("STUPID idiot", "stup1d id10t", "ѕtuрid іdiоt", "ｓtupid ｉdiot", "$tupid idi​ot", "stup!d idiot!", "stupid, idiot..."):
        assert toxicity.fold_text(text).split() == plain.split(), text


def test_lexicon_matches_and_exceptions():
    fold_text = toxicity.fold_text
    lexicon = toxicity.Lexicon({fold_text("clown").strip().join("  "): 3.0, " " + fold_text("vequ").strip(): 2.0}, [fold_text("class clown")], (2.0, 1.0, -3.0))
    match = lexicon.matcher()
    assert match(fold_text("a CLOWN and c1own")) == [3.0, 3.0]
    assert match(fold_text("the class clown")) == [] and match(fold_text("clowns")) == []
    assert match(fold_text("vequille")) == [2.0] and match(fold_text("xvequ")) == []
    long = "word " * 200
    s = [lexicon.score(match, fold_text(t)) for t in ("", "clown", "clown " + long, long)]
    assert s[1] > s[2] > s[3] and s[0] == s[3] < 0.5


def test_toxicity_edge_rows(spark, make_docs, edge_rows):
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, None), (6, 1, 0), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.train(make_docs(edge_rows), labels)
    got = toxicity.score(make_docs(edge_rows), lexicon).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    empty = toxicity.train(make_docs([]), labels.limit(0))
    assert all(r["score"] == 0 for r in toxicity.score(make_docs(edge_rows), empty).collect())
    assert toxicity.score(make_docs([]), lexicon).count() == 0


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    """Ids with two texts: whichever comes first, the same one is learned from."""
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    labels = table(spark, SF001, "labels")
    twice = docs.unionByName(docs.select("doc_id", F.reverse("text").alias("text")))
    a, b = (toxicity.train(d, labels) for d in (twice.orderBy("doc_id", "text"), twice.orderBy(F.desc("text")).repartition(5)))
    assert a.weights == b.weights and a.exceptions == b.exceptions
    assert all(abs(x - y) < 1e-9 for x, y in zip(a.logistic, b.logistic))


def test_gibberish_is_rejected(spark, make_docs):
    import random
    r = random.Random(1)
    rows = [(k, " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 10))) for _ in range(60)))
            for k, letters in enumerate(["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ"] * 100)]
    model = langid.train(table(spark, SF001, "documents"), fold("doc_id", 4) != 2)
    got = langid.predict(make_docs(rows), model).collect()
    assert sum(x["rejected"] for x in got) >= 0.95 * len(rows)
