"""Extra columns whose names are those that the operators use inside."""

from lodestone.llm import codes, decontaminate, jaccard, langid, packing, partitions, pii, quality, tree
from lodestone.llm.shared import held_out

ROWS = [(1, "Mr John Smith wrote to a.b@c.org about ten plain words here today", "en", 5, "x", 7, "k", "n", 1.5, "z"), (2, None, "de", None, "x", 7, "k", "n", None, "z"), (3, "", None, 5, None, 7, "k", "n", 2.5, "z")]
SCHEMA = "doc_id long, text string, lang string, n_words int, items string, h int, pii_key string, pii_new string, score double, held_out string"


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_document_operators_bear_any_columns(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "ten plain words")], "item_id long, text string")
    got = {r.doc_id: r for r in pii.replace_pii(docs).collect()}
    assert list(got[1].asDict()) == [c.split()[0] for c in SCHEMA.split(", ")] and "Smith" not in got[1].text and got[1].pii_key == "k" and got[2].text is None
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 2, 3] and jaccard.keep_one(docs).columns == docs.columns
    assert sorted(r.doc_id for r in decontaminate.find_matches(docs, bench, only_clean=True).collect()) == [2, 3]
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 3 and quality.keep_good(docs, model).columns == docs.columns
    assert langid.predict(docs, langid.fit(docs, ~held_out())).count() == 3
    assert packing.pack(docs).count() == 3


def test_vector_and_turn_operators_bear_any_columns(spark):
    rows = [(i, [float(i), 1.0] * 8, 1, i, "c", 2.0, "v") for i in range(4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, c long, code string, low double, v string")
    assert codes.compress(vectors)[0].count() == 4
    assert partitions.nearest(vectors, lambda i: i == 0).count() == 3
    turns = spark.createDataFrame([(20, 0, "u", "a", 1, 2, "x", "t", 3)], "conv_id long, turn long, role string, text string, conv long, f long, x string, t string, words long")
    assert tree.conversation_tree(turns).count() == 2
