import random

from quern.llm import language_id


def test_rare_language_is_learned_beside_a_hot_one(spark):
    rng = random.Random(2)
    words = {"en": "the of and to in that house with from water".split(), "de": "der die und das nicht ein haus mit von wasser".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i in range(600) for x in ["de" if i in (101, 302, 503) else "en"]]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(labelled, sample=20)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(labelled, model).collect()}
    assert all(got[i] == x for i, _, x in rows)
