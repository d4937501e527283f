import random

import pyarrow as pa

import corpus_pipeline
from quern.llm import importance, lattice, personal_data, sentencepiece_scan
from tests_support import contamination_brute, roots_of, shingle_set

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count() and last.where("not text_ok").count() == 0


def planted():
    """Clean, toxic and low-quality documents, near copies, benchmark passages, personal data, and odd rows."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n=80: [rng.choice(words) for _ in range(n)]
    items = [(1, " ".join(prose(30))), (2, None), (3, " ".join(prose(6)))]
    rows, labels = [], []
    for i in range(600):
        w, kind = prose(), i % 10
        if kind == 1:
            for _ in range(6):
                w[rng.randrange(80)] = rng.choice(["vileword", "badword"])
        if kind == 2:
            w = [x.upper() + "!!" for x in w]
        if kind == 3 and rows:
            w = [*rows[-3][1].split(), "tail"]  # a near copy of a clean document
        if kind == 4:
            w[10:10] = items[0][1].split()[2:20]
        if kind == 5:
            w[5:5] = ["mail", f"a{i}@mail.example.org", "from", "10.0.0.7"]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if kind == 2 else 1, 1 if kind == 1 else 0))
    rows += [(7000, None), (7001, ""), (7001, ""), (7002, rows[0][1]), (7002, rows[0][1]), (None, rows[5][1]), (7003, " ".join(prose(9000))), (7004, "one")]
    return rows, labels[:400], items


def test_run_against_plain_loops(spark, tmp_path):
    rows, labels, items = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 2.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k long, row string, gumbel_key double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # the fitted model is given; all else is plain loops over rows
    model = importance.fit(docs, known)
    weight = [float(importance.weights(pa.array([t], pa.string()), model, model.dense())[0]) for _, t in rows]
    key = [w / 0.5 + float(importance.gumbel(pa.array([i], pa.int64()), 11)[0]) for w, (i, _) in zip(weight, rows)]
    least = sorted(key, reverse=True)[sum(w >= 0 for w in weight) - 1]
    left = [r for r, k in zip(rows, key) if k >= least]
    sets = {n: shingle_set(t) for n, (_, t) in enumerate(left)}
    root, groups = roots_of(sets), {}
    for n in sets:
        groups.setdefault(root[n], []).append(n)
    chosen = [min(g, key=lambda n: (left[n][0] is None, left[n][0] or 0)) for g in groups.values() if sets[g[0]]]
    left = [left[n] for n in sorted(chosen + [n for n in sets if not sets[n]])]
    dirty = [contamination_brute([(0, t)], items)[0][4] for _, t in left]
    left = [r for r, d in zip(left, dirty) if not d]
    models = personal_data.fitted()
    left = [(i, personal_data.redacted(t, models)) for i, t in left]
    memory = sentencepiece_scan.encoder(lattice.load(lattice.default_model()))
    want = [(i, tuple(memory.encode([t])[0].tolist())) for i, t in left]
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    assert all(r["text_ok"] and r["n_pieces"] == len(r["ids"]) for r in got)

    # planted cases: what must go has gone, and clean documents are there
    ids = {r["doc_id"] for r in got}
    kinds = {k: sum(i in ids for i in range(k, 600, 10)) for k in range(10)}
    assert kinds[1] + kinds[2] + kinds[4] <= 6 and kinds[3] <= 6 and min(kinds[k] for k in (0, 5, 6, 7, 8, 9)) >= 58, kinds


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    empty = docs.where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
