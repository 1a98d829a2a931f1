import numpy as np

from treelens.llm import langid

TRAIN = [("the cat and the dog are on the mat with other things", "en"), ("der hund und die katze sind auf dem weg mit anderen dingen", "de"), ("слово о полку игореве и другие", "ru")] * 5
SCHEMA = "doc_id long, text string, lang string, extra string, held_out string"


def test_viterbi_equals_brute_force():
    random = np.random.default_rng(3)
    lengths = np.array([0, 4, 1, 6, 3])
    emit = random.normal(0, 3, (lengths.sum(), 3)).astype(np.float32)
    got, at = langid.viterbi(emit, lengths, 2.0), 0
    for n in lengths:
        part = emit[at : at + n]

        def value(path):
            return sum(part[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

        if n:
            best = max(value(p) for p in np.ndindex(*[3] * int(n)))
            assert abs(value(tuple(got[at : at + n])) - best) < 1e-4
        at += n


def test_mixed_text_gets_spans_and_script_narrows():
    model = langid.Model(TRAIN)
    text = "the cat and the dog are on the mat with other things der hund und die katze auf dem weg слово о полку"
    (lang, score, spans), = langid.predict([text], model)
    assert lang == "en" and 0 < score < 1
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert text[spans[1]["begin"] : spans[1]["end"]] == "der hund und die katze auf dem weg"
    assert langid.predict(["игорь"], model)[0][0] == "ru"


def test_edges(spark):
    rows = [(1, None, "en", "x", "y"), (2, "", None, "x", "y"), (3, "123 !?", "en", "x", "y"), (None, "the dog", None, None, None), (4, "the dog " * 30000, "en", "x", "y"), (4, "漢字", "en", "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.Model(TRAIN)
    got = langid.identify(docs, model).collect()
    assert sorted(((r.doc_id or 0), r.lang_pred) for r in got) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "en")]
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs.limit(0), model).count() == 0
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    empty = langid.fit(docs.where("false"))
    assert langid.identify(docs, empty).where("lang_pred <> 'und'").count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs), spans=False).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
