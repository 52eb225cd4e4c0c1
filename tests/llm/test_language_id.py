import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as L
from tessera.llm.queries import held_out

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(SF).where(~held_out()), per_lang=200)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(SF).where(held_out())
    said = L.predict(docs, model, keep=["doc_id", "lang"])
    right, n, low = said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 150 and right > 0.97 and low <= 0.02 * n


def test_edge_rows(corpus, empty, model):
    got = {i: r for i, r in enumerate(L.predict(corpus, model).collect())}
    assert len(got) == corpus.count() and set(corpus.columns) | {"lang_pred", "rejected"} == set(got[0].asDict())
    by = {r.id: r for r in got.values()}
    for i in (4, 5, 6, 11, 12):  # empty, null, blank, null, no letters
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert by[13].lang_pred == "fr" and 0 <= by[13].score <= 1
    assert L.predict(empty, model).count() == 0 and L.fit(empty) is None
    assert {r.lang_pred for r in L.predict(corpus, None).collect()} == {"und"}


def test_long_texts_are_read_whole():
    text = np.frombuffer(b" " + b"abc def " * 60, np.uint8)
    whole = [np.bincount(b, minlength=(1 << L.BITS) + 1)[:-1] for b in L._buckets(text, np.array([0, len(text)]))]
    old, L.LONG = L.LONG, 100
    try:
        parts = [np.zeros(1 << L.BITS, np.int64) for _ in whole]
        for part, first in L._parts(text, np.array([0, len(text)])):
            for k, b in enumerate(L._buckets(part, first)):
                parts[k] += np.bincount(b[:L.LONG], minlength=(1 << L.BITS) + 1)[:-1]
    finally:
        L.LONG = old
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


#: The first article of the Declaration of Human Rights, or the like of it.
UNLEARNED = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."}


def test_unlearned_languages_and_random_letters_are_rejected(spark, model):
    rng = __import__("random").Random(2)
    rows = [(" ".join(rng.sample(t.split(" "), len(t.split(" ")))), lang) for lang, t in UNLEARNED.items() for _ in range(20)]
    rows += [(" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(3, 9))) for _ in range(rng.randrange(8, 60))), "letters") for _ in range(100)]
    said = L.predict(spark.createDataFrame(rows, "text string, lang string"), model)
    gone = {r.lang: r.gone for r in said.groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("gone")).collect()}
    assert all(x >= 0.9 for x in gone.values()), gone
    kept = L.predict(spark.read.parquet(SF), model, keep=["doc_id"]).where(F.col("lang_pred") != "und").agg(F.avg((~F.col("rejected")).cast("int"))).first()[0]
    assert kept >= 0.99


def test_scores_are_calibrated(spark, model):
    said = L.predict(spark.read.parquet(SF).where(held_out()), model, keep=["lang"]).where("lang_pred <> 'und'")
    mean, right, n = said.agg(F.avg("score"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert abs(mean - right) < 0.03 and 2e-4 < model.temperature < 5e3
    z = np.array([[4.0, 0, 0], [0, 3.0, 0], [0, 2.0, 1.0], [1.0, 0, 0.5]])
    t = L.calibrated(z, np.array([0, 1, 2, 0]))
    assert abs((1 / np.exp((z - z.max(axis=1, keepdims=True)) / t).sum(axis=1)).mean() - 4 / 6) < 1e-6


def test_predictions_equal_a_plain_loop(spark, model):
    docs = spark.read.parquet(SF).limit(40).collect()
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(docs), model, keep=["doc_id"]).collect()}
    for d in docs:
        data = bytes(L._FOLD[np.frombuffer((" " + d.text + " ").encode(), np.uint8)])
        sums, known, n = np.zeros(len(model.langs)), np.zeros(len(model.langs)), 0
        for g in L.GRAMS:
            for i in range(len(data) - g + 1):
                gram = data[i:i + g]
                if gram.strip(b" "):
                    code = 0
                    for c in gram:
                        code = (code * 0x01000193 + c) & 0xFFFFFFFF
                    b = (((code ^ (code >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - L.BITS)
                    sums, known, n = sums + model.table[b].astype(float), known + model.logs[b].astype(float), n + 1
        z = (sums / max(n, 1) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if n:
            k = int(p.argmax())
            assert got[d.doc_id].lang_pred == model.langs[k] and got[d.doc_id].score == pytest.approx(p[k], abs=1e-6)
            assert got[d.doc_id].rejected == (p[k] < L.MAJORITY or known[k] / n < model.familiar)


def test_dotted_names_and_repeated_ids(spark, model):
    docs = spark.createDataFrame([(1, "Çà et là, des élèves", "x")], "`doc.id` bigint, text string, `a.b` string")
    assert L.predict(docs, model).columns == ["doc.id", "text", "a.b", "lang_pred", "score", "rejected"]
    same = spark.createDataFrame([(7, "en" if i % 2 else "de", f"w{i} the und") for i in range(3000)], "doc_id bigint, lang string, text string")
    rows = L._drawn(same.select(F.col("doc_id").alias("id"), "lang"), 100, 11).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in rows} == {"en": 100, "de": 100}
