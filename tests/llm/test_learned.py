"""Language ID and toxicity: held-out accuracy, odd rows."""

from __future__ import annotations

import numpy as np

from ledgerloom.llm import language_id as L
from ledgerloom.llm import toxicity as T

ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !!"), (5, "a"), (6, "the and of " * 20_000), (None, "und der die sch"), (7, "the and"), (7, "the and")]


def test_language_query(spark, sf):
    d = L.op3_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = d[d.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and d.score.between(0, 1).all() and set(d.lang_pred) <= set(d.lang)


def test_language_odd_rows(spark, sf):
    filters = L.learn_filters(spark.read.parquet(f"{sf}/documents.parquet"))
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'clash' AS score", "'x' AS lang")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(df, filters).collect()]
    assert len(got) == len(ODD) and [x[1] for x in got][:4] == ["und"] * 4 and got[4][1] in filters.languages
    assert dict((x[0], x[1]) for x in got)[6] == "en" and dict((x[0], x[1]) for x in got)[None] == "de"
    assert L.identify(df.limit(0), filters).count() == 0
    nothing = L.learn_filters(df.selectExpr("text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in L.identify(df, nothing).collect()} == {"und"}
    kept = L.keep_known(spark.read.parquet(f"{sf}/documents.parquet"))
    assert kept.count() == 200 and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_many_languages_take_several_words():
    names = [f"l{i:03d}" for i in range(70)]
    members = [np.arange(i * 100, i * 100 + 100).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(70)]
    f = L.Filters(names, members)
    assert f.slots.shape[0] == 2
    for i in (0, 63, 64, 69):
        assert ((f.masks(members[i], i // 64) >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert max(f.false_positive) < 0.05


def test_toxicity_learns_subwords():
    rng = np.random.default_rng(0)
    syllables = ["ka", "lo", "mi", "ne", "ru", "sa", "to", "ve"]
    word = lambda: "".join(rng.choice(syllables, 3))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            w[10], w[40] = "grumblefool" + rng.choice(["s", "ed", ""]), "nastywretch"
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    bags = []
    for t in texts:
        u, c = np.unique(T.features([t])[0], return_counts=True)
        bags.append((u, c / c.sum()))
    model = T.train(bags[:300], np.asarray(labels[:300]), np.ones(300))
    s = model.scores(texts[300:])
    y = np.asarray(labels[300:])
    assert ((s >= 0.5) == y).mean() > 0.95
    unseen = model.scores([" ".join([*texts[301].split(), "grumbelfools", "nastywrech"]), texts[301]])
    assert unseen[0] > unseen[1]


def test_toxicity_query_and_odd_rows(spark, sf):
    d = T.op9_toxicity(spark, sf).toPandas()
    assert len(d) == 200 and d.score.between(0, 1).all() and (d.predicted == (d.score >= 0.3)).all()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = T.learn_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'clash' AS score")
    got = T.score_toxicity(df, model)
    assert got.count() == len(ODD) and got.select("score").distinct().count() == 1 and T.score_toxicity(df.limit(0), model).count() == 0


def test_language_sample_counts_copies_once(spark):
    words = [chr(97 + a) + chr(97 + b) + chr(97 + c) for a in range(26) for b in range(26) for c in range(2)]
    texts = [" ".join(words[i : i + 12]) for i in range(0, 1200, 3)]
    plain = spark.createDataFrame([(x, "aa") for x in texts], "text string, lang string")
    drawn = plain.selectExpr("text", "pmod(xxhash64(text), 1 << 30) AS h").orderBy("h").first()["text"]
    copied = spark.createDataFrame([(x, "aa") for x in [*texts, *[drawn] * 200]], "text string, lang string")
    a, b = (L.learn_filters(x, sample_docs=100, min_share=1e-3) for x in (plain, copied))
    assert a.size == b.size and (a.slots == b.slots).all()


FOREIGN = [
    "Nel mezzo del cammino di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. La casa era piccola ma gli amici venivano ogni giorno.",
    "De kinderen liepen langzaam door het bos terwijl de wind hard waaide en niemand wist waar het huis van de oude man lag. Morgen gaan wij naar de markt.",
    "Wczoraj wieczorem poszedlem do sklepu po chleb i mleko ale niestety wszystko bylo juz zamkniete. Jutro rano sprobuje jeszcze raz przed praca.",
    "Eilen illalla menin kauppaan ostamaan leipaa ja maitoa mutta valitettavasti kaikki oli jo suljettu. Huomenna aamulla yritan uudelleen ennen toita.",
]


def test_unknown_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    planted = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(FOREIGN)], "doc_id long, text string")
    kept = [r[0] for r in L.keep_known(docs.unionByName(planted, allowMissingColumns=True)).select("doc_id").collect()]
    assert set(kept) == ids and len(kept) == len(ids)


def test_pipeline_drops_what_is_predicted_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = T.learn_toxicity(docs, labels)
    want = {r[0] for r in T.score_toxicity(docs, model).where("predicted = 0").select("doc_id").collect()}
    assert {r[0] for r in T.drop_toxic(docs, labels).select("doc_id").collect()} == want
