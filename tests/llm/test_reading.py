import random

from quire.llm import reading as R

WORDS = {
    1: "dog ball sun tree red small run jump look cat home play".split(), 2: "train meter spring speed lamp wire battery length weight table".split(),
    3: "acceleration resultant friction refraction equilibrium conductor oscillates magnitude".split(), 4: "hamiltonian ergodicity eigenvalues tensor asymptotic variational invariant entropy".split(),
}


def test_levels_of_held_out_documents(spark):
    rng = random.Random(3)
    docs, truth = [], {}
    for i in range(600):
        lv = rng.randint(1, 4)
        near = [x for x in (lv - 1, lv, lv + 1) if x in WORDS]
        words = [rng.choice(WORDS[lv if rng.random() < 0.75 else rng.choice(near)]) for _ in range(60)]
        truth[i] = lv
        docs.append((i, " ".join(words), "z"))
    labels = [(i, "r", truth[i]) for i in range(0, 600, 5)] + [(0, "r2", truth[0]), (5, "r2", None), (77777, "r", 2)]
    docs += [(900, None, "z"), (901, "", "z"), (902, "12 + 5", "z"), (903, "неизвестное слово", "z"), (904, "dog sun " * 30_000, "z")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, difficulty string")
    l = spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in R.levels(d, l).collect()}
    held = [i for i in truth if i % 5]
    assert sum(got[i] == truth[i] for i in held) >= 0.9 * len(held)
    assert {900, 901, 902}.isdisjoint(got) and got[904] == 1 and got[903] in (1, 2, 3, 4)
    assert R.levels(d.limit(0), l).count() == 0
    assert set(r["reading_level"] for r in R.levels(d, l.limit(0)).collect()) <= {1, 2, 3, 4}
