import random

import numpy as np

from quire.llm import align as A

# one idea a row, in three languages
IDEAS = [
    ("the turtle walks to the lake", "die schildkröte geht zum see", "la tortuga camina hacia el lago"), ("the lamp releases heat", "die glühbirne gibt wärme ab", "la lámpara cede calor"), ("the child watches stars", "das kind beobachtet sterne", "el niño mira estrellas"),
    ("snow melts quickly", "schnee schmilzt schnell", "nieve derrite rápidamente"), ("a dog pulls ropes", "ein hund zieht seile", "un perro tira cuerdas"), ("friction stops wheels", "reibung bremst räder", "rozamiento frena ruedas"),
    ("trains leave stations", "züge verlassen bahnhöfe", "trenes salen estaciones"), ("gas expands slowly", "gas dehnt langsam aus", "gas expande despacio"), ("springs stretch far", "federn dehnen weit", "muelles estiran lejos"), ("the moon shines tonight", "der mond scheint heute", "la luna brilla hoy"),
]


def make(n, seed=0):
    rng = random.Random(seed)
    rows, truth = [], set()
    for k in range(n):
        ideas = rng.sample(range(len(IDEAS)), 5)
        o, t = 2 * k, 2 * k + 1
        la, lb = rng.sample(range(3), 2)
        rows.append((o, None, "\n".join(IDEAS[i][la].capitalize() + "." for i in ideas)))
        place = list(range(5))
        if k % 4 == 1:
            place.remove(2)
        if k % 4 == 2:
            place[0], place[1] = place[1], place[0]
        lines, no = [], 1
        if k % 4 == 3:  # the first two lines joined
            lines.append(IDEAS[ideas[0]][lb].capitalize() + ", " + IDEAS[ideas[1]][lb] + ".")
            truth |= {(t, 1, o, 1), (t, 1, o, 2)}
            place = place[2:]
        for p in place:
            lines.append(IDEAS[ideas[p]][lb].capitalize() + ".")
            truth.add((t, len(lines), o, p + 1))
        rows.append((t, o, "\n".join(lines)))
    return rows, truth


def test_alignment(spark):
    rows, truth = make(500)
    rows += [(9001, 0, None), (9002, 77777, "No origin here."), (9003, 0, ""), (9004, 0, "\n\n$$ x $$"), rows[1], (9005, 9006, "Word " * 20_000), (9006, None, "Wort " * 20_000)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "file_id bigint, origin_id bigint, content string, share int")
    rows = A.links(d).collect()
    got = {(r["translation"], r["line_t"], r["origin"], r["line_o"]) for r in rows if r["line_t"] and r["line_o"]}
    kinds = {(r["translation"], r["line_t"], r["line_o"]): r["kind"] for r in rows}
    assert len(kinds) == len(rows)
    joined = [kinds.get((2 * k + 1, 1, o)) for k in range(3, 500, 4) for o in (1, 2)]
    left_out = [kinds.get((2 * k + 1, None, 3)) for k in range(1, 500, 4)]
    assert joined.count("merge") > 0.9 * len(joined) and left_out.count("omitted") > 0.9 * len(left_out)
    assert kinds[1, 1, 1] == "one"
    assert {g[0] for g in got}.isdisjoint({9001, 9002, 9003, 9004})
    got = {g for g in got if g[0] < 9000}
    right = len(got & truth)
    assert right >= 0.93 * len(truth) and right >= 0.93 * len(got), (right, len(got), len(truth))
    assert A.links(d.limit(0)).count() == 0


def test_transport_keeps_masses():
    rng = np.random.default_rng(1)
    cost = rng.random((3, 4, 5)).astype(np.float32)
    a, b = np.full((3, 4), 0.25, np.float32), np.full((3, 5), 0.2, np.float32)
    a[1, 3] = 0  # padding
    plan = A.transport(cost, a, b, 200)
    assert (plan.sum(2) <= a + 1e-4).all() and (plan.sum(1) <= b + 1e-4).all() and plan[1, 3].max() == 0


def test_gather_sum_like_a_loop():
    rng = np.random.default_rng(2)
    src, idx = rng.random((50, 3)).astype(np.float32), rng.integers(0, 50, 200)
    counts = np.array([0, 5, 1, 0, 7, 5])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    want = np.stack([src[idx[s : s + n]].sum(0) for s, n in zip(starts, counts)])
    assert np.allclose(A.gather_sum(src, idx, starts, counts), want, atol=1e-5)


def test_blocks_give_the_same_plan(monkeypatch):
    rng = np.random.default_rng(3)
    va, vb = A._unit(rng.normal(size=(37, 8)).astype(np.float32)), A._unit(rng.normal(size=(23, 8)).astype(np.float32))
    a, b = rng.random(37).astype(np.float32), rng.random(23).astype(np.float32)
    whole = A.transport((1 - va @ vb.T + A.FAR_COST * A._far(37, 23, 0, 37))[None].astype(np.float32), a[None], b[None])[0]
    monkeypatch.setattr(A, "CELLS", 23 * 5)
    parts = list(A.transport_by_blocks(va, vb, a, b))
    assert len(parts) == 8 and np.allclose(np.concatenate([p[2] for p in parts]), whole, atol=1e-4)


def test_groups():
    t, o = np.array([0, 0, 1, 2, 3, 4, 4, 5]), np.array([0, 1, 2, 3, 3, 4, 5, 5])
    assert A.groups(t, o, 6, 6).tolist() == [1, 1, 0, 2, 2, 3, 3, 3]


def test_hot_origin_travels_once_a_bundle(spark, monkeypatch):
    monkeypatch.setattr(A, "SALT", 500)
    whole = "\n".join(f"Line number {k} has {k * 7} apples." for k in range(1, 61))
    rows = [(0, None, whole), (0, None, whole)] + [(k, 0, f"Zeile {k % 60 + 1} hat {(k % 60 + 1) * 7} Äpfel.") for k in range(1, 3001)] + [(5000, 7, "Eine Zeile."), (7, 0, "One line."), (9, 8, "Nobody there.")]
    d = spark.createDataFrame(rows, "file_id bigint, origin_id bigint, content string")
    made = A.bundles(d, "file_id", "origin_id", "content").toPandas()
    hot = made[made.original == 0]
    assert hot.counted.sum() == 1 and 3001 // A.BUNDLE <= len(hot) < 3001 // A.BUNDLE + 20
    assert sum(len(k) // 8 for k in hot["keys"]) == 3000 and hot.there.all()
    both = made[made.original == 7]  # a translation that is an original, too
    assert both.there.all() and not both.counted.any() and len(both["keys"].iloc[0]) == 8
    got = {(r["translation"], r["line_t"], r["line_o"]) for r in A.links(d).where("kind = 'one' and origin = 0").collect()}
    assert len(got & {(k, 1, k % 60 + 1) for k in range(1, 3001)}) > 2900
