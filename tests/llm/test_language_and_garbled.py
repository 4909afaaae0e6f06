import os
import random
import tracemalloc

import numpy as np
import pytest

from quire.llm import garbled as G
from quire.llm import language as L
from quire.llm.lines import lines_of

SENTENCES = {
    "en": "the turtle moves slowly towards the lake|how much heat does the lamp release|the acceleration depends on the applied force|friction between the surfaces can be neglected|the child looks at the night sky|we assume that the spring is stretched",
    "sk": "korytnačka sa hýbe pomaly k jazeru|koľko tepla uvoľní žiarovka|zrýchlenie závisí od pôsobiacej sily|trenie medzi povrchmi môžeme zanedbať|dieťa sa pozerá na nočnú oblohu|predpokladáme, že pružina je natiahnutá",
    "de": "die schildkröte bewegt sich langsam zum see|wie viel wärme gibt die glühbirne ab|die beschleunigung hängt von der kraft ab|die reibung zwischen den flächen ist klein|das kind schaut in den nachthimmel|wir nehmen an, dass die feder gedehnt ist",
    "ru": "черепаха медленно движется к озеру|сколько тепла выделяет лампа|ускорение зависит от приложенной силы|трением между поверхностями можно пренебречь|ребёнок смотрит на ночное небо|предположим, что пружина растянута",
}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SENTENCES))
        rows.append((i, lang, "\n".join(rng.choice(SENTENCES[lang].split("|")).capitalize() + "." for _ in range(5))))
    return rows


def test_lines():
    x = lines_of(["a\n\n% c\n$$ x\n![p]\n \ntail", None, "", "one"])
    assert [(int(t), int(n), bool(p)) for t, n, p in zip(x.text, x.number, x.prose)] == [(0, 1, True), (0, 2, False), (0, 3, False), (0, 4, False), (0, 5, False), (0, 6, False), (0, 7, True), (1, 1, False), (2, 1, False), (3, 1, True)]
    assert x.string(6) == "tail" and x.string(9) == "one"


def test_language_network_on_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 260)
    rows = corpus()
    rows[3] = (3, None, rows[3][2])
    rows[4] = (4, "sk" if rows[4][1] != "sk" else "de", rows[4][2])
    rows[5] = (5, "SK-sk" if rows[5][1] == "sk" else rows[5][1].upper(), rows[5][2])
    truth = {i: lang for i, lang, _ in corpus()}
    other = "de" if truth[6] != "de" else "sk"
    rows[6] = (6, truth[6], rows[6][2] + "\n" + SENTENCES[other].split("|")[0].capitalize() + ".")
    rows += [(900, "en", None), (901, "en", ""), (902, "en", "$$ x = y $$"), (903, None, "Kind schaut lange. " * 3000)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "file_id bigint, lang string, content string, confidence string")
    got = L.detect(d, L.train(d)).collect()
    main = {r["file_id"]: r for r in got if r["line_no"] == 0}
    right = sum(main[i]["lang"] == truth[i] for i in truth)
    assert right >= 0.98 * len(truth)
    assert not main[3]["labelled"] and not main[4]["labelled"] and main[5]["labelled"]
    assert (6, 6, other) in {(r["file_id"], r["line_no"], r["lang"]) for r in got if r["line_no"]}
    assert 900 not in main and main[901]["lang"] is None and main[902]["lang"] is None and main[903]["lang"] == "de"
    assert sum(r["line_no"] > 0 for r in got) <= 0.03 * 5 * len(truth)
    assert L.detect(d.limit(0), L.train(d.limit(0))).count() == 0


def test_a_full_memory_forgets_no_line_in_hand(monkeypatch):
    monkeypatch.setattr(L, "MEMO", 3)
    net, memo = L.Network(["de", "en"]), {}
    net.lines([b"one", b"two"], memo)
    got = net.lines([b"one", b"three", b"four", b"one"], memo)
    assert np.allclose(got, net.lines([b"one", b"three", b"four", b"one"], {}), atol=1e-5)


def test_languages_and_characters_come_from_all_texts(spark, monkeypatch):
    """However few texts the network begins with."""
    monkeypatch.setattr(L, "TRAIN_TEXTS", 3)
    monkeypatch.setattr(L, "STEPS", 40)
    begun = []
    monkeypatch.setattr(L.Network, "train", lambda self, x, y, train=L.Network.train: (train(self, x, y), begun.append({k: v.copy() for k, v in self.p.items()})))
    rows = corpus()
    net = L.train(spark.createDataFrame(rows, "file_id bigint, lang string, content string"))
    seen = G.empty_counts(4)
    G.count_texts(seen, lines_of([t for _, _, t in rows]), G.label_of([x for _, x, _ in rows], sorted(SENTENCES)))
    assert net.langs == sorted(SENTENCES)
    assert (net.native == (G.Bigrams(*seen, net.langs, L.USED).state == 0)).all()
    assert any((net.p[k] != begun[0][k]).any() for k in net.p)


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_the_passes_over_all_texts_make_no_copies():
    """Copies of each window's neighbourhoods, and of the whole table of bigrams, were most of the passes' time."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(32, 127, (L.BATCH, L.WINDOW)).astype(np.uint8), rng.integers(0, 2, L.BATCH)
    x[::3, 20:] = 32
    net = L.Network(["de", "en"])
    p = {k: v.copy() for k, v in net.p.items()}
    m, v2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    assert peak(lambda: net._step(x, y, np.random.default_rng(5), m, v2, 1, 1e-3, 0.01)) < 4e6
    # the same by the definition
    w = max(L.WIDTHS)
    cols = np.stack([p["embed"][x[:, t : t + w]].reshape(len(x), -1) for t in range(L.WINDOW - w + 1)], 1)
    h = cols @ p["filter"]
    fresh = L.Network(["de", "en"])
    a = np.maximum(h.max(1) + p["bias"], 0)
    assert np.allclose(fresh.scores(x), a @ p["out"] + p["prior"], atol=1e-4)
    drop = (np.random.default_rng(5).random(a.shape) > 0.2) / 0.8
    z = np.exp((a * drop) @ p["out"] + p["prior"])
    d = (z / z.sum(1, keepdims=True) - 0.99 * np.eye(2)[y] - 0.005) / len(y)
    da = (d @ p["out"].T) * (a > 0) * drop
    top = h.argmax(1)
    g_filter, g_embed = np.zeros(p["filter"].shape), np.zeros(p["embed"].shape)
    for i in range(len(x)):
        for f in range(a.shape[1]):
            g_filter[:, f] += da[i, f] * cols[i, top[i, f]]
            for j in range(w):
                g_embed[x[i, top[i, f] + j]] += da[i, f] * p["filter"][j * L.EMBED : (j + 1) * L.EMBED, f]
    assert np.allclose(m["filter"], 0.1 * g_filter * net.mask, atol=1e-6) and np.allclose(m["embed"], 0.1 * g_embed, atol=1e-6)

    langs = [f"{i:02d}" for i in range(12)]
    rows = [(rng.choice([*langs, "none"]), t) for _, _, t in corpus(1500)]
    lines, label, seen = lines_of([t for _, t in rows]), G.label_of([x for x, _ in rows], langs), G.empty_counts(12)
    assert peak(lambda: G.count_texts(seen, lines, label)) < seen[0].nbytes
    cur, before, _, line = G.stream(lines)
    lang = label[lines.text[line]]
    for table, unit in ((seen[1], lines.text[line]), (seen[2], line)):
        held = {(u, g, k) for u, g, c in zip(unit.tolist(), lang.tolist(), cur.tolist()) for k in (c, -1) if g >= 0}
        want = np.zeros(table.shape)
        for _, g, k in held:
            want[g, k] += 1
        assert (table == want).all()
    want = np.zeros(seen[0].shape)
    for g, b, c in zip(lang.tolist(), before.tolist(), cur.tolist()):
        want[g, b, c] += g >= 0
    assert (seen[0] == want).all()


def garble(text, how):
    if how == "lost":
        return text.encode("ascii", "replace").decode()
    if how == "fffd":
        return text.encode("cp1250").decode("utf-8", "replace")
    a, b = how
    return text.encode(a).decode(b)


@pytest.mark.parametrize("how", [("utf-8", "latin-1"), ("cp1250", "latin-1"), ("cp852", "cp1250"), "lost", "fffd"])
def test_damaged_lines_are_found(spark, how):
    rows = corpus(400, seed=3)
    hit = set()
    for i, (k, lang, text) in enumerate(rows):
        if lang == "sk" and k % 9 == 0:
            lines = text.split("\n")
            new = garble(lines[2], how)
            if new != lines[2]:
                hit.add((k, 3))
                lines[2] = new
            rows[i] = (k, lang, "\n".join(lines))
    rows += [(900, "sk", None), (901, "sk", ""), (902, None, "Ａｂｃ" + "​" * 3), (903, "sk", "koľko tepla uvoľní žiarovka " * 2000)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "file_id bigint, lang string, content string, language string")
    got = {(r["file_id"], r["line_no"]) for r in G.find(d, G.learn(d)).collect()}
    assert hit and len(hit & got) >= (0.6 if how[0] == "cp852" else 0.9) * len(hit)  # six sentences teach few bigrams
    assert len(got - hit) <= 2


def test_the_cipher_decides(spark):
    """Without the learned cipher nearly nothing is found; runs of any length are read by it."""
    rows = corpus(400, seed=3)
    for i, (k, lang, text) in enumerate(rows):
        if lang == "sk" and k % 9 == 0:
            rows[i] = (k, lang, garble(text, ("utf-8", "latin-1")))
    d = spark.createDataFrame(rows, "file_id bigint, lang string, content string")
    cipher = G.learn(d)
    found = G.find(d, cipher).count()
    g = cipher.bigrams.langs.index("sk")
    assert cipher.table[g, "Ã¡"][1].argmax() == list(cipher.bigrams.targets[g]).index(G.table_of("á"))
    empty = G.Cipher(cipher.bigrams, {}, {})
    lines = G.lines_of([t for _, _, t in rows])
    runs_only = lambda c: len(G.damaged(lines, G.label_of([x for _, x, _ in rows], c.bigrams.langs), c)[0])
    held, G.reread = G.reread, lambda texts, *_: [(None, 0.0)] * len(texts)
    try:
        assert found > 20 and runs_only(cipher) > 0.9 * found and runs_only(empty) == 0
    finally:
        G.reread = held


def test_what_a_run_can_be_is_found_once(monkeypatch):
    """However many neighbours it has; the readings are the best of all."""
    rows = corpus(120, seed=2)
    langs, seen = sorted(SENTENCES), G.empty_counts(4)
    G.count_texts(seen, lines_of([t for _, _, t in rows]), G.label_of([x for _, x, _ in rows], langs))
    bigrams, g = G.Bigrams(*seen, langs), langs.index("sk")
    rng, letters = np.random.default_rng(2), bigrams.targets[langs.index("sk")]
    runs = ["Ã¡", "Ã", "¡", "Ã©", "©"]
    cipher = G.Cipher(bigrams, {(g, r): (0.2, rng.dirichlet(np.ones(len(letters))).astype(np.float32)) for r in runs}, {(g, r): 3.0 for r in runs})
    asked = []
    monkeypatch.setattr(G, "table_of", lambda c, held=G.table_of: (asked.append(c), held(c))[1])
    for run in ("Ã¡Ã©", "Ã©", "¡"):
        cuts = {(): 0}
        for _ in run:
            cuts |= {(*x, run[sum(map(len, x)) : sum(map(len, x)) + n]): 0 for x in cuts for n in (1, 2) if sum(map(len, x)) + n <= len(run)}
        whole = [x for x in cuts if "".join(x) == run]
        asked.clear()
        got = {}
        for p in map(alphabet_place, "aeknr"):
            for n in map(alphabet_place, "mstv "):
                got[p, n] = cipher.read(g, run, p, n)
        assert len(asked) <= 60  # not for each pair of neighbours
        log = bigrams.log[g]
        for (p, n), (best, stays, read, sure) in got.items():
            paths = []
            for x in whole:
                ways = [(0.0, (p,))]
                for part in x:
                    ways = [(v + log[k[-1], c] + gain, (*k, c)) for v, k in ways for c, gain in cipher.letters(g, part) or []]
                paths += [(v + log[k[-1], n], k[1:]) for v, k in ways]
            v, k = max(paths)
            assert abs(v - best) < 1e-4 and list(k) == read and abs(sure - np.exp(v - np.logaddexp.reduce([x for x, _ in paths]))) < 1e-3
            assert abs(stays - G.fit_itself(run, log, np.array([p]), np.array([n]))[0] - cipher.itself(g, run)) < 1e-4


def test_runs_as_written():
    lines = lines_of(["aÃ\u200b¡b \u00e2\u00adx ?b"])
    cur, _, place, line = G.stream(lines)
    at = lambda c: np.flatnonzero(cur == alphabet_place(c))
    lost = np.flatnonzero(cur == G.alphabet()[1].index("<lost>"))
    a, b = np.concatenate([at("Ã"), at("â"), lost]), np.concatenate([at("¡"), at("â"), lost])
    assert G.written(lines, place, cur, a, b) == (["Ã\u200b¡", "â\u00ad", "\ufffd"], [1, 6, 10], [4, 8, 11], [False, False, True])


def alphabet_place(c):
    return int(G.alphabet()[0][ord(c)])


def test_runs_in_pieces():
    assert G.pieces("скоро".encode().decode("cp1252", "ignore")[:0]) == ()
    assert G.pieces("вес".encode().decode("latin-1")) == tuple(c.encode().decode("latin-1") for c in "вес")
    twice = "á".encode().decode("latin-1").encode().decode("latin-1")
    assert G.pieces(twice * 2) == (twice, twice) and G.pieces("ìø") == ("ì", "ø")


def test_wrong_labels_are_no_languages():
    rng = np.random.default_rng(1)
    counts, texts = np.zeros((4, 6, 6)), np.array([1000, 800, 6, 6])
    for k, n in ((0, 90_000), (1, 80_000), (2, 600)):
        p = rng.dirichlet(np.full(36, 0.15))
        counts[k] = rng.multinomial(n, p).reshape(6, 6)
    mix = 0.5 * counts[0] / counts[0].sum() + 0.5 * counts[1] / counts[1].sum()
    counts[3] = rng.multinomial(600, mix.ravel()).reshape(6, 6)
    assert G.distinct(counts, texts).tolist() == [True, True, True, False]


def test_restored_round_trip(spark):
    """Clean lines of the test data, damaged here and restored again."""
    path = "/root/testdata/sf0.01/problem_files.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    d = spark.read.parquet(path).where("content is not null").dropDuplicates(["file_id"]).select("file_id", "lang", "content")
    rows = [tuple(r) for r in d.orderBy("file_id").collect()]
    bad = {r["file_id"] for r in G.find(d, G.learn(d)).collect()}
    want = {}
    for i, (k, lang, text) in enumerate(rows):
        if lang in ("sk", "cs", "pl", "ru", "uk") and k not in bad and i % 7 == 0:
            lines = text.split("\n")
            new = lines[0].encode("utf-8").decode("cp850" if lang in ("ru", "uk") else "cp1252", "replace")
            if lines[0] and lines[0][0] not in "%!$" and new != lines[0] and "�" not in new and "​" not in lines[0]:
                want[k, 1], lines[0] = lines[0], new
                rows[i] = (k, lang, "\n".join(lines))
    d = spark.createDataFrame(rows, "file_id bigint, lang string, content string")
    got = {(r["file_id"], r["line_no"]): r["restored"] for r in G.find(d, G.learn(d), restore=True).collect()}
    assert want and sum(k in got for k in want) >= 0.97 * len(want)
    done = [k for k in want if got.get(k) is not None]
    assert len(done) >= 0.9 * len(want), (len(done), len(want))
    assert sum(got[k] == want[k] for k in done) >= 0.95 * len(done), [(got[k], want[k]) for k in done if got[k] != want[k]][:5]
    assert G.find(d.limit(0), G.learn(d.limit(0))).count() == 0
