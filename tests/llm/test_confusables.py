import unicodedata

from quire.llm import confusables as C


def test_skeletons():
    same = [("Ａｂ１", "Ab1"), ("a​b­", "ab"), ("a b", "a b"), ("é", "é"), ("ﬁn", "fin"), ("раре", "pape"), ("„", ",,"), ("«", "‹‹"), ("≪", "«"), ("ǳ", "dz"), ("й", "й")]
    other = [("x²", "x2"), ("é", "e"), ("A", "a"), ("1", "l"), ("“", '"'), ("«", "»"), ("-", "−"), ("a!", "a?"), ("½", "1/2")]
    for a, b in same:
        assert C.skeleton_of(a) == C.skeleton_of(b), (a, b)
    for a, b in other:
        assert C.skeleton_of(a) != C.skeleton_of(b), (a, b)
    for c in (chr(i) for i in range(0x20, 0x3000)):  # a skeleton is its own skeleton
        s = C.skeleton_of(c)
        assert C.skeleton_of(s) == s, hex(ord(c))
    assert C.skeleton_of(None) is None and C.skeleton_of("") == "" and C.consistent_of("é") == "é" and unicodedata.is_normalized("NFC", C.consistent_of("Ａ̌"))


def test_pairs_like_brute_force(spark):
    texts = ["abc", "аbc", "ab​c", "abc", "abd", "", None, "Ａbc", "x", "х", "long " * 30_000, "long " * 30_000]
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, "abc", "again")], "file_id bigint, content string, look string")
    marked = C.looks(d, "content", ("file_id",))
    got = {tuple(r) for r in C.look_alike_pairs(marked, "file_id").collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and C.skeleton_of(a) == C.skeleton_of(b)}
    assert got == want
    classes = {r["file_id"]: (r["class_id"], r["n_members"], r["n_writings"]) for r in C.look_alike_classes(marked, "file_id").collect()}
    assert classes[1] == (0, 4, 3) and classes[4] == (4, 1, 1) and 6 not in classes
    assert C.look_alike_pairs(C.looks(d.limit(0), "content", ("file_id",)), "file_id").count() == 0


def test_hot_group_of_copies_gives_only_its_pairs(spark):
    d = spark.range(3000).selectExpr("id as file_id", "case when id = 7 then 'cоpy' else 'copy' end as content")
    assert C.look_alike_pairs(C.looks(d, "content", ("file_id",)), "file_id").count() == 2999


def test_quotes(spark):
    q = "struct<open_mark string, close_mark string>"
    locales = spark.createDataFrame([(1, "fr", ("« ", " »")), (2, "sk", ("„", "“")), (3, "xx", None)], f"locale_no bigint, id string, quotes {q}")
    rows = [(10, "fr", ("≪ ", " »")), (11, "fr", ("« ", " »")), (12, "sk", (",,", "‘‘")), (13, "sk", ("«", "»")), (14, "sk", None), (15, "sk", ("„", None)), (16, None, ("„", "“"))]
    got = {tuple(r) for r in C.quote_pairs(spark.createDataFrame(rows, f"override_id bigint, id string, quotes {q}"), locales).collect()}
    assert got == {(1, 10), (2, 12)}
