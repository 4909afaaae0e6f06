import numpy as np

from quire.llm import names as N


def test_parse():
    assert N.parse("Dr. Štefan M. Jagomitečík, PhD.") == (["stefan", "jagomitecik"], ["m"], [], [])
    assert N.parse("2. UT Donahuhumento") == (["donahuhumento"], ["ut"], ["2"], [])
    assert N.parse("Katarína „Katka“ Haplahatanic")[3] == [("katka", "katarina")]
    assert N.parse("") == ([], [], [], [])


def test_similar_words_like_brute_force(spark):
    words = ["bralasoganer", "brlaasoganer", "bralasogane", "brallasoganer", "dralasoganer", "nabradrenez", "abc", "abd", "jozef", "jozsef", "jomilukasen", "jomilukason"]
    got = {tuple(r) for r in N.similar_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}

    def slip(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
            return False
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or len(d) == 2 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert got == {(a, b) for a in words for b in words if a < b and slip(a, b)}


def test_swaps_far_apart_and_four_letters(spark):
    """Swapped letters that leave only common q-grams as they were; words of four letters that share one q-gram."""
    words = ["abcdefgh", "abfdecgh", "anna", "anno", "enna", "ann", "aaaaa", "aaaaaa"] + [f"ab{x}gh" for x in ("klmn", "opqr", "stuv", "wxyz", "lnok")]
    got = {tuple(r) for r in N.similar_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {("abcdefgh", "abfdecgh"), ("anna", "anno"), ("anna", "enna"), ("aaaaa", "aaaaaa")}


def test_soft_similarity_counts_rare_words_more():
    w = {"of": 0.5, "technology": 2.0, "rarename": 9.0, "university": 2.0}
    full = (["university", "of", "technology", "rarename"], [], [])
    assert N.soft_similarity((["rarename"], ["ut"], []), (["university", "technology", "rarename"], [], []), w) > 0.9
    assert N.soft_similarity((["rarename"], ["lo"], []), full, w) < 0.9
    assert N.soft_similarity(full, (full[0], [], ["2"]), w) == 0


def test_entities(spark):
    groups = [
        ["Jozef Kavalabatová", "Kavalabatová, Jozef", "JOZEF KAVALABATOVÁ", "J. Kavalabatová", "Jozef  Kavalabatová", "Joezf Kavalabatova", "Ing. Jozef Kavalabatová"],
        ["Magdaléna Kavalabatová", "M. Kavalabatová"],
        ["2. University of Technology Donahuhumento", "2. UT Donahuhumento", "Donahuhumento 2. Univ. of Technology"],
        ["1. University of Technology Donahuhumento"],
        ["Katarína „Katka“ Haplahatanic", "Katka Haplahatanic", "Katarína Haplahatanic", "K.M. Haplahatanic"],
        ["!!"], ["??"],
    ]
    names = [(n, 1) for g in groups for n in g] + [(None, 1), ("Jozef Kavalabatová", 2)]
    d = spark.createDataFrame(names, "name string, entity int")
    got = N.entities(d)
    pairs = {tuple(r) for r in N.pairs_of(got).collect()}
    assert pairs == {(a, b) for g in groups for a in g for b in g if a < b}
    assert N.entities(d.limit(0)).count() == 0

def test_nicknames_in_large_families(spark):
    """Contexts that go with hundreds of words count as others do; the number of other names changes nothing."""
    for others in (30, 200):
        rows = [(f, f"katarina{''} {fam}") for f, fam in enumerate(("zupolimak", "hrabotank", "vodnemirek", "plachudel", "storevinka", "mrkolasov"))]
        fams = [r[1].split()[1] for r in rows]
        names = [f"Katarina {x.title()}" for x in fams] + [f"Katka {x.title()}" for x in fams] + [f"Katarina {x}{i}ova" for i, x in enumerate(("Drobna", "Kolesar", "Visnak", "Tomanek"))]
        rng = np.random.default_rng(others)
        letters = list("abcdefghijlmnoprstuvz")
        for x in fams:
            names += ["".join(rng.choice(letters, 8)).title() + f" {x.title()}" for _ in range(others)]
        got = {tuple(r) for r in N.pairs_of(N.entities(spark.createDataFrame([(n,) for n in names], "name string"))).collect()}
        assert {(f"Katarina {x.title()}", f"Katka {x.title()}") for x in fams} <= got, others


def test_chains_of_slips_and_initials_alone(spark):
    words = [("zvonakorevic", 100), ("zvonakorevit", 50), ("zvonakorevi", 20), ("zvonakrevi", 10), ("zvnakrevi", 5)]
    d = spark.createDataFrame(words, "word string, often bigint")
    assert {r["root"] for r in N.word_roots(d).collect()} == {"zvonakorevic"}
    d = spark.createDataFrame([("Barbora Quetzalik",), ("B. Q.",), ("Adam Novoplan",)], "name string")
    assert {tuple(r) for r in N.pairs_of(N.entities(d)).collect()} <= {("B. Q.", "Barbora Quetzalik")}
