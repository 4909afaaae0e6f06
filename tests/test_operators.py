import pytest
from pyspark.sql import functions as F

from quire.operators import lint as L
from quire.operators import numbering as N
from quire.operators import render as D
from quire.operators import rewrite as R
from quire.operators import trees as T
from quire.operators import validate as V
from quire.operators.lines import join_lines, split_lines
from quire.sources import files as S
from quire.streaming import lint_stream


def test_lines(spark):
    d = spark.createDataFrame([(1, "a\nb\n", 7), (2, "", 8), (3, None, 9), (4, "x\r\ny", 0)], "k int, t string, line_no int")
    got = [tuple(r) for r in split_lines(d, "t", "k").orderBy("k", "line_no").collect()]
    assert got == [(1, 1, "a\n"), (1, 2, "b\n"), (1, 3, ""), (2, 1, ""), (4, 1, "x\n"), (4, 2, "y")]
    back = {r["k"]: r["text"] for r in join_lines(split_lines(d, "t", "k"), "k").collect()}
    assert back == {1: "a\nb\n", 2: "", 4: "x\ny"}
    assert split_lines(d.limit(0), "t", "k").count() == 0


CASES = [
    ("a\tb", "tab", 1), ("x,y\n", "cws", 1), ("a;b", "sws", 1), ("\\qtylist{1;2;3}{m}", None, 0), ("\\ang{;3}", None, 0), ("f( a)", "pas", 1), ("f(a )", "pas", 3), ("x\\\\\n", "spb", 1), ("\\frac12", "frb", 5), ("\\SI{1}{m}", "osi", 0),
    ("{ a}", "lbw", 0), ("\\text{ a}", None, 0), ("{a }", "rbw", 3), ("a–b", "uni", 1), ("=======", "cmk", 0), ("a\\cdot b", "cdt", 1), ("a+b", "pws", 0), ("a + b", None, 0), ("% a+b", None, 0), ("x" * 121, "lln", 119), ("a $$ b", "dds", 2), ("$$ {#eq:a}", None, 0), ("$${#eq:a}", "dds", 4), ("$$\n", None, 0),
    ("a=b", "eqs", 1), ("a = b", None, 0), ("😀x,y", "cws", 2),
]


def test_lint_rules(spark):
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "k int, line string")
    got = {}
    for r in L.lint(d).collect():
        got.setdefault(r["k"], []).append((r["rule_id"], r["col"]))
    for i, (line, rule, col) in enumerate(CASES):
        if rule is None:
            assert i not in got, (line, got.get(i))
        else:
            assert (rule, col) in got[i], (line, got.get(i))
    assert 99 not in got


def test_lint_selection(spark):
    assert {r.id for r in L.selected(only=["cws", "nope"])} == {"cws"}
    assert "tak" in {r.id for r in L.selected(warnings=True)} and "tak" not in {r.id for r in L.selected()}
    assert "fra" in {r.id for r in L.selected(kind="answer")}
    with pytest.raises(KeyError):
        L.selected(ignore=["nope"])
    v = L.verdicts(spark.createDataFrame([(1, 1, "ok\n"), (1, 2, "a,b\n"), (2, 1, "fine")], "k int, line_no int, line string"), "k").orderBy("k").collect()
    assert [(r["ok"], r["bad_lines"], r["first_line"], r["first_rule"]) for r in v] == [(False, 1, 2, "cws"), (True, 0, None, None)]


def test_label_rule(spark):
    rows = [("{#eq:ab}", "problem", "ab", False), ("{#eq:x}", "problem", "ab", True), ("{#eq:ab:c}", "solution", "ab", False), ("{#eq:ab}", "solution", "ab", True), ("none", "problem", "ab", False)]
    d = spark.createDataFrame(rows, "l string, k string, n string, bad boolean")
    assert d.where(L.label_rule(F.col("l"), F.col("k"), F.col("n")).isNotNull() != F.col("bad")).count() == 0


def test_rewrites_use_no_python(spark):
    rows = [("@L x", "x", ""), ("@H x", "", "x"), ("@E x", "\\errorMessage{x}", "Error: x"), ("@TODO y", "\\todoMessage{y}", "TODO: y"), ("  $${\n", "  $$\n  \\begin{aligned}\n", "  $$\n  \\begin{aligned}\n"), ("%c\n", "\n", "\n"), ("\\qty{1}{m}", "\\qty{1}{m}", "\\SI{1}{m}")]
    d = spark.createDataFrame(rows, "l string, a string, b string")
    out = d.select("*", R.rewrite(F.col("l"), "pre", "latex").alias("x"), R.rewrite(F.col("l"), "pre", "html").alias("y"))
    for r in out.collect():
        assert (r["x"], r["y"]) == (r["a"], r["b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        R.rewrite(F.col("l"), "pre", "odt")
    img = spark.range(1).select(R.rewrite(F.lit('<img src="a.gp" style="height:20mm">'), "post", "html").alias("x")).first()["x"]
    assert 'src="obrazky/a.png"' in img and "1.7 * 20mm" in img
    q = spark.range(1).select(R.localise_quotes(F.lit('He said "go on" now'), F.lit("„"), F.lit("“")).alias("x")).first()["x"]
    assert q == "He said „go on“ now"


def test_numbering(spark):
    d = spark.createDataFrame([(1, i) for i in range(12)] + [(2, 5)], "p int, i int")
    bins = N.split_mod(d.where("p = 1"), ["p"], ["i"], 3)
    assert sorted(r["i"] for r in bins.where("bin = 1").collect()) == [1, 4, 7, 10]
    shifted = N.split_mod(d.where("p = 1 and i > 0"), ["p"], ["i"], 3, first=1)
    assert [sorted(r["i"] for r in shifted.where(f"bin = {b}").collect()) for b in range(3)] == [[3, 6, 9], [1, 4, 7, 10], [2, 5, 8, 11]]
    assert {(r["p"], r["bin"]): r["items"] for r in N.all_bins(N.split_mod(d, ["p"], ["i"], 3), ["p"], 3).collect()}[2, 2] == 0
    assert N.split_div(d, ["p"], ["i"], 5).where("p = 1 and batch = 2").count() == 2
    with pytest.raises(Exception, match="no bin"):
        N.split_by(d, ["p"], ["i"], lambda i: i, 2).collect()
    assert N.split_mod(d.limit(0), ["p"], ["i"], 3).count() == 0
    first = N.neighbours(spark.createDataFrame([(1, 1, None), (1, 2, "a"), (1, 3, "a")], "p int, i int, v string"), ["p"], ["i"], "v").orderBy("i").collect()
    assert [r["differs"] for r in first] == [False, True, False] and first[-1]["is_last"]


def test_trees(spark):
    r = spark.range(1)
    get = lambda c: r.select(c.alias("x")).first()["x"]
    assert get(T.path_of(F.lit("a"), F.lit(None).cast("string"), F.lit("c"))) == "a"
    assert get(T.padded(F.lit(1234))) == "1234" and get(T.padded(F.lit(7))) == "07"
    left = spark.createDataFrame([(1, "a/b", "1"), (1, "a/c", "2"), (1, "d", "3"), (1, "e/f", "4")], "k int, path string, value string")
    right = spark.createDataFrame([(1, "a/b", "9"), (1, "d/x", "8"), (1, "e", "7"), (2, "z", "0")], "k int, path string, value string")
    got = {(x["k"], x["path"]): x["value"] for x in T.merge_deep(left, right, ["k"]).collect()}
    assert got == {(1, "a/b"): "9", (1, "a/c"): "2", (1, "d/x"): "8", (1, "e"): "7", (2, "z"): "0"}
    m = get(T.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))))
    assert m == {"a": "1", "b": "3"}
    kids = T.with_children(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string"), ["k"], ["o"], ["v"])
    assert {x["k"]: [y["v"] for y in x["children"]] for x in kids.collect()} == {1: ["a", "b"], 2: []}


def test_validation(spark):
    d = spark.createDataFrame([(1, "ABCDE", 5), (2, "abc", -1), (3, None, None)], "k int, code string, n int")
    rules = {"code": V.matches(F.col("code"), "[A-Z]{5}"), "n": V.optional(F.col("n"), F.col("n") >= 0)}
    assert {(r["k"], r["rule"]) for r in V.violations(d, ["k"], rules).collect()} == {(2, "code"), (2, "n"), (3, "code")}
    assert V.require(d.where("k = 1"), rules).count() == 1
    with pytest.raises(Exception, match="violated"):
        V.require(d, rules).collect()
    files = spark.createDataFrame([("a", "problem.md"), ("a", "x.doc"), ("b", "solution.md")], "n string, f string")
    got = {tuple(r) for r in V.tree_check(files, ["n"], "f", ["problem.md"], ["solution.md"], [r".*\.doc"]).collect()}
    assert got == {("a", "forbidden", "x.doc"), ("b", "missing", "problem.md")}


def test_render(spark):
    assert spark.range(1).select(D.fill("a (* x *)!", {"x": F.lit(1)}).alias("t")).first()["t"] == "a 1!"
    with pytest.raises(KeyError):
        D.fill("(* y *)", {})
    f = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "d int, s int, t string")
    assert D.assemble(f, ["d"], "s", "t").first()["text"] == "a\nb"


def test_sources(spark, tmp_path):
    (tmp_path / "t/x/.hid").mkdir(parents=True)
    (tmp_path / "t/x/meta.yaml").write_text("id: x\nlist: [1, {a: true}]\nempty: ~\n")
    (tmp_path / "t/y.md").write_bytes(b"\xff")
    (tmp_path / "t/l").symlink_to(tmp_path / "t/x")
    S.register(spark)
    tree = spark.read.format("tree").load(str(tmp_path / "t"))
    assert {(r["path"], r["kind"]) for r in tree.collect()} == {("x", "dir"), ("x/.hid", "dir"), ("x/meta.yaml", "file"), ("y.md", "file"), ("l", "link")}
    assert [r["path"] for r in S.nodes(tree).collect()] == ["x"] and [r["path"] for r in S.child_dirs(tree).collect()] == ["x"]
    if S.yaml is not None:
        got = {r["path"]: r["value"] for r in S.read_yaml(spark, str(tmp_path / "t")).collect()}
        assert got == {"id": "x", "list/0": "1", "list/1/a": "true", "empty": None}
        bad = S.yaml_leaves(spark.createDataFrame([(1, "a: ["), (2, ""), (3, None)], "k int, t string"), "k", "t").collect()
        assert len(bad) == 1 and bad[0]["error"]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(str(tmp_path / "t"))
    assert [r["utf8"] for r in S.valid_utf8(raw).collect()] == [False]


def test_incremental_lint(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    d = spark.createDataFrame([(1, "a,b\nfine"), (2, None)], "k int, t string")
    d.write.parquet(src)
    for _ in range(2):  # the second run has nothing new
        lint_stream.run_available(spark, src, d.schema, sink, ck, "t", "k")
    assert [(r["k"], r["rule_id"]) for r in spark.read.parquet(sink).collect()] == [(1, "cws")]


def test_documents_by_schema(spark):
    from quire.sources import schemas

    d = spark.createDataFrame([(1, '{"id": "a", "number": 3, "new": 1}'), (2, "{"), (3, None)], "k int, j string")
    got = {r["k"]: r["document"] for r in schemas.parse(d, "j", "year").collect()}
    assert got[1]["id"] == "a" and got[1]["number"] == 3 and got[3] is None and (got[2] is None or got[2]["id"] is None)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        schemas.parse(d.where("k = 2"), "j", "year", strict=True).collect()
    for kind in schemas.SCHEMAS:
        schemas.parse(d, "j", kind).schema


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a,b", "x", "y", 5)], "line_no int, line string, rule_id string, message string, col int")
    assert [r["rule_id"] for r in L.lint(d).collect()] == ["cws"]
    e = d.limit(0)
    assert L.lint(e).count() == 0 and L.verdicts(e, "rule_id").count() == 0
    m = V.presence_matrix(e, ["line"], "rule_id", ["p", "q.r"])
    assert m.columns == ["line", "p", "q.r"] and V.incomplete(m, ["p", "q.r"], False).count() == 0
    assert T.existence(d, e.select("line"), ["line"]).first()["present"] is False
    assert D.assemble(e, ["rule_id"], "line_no", "line").count() == 0


def found(spark, line, *ids):
    rules = [r for r in L.RULES if r.id in ids]
    return [(r["rule_id"], r["col"], r["message"]) for r in L.lint(spark.createDataFrame([(line,)], "line string"), rules, extra=False).collect()]


def test_lint_columns_are_where_the_match_is(spark):
    assert found(spark, "see \\summary then \\sum x", "sum")[0][1] == 18 and found(spark, "\\integral and \\int x", "int")[0][1] == 14
    assert found(spark, "\U0001d7d9\U0001d7d9 a,b", "cws")[0][1] == 4  # characters, not units of UTF-16
    assert found(spark, "a=b", "eqs") == [("eqs", 1, 'Spaces missing around "="')] and found(spark, "a \\leq5", "eqs")[0][1:] == (5, 'Spaces missing around "\\leq"')
    assert found(spark, "1+2", "pws")[0][1] == 0 and found(spark, "\\ang{1\\cdot 2}", "sie") == [("sie", 5, "Use e notation instead of TeX inside \\ang")]
    assert found(spark, "so tak je", "tak")[0][1] == 4 and not found(spark, "takýto, tak, ", "tak") and found(spark, "x;y", "sws")[0][1] == 1 and not found(spark, "\\qtylist{1;2}{m}", "sws")


def test_lint_knows_all_whitespace(spark):
    assert not found(spark, "a,\u00a0b", "cws") and found(spark, "{\u00a0a}", "lbw") and found(spark, "{a\u00a0}", "rbw") and not found(spark, "\\text{\u00a0a}", "lbw")


def test_lint_labels_by_module(spark):
    d = spark.createDataFrame([("{#eq:1234:name}",), ("{#eq:1234}",), ("{#fig:9:x}",), (None,)], "line string")
    got = [r["r"] and r["r"]["message"] for r in d.select(L.label_rule(F.col("line"), F.lit("problem"), F.lit("1234"), "seminar").alias("r")).collect()]
    assert got == [None, "Nonconforming label", "Nonconforming label", None]
    with pytest.raises(ValueError, match="unsupported"):
        L.label_rule(F.col("line"), F.lit("problem"), F.lit("1"), "scholar")


def test_trees_of_files(spark, tmp_path):
    from quire.sources import files

    for at, text in (("a/meta.yaml", "x: 1\ny:\n    z: [u, v]\n"), ("a/b/meta.yaml", ""), ("a/b/c.txt", "t"), ("d/e.txt", "t"), ("f/meta.yaml", "a: [1\n")):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    files.register(spark)
    t = spark.read.format("tree").load(f"file://{tmp_path}")
    assert {(r["path"], r["parent"], r["kind"]) for r in t.collect()} == {
        ("a", "", "dir"), ("a/b", "a", "dir"), ("d", "", "dir"), ("f", "", "dir"), ("a/meta.yaml", "a", "file"), ("a/b/meta.yaml", "a/b", "file"), ("a/b/c.txt", "a/b", "file"), ("d/e.txt", "d", "file"), ("f/meta.yaml", "f", "file"),
    }
    own = spark.read.format("tree").load(str(tmp_path))
    assert sorted(map(tuple, own.select("path", "kind", "depth").collect())) == sorted(map(tuple, t.select("path", "kind", "depth").collect()))
    if files.yaml is not None:
        leaves = files.read_yaml(spark, str(tmp_path)).withColumn("file", F.regexp_replace("file", f"^.*{tmp_path.name}/", ""))
        got = {r["path"]: r["meta"] for r in files.node_metadata(files.nodes(t), leaves).collect()}
        assert got == {"a": {"x": "1", "y/z/0": "u", "y/z/1": "v"}, "a/b": {}, "f": None}
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git/refs/heads/main").write_text("0123456789abcdef\n")
    row = files.build_information(spark, "me", str(tmp_path), str(tmp_path / "a")).first()
    assert row["user"] == "me" and tuple(row["tool"]) == ("0123456", "main") and tuple(row["repo"]) == (None, None)


def test_written_documents(spark, tmp_path):
    from quire.operators import render

    d = spark.createDataFrame([("a.tex", "x\ny\n"), ("b.tex", "")], "name string, text string")
    render.write_documents(d, str(tmp_path / "out"))
    back = {r["name"]: r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert back["a.tex"] == "x\ny\n"
    with pytest.raises(Exception, match="unknown suffix"):
        spark.range(1).select(render.target_name(F.lit("a.doc"))).collect()
    with pytest.raises(Exception, match="unsupported value"):
        spark.range(1).select(render.passed(F.lit("[1]"), F.lit("array"))).collect()


def test_folder_for_tables_must_be_shared(spark):
    from quire import runtime

    made = runtime.cut(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    assert sorted(map(tuple, made.collect())) == [(1, "a"), (2, None)] and made._quire_path.startswith(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    assert runtime.cut(made.limit(0)).columns == ["k", "v"]
    runtime.release(made)
    assert runtime.small(spark.range(10), limit=10)._jdf.queryExecution().toString().count("broadcast") == 0
