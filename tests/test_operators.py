"""Operators on small tables: search, budgets, folds, consolidation, proposals, the bundle reader, the stream."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import gates as G
from brindle.operators import budget as B
from brindle.operators import learning as L
from brindle.operators import policy as P
from brindle.operators import proposals as W
from brindle.operators import ranking as R
from brindle.sources import bundle
from brindle.streaming import ledger

HEAD = "---\ntype: {t}\ndescription: {d}\ntags: [{g}]\ntimestamp: 2024-01-02\n---\n"


@pytest.fixture
def root(tmp_path):
    files = {
        "Dashboard.md": "# Dash\n- **Updated:** never\n- **Status:** idle $1\n",
        "index.md": "---\nversion: 1\n---\n* [a](a) - b\n",
        "log.md": "# Log\n## 2024-01-02\n* **Update**: two\n## 2024-01-01\n* **Creation**: one\n",
        "Knowledge/sample.md": HEAD.format(t="Knowledge", d="plain", g="x") + "about a sprocket\n",
        "Skills/example-skill.md": HEAD.format(t="Skill", d="makes a sprocket", g="sprocket, gear") + "## Use\nsteps\n",
        "Lessons/INDEX.md": "Lines are `- [[target]] — kw1, kw2`.\n## demo\n- [[demo/problems|P]] — gear, Tooth Wheel / cog\n",
        "Lessons/demo/problems.md": HEAD.format(t="Lesson", d="demo problems", g="demo") + "## existing\ngear trouble\n",
        ".git/x.md": HEAD.format(t="Skill", d="sprocket", g="a"),
        "no header.md": "sprocket",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_bundle(spark, root):
    files = bundle.read_files(spark, root)
    assert files.count() == 8
    c = bundle.concepts(files)
    assert sorted(r.concept_id for r in c.collect()) == ["Knowledge/sample.md", "Lessons/demo/problems.md", "Skills/example-skill.md"]
    found = [(r.concept_id, r.score) for r in R.search(c, "sprocket").collect()]
    assert found == [("Skills/example-skill.md", 6), ("Knowledge/sample.md", 1)]
    assert [r.concept_id for r in R.search(c, "sprocket", kind="Knowledge").collect()] == ["Knowledge/sample.md"]
    assert R.search(c, "a to").count() == 0
    lines = bundle.numbered_lines(files.where("path = 'Lessons/INDEX.md'"))
    index = bundle.lesson_index(lines)
    assert [(r.target, r.alias, r.keywords) for r in index.orderBy("line_no").collect()] == [("target", None, ["kw1", "kw2`."]), ("demo/problems", "P", ["gear", "tooth wheel", "cog"])]
    assert R.find_lesson(index, "gears").first().target == "demo/problems"
    assert R.find_lesson(index, "").count() == 0
    prompts = spark.createDataFrame([("p", "the Tooth Wheel and a COG"), ("q", "tooth")], "prompt_id string, prompt string")
    existing = spark.createDataFrame([("demo/problems",)], "target string")
    assert [(r.prompt_id, r.score) for r in R.matched_lessons(prompts, index, existing).collect()] == [("p", 2)]
    assert bundle.directory_index(files, "Skills").first()["index"] == "# Index: Skills\n* [example-skill.md](example-skill.md) - makes a sprocket"
    assert bundle.directory_index(files).first()["index"].startswith("---\nversion")
    assert {r.field: r.value for r in bundle.dashboard_fields(bundle.numbered_lines(files.where("path = 'Dashboard.md'"))).collect()}["Status"] == "idle $1"
    log = bundle.log_entries(bundle.numbered_lines(files.where("path = 'log.md'"))).orderBy("line_no").collect()
    assert [(r.date, r.label, r.text) for r in log] == [("2024-01-02", "Update", "two"), ("2024-01-01", "Creation", "one")]
    hay = bundle.hook_concepts(files)
    p = spark.createDataFrame([("p", "makes one sprocket gear")], "prompt_id string, prompt string")
    assert [(r.path, r.score) for r in R.matched_concepts(p, hay).collect()] == [("Skills/example-skill.md", 3)]


def test_tokens(spark):
    rows = spark.createDataFrame([(0, "# c"), (1, "t: u :Admin"), (2, "t:v:user"), (3, "x:y"), (4, "z:w:root")], "line_no int, line string")
    known = bundle.tokens(rows)
    assert [tuple(r) for r in known.collect()] == [("t", "v", "user")]
    req = spark.createDataFrame([("Bearer t",), ("bearer  t",), ("",), (None,), ("q",)], "bearer string")
    got = [(r.name, r.error) for r in bundle.authenticate(req, known).collect()]
    assert sorted(got, key=str) == sorted([("v", None), ("v", None), (None, "missing bearer credential"), (None, "missing bearer credential"), (None, "unknown token")], key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc\U0001f600", max_size=9), max_size=6), st.integers(0, 20))
def test_budget(spark, texts, cap):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, i int, t string")
    got = B.assemble(df, ["k"], "i", "t", cap).collect()
    out, total = [], 0
    for t in texts:
        if t and total < cap:
            out.append(t[: cap - total])
            total += len(out[-1])
    assert [r.context for r in got] == (["\n\n".join(out)] if out else [])


def test_prompt_parts(spark):
    prompts = spark.createDataFrame([("p",)], "prompt_id string")
    lessons = spark.createDataFrame([("p", "a/b", 1, "chunk"), ("p", "a/c", 2, "")], "prompt_id string, target string, rank int, chunk string")
    concepts = spark.createDataFrame([("p", "x.md", 1, "y" * 3000)], "prompt_id string, path string, rank int, text string")

    def context(mode, rules=""):
        return B.assemble(B.prompt_parts(prompts, "dash", lessons, concepts, mode, rules=rules), ["prompt_id"], "ordinal", "part").first().context

    assert context("static", "be kind") == "be kind\n\n--- Dashboard ---\ndash"
    got = context("retrieval")
    assert got.startswith("--- Lesson: a/b ---\nchunk\n\n--- Concept: x.md ---\nyyy") and got.count("y") == 2500
    assert context("").startswith("--- Dashboard ---\ndash\n\n--- Lesson: a/b ---")


def fold(w, updates):
    up = down = 0
    for r, e, c, i in updates:
        if e >= 0.30:
            w = max(0.0, min(0.95, w + (0.10 if r >= 0 else 0.14) * r * e * c * i))
            up, down = (up + 1, down) if r >= 0 else (up, down + 1)
    return w, up, down


GOLDEN = [("A", 0.40, [(0.85, 1.0, 0.9, 1.0)], 0.4765), ("C", 0.40, [(0.85, 0.15, 0.9, 1.0)], 0.40), ("E", 0.50, [(-0.8, 0.8, 0.9, 1.0)], 0.41936)]


def _edges(spark, rows):
    return spark.createDataFrame([(s, "t", "r", w, 0, 0) for s, w in rows], "source string, target string, relation string, weight double, success_count long, failure_count long")


def _updates(spark, rows):
    flat = [(s, "t", "r", *map(float, u), n) for s, us in rows for n, u in enumerate(us)]
    return spark.createDataFrame(flat, "source string, target string, relation string, reward double, eligibility double, confidence double, independence double, seq long")


def test_weight_goldens(spark):
    got = L.edge_weights(_updates(spark, [(s, u) for s, _, u, _ in GOLDEN]), _edges(spark, [(s, w) for s, w, _, _ in GOLDEN]), ledger.KEY, ["seq"], F.lit(0))
    assert {r.source: round(r.weight, 9) for r in got.collect()} == {s: x for s, _, _, x in GOLDEN}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([-1.0, -0.5, 0.0, 0.7, 1.0]), st.sampled_from([0.1, 0.3, 1.0]), st.just(1.0), st.sampled_from([0.5, 5.0])), min_size=1, max_size=30))
def test_fold_in_pieces(spark, updates):
    got = L.edge_weights(_updates(spark, [("A", updates)]), _edges(spark, [("A", 0.4)]), ledger.KEY, ["seq"], F.floor(F.col("seq") / 4)).first()
    w, up, down = fold(0.4, updates)
    assert got.weight == pytest.approx(w, abs=1e-12) and (got.success_count, got.failure_count) == (up, down)
    assert 0 <= got.weight <= 0.95


def test_consolidate(spark):
    rows = [("a", 0.5, 0, 2, 0.0, 1), ("b", 0.5, 1, 9, 0.8, 1), ("c", 0.05, 0, 0, 0.0, 0), ("d", 0.05, 0, 0, 0.0, 1), ("e", 0.05, 1, 2, 0.0, 0)]
    df = spark.createDataFrame([(*r[:1], "t", "r", *r[1:], "active") for r in rows], "source string, target string, relation string, weight double, success_count long, failure_count long, contradiction_conf double, unique_info int, status string")
    unused = df.select("source", "target", "relation", F.lit(91).alias("unused_days"))
    out = L.consolidate(df, unused)
    assert {r.source: r.status for r in out.collect()} == {"a": "suppressed", "b": "suppressed", "c": "archived", "d": "active", "e": "active"}
    assert tuple(L.status_counts(out).first()) == (2, 1)
    assert {r.status for r in L.consolidate(df.where("source = 'c'")).collect()} == {"active"}


def test_decisions(spark):
    d = L.open_decision(spark.createDataFrame([("d1", 0.75), ("d2", 0.5)], "decision_id string, predicted double"))
    assert {r.status for r in d.collect()} == {"open"}
    closed = L.close_decisions(d, spark.createDataFrame([("d1", 0.40)], "decision_id string, observed double")).collect()
    assert [(r.decision_id, r.prediction_error, r.status, r.flagged) for r in closed] == [("d1", -0.35, "verified", True)]


def test_progressive(spark):
    df = spark.createDataFrame([("g", i, a) for i, a in enumerate([0.9, 0.95, 0.1, 0.5])], "g string, i int, activation double")
    got = {r.i: r.level for r in R.progressive_retrieve(df, ["g"], "i").collect()}
    assert got == {1: "full_concept", 0: "adjacent_sections", 3: "frontmatter"}


def test_last_lines(spark):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(["a", "", "b", "c"])], "k string, line_no int, line string")
    assert sorted(r.line for r in R.last_lines(df, 2, ["k"]).collect()) == ["b", "c"]
    assert sorted(r.line for r in R.last_lines(df, 2, ["k"], newest=True).collect()) == ["a", "b"]
    assert R.last_lines(df, 0, ["k"]).count() == 3
    with pytest.raises(ValueError):
        R.last_lines(df, -1, ["k"])


def test_contradictions(spark):
    rows = [(1, "a", "b", "provides", ["x"], "active"), (2, "a", "b", "does_not_provides", ["x", "y"], "active"), (3, "a", "b", "does_not_provides", ["z"], "active"), (4, "a", "b", "provides", ["y"], "suppressed")]
    df = spark.createDataFrame(rows, "edge_id int, source string, target string, relation string, scope array<string>, status string")
    assert sorted(r.edge_id for r in P.contradictions(df).collect()) == [1, 2]


def _author(df, name="ann"):
    return df.withColumns({"author_name": F.lit(name), "author_email": F.lit("a@example.com")})


def test_proposals(spark, root):
    files = bundle.read_files(spark, root)
    c = spark.createDataFrame([("demo", "new", "kind: problem\nbe careful", ["k1", "k2"]), ("none", "x", "y", ["k"]), ("demo", "leak", "password: abc", ["k"])], "area string, slug string, content string, keywords array<string>")
    ok, bad = W.new_lesson(_author(c), files)
    assert [(r.path, r.append, r.index_line) for r in ok.collect()] == [("Lessons/demo/problems.md", "\n## new\nbe careful\n", "- [[demo/problems]] — k1, k2")]
    assert sorted(r.error for r in bad.collect()) == ["assigned secret key name", "lesson file does not exist"]
    ok, bad = W.new_skill(_author(spark.createDataFrame([("Example Skill", "x"), ('My "New" One', "do it")], "name string, content string")), files, "2024-05-05")
    assert [r.path for r in ok.collect()] == ["Skills/my-new-one.md"] and bad.first().error == "skill already exists"
    assert ok.first().document.startswith("---\ntype: Skill\ndescription: \"My 'New' One\"\n")
    p = spark.createDataFrame([("Knowledge/sample", "timestamp: no"), ("rules/x", "y"), ("nope", "z")], "concept_id string, patch string")
    ok, bad = W.update_concept(_author(p), files, "2024-05-05")
    doc = ok.first().document
    assert "timestamp: 2024-05-05\n---\nabout" in doc and doc.endswith("\n\ntimestamp: no\n")
    assert sorted(r.error for r in bad.collect()) == ["no such concept", "protected target"]
    h = HEAD.format(t="Session", d="s", g="x") + "# 2024-01-02 — Big Day\n"
    ok, _ = W.log_session(_author(spark.createDataFrame([(1, h), (2, h)], "ord int, handoff string")), files, "2024-05-05")
    assert sorted(r.path for r in ok.collect()) == ["Sessions/2024-01-02-big-day-2.md", "Sessions/2024-01-02-big-day.md"]
    ok, bad = W.new_rule(_author(spark.createDataFrame([("r", "why"), ("r", "why"), ("secret=1", "w")], "rule string, rationale string")), "2024-05-05")
    row = ok.collect()
    assert len(row) == 1 and bad.count() == 1
    prop = spark.createDataFrame([(row[0].path, row[0].document)], "path string, text string")
    req = spark.createDataFrame([(row[0].proposal_id, True), (row[0].proposal_id, False), ("zz", True)], "proposal_id string, is_admin boolean")
    ok, bad = W.approve(req, prop)
    done = ok.first()
    assert done.rules_append.endswith("\nr\n\n_Rationale:_ why\n") and "status: approved" in done.document and bad.count() == 2
    again, bad = W.approve(req.limit(1), spark.createDataFrame([(done.path, done.document)], "path string, text string"))
    assert again.count() == 0 and bad.first().error == "proposal is not pending"
    assert W.new_rule(_author(spark.createDataFrame([("r", "why")], "rule string, rationale string"), ""), "d")[1].first().error == "an authenticated author is required"


def test_text_edits(spark):
    df = spark.createDataFrame([("# L\n## d1\nx\n## d0\ny\n", "- **Updated:** a\n- **Status:** b\n", "# I\n## h\nx\n")], "log string, dash string, idx string")
    r = df.select(
        W.prepend_log(F.col("log"), F.lit("* new")).alias("log"),
        W.prepend_log(F.lit("x"), F.lit("* new")).alias("bare"),
        W.replace_field(F.col("dash"), "Status", F.lit("c $1")).alias("dash"),
        W.insert_after_heading(F.col("idx"), F.lit("## h"), F.lit("- l")).alias("idx"),
        W.insert_after_heading(F.col("idx"), F.lit("## k"), F.lit("- l")).alias("idx2"),
    ).first()
    assert r.log == "# L\n## d1\n* new\nx\n## d0\ny\n" and r.bare == "x\n* new\n"
    assert r.dash == "- **Updated:** a\n- **Status:** c $1\n"
    assert r.idx == "# I\n## h\n- l\nx\n" and r.idx2 == "# I\n## h\nx\n\n## k\n- l\n"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    """Append, replay, append, replay: as the batch fold; updates of edges that aren't there do nothing."""
    rows = [(s, [(0.9 if (k + n) % 3 else -1.0, 1.0, 1.0, 1.0) for n in range(9)]) for k, s in enumerate("ABX")]
    u = _updates(spark, rows).withColumn("at", F.col("seq"))
    edges = _edges(spark, [("A", 0.4), ("B", 0.4), ("still", 0.3)])
    path, check, sink = (f"{tmp_path}/{x}" for x in ("ledger", "check", "sink"))
    ledger.append_segment(u.where("seq < 5").coalesce(1), path)
    ledger.replay(spark, path, edges, check, sink)
    ledger.append_segment(u.where("seq >= 5").coalesce(1), path)
    got = {r.source: (round(r.weight, 9), r.success_count, r.failure_count) for r in ledger.replay(spark, path, edges, check, sink).collect()}
    want = {s: fold(0.4, us) for s, us in rows if s != "X"}
    assert got == {s: (round(w, 9), a, b) for s, (w, a, b) in want.items()} | {"still": (0.3, 0, 0)}


def test_hot_edge_is_folded_in_ranges(spark):
    updates = [((n % 7 - 3) / 3, 1.0, 1.0, 1.0) for n in range(3000)]
    u = _updates(spark, [("A", updates)])
    got = L.edge_weights(u, _edges(spark, [("A", 0.4)]), ledger.KEY, ["seq"]).first()
    w, up, down = fold(0.4, updates)
    assert got.weight == pytest.approx(w, abs=1e-9) and (got.success_count, got.failure_count) == (up, down)


def test_append_segment(spark, tmp_path):
    ev = spark.createDataFrame([("e1", "s", "x" * 400), ("e2", "s", "y")], "event_id string, session_id string, summary string")
    ledger.append_segment(ev.limit(1), f"{tmp_path}/l")
    ledger.append_segment(ev.where("event_id = 'e2'"), f"{tmp_path}/l")
    got = bundle.read_events(spark, f"{tmp_path}/l", "s")
    assert got.count() == 2 and {len(r.summary) for r in got.collect()} == {280, 1}


def test_patches_of_one_concept_in_a_batch(spark, root):
    files = bundle.read_files(spark, root)
    p = spark.createDataFrame([("Knowledge/sample", "two", 2), ("/Knowledge/sample.md", "one", 1), ("Knowledge/sample", "password: abc", 3)], "concept_id string, patch string, ord int")
    ok, bad = W.update_concept(_author(p), files, "2024-05-05")
    (r,) = ok.collect()
    assert r.document.endswith("about a sprocket\n\none\n\ntwo\n") and r.log_line.count("\n") == 1 and bad.count() == 1


def test_a_proposal_is_approved_once_in_a_batch(spark):
    ok, _ = W.new_rule(_author(spark.createDataFrame([("r", "why")], "rule string, rationale string")), "2024-05-05")
    row = ok.first()
    req = spark.createDataFrame([(row.proposal_id, True, 2), (row.proposal_id + ".md", True, 1), (row.proposal_id, False, 0)], "proposal_id string, is_admin boolean, ord int")
    done, bad = W.approve(req, spark.createDataFrame([(row.path, row.document)], "path string, text string"))
    assert [r.ord for r in done.collect()] == [1] and sorted(r.error for r in bad.collect()) == ["admin privilege required", "proposal is not pending"]


def test_free_numbers(spark):
    import random

    rng = random.Random(3)
    taken = {s: set(rng.sample(range(1, 30), rng.randint(0, 20))) for s in "abc"}
    rows = spark.createDataFrame([(s, i) for s in "abcd" for i in range(rng.randint(1, 25))], "s string, i int")
    t = spark.createDataFrame([(s, n) for s, ns in taken.items() for n in ns] * 2, "s string, n int")
    got = {}
    for r in W.free_numbers(rows, t, "s", "i").orderBy("s", "i").collect():
        got.setdefault(r.s, []).append(r.n)
    for s, ns in got.items():
        free = [n for n in range(1, 100) if n not in taken.get(s, ())]
        assert ns == free[: len(ns)]


def test_get_concept(spark, root):
    known = bundle.concepts(bundle.read_files(spark, root))
    got = bundle.get_concept(known, "Skills\\example-skill")
    assert (got["id"], got["type"], got["tags"], got["body"]) == ("Skills/example-skill.md", "Skill", ["sprocket", "gear"], "## Use\nsteps")
    with pytest.raises(LookupError):
        bundle.get_concept(known, "Skills/none")
    with pytest.raises(LookupError):
        bundle.get_concept(known, "../x")
    assert [r.concept_id for r in R.find_skill(bundle.concepts(bundle.read_files(spark, root)), "sprocket").collect()] == ["Skills/example-skill.md"]


def test_writes_are_applied(spark, root, tmp_path):
    """A batch of every kind of write, written as files and read again."""
    files = bundle.read_files(spark, root)
    lesson, _ = W.new_lesson(_author(spark.createDataFrame([("demo", "new", "be careful", ["k1"], 1), ("demo", "newer", "be quick", ["k2"], 2)], "area string, slug string, content string, keywords array<string>, ord int")), files)
    skill, _ = W.new_skill(_author(spark.createDataFrame([("One", "do it")], "name string, content string")), files, "2024-05-05")
    patch, _ = W.update_concept(_author(spark.createDataFrame([("Knowledge/sample", "more")], "concept_id string, patch string")), files, "2024-05-05")
    session, _ = W.log_session(_author(spark.createDataFrame([(1, HEAD.format(t="Session", d="s", g="x") + "# 2024-01-02 Day\n")], "ord int, handoff string")), files, "2024-05-05")
    docs = skill.select("path", "document", "log_line", "ord").unionByName(patch.select("path", "document", "log_line", "ord"))
    from brindle.operators import writes

    before = files.count()
    assert writes.commit(writes.apply(files, "2024-05-05", documents=docs, lessons=lesson, sessions=session), root) == 7
    now = {r.path: r.text for r in bundle.read_files(spark, root).collect()}
    assert now["Lessons/demo/problems.md"].endswith("## existing\ngear trouble\n\n## new\nbe careful\n\n## newer\nbe quick\n")
    assert "## demo\n- [[demo/problems]] — k2\n- [[demo/problems]] — k1\n- [[demo/problems|P]]" in now["Lessons/INDEX.md"]
    assert now["Skills/one.md"].endswith("# One\n\ndo it\n") and now["Knowledge/sample.md"].endswith("\n\nmore\n") and "Sessions/2024-01-02-day.md" in now
    log = now["log.md"].split("\n")
    assert log[:2] == ["# Log", "## 2024-01-02"] and sum(x.startswith("* **") for x in log) == 7 and log[2].startswith("* **Update**: Session")
    assert "- **Updated:** 2024-05-05\n" in now["Dashboard.md"] and now["no header.md"] == "sprocket"
    assert len(now) == before + 2


def test_keywords_between_words(spark):
    """Keywords without a letter: only what stands between two words counts, as a word pattern has it."""
    import re

    prompts = ["a++b", "a ++ b", "c++", "x, y", "x , y", "é, z", "n/a n/ a", ""]
    keys = ["++", ", ", "/", " ", " ++ ", ",", "n/a", "é,", "c++"]
    p = spark.createDataFrame([(str(i), x) for i, x in enumerate(prompts)], "prompt_id string, prompt string")
    index = spark.createDataFrame([(i, f"t{i}", [k]) for i, k in enumerate(keys)], "line_no int, target string, keywords array<string>")
    got = {(int(r.prompt_id), r.target) for r in R.matched_lessons(p, index, index.select("target"), most=99).collect()}
    assert got == {(i, f"t{j}") for i, x in enumerate(prompts) for j, k in enumerate(keys) if re.search(rf"\b{re.escape(k)}\b", x)}


def test_index_lines_of_a_batch():
    """Lines put into an index at once stand as if put there one by one, odd headings and line ends included."""
    import random

    def one(text, heading, line):
        out, done = [], False
        for x in text.splitlines():
            out.append(x)
            if not done and x.strip() == heading:
                out.append(line)
                done = True
        return "\n".join(out if done else [*out, "", heading, line]) + "\n"

    rng = random.Random(7)
    bits = ["## a", "## b", " ## a ", "## c", "x", "", "\n", "\r", "\r\n", "\u2028", "\x1f", "- l"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 8)))
        n = rng.randint(1, 9)
        headings = rng.choices(["## a", "## b", "## c", "## a ", "## a\n## b", "x", ""], k=n)
        lines = [f"- {i}" if rng.random() < 0.4 else "".join(rng.choices(bits, k=rng.randint(0, 5))) for i in range(n)]
        want = text
        for h, x in zip(headings, lines, strict=True):
            want = one(want, h, x)
        assert W._inserted(text, headings, lines) == want, (text, headings, lines)


def test_many_lessons_in_one_batch(spark):
    """Thousands of index lines of one batch: their time grows with their number, not with its square."""
    import time

    from brindle.operators import writes

    n = 12_000
    files = spark.createDataFrame([("Lessons/INDEX.md", "# Index\n## a0\n- old\n"), ("Lessons/a0/problems.md", "x\n"), ("Lessons/a1/problems.md", "x\n")], "path string, text string")
    area = F.concat(F.lit("a"), (F.col("id") % 2).cast("string"))
    row = spark.range(n).select(F.concat(F.lit("Lessons/"), area, F.lit("/problems.md")).alias("path"), F.lit("\n## s\nb\n").alias("append"), F.concat(F.lit("## "), area).alias("index_heading"), F.concat(F.lit("- "), F.col("id").cast("string")).alias("index_line"), F.col("id").alias("ord"))
    began = time.time()
    got = {r.path: r.text for r in writes.apply(files, "2024-05-05", lessons=row).collect()}
    assert time.time() - began < 60
    even, odd = (("\n".join(f"- {i}" for i in range(n - 2 + k, -1, -2))) for k in (0, 1))
    assert got["Lessons/INDEX.md"] == f"# Index\n## a0\n{even}\n- old\n\n## a1\n{odd}\n"
    assert got["Lessons/a0/problems.md"] == "x\n" + "\n## s\nb\n" * (n // 2)


def test_gates_run_in_many_tasks(spark):
    """The gates of rows that one task reads run in many tasks."""
    rows = spark.range(4000).coalesce(1)
    files = F.broadcast(spark.range(1).select(F.lit("Knowledge/a.md").alias("path"), F.lit("x").alias("text")))
    _, bad = W.update_concept(_author(rows.select(F.lit("Knowledge/b").alias("concept_id"), F.lit("p").alias("patch"), F.col("id").alias("ord"))), files, "2024-05-05")
    assert sorted(r["count"] for r in bad.groupBy(F.spark_partition_id().alias("task")).count().collect())[-1] <= 2000
    lessons = rows.select(F.lit("b").alias("area"), F.lit("s").alias("slug"), F.lit("c").alias("content"), F.array(F.lit("k")).alias("keywords"), F.col("id").alias("ord"))
    _, bad = W.new_lesson(_author(lessons), files)
    assert sorted(r["count"] for r in bad.groupBy(F.spark_partition_id().alias("task")).count().collect())[-1] <= 2000


def test_keywords_are_made_once(spark):
    """Lesson matching makes the keywords of the index once, however many kinds of keywords there are."""
    seen = spark.sparkContext.accumulator(0)

    def made(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    lines = spark.createDataFrame([(i, f"t{i}", ["gear", "gear box", ", "]) for i in range(8)], "line_no int, target string, keywords array<string>")
    index = lines.mapInArrow(made, lines.schema)
    prompts = spark.createDataFrame([("p", "a gear box, please")], "prompt_id string, prompt string")
    got = R.matched_lessons(prompts, index, lines.select("target")).collect()
    assert sorted((r.target, r.score, r["rank"]) for r in got) == [("t0", 3, 1), ("t1", 3, 2)]
    assert seen.value == 8


def test_secret_gate_finds_each_kind(spark):
    """Looking first for an address or :// changes no verdict."""
    texts = ["10.0.0.1 login", "10.0.0.1\nlogin", "x\u202810.0.0.1 login\u2028", "https://a:b@c", "https://c", "a://b:c\n@d", "1.2.3 key", ""]
    ip, url = "ip address paired with credential on one line", "credentialed connection string"
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", G.secret_reason(F.col("x")).alias("r"))
    assert [r.r for r in rows.orderBy("i").collect()] == [ip, None, ip, url, None, None, None, None]


def test_skill_gates_run_once(spark):
    """Accepted and rejected skills come of one pass over the candidates, whatever their errors."""
    seen = spark.sparkContext.accumulator(0)

    def made(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"S{i % 40}", "password: abc" if i == 7 else f"do {i}", "" if i == 9 else "ann", "a@example.com", i) for i in range(50)], "name string, content string, author_name string, author_email string, ord int")
    files = spark.createDataFrame([("Skills/s1.md",)], "path string")
    ok, bad = W.new_skill(rows.mapInArrow(made, rows.schema), files, "2024-05-05")
    both = ok.select("path", "ord", F.lit("").alias("error"), "document").unionByName(bad.select("path", "ord", "error", F.lit("").alias("document")))
    got = {r.ord: r for r in both.collect()}
    assert len(got) == 50 and seen.value == 50
    again = {1, *(set(range(40, 50)) - {47, 49})}
    assert {i for i, r in got.items() if r.error == "skill already exists"} == again
    assert got[7].error == "assigned secret key name" and got[9].error == "an authenticated author is required"
    assert got[47].document.endswith("# S7\n\ndo 47\n") and got[49].error == ""
