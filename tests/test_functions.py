"""Known answers for text, gates and scores."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import gates as G
from brindle.functions import scoring as S
from brindle.functions import text as T

HEAD = '---\ntype: Skill\ndescription: "A \'thing\'"\ntags: [a, "b", , c]\ntimestamp: 2024-01-02\n---\n'


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, "The Orders-API and the api v1.2 to of", T.query_words) == ["orders-api", "api", "v1.2"]
    assert one(spark, "widget widget gear into", T.query_words) == ["widget", "widget", "gear"]
    assert one(spark, "widget widget gea into", T.prompt_words) == ["widget"]
    assert T.literal_query_words("Sprocket sprocket a") == ["sprocket", "sprocket"]
    assert one(spark, "aaaa", lambda c: T.occurrences(c, "aa")) == 2


@pytest.mark.parametrize(("text", "want"), [("  Hello, World! ", "hello-world"), ("---", "untitled"), (None, "untitled"), ("É1", "1")])
def test_slug(spark, text, want):
    assert one(spark, text, T.slug) == want


def test_frontmatter(spark):
    doc = HEAD + "body\n\nmore\n"
    fm = one(spark, doc, T.frontmatter)
    assert fm == {"type": "Skill", "description": "A 'thing", "tags": '[a, "b", , c]', "timestamp": "2024-01-02"}
    assert one(spark, fm["tags"], T.inline_list) == ["a", "b", "c"]
    assert one(spark, doc, T.body) == "body\n\nmore"
    for bad in ("", "no header", "---\ntype: x\n", "----\ntype: x\n---\n"):
        assert one(spark, bad, T.frontmatter) == {}
        assert one(spark, bad, T.body) == bad
    assert one(spark, "---\ntype: a\ntype: b\n1x: y\n---", T.frontmatter) == {"type": "b"}
    assert one(spark, "---\r\ntype: a\r\n --- \r\nx\r\ny", T.body) == "x\ny"


def test_short_frontmatter(spark):
    assert one(spark, HEAD + "x", T.short_frontmatter) == {"type": "Skill", "description": "A 'thing'", "tags": '[a, "b", , c]', "timestamp": "2024-01-02"}
    assert one(spark, "---\ntype: x\n", T.short_frontmatter) is None
    assert one(spark, "---\ntype: x\nd: " + "y" * 900 + "\n---\n", T.short_frontmatter) is None


def test_sections(spark):
    body = "intro\n## One\na\n### sub\nb\n## Two\n"
    assert one(spark, body, T.sections) == ["## One\na\n### sub\nb", "## Two"]
    assert one(spark, body, lambda c: T.section(c, "One")) == "a\n### sub\nb"
    assert one(spark, body, lambda c: T.section(c, "Three")) == ""


def test_ids_and_links(spark):
    assert one(spark, "\\a\\b", T.concept_id) == "a/b.md"
    assert one(spark, "a/../b", T.concept_id) is None
    assert one(spark, "see [[a/b|B]] and [[c]]", T.wikilinks) == ["a/b", "c"]
    assert one(spark, "see [[a/b|B]] and [[c]]", T.wikilinks_to_markdown) == "see [B](a/b.md) and [c](c.md)"
    assert one(spark, "{{X}}/{{Y}}", lambda c: T.placeholders(c, {"X": "1"})) == "1/{{Y}}"
    assert one(spark, "a\nKind: Patterns\n", T.lesson_kind) == "patterns"
    assert one(spark, "a", T.lesson_kind) == "problems"


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("password: hunter2", "assigned secret key name"),
        ("password:\nfoo", "assigned secret key name"),
        ('"password": "x"', None),
        ("my_api_key=1", None),
        ("-----BEGIN RSA PRIVATE KEY-----", "private key block"),
        ("db://u:p@host/x", "credentialed connection string"),
        ("login 10.0.0.1", "ip address paired with credential on one line"),
        ("10.0.0.1 key", "ip address paired with credential on one line"),
        ("10.0.0.1\nkey", None),
        ("plain text", None),
    ],
)
def test_secrets(spark, text, reason):
    assert one(spark, text, G.secret_reason) == reason


def test_violations(spark):
    assert one(spark, HEAD, G.violation) is None
    assert one(spark, "x", G.violation) == "missing frontmatter block"
    assert one(spark, HEAD.replace("Skill", " "), G.violation) == "blank or missing 'type'"
    assert one(spark, HEAD.replace('[a, "b", , c]', "[]"), G.violation) == "blank or missing 'tags'"
    assert one(spark, "rules/x", G.protected) and one(spark, "PROTOCOL", G.protected) and one(spark, "../x", G.protected)
    assert not one(spark, "Skills/x", G.protected)


def test_activation_goldens(spark):
    hi = {"semantic_similarity": 1.0, "project_context_signal": 1.0, "explicit_link_signal": 1.0, "tag_match": 1.0, "reliability_signal": 1.0, "description_match": 1.0, "recency_signal": 1.0, "coactivation_signal": 1.0}
    mid, lo = {"semantic_similarity": 0.6, "tag_match": 0.5}, {"deprecated_penalty": 1.0}
    df = spark.createDataFrame([("hi", hi), ("mid", mid), ("lo", lo)], "ref string, s map<string,double>")
    a = S.activation(S.from_map(F.col("s")))
    got = {r.ref: (round(r.a, 6), r.level) for r in df.select("ref", a.alias("a"), S.retrieval_level(a).alias("level")).collect()}
    assert got == {"hi": (0.92, "full_concept"), "mid": (0.2, "ignore"), "lo": (0.0, "ignore")}


@pytest.mark.parametrize(("a", "level"), [(0.40, "index_only"), (0.34, "ignore"), (0.50, "frontmatter"), (0.88, "full_concept")])
def test_levels(spark, a, level):
    assert spark.range(1).select(S.retrieval_level(F.lit(a)).alias("x")).first().x == level
