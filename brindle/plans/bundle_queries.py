"""Queries over documents, benchmark, pages, parts and conversations: parsing, search, gates, budgets, links, proposals.

Documents stand in for concepts (lang is the type, source the description), benchmark rows for prompts, part names for
the keyword index, pages for linked concepts, conversations for sessions. Where a parser needs a header or headings, the
query builds them around the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import gates as G
from ..functions import text as T
from ..operators import budget as B
from ..operators import policy as P
from ..operators import proposals
from ..operators import ranking as R
from ..operators import writes
from ..sources import bundle
from ..sources.storage import shared_path


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP = f"({', '.join(map(_quoted, C.STOP_WORDS))})"
WORDS = "string tion queue the tion"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("concept_id"), F.col("source").alias("stem"), F.col("lang").alias("type"), F.concat_ws(" ", "lang", "source").alias("description"), F.array("lang").alias("tags"), F.col("text").alias("body"))


def _score_sql(words: list[str]) -> str:
    def n(h, w):
        return f"(length({h}) - length(replace({h}, '{w}', ''))) // {len(w)}"

    return " + ".join(f"3 * ({n('h', w)}) + {n('b', w)}" for w in words)


def _search_sql(words: list[str], where: str) -> str:
    return f"""WITH c AS (SELECT doc_id, lang || ' ' || source AS description, lower(lang || ' ' || source || ' ' || lang || ' ' || source) AS h, lower(text) AS b FROM documents WHERE {where}),
s AS (SELECT doc_id AS concept_id, description, {_score_sql(words)} AS score FROM c) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, concept_id LIMIT 10"""


def bundle_search(spark, sf_dir):
    return R.search(_concepts(spark, sf_dir), WORDS)


def search_by_type(spark, sf_dir):
    return R.search(_concepts(spark, sf_dir), "queue source src1", kind="fr")


def prompt_tokens(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(T.query_words(F.col("text")), " ").alias("query_words"), F.array_join(F.array_sort(T.prompt_words(F.col("text"))), " ").alias("prompt_words"))


_TOKENS = "regexp_extract_all(lower({x}), '[a-z0-9_.-]+')"
PROMPT_TOKENS = f"""WITH t AS (SELECT item_id, {_TOKENS.format(x='text')} AS w FROM benchmark)
SELECT item_id, array_to_string(list_filter(w, lambda x: length(x) > 2 AND x NOT IN {STOP}), ' ') AS query_words,
array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) > 3 AND x NOT IN {STOP}))), ' ') AS prompt_words FROM t"""


def concept_overlap_top1(spark, sf_dir):
    prompts = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    concepts = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("hay"))
    return R.matched_concepts(prompts, concepts)


OVERLAP = f"""WITH p AS (SELECT DISTINCT item_id AS prompt_id, unnest(list_filter({_TOKENS.format(x='text')}, lambda x: length(x) > 3 AND x NOT IN {STOP})) AS w FROM benchmark),
c AS (SELECT DISTINCT doc_id AS path, unnest({_TOKENS.format(x='text')}) AS w FROM documents),
s AS (SELECT prompt_id, path, count(*) AS score FROM p JOIN c USING (w) GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, path) AS rank FROM s) SELECT * FROM r WHERE rank <= 1"""


def _part_index(spark, sf_dir):
    """A lesson index line for each part: its name and type as keywords."""
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("line_no"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("target"), F.lower("p_name").alias("kw_line"), F.array(F.lower("p_name"), F.lower("p_type")).alias("keywords"))


def lesson_containment(spark, sf_dir):
    return R.find_lesson(_part_index(spark, sf_dir), "Widget", limit=20)


CONTAINMENT = """WITH k AS (SELECT p_partkey AS line_no, [lower(p_name), lower(p_type)] AS keys, lower(p_name) AS kw_line FROM part),
s AS (SELECT line_no, 'part/' || line_no AS target, 'Lessons/part/' || line_no || '.md' AS concept_id, kw_line, len(list_filter(keys, lambda x: contains(x, 'widget') OR contains('widget', x))) AS score FROM k)
SELECT target, concept_id, kw_line, score FROM s WHERE score > 0 ORDER BY score DESC, line_no LIMIT 20"""


def _lesson_index(spark, sf_dir):
    """An index line for each document: its long words, its first two words as one keyword, and a gap between words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    pair = F.regexp_extract(F.lower("text"), r"^([a-z]+ [a-z]+) ", 1)
    gap = F.when(F.col("doc_id") % 50 == 0, F.array(F.lit(", "))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.filter(F.concat(F.filter(words, lambda w: F.length(w) > 6), F.array(pair), gap), lambda w: w != ""))
    d = _read(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("line_no"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("target"), keys.alias("keywords"))


def _prompts(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))


def _matched(spark, sf_dir):
    index = _lesson_index(spark, sf_dir)
    return R.matched_lessons(_prompts(spark, sf_dir), index, index.where("line_no % 10 <> 3").select("target"))


def lesson_word_match_top2(spark, sf_dir):
    return _matched(spark, sf_dir)


WORD_MATCH = r"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3),
k AS (SELECT DISTINCT doc_id AS line_no, unnest(list_filter(regexp_extract_all(t, '[a-z0-9_]+'), lambda x: length(x) > 6)) AS w FROM d),
k2 AS (SELECT doc_id AS line_no, regexp_extract(t, '^([a-z]+ [a-z]+) ', 1) AS w FROM d WHERE regexp_matches(t, '^([a-z]+ [a-z]+) ')),
k3 AS (SELECT doc_id AS line_no FROM d WHERE doc_id % 50 = 0),
w AS (SELECT DISTINCT item_id AS prompt_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark),
h AS (SELECT prompt_id, line_no FROM w JOIN k USING (w)
  UNION ALL SELECT item_id, line_no FROM benchmark JOIN k2 ON regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || w || '([^\p{L}\p{N}_]|$)')
  UNION ALL SELECT item_id, line_no FROM benchmark, k3 WHERE regexp_matches(lower(text), '[\p{L}\p{N}_], [\p{L}\p{N}_]')),
t AS (SELECT prompt_id, line_no, count(*) AS score FROM h GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, line_no) AS rank FROM t)
SELECT prompt_id, 'doc/' || line_no AS target, score, rank FROM u WHERE rank <= 2"""


def _with_headings(spark, sf_dir):
    """Documents whose lines are sections: each line becomes '## <its number>' and the line."""
    d = _read(spark, sf_dir, "documents")
    made = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)), "\n")
    return d.select("doc_id", made.alias("body"))


def section_nodes(spark, sf_dir):
    return bundle.sections(_with_headings(spark, sf_dir), "doc_id").select("doc_id", "pos", "slug", F.col("node"), F.length("text").alias("n_chars"))


SECTION_NODES = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, 'part-' || pos AS slug, doc_id || '#part-' || pos AS node, length(regexp_replace('## Part ' || pos || chr(10) || line, '\s+$', '')) AS n_chars FROM l"""


def _with_header(spark, sf_dir):
    """Documents with a header: keys of every seventh and fifth are blank or missing."""
    d = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    head = F.concat(
        F.lit("---\ntype: "),
        F.when(i % 7 == 0, "").otherwise(F.col("lang")),
        F.lit('\ndescription: "'),
        F.col("source"),
        F.lit('"\n'),
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("tags: [a, '"), F.col("lang"), F.lit("', ]\n"))),
        F.lit("timestamp: 2024-01-0"),
        (i % 9 + 1).cast("string"),
        F.lit("\ntype: "),
        F.when(i % 7 == 0, "").otherwise(F.col("source")),
        F.lit("\n---\n"),
    )
    return d.select("doc_id", F.when(i % 11 == 0, F.col("text")).otherwise(F.concat(head, F.col("text"))).alias("text"))


def frontmatter_parse(spark, sf_dir):
    fm = F.col("fm")
    return _with_header(spark, sf_dir).withColumn("fm", T.frontmatter(F.col("text"))).select("doc_id", F.coalesce(fm["type"], F.lit("")).alias("type"), F.coalesce(fm["description"], F.lit("")).alias("description"), F.coalesce(F.array_join(T.inline_list(fm["tags"]), "|"), F.lit("")).alias("tags"), F.coalesce(fm["timestamp"], F.lit("")).alias("timestamp"), F.md5(T.body(F.col("text")).cast("binary")).alias("body"))


#: A text as the lines of a body: line ends as line feeds, none at the end.
_BODY = r"regexp_replace(regexp_replace({x}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n$', '')"
FRONTMATTER_PARSE = f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN '' ELSE source END AS type, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS description,
CASE WHEN doc_id % 11 = 0 OR doc_id % 5 = 0 THEN '' ELSE 'a|' || lang END AS tags, CASE WHEN doc_id % 11 = 0 THEN '' ELSE '2024-01-0' || (doc_id % 9 + 1) END AS timestamp, md5(CASE WHEN doc_id % 11 = 0 THEN text ELSE {_BODY.format(x='text')} END) AS body FROM documents"""


def frontmatter_violations(spark, sf_dir):
    t = F.col("text")
    return _with_header(spark, sf_dir).select("doc_id", F.coalesce(G.violation(t), F.lit("")).alias("violation"), G.conforms(t).alias("conforms"))


VIOLATIONS = """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing frontmatter block' WHEN doc_id % 7 = 0 THEN 'blank or missing ''type''' WHEN doc_id % 5 = 0 THEN 'blank or missing ''tags''' ELSE '' END AS violation,
doc_id % 11 <> 0 AND doc_id % 7 <> 0 AS conforms FROM documents"""


def slugify(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand", "p_type")).alias("slug"))


SLUGIFY = "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(concat_ws(' / ', p_name, p_brand, p_type)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM part"


def secret_flags(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(G.secret_reason(F.col("text"), unicode=False), F.lit("")).alias("reason"))


def _secret_sql(text: str) -> str:
    return f"""CASE
 WHEN regexp_matches({text}, {_quoted(C.SECRET_KEY)}) THEN 'assigned secret key name'
 WHEN regexp_matches({text}, {_quoted(C.SECRET_PEM)}) THEN 'private key block'
 WHEN regexp_matches({text}, {_quoted(C.SECRET_URL)}) THEN 'credentialed connection string'
 WHEN len(list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, {_quoted(C.IPV4)}) AND regexp_matches(x, {_quoted(C.AUTH_WORD)}))) > 0 THEN 'ip address paired with credential on one line'
 ELSE '' END"""


SECRET_FLAGS = f"SELECT doc_id, {_secret_sql('text')} AS reason FROM documents"


def protected_targets(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    target = F.when(i % 5 == 0, "PROTOCOL").when(i % 5 == 1, F.concat(F.lit("/rules\\r"), i.cast("string"))).when(i % 5 == 2, "a/../b").otherwise(F.concat(F.lit("Skills/s"), i.cast("string")))
    return d.select("doc_id", F.coalesce(T.concept_id(target), F.lit("")).alias("concept_id"), G.protected(target).alias("protected"))


PROTECTED = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'PROTOCOL.md' WHEN 1 THEN 'rules/r' || doc_id || '.md' WHEN 2 THEN '' ELSE 'Skills/s' || doc_id || '.md' END AS concept_id, doc_id % 5 <= 2 AS protected FROM documents"""


def event_limits(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    refs = F.sequence(F.lit(1), F.col("turn") + 1)
    return c.select("conv_id", "turn", F.array_join(G.event_violations(F.col("text"), F.col("text"), refs, refs), ",").alias("over"), F.length(F.left("text", F.lit(280))).cast("long").alias("clipped"))


EVENT_LIMITS = """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(text) > 280 THEN 'summary' END, CASE WHEN strlen(text) > 2048 THEN 'payload' END, CASE WHEN turn + 1 > 8 THEN 'memory_refs' END, CASE WHEN turn + 1 > 5 THEN 'evidence_refs' END], lambda x: x IS NOT NULL), ',') AS over,
least(length(text), 280) AS clipped FROM conversations"""


def context_budget(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    out = B.assemble(c, ["conv_id"], "turn", "text", cap=600)
    return out.select("conv_id", F.length("context").cast("long").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("digest"))


CONTEXT_BUDGET = """WITH b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WHERE length(text) > 0),
p AS (SELECT conv_id, turn, left(text, (600 - before)::BIGINT) AS piece FROM b WHERE before < 600),
a AS (SELECT conv_id, string_agg(piece, chr(10) || chr(10) ORDER BY turn) AS context FROM p GROUP BY conv_id)
SELECT conv_id, length(context) AS n_chars, md5(context) AS digest FROM a"""


def staged_lessons(spark, sf_dir):
    """Each conversation's turns as a lesson, staged for its first turn as the prompt."""
    c = _read(spark, sf_dir, "conversations").where("text is not null")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("## t"), t["turn"].cast("string"), F.lit("\n"), F.regexp_replace(t["text"], r"\s+", " "))), "\n")
    g = c.groupBy("conv_id").agg(text.alias("lesson"), F.min_by("text", "turn").alias("prompt"))
    staged = R.staged_lesson(F.col("prompt"), F.col("lesson"))
    return g.select("conv_id", F.length(staged).cast("long").alias("n_chars"), F.md5(staged.cast("binary")).alias("digest"))


def _lines(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("line_no"), F.concat_ws(": ", "role", "text").alias("line"))


def recent_changes_file(spark, sf_dir):
    return R.last_lines(_lines(spark, sf_dir), 2, ["conv_id"])


def recent_changes_newest(spark, sf_dir):
    return R.last_lines(_lines(spark, sf_dir), 2, ["conv_id"], newest=True)


_RECENT = "SELECT conv_id, line_no, line FROM (SELECT conv_id, turn AS line_no, concat_ws(': ', role, text) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn {o}) AS n FROM conversations) WHERE n <= 2"


def _links(spark, sf_dir):
    """Anchors of the pages: (source page's folder, target), entities aside."""
    p = _read(spark, sf_dir, "pages").where("html is not null")
    return p.select(F.concat(F.lit("/"), F.col("page_id").cast("string")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))


_LINKS = """l AS (SELECT '/' || page_id AS source, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages)"""


def link_graph(spark, sf_dir):
    return P.link_graph(_links(spark, sf_dir))


LINK_GRAPH = f"WITH {_LINKS} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM l WHERE source <> target"


def broken_links(spark, sf_dir):
    links = _links(spark, sf_dir)
    nodes = links.select(F.col("target").alias("node")).distinct().where(F.length("node") % 2 == 0)
    return P.broken_links(links, nodes).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


BROKEN_LINKS = f"WITH {_LINKS} SELECT target, count(*) AS n FROM l WHERE length(target) % 2 <> 0 GROUP BY target"


def wikilinks(spark, sf_dir):
    """Benchmark texts with their first two words made links."""
    b = _read(spark, sf_dir, "benchmark")
    made = F.regexp_replace("text", r"^([a-zA-Z]+) ([a-zA-Z]+)", "[[$1|x]] [[$2]]")
    return b.select("item_id", F.array_join(T.wikilinks(made), ",").alias("targets"), F.md5(T.wikilinks_to_markdown(made).cast("binary")).alias("markdown"))


WIKILINKS = r"""WITH m AS (SELECT item_id, text, regexp_extract(text, '^([a-zA-Z]+) ([a-zA-Z]+)', 1) AS a, regexp_extract(text, '^([a-zA-Z]+) ([a-zA-Z]+)', 2) AS b FROM benchmark)
SELECT item_id, CASE WHEN a <> '' THEN a || ',' || b ELSE '' END AS targets, md5(CASE WHEN a <> '' THEN '[x](' || a || '.md) [' || b || '](' || b || '.md)' || substr(text, length(a) + length(b) + 2) ELSE text END) AS markdown FROM m"""


def stale_index(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    return P.stale(p.where("page_id % 4 <> 0").select(F.col("page_id").alias("path")), p.where("page_id % 3 <> 0").select(F.col("page_id").alias("path")))


STALE = "SELECT page_id AS path, CASE WHEN page_id % 3 = 0 THEN 'missing file' ELSE 'not indexed' END AS problem FROM pages WHERE (page_id % 4 <> 0) <> (page_id % 3 <> 0)"


def proposal_ids(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark")
    return b.select("item_id", proposals.proposal_id(F.col("text"), F.concat(F.lit("because "), F.col("item_id").cast("string"))).alias("proposal_id"))


PROPOSAL_IDS = "SELECT item_id, 'proposal-' || substr(sha1(text || '|' || 'because ' || item_id), 1, 8) AS proposal_id FROM benchmark"


def session_names(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").where("turn = 0")
    handoff = F.concat(F.lit("# 2024-02-0"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit(" — Topic "), (F.col("conv_id") % 4).cast("string"), F.lit("\n"), F.coalesce(F.regexp_replace("text", r"\d", ""), F.lit("")))
    return c.select("conv_id", proposals.session_stem(handoff, "2024-01-01").alias("stem"))


SESSION_NAMES = "SELECT conv_id, '2024-02-0' || (conv_id % 9 + 1) || '-topic-' || (conv_id % 4) AS stem FROM conversations WHERE turn = 0"


def authenticate(spark, sf_dir):
    """Customers as bearers: a token file is made of every third, some lines malformed, some repeated."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    line = F.concat_ws(":", F.concat(F.lit("t"), (k % 500).cast("string")), F.concat(F.lit("u"), k.cast("string")), F.when(k % 2 == 0, "Admin").when(k % 9 == 1, "guest").otherwise("user"))
    known = bundle.tokens(c.where(k % 3 == 0).select(k.alias("line_no"), line.alias("line")))
    requests = c.select(k.alias("request"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("Bearer t"), (k % 600).cast("string"))).alias("bearer"))
    out = bundle.authenticate(requests, known)
    return out.select("request", F.coalesce("email", F.lit("")).alias("email"), F.coalesce("is_admin", F.lit(False)).alias("is_admin"), F.coalesce("error", F.lit("")).alias("error"))


AUTHENTICATE = """WITH t AS (SELECT c_custkey AS n, 't' || (c_custkey % 500) AS token, 'u' || c_custkey AS u, CASE WHEN c_custkey % 2 = 0 THEN 'admin' WHEN c_custkey % 9 = 1 THEN 'guest' ELSE 'user' END AS role FROM customer WHERE c_custkey % 3 = 0),
k AS (SELECT token, arg_max(u, n) AS u, arg_max(role, n) AS role FROM t WHERE role <> 'guest' GROUP BY token),
r AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 't' || (c_custkey % 600) END AS token FROM customer)
SELECT request, coalesce(u || '@example.com', '') AS email, coalesce(role = 'admin', false) AS is_admin, CASE WHEN r.token = '' THEN 'missing bearer credential' WHEN u IS NULL THEN 'unknown token' ELSE '' END AS error FROM r LEFT JOIN k ON r.token = k.token"""


def _files(spark, sf_dir):
    """Documents as files of a bundle: a folder per source, a header around every text."""
    d = _with_header(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source")), "doc_id")
    return d.select("doc_id", F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


def bundle_index(spark, sf_dir):
    """The listing of one folder; long, so its digest."""
    return bundle.directory_index(_files(spark, sf_dir), "src3").select("path", F.length("index").cast("long").alias("n_chars"), F.md5(F.col("index").cast("binary")).alias("digest"))


BUNDLE_INDEX = """SELECT 'src3' AS path, length(t) AS n_chars, md5(t) AS digest FROM (SELECT '# Index: src3' || chr(10) || string_agg('* [d' || doc_id || '.md](d' || doc_id || '.md) - ' || CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END, chr(10) ORDER BY 'd' || doc_id || '.md') AS t
FROM documents WHERE source = 'src3')"""


def lesson_index_lines(spark, sf_dir):
    """Parts as index lines, every fourth malformed."""
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("- "), F.col("p_name"))).otherwise(F.concat(F.lit("- [[area/"), k.cast("string"), F.lit("|x]] — "), F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(" / "), F.col("p_brand")))
    out = bundle.lesson_index(p.select(k.alias("line_no"), line.alias("line")))
    return out.select("line_no", "target", "alias", F.array_join("keywords", "|").alias("keywords"))


LESSON_INDEX = "SELECT p_partkey AS line_no, 'area/' || p_partkey AS target, 'x' AS alias, lower(p_name) || '|' || lower(p_type) || '|' || lower(p_brand) AS keywords FROM part WHERE p_partkey % 4 <> 0"


def log_by_date(spark, sf_dir):
    """Conversations as logs: a heading every third line, entries in between."""
    c = _read(spark, sf_dir, "conversations")
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## day "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("* **"), F.col("role"), F.lit("**: n"), F.col("turn").cast("string")))
    return bundle.log_entries(c.select("conv_id", F.col("turn").alias("line_no"), line.alias("line")), "conv_id")


LOG_BY_DATE = """SELECT conv_id, turn AS line_no, max('day ' || h) FILTER (h IS NOT NULL) AS date, role AS label, 'n' || turn AS text
FROM (SELECT c.conv_id, c.turn, c.role, (SELECT max(d.turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn < c.turn AND d.turn % 3 = 0) AS h FROM conversations c WHERE c.turn % 3 <> 0) GROUP BY conv_id, turn, role"""


def prompt_context(spark, sf_dir):
    """Each benchmark prompt's context: rules, a dashboard, its best lessons and its best document that is none of
    these, under the budget. A prompt has three of these at most: they go to the documents, whose texts are not shuffled.
    The lessons are needed twice, so they are written and read."""
    prompts, chosen, path = _prompts(spark, sf_dir), _matched(spark, sf_dir), shared_path(spark, "matched")
    chosen.write.parquet(path)
    matched = spark.read.schema(chosen.schema).parquet(path)
    d = _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    best = R.matched_concepts(prompts, d.select("path", F.col("text").alias("hay")), exclude=F.broadcast(matched.select("prompt_id", F.col("target").alias("path"))))
    concepts = F.broadcast(best).join(d, "path").select("prompt_id", "path", "rank", "text")
    lessons = F.broadcast(matched).join(d.withColumnRenamed("path", "target"), "target").select("prompt_id", "target", "rank", F.left("text", F.lit(1500)).alias("chunk"))
    out = B.assemble(B.prompt_parts(prompts, "idle", lessons, concepts, rules="Be brief."), ["prompt_id"], "ordinal", "part")
    return out.select("prompt_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").cast("long").alias("n_chars"))


PROMPT_CONTEXT = f"""WITH m AS ({WORD_MATCH}), {OVERLAP[5:].split("r AS (")[0]}
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.prompt_id ORDER BY s.score DESC, 'doc/' || s.path) AS rank FROM s ANTI JOIN m ON m.prompt_id = s.prompt_id AND m.target = 'doc/' || s.path),
parts AS (SELECT item_id AS prompt_id, -1 AS n, 'Be brief.' AS part FROM benchmark
  UNION ALL SELECT item_id, 0, '--- Dashboard ---' || chr(10) || 'idle' FROM benchmark
  UNION ALL SELECT prompt_id, rank, '--- Lesson: ' || target || ' ---' || chr(10) || left(text, 1500) FROM m JOIN documents ON 'doc/' || doc_id = target WHERE length(text) > 0
  UNION ALL SELECT prompt_id, 1000 + rank, '--- Concept: doc/' || path || ' ---' || chr(10) || left(text, 2500) FROM o JOIN documents ON doc_id = path WHERE rank = 1 AND length(text) > 0),
b AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY prompt_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts),
y AS (SELECT prompt_id, string_agg(left(part, (6000 - before)::BIGINT), chr(10) || chr(10) ORDER BY n) AS t FROM b WHERE before < 6000 GROUP BY prompt_id)
SELECT prompt_id, md5(t) AS digest, length(t) AS n_chars FROM y"""


_WHO = "CASE WHEN doc_id % 8 = 0 THEN '' ELSE 'ann' END"


def write_gates(spark, sf_dir):
    """Documents as skills to write: which are accepted, and why others aren't. Every twelfth has a header of its own."""
    d = _read(spark, sf_dir, "documents").where("text is not null")
    i = F.col("doc_id")
    files = d.where("doc_id % 9 = 0").select(F.concat(F.lit("Skills/skill-"), i.cast("string"), F.lit(".md")).alias("path"))
    text = F.regexp_replace("text", "[^a-z :=0-9.]", " ")
    content = F.when(i % 12 == 0, F.concat(F.lit("---\ntype: Skill\n---\n"), text)).otherwise(text)
    name = F.concat(F.lit("Skill "), (i - F.when(i % 10 == 1, 1).otherwise(0)).cast("string"))
    c = d.select(name.alias("name"), content.alias("content"), F.expr(_WHO).alias("author_name"), F.lit("a@example.com").alias("author_email"), i.alias("ord"))
    ok, bad = proposals.new_skill(c, files, "2024-01-01")
    return ok.select("ord", "path", F.lit("").alias("error"), F.md5(F.col("document").cast("binary")).alias("digest")).unionByName(bad.select("ord", "path", "error", F.lit("").alias("digest")))


WRITE_GATES = f"""WITH d AS (SELECT doc_id, doc_id - CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS k, {_WHO} AS who, regexp_replace(text, '[^a-z :=0-9.]', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, 'Skills/skill-' || k || '.md' AS path, CASE WHEN doc_id % 12 = 0 THEN '---' || chr(10) || 'type: Skill' || chr(10) || '---' || chr(10) || t
  ELSE '---' || chr(10) || 'type: Skill' || chr(10) || 'description: "Skill ' || k || '"' || chr(10) || 'tags: [skill]' || chr(10) || 'timestamp: 2024-01-01' || chr(10) || '---' || chr(10) || chr(10) || '# Skill ' || k || chr(10) || chr(10) || ltrim(t) END AS doc FROM d),
e AS (SELECT c.*, CASE WHEN who = '' THEN 'an authenticated author is required' WHEN x.doc_id IS NOT NULL THEN 'skill already exists'
  ELSE coalesce(nullif({_secret_sql("('Skill ' || k || chr(10) || doc)")}, ''), CASE WHEN c.doc_id % 12 = 0 THEN 'blank or missing ' || chr(39) || 'description' || chr(39) ELSE '' END) END AS own
  FROM c LEFT JOIN (SELECT doc_id FROM d WHERE doc_id % 9 = 0) x ON x.doc_id = k),
f AS (SELECT *, row_number() OVER (PARTITION BY path, own = '' ORDER BY doc_id) AS turn FROM e)
SELECT doc_id AS ord, path, CASE WHEN own = '' AND turn > 1 THEN 'skill already exists' ELSE own END AS error, CASE WHEN own = '' AND turn = 1 THEN md5(CASE WHEN ends_with(doc, chr(10)) THEN doc ELSE doc || chr(10) END) ELSE '' END AS digest FROM f"""


STAGED = rf"""WITH c AS (SELECT conv_id, turn, text, rtrim('## t' || turn || chr(10) || regexp_replace(text, '\s+', ' ', 'g'), ' ' || chr(10)) AS sec FROM conversations WHERE text IS NOT NULL),
g AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM c GROUP BY conv_id),
p AS (SELECT conv_id, list_filter({_TOKENS.format(x='prompt')}, lambda x: length(x) > 3 AND x NOT IN {STOP}) AS own FROM g),
h AS (SELECT c.conv_id, c.turn, sec FROM c JOIN p USING (conv_id) WHERE list_has_any({_TOKENS.format(x='sec')}, own)),
a AS (SELECT conv_id, left(string_agg(sec, chr(10) || chr(10) ORDER BY turn), 4000) AS t FROM h GROUP BY conv_id)
SELECT g.conv_id, length(coalesce(t, '')) AS n_chars, md5(coalesce(t, '')) AS digest FROM g LEFT JOIN a USING (conv_id)"""


def named_sections(spark, sf_dir):
    """The text under one heading that some documents have, and whether a heading that none has is missing."""
    rows = _with_headings(spark, sf_dir).where("body is not null")
    return rows.select("doc_id", F.md5(T.section(F.col("body"), "Part 1").cast("binary")).alias("digest"), (T.section(F.col("body"), "Part") == "").alias("no_such"))


NAMED_SECTIONS = r"""SELECT doc_id, md5(coalesce(regexp_replace(string_split(text, chr(10))[2], '^\s+|\s+$', '', 'g'), '')) AS digest, true AS no_such FROM documents WHERE text IS NOT NULL"""


def lesson_kinds(spark, sf_dir):
    """Benchmark texts with a kind line: of every third it says pattern, of others problem, something else, or nothing."""
    i = F.col("item_id")
    line = F.when(i % 3 == 0, "  Kind: Pattern\n").when(i % 3 == 1, "kind : problems\nkind: patterns\n").when(i % 2 == 0, "kindly: pattern\n").otherwise("")
    return _read(spark, sf_dir, "benchmark").select("item_id", T.lesson_kind(F.concat("text", F.lit("\n"), line)).alias("kind"))


LESSON_KINDS = "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'patterns' ELSE 'problems' END AS kind FROM benchmark"


def placeholders(spark, sf_dir):
    """Benchmark texts after two names, one given and one not, and one whose value looks like a pattern."""
    made = F.concat(F.lit("{{ROOT}}/{{NONE}}/{{HOME}} {{ROOT}} "), "text")
    return _read(spark, sf_dir, "benchmark").select("item_id", F.md5(T.placeholders(made, {"ROOT": "/srv", "HOME": "$1\\0"}).cast("binary")).alias("digest"))


PLACEHOLDERS = r"SELECT item_id, md5('/srv/{{NONE}}/$1\0 /srv ' || text) AS digest FROM benchmark"


def _bundle(spark, sf_dir):
    """Benchmark texts as a bundle: files in folders, hidden folders, reserved names and files without a header among them."""
    i = F.col("item_id")
    path = F.when(i % 7 == 0, F.concat(F.lit("r"), i.cast("string"), F.lit("/index.md"))).when(i % 5 == 0, F.concat(F.lit("a/.h"), i.cast("string"), F.lit("/x.md"))).otherwise(F.concat(F.lit("Knowledge/k "), i.cast("string"), F.lit(".md")))
    kind = F.when(i % 4 == 0, "Session").when(i % 4 == 1, "Skill").otherwise("Knowledge")
    head = F.concat(F.lit("---\r\ntype: "), kind, F.lit("\ndescription: 'about "), i.cast("string"), F.lit("'\ntags: [x, t"), (i % 3).cast("string"), F.lit("]\n---\n"))
    return _read(spark, sf_dir, "benchmark").select(path.alias("path"), F.when(i % 3 == 0, F.col("text")).otherwise(F.concat(head, F.col("text"))).alias("text"))


def _written(spark, sf_dir):
    root = shared_path(spark, "bundle")
    bundle.write_files(_bundle(spark, sf_dir), root)
    return bundle.read_files(spark, root)


_IN_BUNDLE = "item_id % 7 <> 0 AND item_id % 5 <> 0 AND item_id % 3 <> 0"


def bundle_scan(spark, sf_dir):
    """A bundle written as files and read again as concepts."""
    c = bundle.concepts(_written(spark, sf_dir))
    return c.select("concept_id", "stem", "type", "description", F.array_join("tags", "|").alias("tags"), F.md5(F.col("body").cast("binary")).alias("body"))


BUNDLE_SCAN = f"""SELECT 'Knowledge/k ' || item_id || '.md' AS concept_id, 'k ' || item_id AS stem, CASE item_id % 4 WHEN 0 THEN 'Session' WHEN 1 THEN 'Skill' ELSE 'Knowledge' END AS type, 'about ' || item_id AS description,
'x|t' || (item_id % 3) AS tags, md5({_BODY.format(x='text')}) AS body FROM benchmark WHERE {_IN_BUNDLE}"""


def hook_scan(spark, sf_dir):
    """The same files as the concepts that a prompt may be given."""
    return bundle.hook_concepts(_written(spark, sf_dir)).select("path", "hay")


HOOK_SCAN = f"""SELECT 'Knowledge/k ' || item_id || '.md' AS path, chr(39) || 'about ' || item_id || chr(39) || ' [x, t' || (item_id % 3) || '] k ' || item_id AS hay
FROM benchmark WHERE {_IN_BUNDLE} AND item_id % 4 <> 0"""


def file_reads(spark, sf_dir):
    """Single files, whole and to a limit, and one that isn't there."""
    files = _bundle(spark, sf_dir)
    asked = [("Knowledge/k 1.md", None), ("Knowledge/k 2.md", 40), ("r0/index.md", None), ("none.md", 5)]
    out, *more = (bundle.point_read(files, p, n).select(F.lit(p).alias("path"), F.md5(F.col("text").cast("binary")).alias("digest")) for p, n in asked)
    for part in more:
        out = out.unionByName(part)
    return out


FILE_READS = """WITH f AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE '---' || chr(13) || chr(10) || 'type: ' || CASE item_id % 4 WHEN 0 THEN 'Session' WHEN 1 THEN 'Skill' ELSE 'Knowledge' END || chr(10) ||
  'description: ' || chr(39) || 'about ' || item_id || chr(39) || chr(10) || 'tags: [x, t' || (item_id % 3) || ']' || chr(10) || '---' || chr(10) || text END AS t FROM benchmark)
SELECT 'Knowledge/k 1.md' AS path, md5(coalesce(max(t) FILTER (item_id = 1), '')) AS digest FROM f UNION ALL SELECT 'Knowledge/k 2.md', md5(coalesce(left(max(t) FILTER (item_id = 2), 40), '')) FROM f
UNION ALL SELECT 'r0/index.md', md5(coalesce(max(t) FILTER (item_id = 0), '')) FROM f UNION ALL SELECT 'none.md', md5('')"""


def dashboard_read(spark, sf_dir):
    """Conversations as dashboards: a field for each turn, every third line not one."""
    c = _read(spark, sf_dir, "conversations")
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    text = F.concat(F.when(F.col("turn") % 3 == 2, "* **").otherwise("- **"), F.col("role"), F.col("turn").cast("string"), F.lit(":** x"), t)
    out = bundle.dashboard_fields(c.select("conv_id", F.col("turn").alias("line_no"), text.alias("line")), "conv_id")
    return out.select("conv_id", "field", F.md5(F.col("value").cast("binary")).alias("digest"))


DASHBOARD_READ = r"""SELECT conv_id, role || turn AS field, md5('x' || regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS digest FROM conversations WHERE turn % 3 <> 2"""


def concept_lookup(spark, sf_dir):
    """Benchmark items ask for documents by path, with backslashes, without a suffix, or for none that exist."""
    i = F.col("item_id")
    own = F.concat(F.lit("d"), (i * 3 + 1).cast("string"))
    source = _read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("own"), F.coalesce("source", F.lit("none")).alias("source"))
    b = _read(spark, sf_dir, "benchmark").select("item_id", own.alias("own")).join(source, "own", "left")
    wanted = F.when(i % 4 == 0, F.concat(F.lit("/"), "source", F.lit("/"), "own")).when(i % 4 == 1, F.concat("source", F.lit("\\"), "own", F.lit(".md"))).when(i % 4 == 2, F.lit("../x")).otherwise(F.concat("source", F.lit("/"), "own", F.lit(".md")))
    out = bundle.get_concepts(b.select("item_id", wanted.alias("wanted")), bundle.concepts(_files(spark, sf_dir)))

    def shown(c):
        return F.coalesce(c, F.lit(""))

    return out.select("item_id", shown(F.col("concept_id")).alias("concept_id"), shown(F.col("type")).alias("type"), shown(F.array_join("tags", "|")).alias("tags"), shown(F.md5(F.col("body").cast("binary"))).alias("body"), shown(F.col("error")).alias("error"))


CONCEPT_LOOKUP = f"""WITH d AS (SELECT doc_id, coalesce(source, 'none') || '/d' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS type, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'a|' || lang END AS tags, md5({_BODY.format(x='text')}) AS body FROM documents),
b AS (SELECT item_id, CASE WHEN item_id % 4 <> 2 THEN path END AS path, item_id % 4 <> 2 AND doc_id IS NOT NULL AND doc_id % 11 <> 0 AS found, type, tags, body FROM benchmark LEFT JOIN d ON doc_id = item_id * 3 + 1)
SELECT item_id, coalesce(path, '') AS concept_id, CASE WHEN found THEN type ELSE '' END AS type, CASE WHEN found THEN tags ELSE '' END AS tags, CASE WHEN found THEN body ELSE '' END AS body, CASE WHEN found THEN '' ELSE 'no such concept' END AS error FROM b"""


def concept_patches(spark, sf_dir):
    """Two patches for every third part's concept, in order; protected, missing and unauthored ones among them."""
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    head = F.concat(F.lit('---\ntype: Knowledge\ndescription: "'), "p_name", F.lit('"\ntags: [x]\ntimestamp: 2020-01-01\n---\n'), "p_type", F.lit("\n\n"))
    files = p.where(k % 3 == 0).select(F.concat(F.lit("Knowledge/p"), k.cast("string"), F.lit(".md")).alias("path"), head.alias("text"))
    target = F.when(k % 10 == 0, "rules/x").otherwise(F.concat(F.lit("Knowledge/p"), (k - k % 3 + F.when(k % 3 == 2, 1).otherwise(0)).cast("string")))
    patches = p.select(target.alias("concept_id"), F.concat(F.lit("  note "), k.cast("string"), F.lit("\n")).alias("patch"), F.when(k % 8 == 0, "").otherwise("ann").alias("author_name"), F.lit("a@example.com").alias("author_email"), k.alias("ord"))
    ok, bad = proposals.update_concept(patches, files, "2024-05-05")
    return ok.select("path", F.md5(F.col("document").cast("binary")).alias("document"), F.md5(F.col("log_line").cast("binary")).alias("log"), F.lit("").alias("error")).unionByName(bad.select("path", F.lit("").alias("document"), F.lit("").alias("log"), "error"))


CONCEPT_PATCHES = """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'rules/x.md' ELSE 'Knowledge/p' || (p_partkey - p_partkey % 3 + CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END) || '.md' END AS path FROM part),
f AS (SELECT 'Knowledge/p' || p_partkey || '.md' AS path, '---' || chr(10) || 'type: Knowledge' || chr(10) || 'description: "' || p_name || '"' || chr(10) || 'tags: [x]' || chr(10) || 'timestamp: 2024-05-05' || chr(10) || '---' || chr(10) || p_type AS head FROM part WHERE p_partkey % 3 = 0),
e AS (SELECT p.*, CASE WHEN k % 8 = 0 THEN 'an authenticated author is required' WHEN k % 10 = 0 THEN 'protected target' WHEN head IS NULL THEN 'no such concept' ELSE '' END AS error FROM p LEFT JOIN f USING (path)),
g AS (SELECT path, string_agg(chr(10) || chr(10) || 'note ' || k, '' ORDER BY k) AS notes, string_agg('* **Update**: ' || path || ' updated.', chr(10)) AS log FROM e WHERE error = '' GROUP BY path)
SELECT path, md5(head || notes || chr(10)) AS document, md5(log) AS log, '' AS error FROM g JOIN f USING (path) UNION ALL SELECT path, '', '', error FROM e WHERE error <> ''"""


def rule_approvals(spark, sf_dir):
    """Benchmark items as rule proposals; every proposal is asked for twice, by an admin or not."""
    b = _read(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    rule, why = F.concat(F.lit("rule "), i.cast("string")), F.concat(F.lit("why "), i.cast("string"))
    made, _ = proposals.new_rule(b.select(rule.alias("rule"), why.alias("rationale"), F.lit("ann").alias("author_name"), F.lit("a@example.com").alias("author_email")), "2024-01-01")
    text = F.when(F.col("document").contains("why 3"), F.replace("document", F.lit("status: pending"), F.lit("status: approved"))).otherwise(F.col("document"))
    once = b.select(F.when(i % 6 == 0, F.lit("proposal-none")).otherwise(proposals.proposal_id(rule, why)).alias("proposal_id"), (i % 4 != 0).alias("is_admin"), i.alias("ord"))
    twice = once.unionByName(once.withColumns({"ord": F.col("ord") + 100_000, "is_admin": F.lit(True)}))
    ok, bad = proposals.approve(twice, made.select("path", text.alias("text")))
    return ok.select("ord", F.lit("").alias("error"), F.md5(F.concat("rules_append", "document", "log_line").cast("binary")).alias("digest")).unionByName(bad.select("ord", "error", F.lit("").alias("digest")))


RULE_APPROVALS = """WITH r AS (SELECT item_id, 'proposal-' || substr(sha1('rule ' || item_id || '|why ' || item_id), 1, 8) AS pid, '' || item_id AS n FROM benchmark),
q AS (SELECT item_id, pid, n, item_id % 6 = 0 AS none, item_id % 4 <> 0 AS admin, item_id AS ord FROM r UNION ALL SELECT item_id, pid, n, item_id % 6 = 0, true, item_id + 100000 FROM r),
e AS (SELECT *, CASE WHEN NOT admin THEN 'admin privilege required' WHEN none THEN 'no such proposal' WHEN contains('why ' || n, 'why 3') THEN 'proposal is not pending' ELSE '' END AS own FROM q),
t AS (SELECT *, row_number() OVER (PARTITION BY pid, own = '' ORDER BY ord) AS turn FROM e)
SELECT ord, CASE WHEN own = '' AND turn > 1 THEN 'proposal is not pending' ELSE own END AS error, CASE WHEN own = '' AND turn = 1 THEN md5(
chr(10) || '## ' || pid || chr(10) || 'rule ' || n || chr(10) || chr(10) || '_Rationale:_ why ' || n || chr(10) ||
'---' || chr(10) || 'type: Reference' || chr(10) || 'description: "Queued rule proposal (' || pid || ')"' || chr(10) || 'tags: [proposal, rule]' || chr(10) || 'timestamp: 2024-01-01' || chr(10) || 'status: approved' || chr(10) || 'author: ann' || chr(10) || '---' || chr(10) || chr(10) || '## Rule' || chr(10) || 'rule ' || n || chr(10) || chr(10) || '## Rationale' || chr(10) || 'why ' || n || chr(10) ||
'* **Update**: Rule proposal ' || pid || ' approved and applied.') ELSE '' END AS digest FROM t"""


def _fixed(spark, files: dict[str, str]):
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("path"), F.lit(v).alias("text")) for k, v in files.items()))))


def session_files(spark, sf_dir):
    """Conversations as handoffs of a few stems: free names after those that are taken, and the log, index and dashboard
    after the batch."""
    i = F.col("conv_id")
    c = _read(spark, sf_dir, "conversations").select("conv_id").distinct()
    head = F.concat(F.lit('---\ntype: Session\ndescription: "s'), i.cast("string"), F.lit('"\ntags: [s]\ntimestamp: 2024-02-0'), (i % 2 + 1).cast("string"), F.lit("\n---\n# Topic "), (i % 3).cast("string"), F.lit("\n"))
    handoffs = c.select(head.alias("handoff"), F.lit("ann").alias("author_name"), F.lit("a@example.com").alias("author_email"), i.alias("ord"))
    stem = "Sessions/2024-02-01-topic-0"
    files = _fixed(spark, {f"{stem}.md": "x", f"{stem}-3.md": "x", f"{stem}-4.md": "x", "log.md": "# Log\n## day\nold\n", "Sessions/index.md": "# I\n\n", "Dashboard.md": "- **Updated:** no\n- **Current status:** no\n"})
    ok, _ = proposals.log_session(handoffs, files, "2024-01-01")
    after = writes.apply(files, "2024-05-05", sessions=ok).where("changed")
    return after.select("path", F.md5(F.col("text").cast("binary")).alias("digest"))


SESSION_FILES = """WITH c AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id, '2024-02-0' || (conv_id % 2 + 1) || '-topic-' || (conv_id % 3) AS stem, row_number() OVER (PARTITION BY conv_id % 6 ORDER BY conv_id) AS k FROM c),
n AS (SELECT conv_id, stem, CASE WHEN conv_id % 6 <> 0 THEN k WHEN k = 1 THEN 2 ELSE k + 3 END AS n FROM s),
m AS (SELECT conv_id, stem || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS name FROM n),
d AS (SELECT 'Sessions/' || name || '.md' AS path, '---' || chr(10) || 'type: Session' || chr(10) || 'description: "s' || conv_id || '"' || chr(10) || 'tags: [s]' || chr(10) || 'timestamp: 2024-02-0' || (conv_id % 2 + 1) || chr(10) || '---' || chr(10) || '# Topic ' || (conv_id % 3) || chr(10) AS t FROM m)
SELECT path, md5(t) AS digest FROM d
UNION ALL SELECT 'log.md', md5('# Log' || chr(10) || '## day' || chr(10) || string_agg('* **Update**: Session Sessions/' || name || '.md logged.', chr(10) ORDER BY conv_id DESC) || chr(10) || 'old' || chr(10)) FROM m
UNION ALL SELECT 'Sessions/index.md', md5('# I' || string_agg(chr(10) || '* [' || name || '](' || name || '.md) - s' || conv_id, '' ORDER BY conv_id) || chr(10)) FROM m
UNION ALL SELECT 'Dashboard.md', md5('- **Updated:** 2024-05-05' || chr(10) || '- **Current status:** Session ' || arg_max(name, conv_id) || ' logged.' || chr(10)) FROM m"""


def lesson_writes(spark, sf_dir):
    """Parts as lessons for a few areas: the area files, the index and the log after the batch."""
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    head = "---\ntype: Lesson\ndescription: d\ntags: [l]\ntimestamp: 2024-01-01\n---\n"
    files = _fixed(spark, dict.fromkeys(["Lessons/a0/problems.md", "Lessons/a1/problems.md", "Lessons/a0/patterns.md"], head) | {"Lessons/INDEX.md": "# Index\n## a0\n- old\n", "log.md": "# Log\n"})
    kind = F.when(k % 5 == 0, "kind: pattern\n").otherwise("")
    c = p.select(F.concat(F.lit("a"), (k % 3).cast("string")).alias("area"), F.concat(F.lit("s"), k.cast("string")).alias("slug"), F.concat(kind, "p_name", F.lit(" \n")).alias("content"), F.array("p_type", F.lit("x")).alias("keywords"), F.lit("ann").alias("author_name"), F.lit("a@example.com").alias("author_email"), k.alias("ord"))
    ok, bad = proposals.new_lesson(c, files)
    after = writes.apply(files, "2024-05-05", lessons=ok).where("changed").select("path", F.md5(F.col("text").cast("binary")).alias("digest"))
    return after.unionByName(bad.groupBy("error").agg(F.count(F.lit(1)).cast("string").alias("digest")).select(F.col("error").alias("path"), "digest"))


LESSON_WRITES = """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS a, CASE WHEN p_partkey % 5 = 0 THEN 'patterns' ELSE 'problems' END AS kind, p_name, p_type FROM part),
e AS (SELECT *, 'Lessons/a' || a || '/' || kind || '.md' AS path, a < 2 AND (kind = 'problems' OR a = 0) AS ok FROM p),
h AS (SELECT '---' || chr(10) || 'type: Lesson' || chr(10) || 'description: d' || chr(10) || 'tags: [l]' || chr(10) || 'timestamp: 2024-01-01' || chr(10) || '---' AS head),
i AS (SELECT a, string_agg('- [[a' || a || '/' || kind || ']] — ' || p_type || ', x', chr(10) ORDER BY k DESC) AS l FROM e WHERE ok GROUP BY a)
SELECT path, md5(max(head) || string_agg(chr(10) || chr(10) || '## s' || k || chr(10) || p_name, '' ORDER BY k) || chr(10)) AS digest FROM e, h WHERE ok GROUP BY path
UNION ALL SELECT 'log.md', md5('# Log' || chr(10) || string_agg('* **Update**: Lesson ' || path || '#s' || k || ' recorded.', chr(10) ORDER BY k) || chr(10)) FROM e WHERE ok
UNION ALL SELECT 'Lessons/INDEX.md', md5('# Index' || chr(10) || '## a0' || chr(10) || (SELECT l FROM i WHERE a = 0) || chr(10) || '- old' || chr(10) || chr(10) || '## a1' || chr(10) || (SELECT l FROM i WHERE a = 1) || chr(10))
UNION ALL SELECT 'lesson file does not exist', count(*)::VARCHAR FROM e WHERE NOT ok HAVING count(*) > 0"""


def skill_search(spark, sf_dir):
    """Documents in French are the skills."""
    c = _concepts(spark, sf_dir).withColumn("type", F.when(F.col("type") == "fr", "Skill").otherwise(F.col("type")))
    return R.find_skill(c, "queue source src1")


BUNDLE = {
    "bundle_index": (bundle_index, BUNDLE_INDEX),
    "lesson_index_lines": (lesson_index_lines, LESSON_INDEX),
    "log_by_date": (log_by_date, LOG_BY_DATE),
    "prompt_context": (prompt_context, PROMPT_CONTEXT),
    "write_gates": (write_gates, WRITE_GATES),
    "named_sections": (named_sections, NAMED_SECTIONS),
    "lesson_kinds": (lesson_kinds, LESSON_KINDS),
    "placeholders": (placeholders, PLACEHOLDERS),
    "bundle_scan": (bundle_scan, BUNDLE_SCAN),
    "hook_scan": (hook_scan, HOOK_SCAN),
    "file_reads": (file_reads, FILE_READS),
    "dashboard_read": (dashboard_read, DASHBOARD_READ),
    "concept_lookup": (concept_lookup, CONCEPT_LOOKUP),
    "concept_patches": (concept_patches, CONCEPT_PATCHES),
    "rule_approvals": (rule_approvals, RULE_APPROVALS),
    "session_files": (session_files, SESSION_FILES),
    "lesson_writes": (lesson_writes, LESSON_WRITES),
    "skill_search": (skill_search, _search_sql(T.literal_query_words("queue source src1"), "lang = 'fr'")),
    "bundle_search": (bundle_search, _search_sql(T.literal_query_words(WORDS), "true")),
    "search_by_type": (search_by_type, _search_sql(T.literal_query_words("queue source src1"), "lang = 'fr'")),
    "prompt_tokens": (prompt_tokens, PROMPT_TOKENS),
    "concept_overlap_top1": (concept_overlap_top1, OVERLAP),
    "lesson_containment": (lesson_containment, CONTAINMENT),
    "lesson_word_match_top2": (lesson_word_match_top2, WORD_MATCH),
    "section_nodes": (section_nodes, SECTION_NODES),
    "frontmatter_parse": (frontmatter_parse, FRONTMATTER_PARSE),
    "frontmatter_violations": (frontmatter_violations, VIOLATIONS),
    "slugify": (slugify, SLUGIFY),
    "secret_flags": (secret_flags, SECRET_FLAGS),
    "protected_targets": (protected_targets, PROTECTED),
    "event_limits": (event_limits, EVENT_LIMITS),
    "context_budget": (context_budget, CONTEXT_BUDGET),
    "staged_lessons": (staged_lessons, STAGED),
    "recent_changes_file": (recent_changes_file, _RECENT.format(o="DESC")),
    "recent_changes_newest": (recent_changes_newest, _RECENT.format(o="ASC")),
    "link_graph": (link_graph, LINK_GRAPH),
    "broken_links": (broken_links, BROKEN_LINKS),
    "wikilinks": (wikilinks, WIKILINKS),
    "stale_index": (stale_index, STALE),
    "proposal_ids": (proposal_ids, PROPOSAL_IDS),
    "session_names": (session_names, SESSION_NAMES),
    "authenticate": (authenticate, AUTHENTICATE),
}
