"""Text expressions: tokenizers, occurrence counts, slugs, frontmatter, sections. JVM-side columns only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .constants import HEADER_CHARS, STOP_WORDS

TOKEN = r"[a-z0-9_.-]+"
#: Line ends of Python's splitlines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def words(text: Column, longer_than: int) -> Column:
    """Lower-case tokens longer than a bound, without stop words, in order, repeats kept."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(tokens, lambda w: (F.length(w) > longer_than) & ~w.isin(*STOP_WORDS))


def query_words(text: Column) -> Column:
    """Search tokens: longer than 2, repeats kept (a repeated word counts twice)."""
    return words(text, 2)


def prompt_words(text: Column) -> Column:
    """Prompt tokens: longer than 3, each once."""
    return F.array_distinct(words(text, 3))


def literal_query_words(query: str | None) -> list[str]:
    """query_words of a constant, so that a search compiles to literals."""
    return [w for w in re.findall(TOKEN, (query or "").lower()) if len(w) > 2 and w not in STOP_WORDS]


def occurrences(hay: Column, word: str) -> Column:
    """How often a word stands in a text, substrings included, without overlap."""
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(word), F.lit("")))) / len(word)).cast("long")


def slug(text: Column) -> Column:
    """Lower case, other than a-z and 0-9 to single hyphens, none at the ends; 'untitled' if nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", "untitled").otherwise(s)


def lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def stripped(text: Column) -> Column:
    """Without white space at the ends, as Python's strip."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unquoted(text: Column) -> Column:
    """Without double quotes at the ends, then without single ones; all repeats."""
    return F.regexp_replace(F.regexp_replace(text, '^"+|"+$', ""), "^'+|'+$", "")


def inline_list(value: Column) -> Column:
    """[a, b] as an array; empty items go, quotes go, commas in quotes aren't special."""
    v = stripped(value)
    inner = F.when(v.startswith("[") & v.endswith("]"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(F.filter(F.split(inner, ","), lambda x: stripped(x) != ""), lambda x: unquoted(stripped(x)))


#: Line ends, and white space within a line, as pattern parts.
_NL = "(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029])"
_BLANK = "[\\s&&[^\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]]*"
_HEADER = rf"(?sU)\A---{_BLANK}{_NL}((?:.*?{_NL})??){_BLANK}---{_BLANK}(?:{_NL}|\z)"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _last_wins(entries: Column) -> Column:
    """A map of (k, v) structs; of one key the last."""

    def build(es):
        keys = F.array_distinct(F.transform(es, lambda e: e["k"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(es, lambda e: e["k"] == k), -1)["v"].alias("v"))))

    return let(entries, build)


def frontmatter(text: Column) -> Column:
    """Header keys and values as a map; later repeats win; an empty map without a closed header.

    tags stays the raw value with its quotes (inline_list() reads it); other values lose their quotes.
    """
    key = C.HEADER_KEY
    header = F.filter(F.split(F.regexp_extract(text, _HEADER, 1), LINE_END), lambda x: x.rlike(key))

    def entry(line):
        k, v = F.regexp_extract(line, key, 1), stripped(F.regexp_extract(line, key, 2))
        return F.struct(k.alias("k"), F.when(k == "tags", v).otherwise(unquoted(v)).alias("v"))

    return _last_wins(F.transform(header, entry))


def body(text: Column) -> Column:
    """The lines after a closed header, joined by line feeds; the text itself without one."""
    rest = F.substring(text, F.length(F.regexp_extract(text, _HEADER, 0)) + 1, F.length(text))
    joined = F.regexp_replace(F.regexp_replace(rest, LINE_END, "\n"), r"\n\z", "")
    return F.when(text.rlike(_HEADER), joined).otherwise(text)


def short_frontmatter(text: Column) -> Column:
    """The prompt hook's own header parser: first 800 characters, letters-only keys, non-empty values, double quotes only."""
    head = F.left(text, F.lit(HEADER_CHARS))
    # closes at the first line that starts with three hyphens
    block = F.regexp_extract(head, C.SHORT_HEADER, 1)
    key = C.SHORT_HEADER_KEY
    entries = F.transform(F.filter(lines(block), lambda x: x.rlike(key)), lambda x: F.struct(F.regexp_extract(x, key, 1).alias("k"), F.regexp_replace(stripped(F.regexp_extract(x, key, 2)), '^"+|"+$', "").alias("v")))
    return F.when(head.rlike(C.SHORT_HEADER), _last_wins(entries))


def sections(text: Column) -> Column:
    """Chunks that start with a level-two heading, stripped, in order."""
    return F.filter(F.transform(F.split(text, C.SECTION_START), stripped), lambda s: s.startswith("##"))


def section(text: Column, name: str) -> Column:
    """The text under '## name' up to the next level-two heading, stripped; '' without one."""
    return stripped(F.regexp_extract(text, C.SECTION_NAMED.replace("{name}", name), 1))


def concept_id(path: Column) -> Column:
    """A path or id as a normal id: forward slashes, none leading, ending in .md; null if it leaves the bundle."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    return F.when(~p.rlike(r"(^|/)\.\.(/|$)"), F.when(p.endswith(".md"), p).otherwise(F.concat(p, F.lit(".md"))))


def wikilinks(text: Column) -> Column:
    """Targets of [[target|alias]] links, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(C.WIKILINK), F.lit(1)), lambda t: F.trim(F.element_at(F.split(t, r"\|"), 1)))


def wikilinks_to_markdown(text: Column) -> Column:
    """[[target|alias]] as [alias](target.md), [[target]] as [target](target.md)."""
    return F.regexp_replace(F.regexp_replace(text, C.WIKILINK_ALIAS, "[$2]($1.md)"), C.WIKILINK_PLAIN, "[$1]($1.md)")


def placeholders(text: Column, values: dict[str, str]) -> Column:
    """{{NAME}} replaced by its value, for each name given."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(value))
    return text


def lesson_kind(text: Column) -> Column:
    """patterns if a line says 'kind: pattern', else problems; the first such line decides."""
    return F.when(F.lower(F.regexp_extract(text, C.LESSON_KIND, 1)).startswith("pattern"), "patterns").otherwise("problems")


def filled(form: str, *values: Column) -> Column:
    """A format of constants.py with its %s filled in."""
    first, *rest = form.split("%s")
    return F.concat(F.lit(first), *(x for v, r in zip(values, rest, strict=True) for x in (v, F.lit(r))))


def without_last_lines(text: Column) -> Column:
    """Without line feeds at the end."""
    return F.regexp_replace(text, r"\n+\z", "")


def with_line_end(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
