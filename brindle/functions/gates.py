"""Validation and secret gates as columns: a reason, or null where a text passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import concept_id, frontmatter, inline_list, let, lines, stripped


def violation(text: Column) -> Column:
    """Why a document's header isn't valid; the first failing key decides."""

    def judge(fm):
        out = F.lit(None).cast("string")
        for key in reversed(C.REQUIRED_KEYS):
            value = fm[key]
            blank = F.size(inline_list(F.coalesce(value, F.lit("")))) == 0 if key == "tags" else F.coalesce(stripped(value), F.lit("")) == ""
            out = F.when(blank, f"blank or missing '{key}'").otherwise(out)
        return F.when(F.size(fm) == 0, "missing frontmatter block").otherwise(out)

    return let(frontmatter(text), judge)


def conforms(text: Column) -> Column:
    """The weaker conformance rule: a header that parses and has a non-empty type."""
    return F.coalesce(F.length(stripped(frontmatter(text)["type"])) > 0, F.lit(False))


def secret_reason(text: Column, unicode: bool = True) -> Column:
    """The first kind of credential that a text carries. unicode: digit, space and word classes as in Python.

    Only a text with an address anywhere is split into lines, and only one with :// is looked through for credentials in it.
    """
    u = "(?U)" if unicode else ""
    on_line = text.rlike(u + C.IPV4) & F.exists(lines(text), lambda x: x.rlike(u + C.IPV4) & x.rlike(u + C.AUTH_WORD))
    return (
        F.when(text.rlike(u + C.SECRET_KEY), "assigned secret key name")
        .when(text.rlike(u + C.SECRET_PEM), "private key block")
        .when(F.contains(text, F.lit("://")) & text.rlike(u + C.SECRET_URL), "credentialed connection string")
        .when(on_line, "ip address paired with credential on one line")
    )


def protected(target: Column) -> Column:
    """Targets that only proposals change; ids with or without .md. A path out of the bundle is protected too."""
    cid = concept_id(target)
    return cid.isNull() | cid.isin("Dashboard.md", "PROTOCOL.md") | cid.startswith("rules/")


def event_violations(summary: Column, payload: Column, memory_refs: Column, evidence_refs: Column) -> Column:
    """Size limits that an event breaks."""
    found = F.array(
        F.when(F.length(summary) > C.SUMMARY_CHARS, F.lit("summary")),
        F.when(F.octet_length(payload) > C.PAYLOAD_BYTES, F.lit("payload")),
        F.when(F.size(memory_refs) > C.MEMORY_REFS, F.lit("memory_refs")),
        F.when(F.size(evidence_refs) > C.EVIDENCE_REFS, F.lit("evidence_refs")),
    )
    return F.filter(found, lambda x: x.isNotNull())
