"""Weights, thresholds and vocabularies of the bundle engine."""

# ---- fixed values: they must be these for right results ----
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "into", "your")
RESERVED_FILES = ("index.md", "INDEX.md", "log.md", "Dashboard.md")
SKIPPED_TYPES = ("Hub", "Dashboard", "Template", "Reference", "Task Board", "Session")
FRONTMATTER_WEIGHT = 3
REQUIRED_KEYS = ("type", "description", "tags", "timestamp")
MAX_LESSONS, MAX_CONCEPTS, MIN_OVERLAP = 2, 1, 2
LESSON_CHARS, CONCEPT_CHARS, CONTEXT_CHARS, HEADER_CHARS = 4000, 2500, 6000, 800
SUMMARY_CHARS, PAYLOAD_BYTES, MEMORY_REFS, EVIDENCE_REFS = 280, 2048, 8, 5

SECRET_KEY = r"(?i)\b(passwd|password|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key)\b\s*[:=]\s*\S"
SECRET_PEM = r"(?i)BEGIN[ A-Z0-9]*PRIVATE KEY"
SECRET_URL = r"(?i)\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@"
IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
AUTH_WORD = r"(?i)\b(password|passwd|pass|pwd|secret|token|apikey|api_key|key|auth|credential|login)\b"

ACTIVATION = {
    "base_activation": 0.04,
    "semantic_similarity": 0.25,
    "tag_match": 0.10,
    "description_match": 0.10,
    "explicit_link_signal": 0.13,
    "project_context_signal": 0.15,
    "recency_signal": 0.05,
    "coactivation_signal": 0.06,
    "reliability_signal": 0.08,
    "novelty_signal": 0.04,
    "contradiction_inhibition": -0.40,
    "project_mismatch": -0.35,
    "deprecated_penalty": -0.60,
    "token_cost_penalty": -0.15,
    "refractory_penalty": -0.40,
}
LEVELS = ((0.35, "ignore"), (0.50, "index_only"), (0.65, "frontmatter"), (0.78, "matching_section"), (0.88, "adjacent_sections"))
TOP_LEVEL = "full_concept"
SALIENCE = {
    "goal_relevance": 0.25,
    "novelty": 0.10,
    "prediction_error": 0.20,
    "threat": 0.15,
    "user_emphasis": 0.15,
    "unresolved_conflict": 0.10,
    "expected_information_gain": 0.05,
    "repetition": -0.10,
    "low_impact": -0.10,
}
GOAL = {
    "source_authority": 0.25,
    "expected_impact": 0.20,
    "urgency": 0.12,
    "dependency_unlock": 0.12,
    "commitment_strength": 0.10,
    "information_value": 0.06,
    "cost": -0.05,
    "risk": -0.07,
    "conflict_penalty": -0.15,
}
AUTHORITY = {"constitution": 1.00, "user_request": 0.95, "user_project": 0.85, "active_task": 0.65, "model_goal": 0.40, "exploration": 0.20}
DECISION = {
    "goal_progress": 0.24,
    "expected_utility": 0.14,
    "information_gain": 0.10,
    "reversibility": 0.10,
    "user_alignment": 0.14,
    "identity_consistency": 0.08,
    "confidence_adjusted_success": 0.10,
    "resource_cost": -0.06,
    "risk": -0.12,
    "irreversible_damage": -0.20,
    "uncertainty_penalty": -0.08,
    "policy_violation": -1.00,
}
#: risk, information gain, reversibility; where the policy gives no factor, 1.00.
RISK_MODES = {"exploration": (0.75, 1.40, 1.10), "standard": (1.00, 1.00, 1.00), "production": (1.50, 0.80, 1.40), "high_stakes": (2.00, 1.00, 1.75)}
REWARD = {"goal_progress": 0.30, "accuracy": 0.25, "information_gain": 0.10, "user_feedback": 0.15, "resource_efficiency": 0.10, "policy_compliance": 0.10, "harm": -0.25}
OUTCOME_REWARD = {
    "test_passed": 0.80,
    "verifier_passed": 0.85,
    "user_confirmed": 0.75,
    "plausible_unverified": 0.20,
    "user_correction": -0.55,
    "test_failed": -0.80,
    "rollback": -0.90,
    "policy_violation": -1.00,
}
ELIGIBILITY = {"direct_used_in_action": 1.00, "influenced_decision": 0.80, "used_in_verification": 0.65, "background_context_only": 0.15, "not_used": 0.00}
INDEPENDENCE = {"same_tool_output": 0.10, "same_session": 0.30, "same_day": 0.50, "other_session": 0.75, "independent": 1.00}
POSITIVE_RATE, NEGATIVE_RATE, MIN_ELIGIBILITY, WEIGHT_MAX = 0.10, 0.14, 0.30, 0.95
SUPPRESS_FAILURES, SUPPRESS_CONTRADICTION, PRUNE_WEIGHT, PRUNE_DAYS = 2, 0.80, 0.10, 90
ATTENTION_LOW, ATTENTION_HIGH, ERROR_FLAG = 0.25, 0.55, 0.25
CONFIDENCE = ((0.25, "weak speculation"), (0.50, "plausible, unverified"), (0.70, "moderate confidence"), (0.85, "strong evidence"), (0.95, "multiple confirmations"))
CONFIDENCE_TOP = "direct, repeated, reliable"
LEVEL_QUOTA = {("index_only",): 12, ("frontmatter",): 6, ("matching_section", "adjacent_sections"): 4, ("full_concept",): 1}
TYPE_QUOTA = {"session": 2, "lesson": 4, "skill": 2, "knowledge": 3, "project": 2}
GOAL_STEPS = (
    ("proposed", "authorized"),
    ("authorized", "active"),
    ("active", "blocked"),
    ("active", "suspended"),
    ("active", "achieved"),
    ("blocked", "active"),
    ("suspended", "active"),
    ("blocked", "achieved"),
    ("suspended", "achieved"),
    ("achieved", "verified"),
    ("verified", "archived"),
    ("verified", "cancelled"),
)
BUDGET_SPLIT = {
    "perception": (20, 15, 10, 8, 8),
    "retrieval": (0, 10, 20, 20, 18),
    "workspace": (30, 20, 15, 12, 12),
    "simulation": (0, 0, 10, 22, 18),
    "planning": (10, 15, 15, 18, 16),
    "verification": (10, 15, 15, 15, 23),
    "response": (30, 25, 15, 5, 5),
}
INITIAL_WEIGHT = {"same_session": 0.10, "model_inferred": 0.20, "one_verified_task": 0.40, "two_verified_tasks": 0.65, "three_confirmations": 0.80, "strong_repeated": 0.90}
EPISTEMIC = ("observed", "inferred", "predicted", "imagined", "desired", "counterfactual", "unknown")
#: Header lines of the full and of the short parser, named sections, links, lesson kinds, index and log lines.
HEADER_KEY, SHORT_HEADER_KEY, SHORT_HEADER = r"^([A-Za-z_][\w-]*):\s*(.*)$", r"^([A-Za-z_]+):\s*(.+)$", r"(?s)\A---\n(.*?)\n---"
SECTION_START, SECTION_NAMED = r"(?m)^(?=##\s)", r"(?ms)^##\s+\Q{name}\E\s*\n(.*?)(?=^##\s|\z)"
WIKILINK, WIKILINK_ALIAS, WIKILINK_PLAIN = r"\[\[([^\]]+)\]\]", r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"\[\[([^\]|]+)\]\]"
LESSON_KIND, LESSON_KIND_LINE = r"(?im)^\s*kind\s*:\s*(problems?|patterns?)", r"(?im)^\s*kind\s*:\s*(problems?|patterns?)\s*$\n?"
INDEX_LINE, FIELD_LINE, LOG_LINE = r"\[\[([^\]]+)\]\]\s*[—-]+\s*(.+)$", r"^-\s*\*\*([^*]+):\*\*\s*(.*)$", r"^\*\s*\*\*([^*]+)\*\*:\s*(.*)$"
#: Documents and log lines of writes; %s stands for what they name.
SKILL_HEADER = '---\ntype: Skill\ndescription: "%s"\ntags: [skill]\ntimestamp: %s\n---\n\n# %s\n\n'
PROPOSAL_HEADER = '---\ntype: Reference\ndescription: "Queued rule proposal (%s)"\ntags: [proposal, rule]\ntimestamp: %s\nstatus: pending\nauthor: %s\n---\n\n## Rule\n%s\n\n## Rationale\n%s\n'
RULE_ADDED = "\n## %s\n%s\n\n_Rationale:_ %s\n"
LOG_LESSON, LOG_SKILL, LOG_CONCEPT = "* **Update**: Lesson %s#%s recorded.", "* **Creation**: Skill %s added.", "* **Update**: %s updated."
LOG_SESSION, LOG_APPROVED, NOTE_SESSION = "* **Update**: Session %s logged.", "* **Update**: Rule proposal %s approved and applied.", "Session %s logged."
DASHBOARD_FIELDS = ("Updated", "Current status")
HYPOTHESIS_STEPS = (("Proposed", "Testing"), ("Testing", "Confirmed"), ("Testing", "Refuted"))
WORKSPACE_LIMITS = {"primary_goals": 1, "secondary_goals": 2, "hypotheses": 3, "constraints": 3, "risks": 2, "plan_steps": 5, "memory_refs": 8}
ASSEMBLY_NODES = 8
# ---- end of fixed values ----
