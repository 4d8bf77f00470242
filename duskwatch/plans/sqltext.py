"""SQL fragments of the rules, for the expected-result queries."""

from __future__ import annotations

from duskwatch.functions import rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return ", ".join(quoted(v) for v in values)


def norm(c: str) -> str:
    return f"lower(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '^\\s+|\\s+$', '', 'g'))"


def joined(*cols: str) -> str:
    return "lower(" + " || ' ' || ".join(f"coalesce({c}, '')" for c in cols) + ")"


def keyword_case(text: str, keyword_rules, default: str) -> str:
    arms = []
    for name, words in keyword_rules:
        cond = " OR ".join(f"contains({text}, {quoted(w)})" for w in words)
        arms.append(f"WHEN {cond} THEN {quoted(name)}")
    return f"CASE {' '.join(arms)} ELSE {quoted(default)} END"


def activity(title: str = "title", description: str = "description") -> str:
    return keyword_case(f"(' ' || {joined(title, description)} || ' ')", rules.ACTIVITY_RULES, rules.ACTIVITY_DEFAULT)


def attack(title: str = "title", description: str = "description") -> str:
    return keyword_case(joined(title, description), rules.ATTACK_RULES, rules.ATTACK_DEFAULT)


def severity_rank(c: str) -> str:
    arms = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(rules.SEVERITIES))
    return f"CASE {norm(c)} {arms} ELSE 99 END"
