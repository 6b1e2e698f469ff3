"""SQL texts with the meaning of the rule tables, for a second engine to check results with."""

from __future__ import annotations

from ..functions import lexicons as L
from ..functions import text as T


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(words: list[str], col: str) -> str:
    return "(" + " OR ".join(f"contains({col}, {quote(w)})" for w in words) + ")"


def how_many_of(words: list[str], col: str) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {quote(w)}) AS INTEGER)" for w in words) + ")"


def found(pattern: str, col: str) -> str:
    return f"regexp_matches({col}, {quote(pattern)})"


def count(pattern: str, col: str) -> str:
    return f"len(regexp_extract_all({col}, {quote(pattern)}))"


def ladder(steps: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {quote(name)}" for cond, name in steps) + f" ELSE {quote(rest)} END"


MESSAGES = "m AS (SELECT conv_id AS session_id, turn AS idx, role, text AS content, lower(text) AS low, regexp_split_to_array(lower(text), '\\s+') AS ws, length(text) AS size FROM conversations)"


#: A word three times in a row, without back-references: the end of one word, the next word, the beginning of the one after.
REPEATED = r"len(list_filter(range(1, len(ws) - 1), lambda i: length(regexp_extract(ws[i], '(\w{2,20})$', 1)) > 0 AND ws[i + 1] = regexp_extract(ws[i], '(\w{2,20})$', 1) AND starts_with(ws[i + 2], ws[i + 1]))) > 0"


def features() -> str:
    """CTEs m (messages) and f (features of each)."""
    p = L.PATTERNS
    counts = ", ".join(f"{count(T.alternation(words), 'low')} AS n_{k}" for k, (_, words) in L.SIGNALS.items())
    score = " + ".join(f"{w} * n_{k}" for k, (w, _) in L.SIGNALS.items())
    letters = r"length(regexp_replace(content, '[^\p{L}]', '', 'g'))"
    flags = ", ".join(f"role = 'assistant' AND {found('(?i)' + pattern, quote(' ') + ' || content' if thinks else 'content')} AS {k}" for k, (thinks, _, pattern) in L.BEHAVIOR.items())
    protocol = "CASE WHEN trim(regexp_replace(content, '\\s+', ' ', 'g')) = '' THEN 'empty_wrapper' " + " ".join(f"WHEN {found(f'(?s)<{t}>.*?</{t}>', 'content')} THEN {quote(t.replace('-', '_'))}" for t in L.PROTOCOL_TAGS)
    protocol += f" WHEN {any_of(L.CONTINUATION, 'content')} THEN 'clear_continuation' WHEN contains(content, {quote(L.SKILL[0])}) AND contains(content, {quote(L.SKILL[1])}) THEN 'skill_injection' WHEN {any_of(L.RELAY, 'content')} THEN 'subagent_relay' END"
    return f"""{MESSAGES},
c AS (SELECT *, {counts}, CASE WHEN {letters} > 0 THEN length(regexp_replace(content, '[^\\p{{Lu}}]', '', 'g')) / {letters} ELSE 0.0 END AS caps, length(content) - length(replace(content, '!', '')) AS exclamations,
 length(content) - length(replace(content, '?', '')) AS questions, {found(p['profanity'], 'content')} AS profanity, {found(p['error'], 'content')} AS has_error, {found(p['traceback'], 'content')} AS traceback, contains(content, '```') AS code_block,
 {protocol} AS protocol_type, {flags} FROM m),
s AS (SELECT *, {score} + CASE WHEN size >= 500 THEN 3 WHEN size >= 200 THEN 1 ELSE 0 END AS raw_score, ({found(L.EMERGENCY, 'content')} AND (caps > 0.4 OR exclamations >= 2)) OR {REPEATED} AS emergency,
 protocol_type IS NULL AND n_frustration + n_failure + n_pivot + n_architecture + n_code + n_breakthrough + n_plan > 0 AND (
  (role = 'assistant' AND {how_many_of(L.ANALYSIS_WORDS, 'low')} >= 2 AND size > 500) OR ((n_failure > 20 OR n_frustration > 10) AND size > 1000) OR (n_failure >= 3 AND n_architecture >= 3 AND size > 500)
  OR (role = 'assistant' AND (n_failure >= 1 OR n_frustration >= 1) AND {how_many_of(L.POSITIVE_WORDS, 'low')} >= 2 AND size > 300)) AS content_referential FROM c),
f AS (SELECT *, has_error AND protocol_type IS NULL AND NOT (content_referential OR size > 500) AS error, CASE WHEN protocol_type IS NOT NULL THEN 0 ELSE raw_score END AS filter_score,
 CASE WHEN protocol_type IS NOT NULL THEN 1 WHEN size < 50 AND raw_score = 0 THEN 1 WHEN size >= 500 OR raw_score >= 6 THEN 4 WHEN size >= 100 OR raw_score >= 3 THEN 3 WHEN raw_score >= 1 THEN 2 ELSE 1 END AS filter_tier FROM s)"""


def tag_columns() -> str:
    """The four tags over f."""
    a = {k: any_of(v, "low") for k, v in L.ACTION.items()}
    e = {k: any_of(v, "low") for k, v in L.EMOTION.items()}
    i = {k: any_of(v, "low") for k, v in L.INTENT.items()}
    p = L.PATTERNS
    creates = f"({found(p['create_1'], 'content')} OR {found(p['create_2'], 'content')})"
    edits = f"({found(p['edit'], 'content')} OR {found(p['edit_in'], 'content')})"
    action = ladder([
        (a["reverted"], "reverted"), (f"{a['abandoned']} OR n_pivot >= 3", "abandoned"), (f"{a['decided']} OR (n_pivot >= 1 AND n_plan >= 1)", "decided"), (a["discovered"], "discovered"), (f"error OR traceback OR n_failure >= 2 OR {a['debugged']}", "debugged"), (a["refactored"], "refactored"),
        (f"(code_block AND {creates}) OR ({a['created']} AND (code_block OR n_code >= 10))", "created"), (f"{edits} OR {a['modified']}", "modified"), ("n_architecture >= 4 AND n_code >= 10", "created"), ("n_code >= 5", "modified"), ("role = 'user' AND questions >= 2", "discovered"), ("role = 'user'", "decided"), ("n_architecture >= 2 OR n_plan >= 2", "discovered"),
    ], "modified")
    confidence = ladder([*((any_of(v, "low"), k) for k, v in L.CONFIDENCE.items()), ("overconfident", "working"), ("confusion OR assumptions", "tentative"), ("error OR n_failure >= 2", "fragile"), ("n_code >= 15", "working")], "tentative")
    emotion = ladder([
        ("profanity OR emergency OR caps > 0.5 OR n_frustration >= 3", "frustrated"), (f"(exclamations >= 2 AND {e['excited']}) OR (contains(low, 'love') AND role = 'user')", "excited"), (f"{e['relieved']} AND NOT profanity", "relieved"), (f"{e['confident']} OR overconfident", "confident"), (e["cautious"], "cautious"),
        (f"(questions >= 3 AND role = 'user') OR {e['uncertain']} OR confusion", "uncertain"), (f"{e['curious']} OR (n_architecture >= 3 AND NOT profanity)", "curious"), ("role = 'user' AND caps > 0.15", "frustrated"), ("role = 'user' AND questions >= 1", "curious"),
    ], "confident")
    intent = ladder([
        (f"error OR traceback OR n_failure >= 3 OR ({i['bugfix']} AND NOT {i['not_bugfix']})", "bugfix"), (i["cleanup"], "cleanup"), (f"{i['exploration']} OR n_architecture >= 4", "exploration"), (i["correctness"], "correctness"), (i["maintainability"], "maintainability"), (i["performance"], "performance"), (f"{i['feature']} OR n_plan >= 3 OR n_code >= 10", "feature"),
    ], "exploration")
    return f"{action} AS action_vector, {confidence} AS confidence_signal, {emotion} AS emotional_tenor, {intent} AS intent_marker"


