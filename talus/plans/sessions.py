"""Queries of session selection, synthesis and dossiers over the driver's tables, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dossier, sessions, synthesis
from ..operators import messages as M
from ..operators import normalize as N
from . import oracle as S
from .queries import enriched, messages, query, read, tagged

COUNTS = "count(*) AS total_messages, count_if(role = 'user') AS user_messages, count_if(role = 'assistant') AS assistant_messages"


@query(
    f"""WITH {S.features()}, w AS (SELECT session_id, idx, CASE WHEN filter_tier = 4 THEN 'tier' WHEN role = 'user' AND filter_tier >= 2 THEN 'user'
WHEN role = 'user' AND protocol_type IS NULL AND (exclamations >= 5 OR caps > 0.3) THEN 'intense' END AS why FROM f)
SELECT session_id, idx, why FROM w WHERE why IS NOT NULL"""
)
def selected_messages(spark, d):
    return sessions.selected(enriched(spark, d)).select("session_id", "idx", "why")


@query(f"WITH {S.features()} SELECT session_id, idx AS i, role AS r, content AS c, CAST(size AS INTEGER) AS cl, filter_tier AS t, protocol_type IS NOT NULL AS is_protocol, content_referential AS content_ref FROM f")
def condensed_messages(spark, d):
    return sessions.condensed(enriched(spark, d)).select("session_id", "i", "r", "c", "cl", "t", "is_protocol", "content_ref")


@query(f"WITH {S.features()} SELECT session_id, idx, role, filter_tier, CASE WHEN filter_tier = 4 THEN substr(content, 1, 80) ELSE content END AS content FROM f WHERE filter_tier >= 2")
def tier_previews(spark, d):
    e = enriched(spark, d)
    previews = e.where("filter_tier = 4").select("session_id", "idx", F.substring("content", 1, 80).alias("preview"))
    return sessions.with_previews(e, previews).select("session_id", "idx", "role", "filter_tier", "content")


@query(
    """WITH s AS (SELECT conv_id AS session_id, count(*) AS total_messages, count(DISTINCT role) FILTER (role IN ('user', 'system')) AS kinds, max(length(text)) AS longest FROM conversations GROUP BY conv_id)
SELECT session_id, total_messages FROM s WHERE total_messages >= 5 AND kinds = 2 AND longest < 3000"""
)
def eligible_sessions(spark, d):
    """Sessions of five messages with a user's and a system's, but for those with a very long one."""
    m = messages(spark, d)
    stats = m.groupBy("session_id").agg(F.count("*").alias("total_messages"))
    done = m.where("length(content) >= 3000").select("session_id").distinct()
    return sessions.eligible(stats, m.select("session_id", F.col("role").alias("file")), ["user", "system"], 5, done)


@query(
    """WITH n AS (SELECT md5(CAST(o_custkey AS VARCHAR)) AS uuid, o_orderkey % 3 = 0 AS prefixed, CASE WHEN o_orderkey % 2 = 0 THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) ELSE substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) END AS prefix FROM orders),
k AS (SELECT uuid FROM n GROUP BY uuid HAVING count(*) > 1)
SELECT DISTINCT prefix AS short FROM n JOIN k USING (uuid) WHERE prefixed AND prefix <> substr(uuid, 1, 8)"""
)
def duplicate_sessions(spark, d):
    """An order is a file, named by its customer's id, one in three with a prefix."""
    o = read(spark, d, "orders")
    uuid, own = F.md5(F.col("o_custkey").cast("string").cast("binary")), F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    prefix = F.substring(F.when(F.col("o_orderkey") % 2 == 0, own).otherwise(uuid), 1, 8)
    name = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.concat(prefix, F.lit("_"))).otherwise(""), uuid, F.lit(".jsonl"))
    return sessions.duplicates(o.select(name.alias("name")))


@query("SELECT user_id AS session_id, max(ts) AS modified FROM events GROUP BY user_id ORDER BY modified DESC, session_id LIMIT 25")
def recent_sessions(spark, d):
    seen = read(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("modified"))
    return sessions.recent(seen, 25)


@query("SELECT user_id AS session_id, event_id AS idx, event_type FROM events ORDER BY ts, user_id, event_id LIMIT 200")
def chronological_messages(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("idx"), "ts", "event_type")
    return sessions.chronological(e, 200).select("session_id", "idx", "event_type")


@query(
    """WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'processed' ELSE 'pending' END AS state FROM events WHERE event_type IN ('click', 'purchase', 'view')),
l AS (SELECT user_id, arg_max(state, (ts, list_position(['pending', 'in_progress', 'processed'], state))) AS state FROM s GROUP BY user_id)
SELECT u.user_id AS file, coalesce(l.state, 'pending') AS state FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l USING (user_id)"""
)
def file_ledger(spark, d):
    """A user is a file, whose clicks and purchases move it on."""
    e = read(spark, d, "events")
    state = F.when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "purchase", "processed").otherwise("pending")
    marks = e.where("event_type in ('click', 'purchase', 'view')").select(F.col("user_id").alias("file"), state.alias("state"), F.col("ts").alias("at"))
    return sessions.ledger(e.select(F.col("user_id").alias("file")), marks)


@query("SELECT r_regionkey AS run_id, count(n_name) AS files, CAST(coalesce(sum(length(n_name)), 0) AS BIGINT) AS bytes, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def run_manifests(spark, d):
    runs = read(spark, d, "region").select(F.col("r_regionkey").alias("run_id"))
    files = read(spark, d, "nation").select(F.col("n_regionkey").alias("run_id"), F.col("n_name").alias("name"), F.length("n_name").cast("long").alias("bytes"), F.sha2("n_name", 256).alias("sha256"))
    names = F.array_join(F.transform(F.coalesce("listing", F.array().cast("array<struct<name:string,bytes:bigint,sha256:string>>")), lambda x: x["name"]), ",")
    return sessions.archived(runs, files).select("run_id", "files", "bytes", names.alias("names"))


def _stats(spark, d):
    """What synthesis reads of a session; characters stand for tokens, words of over 11 letters for files."""
    e = enriched(spark, d)
    words = F.size(F.array_distinct(F.filter(F.split("content", r"\s+"), lambda w: F.length(w) > 11)))
    more = e.groupBy("session_id").agg(F.sum(F.when(F.col("role") == "user", F.col("content_length")).otherwise(0)).alias("input_tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("content_length")).otherwise(0)).alias("output_tokens"), F.max(words).alias("files"))
    own = M.session_stats(e).select("session_id", "total_messages", "user_messages", "assistant_messages", "tier_1", "errors", F.size("frustration_peaks").alias("peaks"))
    return own.join(more, "session_id")


def _found(spark, d):
    e = enriched(spark, d)
    facts = e.select("session_id", F.col("idx").alias("position"), "filter_score", F.col("content").alias("preview"), F.when(F.col("role") == "assistant", F.lit("answered")).alias("action"))
    arcs = e.where("role = 'system'").select("session_id", F.col("idx").alias("position"), F.substring("content", 1, 60).alias("arc"), F.substring("content", 61, 60).alias("goal"))
    notes = e.where("role = 'assistant'").select("session_id", F.col("idx").alias("position"), F.when(F.col("idx") % 2 == 0, F.lit("Note")).alias("title"), F.col("content").alias("detail"))
    graph = e.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("nodes"), F.count_if(F.col("role") == "assistant").alias("edges"))
    words = e.select("session_id", F.explode(F.split("content", r"\s+")).alias("file")).where("length(file) > 11")
    top = words.groupBy("session_id", "file").agg(F.count("*").alias("n"))
    return facts, arcs, notes, graph, top


_FOUND = f"""{S.features()},
st AS (SELECT session_id, {COUNTS}, count_if(filter_tier = 1) AS tier_1, count_if(error) AS errors, count_if(protocol_type IS NULL AND role = 'user' AND (caps > 0.3 OR (profanity AND protocol_type IS NULL) OR exclamations >= 5)) AS peaks,
 sum(CASE WHEN role = 'user' THEN size ELSE 0 END) AS it, sum(CASE WHEN role = 'assistant' THEN size ELSE 0 END) AS ot, max(len(list_distinct(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: length(w) > 11)))) AS files FROM f GROUP BY session_id),
tf AS (SELECT session_id, w AS file, count(*) AS n FROM (SELECT session_id, unnest(regexp_split_to_array(content, '\\s+')) AS w FROM f) WHERE length(w) > 11 GROUP BY ALL),
tk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, file) AS rank FROM tf),
p1 AS (SELECT session_id, idx AS position, substr(content, 1, 200) AS title, CASE WHEN role = 'assistant' THEN 'answered' ELSE 'processed' END AS description FROM f WHERE filter_score >= 3),
p2 AS (SELECT session_id, 0 AS position, 'Frustration Events' AS title, peaks || ' frustration peaks detected across ' || total_messages || ' messages' AS description FROM st WHERE peaks > 0
 UNION ALL SELECT session_id, 1, 'Tool-Heavy Session', printf('%.0f', tier_1 * 100.0 / total_messages) || '% of messages are tier-1 tool operations with no visible text content' FROM st WHERE tier_1 * 100.0 / total_messages > 80),
p3 AS (SELECT session_id, idx AS position, substr(content, 1, 60) AS title, substr(content, 61, 60) AS description FROM f WHERE role = 'system' AND content <> ''),
p4 AS (SELECT session_id, idx AS position, CASE WHEN idx % 2 = 0 THEN 'Note' ELSE 'Explorer Observation' END AS title, substr(content, 1, 300) AS description
 FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS k FROM f WHERE role = 'assistant' AND ((idx % 2 = 0 AND content <> '') OR length(content) > 30)) WHERE k <= 4),
p5 AS (SELECT session_id, 0 AS position, 'Idea Flow' AS title, user_messages || ' ideas connected by ' || assistant_messages || ' transitions in this session' AS description FROM st WHERE user_messages > 1),
q AS (
 SELECT 1 AS pass, 'F' AS letter, * FROM p1 UNION ALL SELECT 1, 'F', session_id, 0, 'Session completed', 'Session with ' || total_messages || ' messages processed' FROM st WHERE session_id NOT IN (SELECT session_id FROM p1)
 UNION ALL SELECT 2, 'P', * FROM p2 UNION ALL SELECT 2, 'P', session_id, 0, 'Session Structure', 'Session with ' || user_messages || ' user messages and ' || assistant_messages || ' assistant messages' FROM st WHERE session_id NOT IN (SELECT session_id FROM p2)
 UNION ALL SELECT 3, 'V', * FROM p3 UNION ALL SELECT 3, 'V', session_id, 0, 'Single-Task Execution', 'Session focused on a single primary objective across ' || total_messages || ' messages' FROM st WHERE session_id NOT IN (SELECT session_id FROM p3)
 UNION ALL SELECT 4, 'C', * FROM p4 UNION ALL SELECT 4, 'C', session_id, 0, 'Session Character', 'A ' || total_messages || '-message session with ' || files || ' files referenced' FROM st WHERE session_id NOT IN (SELECT session_id FROM p4)
 UNION ALL SELECT 5, 'W', * FROM p5 UNION ALL SELECT 5, 'W', session_id, 0, 'Token Economy', 'Input: ' || format('{{:,}}', CAST(it AS BIGINT)) || ' tokens, Output: ' || format('{{:,}}', CAST(ot AS BIGINT)) || ' tokens' FROM st WHERE session_id NOT IN (SELECT session_id FROM p5)
 UNION ALL SELECT 6, 'G', session_id, rank, file, 'Referenced ' || n || ' times in this session.' FROM tk WHERE rank <= 5
 UNION ALL SELECT 6, 'G', session_id, 1000000, 'error_handling', errors || ' errors occurred during this session.' FROM st WHERE errors > 0
 UNION ALL SELECT 6, 'G', session_id, 2000000, 'Input/output token ratio', CAST(CAST(round_even(it / greatest(ot, 1), 0) AS BIGINT) AS VARCHAR) || ':1' FROM st),
fi AS (SELECT session_id, CAST(pass AS INTEGER) AS pass, printf('%s%02d', letter, row_number() OVER (PARTITION BY session_id, pass ORDER BY position, title, description)) AS id, title, description FROM q)"""


@query(f"WITH {_FOUND} SELECT * FROM fi")
def session_passes(spark, d):
    facts, arcs, notes, graph, top = _found(spark, d)
    return synthesis.passes(_stats(spark, d), facts, arcs, notes, graph, top)


@query(
    f"""WITH {_FOUND},
pk AS (SELECT session_id, idx, caps, profanity, content, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS rank FROM f WHERE protocol_type IS NULL AND role = 'user' AND exclamations >= 1),
nd AS (SELECT session_id, substr(content, 1, 30) AS label, content, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS rank FROM f WHERE role = 'user'),
sw AS (SELECT session_id, file, row_number() OVER (PARTITION BY session_id ORDER BY n, file) AS rank FROM tf),
mk AS (
 SELECT tk.session_id, 0 AS section, rank, 'file_activity' AS type, file AS target, 'SESSION:' || tk.session_id || ' - Referenced ' || n || ' times' AS marker, 'This file was actively discussed/modified during session ' || tk.session_id || ' (' || total_messages || ' messages)' AS context FROM tk JOIN st USING (session_id) WHERE rank <= 10
 UNION ALL SELECT session_id, 1, rank, 'frustration_event', NULL, printf('FRUSTRATION at msg %s: caps_ratio=%.2f, profanity=%s', CAST(idx AS VARCHAR), CAST(caps AS DOUBLE), CASE WHEN profanity THEN 'True' ELSE 'False' END), substr(content, 1, 150) FROM pk WHERE rank <= 5
 UNION ALL SELECT session_id, 2, rank, 'idea_marker', NULL, 'IDEA: ' || label, substr(content, 1, 200) FROM nd WHERE rank <= 10
 UNION ALL SELECT session_id, 3, rank, 'modification_event', file, 'MODIFIED in session ' || session_id, 'File was modified during this session' FROM sw WHERE rank <= 5
 UNION ALL SELECT session_id, 6, 1, 'warning', title, 'WARNING: ' || substr(description, 1, 100), 'error_count' FROM fi WHERE pass = 6 AND title = 'error_handling'
 UNION ALL SELECT session_id, 7, 1, 'session_metadata', NULL, 'SESSION PROFILE: ' || total_messages || ' msgs, ' || format('{{:,}}', CAST(it AS BIGINT)) || ' input tokens, ' || format('{{:,}}', CAST(ot AS BIGINT)) || ' output tokens', 'Tier 1 messages: ' || tier_1 FROM st)
SELECT session_id, printf('M%03d', row_number() OVER (PARTITION BY session_id ORDER BY section, rank, marker)) AS id, type, target, marker, context FROM mk"""
)
def session_markers(spark, d):
    facts, arcs, notes, graph, top = _found(spark, d)
    stats, e = _stats(spark, d), enriched(spark, d)
    peaks = e.where("not is_protocol and role = 'user' and exclamations >= 1").select("session_id", "idx", "caps_ratio", "profanity", F.col("content").alias("preview"))
    nodes = e.where("role = 'user'").select("session_id", F.col("idx").alias("position"), F.substring("content", 1, 30).alias("label"), F.col("content").alias("description"))
    software = top.select("session_id", F.lit("modified").alias("kind"), F.col("n").alias("position"), F.col("file").alias("name"))
    return synthesis.grounded_markers(stats, top, peaks, nodes, software, synthesis.passes(stats, facts, arcs, notes, graph, top))


@query(
    f"""WITH {S.features()} SELECT session_id, {COUNTS}, count_if(error) AS errors, CAST(0 AS BIGINT) AS input_tokens, {", ".join(f"count_if(filter_tier = {k}) AS tier_{k}" for k in M.TIERS)}, FALSE AS is_subagent FROM f GROUP BY session_id"""
)
def session_context(spark, d):
    c = synthesis.session_context(M.session_stats(enriched(spark, d)))
    return c.select("session_id", "total_messages", "user_messages", "assistant_messages", "errors", "input_tokens", *(F.col("tier_distribution")[str(k)].alias(f"tier_{k}") for k in M.TIERS), "is_subagent")


_NOTES = "regexp_split_to_array(text, '\\s+')[1]"


@query(
    f"""WITH t AS (SELECT DISTINCT conv_id, lower({_NOTES}) AS stem FROM conversations WHERE role = 'user' AND regexp_full_match({_NOTES}, '[A-Za-z]{{5,}}'))
SELECT t.conv_id AS session_id, stem || '.py' AS file, k.kind, CAST(turn AS VARCHAR) AS section, count(*) AS n FROM t JOIN conversations c USING (conv_id), (VALUES ('observation'), ('anomaly')) k(kind)
WHERE role = 'assistant' AND contains(lower(text), stem) AND (k.kind = 'observation' OR turn % 3 = 0) GROUP BY ALL"""
)
def explorer_observations(spark, d):
    """An assistant's messages are notes, some of them anomalies; the first word of a user's message names a file."""
    m = messages(spark, d)
    first = F.get(F.split("content", r"\s+"), F.lit(0))
    files = m.where("role = 'user'").select("session_id", F.lower(first).alias("stem")).where(F.col("stem").rlike("^[a-z]{5,}$")).select("session_id", F.concat("stem", F.lit(".py")).alias("file")).distinct()
    note = F.to_json(F.struct(F.concat(F.when(F.col("idx") % 3 == 0, F.lit("anomaly-")).otherwise("note-"), F.col("idx").cast("string")).alias("id"), F.col("content").alias("observation")))
    notes = m.where("role = 'assistant'").groupBy("session_id").agg(F.concat(F.lit('{"observations":['), F.array_join(F.collect_list(note), ","), F.lit("]}")).alias("doc"))
    found = synthesis.explorer_context(files, notes).withColumn("section", F.regexp_extract("section", r"-(\d+)$", 1))
    return found.groupBy("session_id", "file", "kind", "section").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT s_nationkey AS session_id, s_name AS file, s_acctbal FROM supplier)
SELECT a.session_id, a.file, 'warning' AS kind, CASE WHEN b.s_acctbal < 0 THEN 'high' ELSE 'unknown' END AS severity, 'about ' || b.file AS content, count(*) AS n FROM s a JOIN s b USING (session_id) WHERE contains('see ' || b.file, a.file) GROUP BY ALL
UNION ALL SELECT a.session_id, a.file, 'recommendation', 'unknown', 'pay ' || b.file, count(*) FROM s a JOIN s b USING (session_id) WHERE b.s_acctbal < 0 AND contains(b.file || ' owes', a.file) GROUP BY ALL"""
)
def marker_files(spark, d):
    """A nation's suppliers are its files and what its markers are about."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("session_id"), F.col("s_name").alias("file"), "s_acctbal")
    owes = F.col("s_acctbal") < 0
    warning = F.struct(F.concat(F.lit("see "), "file").alias("target"), F.when(owes, "high").alias("severity"), F.concat(F.lit("about "), "file").alias("warning"))
    advice = F.when(owes, F.struct(F.array(F.col("file"), F.lit("owes")).alias("affected_files"), F.concat(F.lit("pay "), "file").alias("fix")))
    docs = s.groupBy("session_id").agg(F.to_json(F.struct(F.collect_list(warning).alias("warnings"), F.collect_list(advice).alias("recommendations"))).alias("doc"))
    found = dossier.marker_files(s.select("session_id", "file"), docs)
    return found.groupBy("session_id", "file", "kind", "severity", "content").agg(F.count("*").alias("n"))


@query(
    """WITH n AS (SELECT p_brand AS session_id, 'sub ' || p_size AS name, CAST(count(*) AS INTEGER) AS nodes, max(p_name) AS summary FROM part GROUP BY p_brand, p_size)
SELECT n.session_id, c.n_name AS file, CAST(c.n_regionkey AS INTEGER) AS position, n.name, n.nodes, n.summary FROM n JOIN nation c ON n.name = 'sub ' || c.n_nationkey"""
)
def subgraph_files(spark, d):
    """Parts of a brand and size are a subgraph; a nation is a file whose concept is the size of its number."""
    p = read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.collect_list("p_partkey").alias("node_ids"), F.max("p_name").alias("summary"))
    one = F.struct(F.concat(F.lit("sub "), F.col("p_size").cast("string")).alias("name"), "node_ids", "summary")
    docs = p.groupBy(F.col("p_brand").alias("session_id")).agg(F.to_json(F.struct(F.collect_list(one).alias("subgraphs"))).alias("doc"))
    concepts = read(spark, d, "nation").select(F.col("n_name").alias("file"), F.col("n_regionkey").cast("int").alias("position"), F.concat(F.lit("sub "), F.col("n_nationkey").cast("string")).alias("name"))
    return dossier.subgraph_files(concepts, dossier.subgraphs(docs)).select("session_id", "file", "position", "name", "nodes", "summary")


@query(
    """WITH p AS (SELECT a.s_name AS fa, b.s_name AS fb, round(1 / (1 + abs(a.s_acctbal - b.s_acctbal) / 1000), 3) AS score, CASE WHEN a.s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS pattern, 1 / (1 + abs(a.s_acctbal - b.s_acctbal) / 1000) AS raw
 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey),
q AS (SELECT fa AS file, fb AS similar_to, score, pattern FROM p WHERE raw > 0.3 UNION ALL SELECT fb, fa, score, pattern FROM p WHERE raw > 0.3),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY score DESC, similar_to, pattern) AS INTEGER) AS rank FROM q) SELECT * FROM k WHERE rank <= 10"""
)
def similar_top(spark, d):
    """Suppliers of a nation are alike by their balances; the ten most alike of each."""
    s = read(spark, d, "supplier")
    a, b = s.select(*(F.col(c).alias(f"a_{c}") for c in s.columns)), s.select(*(F.col(c).alias(f"b_{c}") for c in s.columns))
    pairs = a.join(b, (F.col("a_s_nationkey") == F.col("b_s_nationkey")) & (F.col("a_s_suppkey") < F.col("b_s_suppkey")))
    score = 1 / (1 + F.abs(F.col("a_s_acctbal") - F.col("b_s_acctbal")) / 1000)
    pattern = F.when(F.col("a_s_nationkey") % 2 == 0, "even").otherwise("odd")
    return dossier.similar_files(pairs.select(F.col("a_s_name").alias("file_a"), F.col("b_s_name").alias("file_b"), score.alias("score"), pattern.alias("pattern")))


@query(
    """WITH t AS (SELECT l_suppkey AS session_id, 'part ' || l_partkey AS file, count(*) AS n, count_if(l_returnflag = 'A') AS c, count_if(l_returnflag = 'R') AS m FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, file) AS rank FROM t) SELECT session_id, file, n AS total_mentions, CAST(rank AS INTEGER) AS rank, c AS times_created, m AS times_modified, n AS total_references, CAST(0 AS INTEGER) AS warnings FROM k WHERE rank <= 15"""
)
def dossiers(spark, d):
    """A supplier is a session, its parts are the files that line items mention and touch."""
    item = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("session_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("file"), "l_returnflag")
    mentions = item.groupBy("session_id", "file").agg(F.count("*").alias("n"))
    action = F.when(F.col("l_returnflag") == "A", "created").when(F.col("l_returnflag") == "R", "modified")
    none = spark.createDataFrame([], "session_id long, file string, kind string, id string, severity string, content string")
    graphs = spark.createDataFrame([], "session_id long, file string, position int, name string, nodes int, summary string")
    found = dossier.assemble(mentions, item.withColumn("action", action), none, graphs)
    return found.select("session_id", "file", "total_mentions", "rank", "times_created", "times_modified", "total_references", F.size("warnings").alias("warnings"))


@query(
    """WITH f AS (SELECT split_part(p_type, ' ', 1) AS ext, p_brand AS state, p_size AS kb, p_retailprice, p_partkey % 7 = 0 AS dead, p_size > 45 AS trunc FROM part), s AS (SELECT o_custkey, count(*) * 20 AS messages, count_if(o_orderstatus = 'F') AS p1 FROM orders GROUP BY o_custkey),
d AS (SELECT 'ext' AS section, ext AS name, CAST(count(*) AS DOUBLE) AS value FROM f GROUP BY ext UNION ALL SELECT 'state', state, count(*) FROM f GROUP BY state
 UNION ALL SELECT 'session_size', CASE WHEN messages <= 50 THEN 'tiny_0_50' WHEN messages <= 200 THEN 'small_51_200' WHEN messages <= 1000 THEN 'medium_201_1000' WHEN messages <= 5000 THEN 'large_1001_5000' ELSE 'mega_5000_plus' END, count(*) FROM s GROUP BY ALL
 UNION ALL SELECT 'page_size', CASE WHEN kb < 10 THEN 'under_10' WHEN kb < 20 THEN '10_20' WHEN kb < 30 THEN '20_30' WHEN kb < 40 THEN '30_40' WHEN kb < 50 THEN '40_50' ELSE 'over_50' END, count(*) FROM f GROUP BY ALL
 UNION ALL SELECT 'issue', 'dead_code', count_if(dead) FROM f UNION ALL SELECT 'issue', 'missing_from_disk', 0 UNION ALL SELECT 'issue', 'key_mismatch', 0 UNION ALL SELECT 'issue', 'truncation_violations', count_if(trunc) FROM f
 UNION ALL SELECT 'total', 'total_annotations', sum(kb) FROM f UNION ALL SELECT 'total', 'total_frictions', count(*) FROM f UNION ALL SELECT 'total', 'total_decisions', 0 UNION ALL SELECT 'total', 'total_warnings', 0 UNION ALL SELECT 'total', 'total_failed', 0
 UNION ALL SELECT 'total', 'total_files', count(*) FROM f UNION ALL SELECT 'total', 'total_size_mb', round(sum(kb) / 1024, 1) FROM f UNION ALL SELECT 'total', 'avg_credibility', round(avg(1.0 / kb) * 100, 1) FROM f
 UNION ALL SELECT 'total', 'total_sessions', count(*) FROM s UNION ALL SELECT 'total', 'total_messages', sum(messages) FROM s
 UNION ALL SELECT 'phase_rate', 'p0', 100 UNION ALL SELECT 'phase_rate', 'p1', avg(CASE WHEN p1 >= 3 THEN 1.0 ELSE 0.0 END) * 100 FROM s UNION ALL SELECT 'phase_rate', 'p2', 0 UNION ALL SELECT 'phase_rate', 'p3', 0)
SELECT section, name, round(value, 6) AS value FROM d"""
)
def dashboard(spark, d):
    """Parts are files, customers with orders are sessions."""
    p = read(spark, d, "part")
    zero, no = F.lit(0), F.lit(False)
    files = p.select(
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("ext"), F.col("p_brand").alias("state"), (F.col("p_partkey") % 7 == 0).alias("is_dead_code"), no.alias("is_missing"), no.alias("has_key_mismatch"), (F.col("p_size") > 45).alias("has_truncation"),
        F.col("p_size").alias("size_kb"), F.col("p_size").alias("annotations"), F.lit(1).alias("frictions"), zero.alias("decisions"), zero.alias("warnings"), zero.alias("failed_approaches"), F.lit(1).alias("verified"), F.col("p_size").alias("claims"),
    )
    done = read(spark, d, "orders").groupBy("o_custkey").agg((F.count("*") * 20).alias("messages"), F.lit(1).alias("p0"), F.count_if(F.col("o_orderstatus") == "F").alias("p1"), zero.alias("p2"), zero.alias("p3"))
    return dossier.dashboard(files, done).withColumn("value", F.round("value", 6))


@query(f"WITH {S.features()}, t AS (SELECT session_id, {S.tag_columns()} FROM f WHERE protocol_type IS NULL), ec AS (SELECT session_id, emotional_tenor AS v, count(*) AS n FROM t GROUP BY ALL) SELECT session_id, string_agg(v || ':' || n, ', ' ORDER BY n DESC, v) AS emotions FROM ec GROUP BY session_id")
def emotion_summaries(spark, d):
    return dossier.arc_summary(tagged(spark, d), ["session_id"], "emotional_tenor", "emotions")


@query(
    """WITH w AS (SELECT conv_id, turn, role, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM conversations),
j AS (SELECT m.conv_id AS session_id, CAST(m.turn AS VARCHAR) AS marker_id, CAST(n.turn AS VARCHAR) AS id, n.turn AS position FROM w m JOIN w n ON n.conv_id = m.conv_id AND n.role = 'assistant' WHERE m.role = 'user' AND length(m.text) > 20 AND len(list_intersect(list_distinct(m.ws[1:8]), list_distinct(n.ws))) >= 3),
k AS (SELECT session_id, marker_id, id, CAST(row_number() OVER (PARTITION BY session_id, marker_id ORDER BY position, id) AS INTEGER) AS rank FROM j) SELECT * FROM k WHERE rank <= 5"""
)
def related_nodes(spark, d):
    """A user's messages are markers, an assistant's are nodes."""
    m = messages(spark, d)
    marks = m.where("role = 'user'").select("session_id", F.col("idx").cast("string").alias("marker_id"), F.col("content").alias("claim"))
    none = F.lit(None).cast("string")
    nodes = m.where("role = 'assistant'").select("session_id", F.col("idx").alias("position"), F.col("idx").cast("string").alias("id"), F.col("content").alias("label"), none.alias("description"), none.alias("source"))
    return dossier.related_nodes(marks, nodes)


@query(
    """WITH e AS (SELECT event_id, event_id % 4 AS k FROM events)
SELECT event_id AS session_id, CASE WHEN k = 3 THEN 'unreadable' WHEN event_id % 5 = 0 THEN 'already_normalized' WHEN k = 0 THEN 'valid' ELSE 'needs_normalization' END AS status, k = 0 AS valid,
 CASE k WHEN 0 THEN '' WHEN 1 THEN 'metadata' WHEN 2 THEN 'edges,metadata' ELSE 'PARSE_ERROR' END AS missing FROM e"""
)
def validated_documents(spark, d):
    """Idea graphs with all members, without some, and broken ones; one in five is stamped."""
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("k"), (F.col("event_id") % 5 == 0).alias("stamped"))
    body = F.when(F.col("k") == 0, '"nodes":[],"edges":[],"metadata":{}').when(F.col("k") == 1, '"nodes":[1],"edges":[]').otherwise('"nodes":[]')
    doc = F.when(F.col("k") == 3, F.lit("[broken")).otherwise(F.concat(F.lit("{"), F.when(F.col("stamped"), F.lit('"_normalized_at":"now",')).otherwise(""), body, F.lit("}")))
    out = N.normalization_status(e.select(F.col("event_id").alias("session_id"), F.lit("idea_graph").alias("kind"), doc.alias("doc")))
    return out.select("session_id", "status", "valid", F.array_join("missing_keys", ",").alias("missing"))
