"""Retrieval with evidence, verification, moderation, invitations, jobs and feedback over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, temporal
from ..operators import dedup, metrics, services, uploads
from ..operators.relational import by_key, nulled_where_gone, page, top_one, updated_where, without_where
from .catalogue import BEST_SQL, STATE_SQL, best_source_per_order, public, with_state
from .registry import EVENT_CLOCK, ORDER_CLOCK, clock, query


def now():
    return clock(ORDER_CLOCK)


STOPS_SQL = ", ".join(f"'{w}'" for w in scalar.STOP_WORDS)
FRESH_SQL = "l_shipdate >= TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 90 DAY"
# A part's name is searched; its lines are its sources. A question without a token of its own asks for rings or bolts too.
RETRIEVAL_SQL = f"""
WITH q AS (SELECT DISTINCT conv_id, turn, list_slice(list_filter(regexp_extract_all(lower(text || CASE WHEN conv_id % 3 = 0 THEN ' ring bolt' ELSE '' END), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({STOPS_SQL})), 1, 6) AS tokens
           FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN substr(text, 1, 12) WHEN conv_id % 3 = 1 THEN text ELSE 'how to' END AS text FROM conversations WHERE role = 'user') c),
r AS (SELECT p_partkey AS id, lower(p_name) AS text, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity > 48) THEN 'conflicting' WHEN NOT coalesce(bool_or(l_returnflag = 'N' AND l_linestatus = 'O'), false) THEN 'unverified'
        WHEN NOT bool_or(l_returnflag = 'N' AND l_linestatus = 'O' AND {FRESH_SQL}) THEN 'stale' ELSE 'accepted' END AS evidence FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
names AS (SELECT DISTINCT text FROM r), t AS (SELECT DISTINCT unnest(tokens) AS token FROM q), h AS (SELECT token, text FROM t JOIN names ON contains(text, token)),
n AS (SELECT DISTINCT conv_id, turn, text FROM (SELECT conv_id, turn, unnest(tokens) AS token FROM q) x JOIN h USING (token) UNION SELECT conv_id, turn, text FROM q, names WHERE len(tokens) = 0),
k AS (SELECT text, id, evidence FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS nth FROM r) y WHERE nth <= 32),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY id) AS nth FROM n JOIN k USING (text)),
f AS (SELECT * FROM c WHERE nth <= 32),
a AS (SELECT conv_id, turn, id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY id) AS nth FROM f WHERE evidence = 'accepted'),
answers AS (SELECT q.conv_id, q.turn, coalesce(string_agg(a.id::VARCHAR, ',' ORDER BY a.id), '') AS accepted FROM q LEFT JOIN a ON a.conv_id = q.conv_id AND a.turn = q.turn AND a.nth <= 8 GROUP BY 1, 2),
rejected AS (SELECT q.conv_id, q.turn, count(*) FILTER (WHERE evidence = 'unverified') AS unverified, count(*) FILTER (WHERE evidence = 'stale') AS stale, count(*) FILTER (WHERE evidence = 'conflicting') AS conflicting FROM q LEFT JOIN f ON f.conv_id = q.conv_id AND f.turn = q.turn GROUP BY 1, 2)
"""


def answers(t):
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.substring("text", 1, 12), F.lit(" ring bolt"))).when(F.col("conv_id") % 3 == 1, F.col("text")).otherwise("how to")
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", scalar.query_tokens(text, 6).alias("tokens")).distinct()
    sources = t.lineitem.select(
        F.col("l_partkey").alias("id"), F.expr("l_returnflag = 'R' AND l_quantity > 48").alias("disqualifying"), F.expr("l_returnflag = 'N' AND l_linestatus = 'O'").alias("verified"), "l_shipdate"
    )
    records = services.evidence_state(t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("text")), sources, "id", temporal.is_fresh(F.col("l_shipdate"), now()))
    return services.retrieved(asked, records, ["conv_id", "turn"])


@query("evidence_retrieval", f"{RETRIEVAL_SQL} SELECT a.conv_id, a.turn, a.accepted, r.unverified, r.stale, r.conflicting FROM answers a JOIN rejected r USING (conv_id, turn)")
def evidence_retrieval(t):
    return answers(t).select("conv_id", "turn", F.array_join("accepted", ",").alias("accepted"), "unverified", "stale", "conflicting")


CITED_SQL = "SELECT l_partkey AS id, l_orderkey AS source, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS nth FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'"


@query("answer_citations", f"{RETRIEVAL_SQL} SELECT conv_id, turn, 'claim-' || a.nth AS claim_key, a.id, s.source FROM a LEFT JOIN ({CITED_SQL}) s ON s.id = a.id AND s.nth = 1 WHERE a.nth <= 8")
def answer_citations(t):
    """The claims of each answer with the latest verified source of what they speak of."""
    approved = t.lineitem.filter("l_returnflag = 'N' AND l_linestatus = 'O'")
    latest = top_one(approved, ["l_partkey"], F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("source"))
    return services.claims(answers(t), ["conv_id", "turn"], latest).select("conv_id", "turn", "claim_key", "id", "source")


@query(
    "response_confidence",
    "SELECT user_id, date_trunc('hour', ts) AS asked_at, CASE WHEN bool_or(event_type = 'error') THEN 'low' WHEN bool_or(value > 99) OR bool_or(event_type = 'view') THEN 'medium' WHEN bool_or(event_type = 'purchase') THEN 'high' ELSE 'medium' END AS confidence FROM events GROUP BY 1, 2",
)
def response_confidence(t):
    """An answer is what a user was shown in one hour; its evidence decides how sure it is."""
    level = F.when(F.col("event_type") == "error", "low").when(F.col("event_type") == "view", "medium").when(F.col("event_type") == "purchase", "high")
    said = t.events.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("asked_at")).agg(F.collect_set(level).alias("levels"), F.bool_or(F.col("value") > 99).alias("warned"))
    return said.select("user_id", "asked_at", scalar.response_confidence(F.col("levels"), F.col("warned")).alias("confidence"))


ANSWER_SQL = (
    "CASE WHEN conv_id % 4 > 1 THEN 'comparison of selected scholarships' WHEN contains(l, 'changed') THEN 'what changed from source monitoring' WHEN contains(l, 'prioriti') OR contains(l, 'task') THEN 'application task prioritization' "
    "WHEN contains(l, 'progress') THEN 'private application progress summary' WHEN conv_id % 4 = 1 THEN 'scholarship detail explanation' WHEN contains(l, 'deadline') OR contains(l, 'open') THEN 'deadline/status explanation' "
    "WHEN contains(l, 'fund') OR contains(l, 'coverage') THEN 'funding coverage explanation' WHEN contains(l, 'document') OR contains(l, 'requirement') THEN 'requirements checklist explanation' ELSE 'scholarship search' END"
)
TOPICS = ["what Changed", "my tasks", "progress", "deadline", "fund", "documents", ""]


@query("answer_type", f"SELECT conv_id, turn, {ANSWER_SQL} AS answer FROM (SELECT conv_id, turn, lower(text || ' ' || list_extract({TOPICS}, CAST((conv_id + turn) % 7 + 1 AS BIGINT))) AS l FROM conversations) c")
def answer_type(t):
    topic = F.get(F.array(*[F.lit(x) for x in TOPICS]), ((F.col("conv_id") + F.col("turn")) % 7).cast("int"))
    return t.conversations.select("conv_id", "turn", scalar.answer_type(F.concat("text", F.lit(" "), topic), F.col("conv_id") % 4).alias("answer"))


@query("record_by_key", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def record_by_key(t):
    return by_key(t.orders, "o_orderkey", 7).select("o_orderkey", "o_orderstatus")


@query("public_detail", f"SELECT o_orderkey, {STATE_SQL} AS window_state, l_partkey AS source_part, l_shipdate AS verified_at FROM orders JOIN ({BEST_SQL}) b ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_linestatus = 'O' AND l.l_returnflag = 'R')")
def public_detail(t):
    """Active records with their selected official source; without one a record has no public detail."""
    best = best_source_per_order(t).withColumnRenamed("l_orderkey", "o_orderkey")
    return with_state(public(t).filter("o_orderstatus <> 'P'")).join(best, "o_orderkey").select("o_orderkey", "window_state", F.col("l_partkey").alias("source_part"), F.col("l_shipdate").alias("verified_at"))


CYCLE_SQL = (
    "SELECT l_orderkey, l_shipdate, l_returnflag = 'A' AS archived, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A', CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_shipdate END DESC NULLS LAST, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS r FROM lineitem"
)


@query("window_projection", f"SELECT o_orderkey, c.l_shipdate AS deadline, coalesce(c.archived, false) AS archived FROM orders LEFT JOIN (SELECT * FROM ({CYCLE_SQL}) x WHERE r = 1) c ON c.l_orderkey = o_orderkey")
def window_projection(t):
    """The current cycle's window copied onto its record."""
    archived = F.col("l_returnflag") == "A"
    order = [archived, F.when(~archived, F.col("l_shipdate")).desc_nulls_last(), *[F.desc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]]
    cycle = top_one(t.lineitem, ["l_orderkey"], *order).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("deadline"), archived.alias("archived"))
    return t.orders.join(cycle, "o_orderkey", "left").select("o_orderkey", "deadline", F.coalesce("archived", F.lit(False)).alias("archived"))


@query(
    "verification_update",
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'expired' WHEN 2 THEN 'draft' WHEN 3 THEN 'draft' WHEN 4 THEN 'draft' ELSE 'active' END AS status FROM orders",
)
def verification_update(t):
    said = F.get(F.array(*[F.lit(x) for x in ("officially_verified", "expired", "needs_review", "unverified", "conflicting_information")]), (F.col("o_orderkey") % 6).cast("int"))
    updates = t.orders.select("o_orderkey", said.alias("verification_status")).filter("verification_status IS NOT NULL")
    return services.verified(t.orders.select("o_orderkey", F.lit("active").alias("status")), updates, "o_orderkey").select("o_orderkey", "status")


@query(
    "source_pick",
    "SELECT o_orderkey, CASE WHEN asked IS NULL AND n = 1 THEN 'picked' WHEN asked IS NULL THEN 'source_required' WHEN own THEN 'picked' ELSE 'source_not_found' END AS outcome, CASE WHEN asked IS NULL AND n = 1 THEN only_one WHEN asked IS NOT NULL AND own THEN asked END AS chosen FROM "
    "(SELECT o_orderkey, asked, coalesce(n, 0) AS n, only_one, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = asked) AS own FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 10 END AS asked FROM orders) a LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS only_one FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey) b",
)
def source_pick(t):
    requests = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 10).alias("l_suppkey"))
    sources = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return services.picked_source(requests, sources, "o_orderkey", "l_suppkey").select("o_orderkey", "outcome", "chosen")


DECIDED_SQL = (
    "SELECT p_partkey AS id, first_id, CASE WHEN p_type = first_type THEN 1.0 ELSE 0.95 END AS score, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (p_size % 7) AS created_at, CASE p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed_duplicate' ELSE 'dismissed' END AS status "
    "FROM (SELECT *, min(p_partkey) OVER w AS first_id, first_value(p_type) OVER (PARTITION BY lower(p_name), p_brand ORDER BY p_partkey) AS first_type FROM part WINDOW w AS (PARTITION BY lower(p_name), p_brand)) t WHERE p_partkey <> first_id"
)


def _decided(t):
    """Parts of one name and brand as suggestions beside the first of them, scored by whether they agree in type, with what was decided."""
    groups = dedup.exact_groups(t.part, "p_partkey", F.struct(F.lower("p_name"), "p_brand")).filter("p_partkey <> first_id").select(F.col("p_partkey").alias("id"), "first_id")
    part = lambda key, kind: t.part.select(F.col("p_partkey").alias(key), F.col("p_type").alias(kind), *([F.col("p_size")] if key == "id" else []))
    scored = groups.join(part("id", "own"), "id").join(part("first_id", "first"), "first_id")
    made = clock("2024-01-01 00:00:00") + F.make_dt_interval(mins=(F.col("p_size") % 7).cast("int"))
    scored = scored.select("id", "first_id", F.when(F.col("own") == F.col("first"), 1.0).otherwise(0.95).alias("score"), made.alias("created_at"))
    decisions = t.part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 1).alias("is_duplicate"))
    return services.decided(scored, decisions, "id")


@query("duplicate_queue", f"SELECT id, first_id, CAST(score AS DOUBLE) AS score, status FROM ({DECIDED_SQL}) d")
def duplicate_queue(t):
    return _decided(t).select("id", "first_id", "score", "status")


@query("duplicate_queue_page", f"SELECT id, first_id, CAST(score AS DOUBLE) AS score, created_at FROM ({DECIDED_SQL}) d WHERE status = 'pending' ORDER BY score DESC, created_at, id LIMIT 50")
def duplicate_queue_page(t):
    """The fifty suggestions to decide next."""
    return services.pending_queue(_decided(t)).select("id", "first_id", "score", "created_at")


MODERATED_SQL = "SELECT doc_id, list_extract(['hide', 'restore', 'suspend', 'reinstate', 'resolve', 'erase'], CAST(doc_id % 6 + 1 AS BIGINT)) AS action FROM documents"


@query(
    "moderation_effects",
    f"SELECT doc_id, action, CASE WHEN action = 'erase' THEN 'unsupported' WHEN there THEN 'applied' ELSE 'not_found' END AS outcome, CASE WHEN there THEN CASE action WHEN 'hide' THEN 'hidden' WHEN 'restore' THEN 'visible' WHEN 'suspend' THEN 'suspended' WHEN 'reinstate' THEN 'active' WHEN 'resolve' THEN 'resolved' END END AS status FROM "
    f"(SELECT *, CASE WHEN action IN ('hide', 'restore') THEN EXISTS (SELECT 1 FROM pages p WHERE p.page_id = doc_id) WHEN action IN ('suspend', 'reinstate') THEN EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = doc_id) WHEN action = 'resolve' THEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id) ELSE false END AS there FROM ({MODERATED_SQL}) m) t",
)
def moderation_effects(t):
    action = F.get(F.array(*[F.lit(a) for a in (*services.MODERATION, "erase")]), (F.col("doc_id") % 6).cast("int"))
    actions = t.documents.select("doc_id", F.col("doc_id").alias("target_id"), action.alias("action"))
    targets = t.pages.select(F.lit("content").alias("target_type"), F.col("page_id").alias("target_id"))
    targets = targets.unionByName(t.customer.select(F.lit("member").alias("target_type"), F.col("c_custkey").alias("target_id"))).unionByName(t.labels.select(F.lit("report").alias("target_type"), F.col("doc_id").alias("target_id")))
    return services.moderated(actions, targets).select("doc_id", "action", "outcome", "status")


INVITED_SQL = "SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS reserved, min(ts) FILTER (WHERE event_type = 'purchase') AS verified, min(ts) + INTERVAL 12 HOUR + INTERVAL 1 HOUR * (user_id % 1000) AS expires FROM events GROUP BY 1"
INVITATION_SQL = "CASE WHEN reserved IS NOT NULL AND reserved < expires AND verified >= reserved AND verified < expires THEN 'redeemed' WHEN expires <= TIMESTAMP '2024-01-20 00:00:00' THEN 'expired' WHEN reserved IS NOT NULL THEN 'reserved' ELSE 'pending' END"


@query("invitations", f"SELECT user_id, {INVITATION_SQL} AS state FROM ({INVITED_SQL}) i")
def invitations(t):
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    invited = t.events.groupBy("user_id").agg(first("signup").alias("reserved"), first("purchase").alias("verified"), F.min("ts").alias("start"))
    expires = F.col("start") + F.make_dt_interval(hours=(12 + F.col("user_id") % 1000).cast("int"))
    return invited.select("user_id", services.invitation_state(F.col("reserved"), F.col("verified"), expires, clock(EVENT_CLOCK)).alias("state"))


@query("bulk_update", "SELECT event_id, CASE WHEN event_type = 'click' AND value > 50 THEN 'cancelled' ELSE event_type END AS event_type, CASE WHEN event_type = 'click' AND value > 50 THEN 0 ELSE value END AS value FROM events")
def bulk_update(t):
    hit = (F.col("event_type") == "click") & (F.col("value") > 50)
    return updated_where(t.events, hit, event_type=F.lit("cancelled"), value=F.lit(0.0)).select("event_id", "event_type", "value")


@query("cascade_set_null", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) THEN o_custkey END AS o_custkey FROM orders")
def cascade_set_null(t):
    return nulled_where_gone(t.orders, t.customer.filter("c_acctbal >= 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("sealed_objects", "SELECT doc_id, text, true AS bound FROM documents")
def sealed_objects(t):
    """Texts sealed in envelopes and opened again; an envelope opens under its own name and master key alone."""
    name = F.col("doc_id").cast("string")
    made = t.documents.select("doc_id", scalar.sealed(F.col("text"), "master", name).alias("envelope"))
    bound = scalar.opened(F.col("envelope"), "master", F.lit("x")).isNull() & scalar.opened(F.col("envelope"), "other", name).isNull()
    return made.select("doc_id", scalar.opened(F.col("envelope"), "master", name).alias("text"), bound.alias("bound"))


@query("pseudonyms", "SELECT user_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3), substr(h, 21, 12)) AS pseudonym FROM (SELECT DISTINCT user_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('community:' || user_id)) AS h FROM events) e")
def pseudonyms(t):
    return t.events.select("user_id").distinct().select("user_id", scalar.pseudonym(F.col("user_id")).alias("pseudonym"))


@query("currency_checks", "SELECT c_custkey, observed = 'EUR' AND c_acctbal > 0 AS ok FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'EURO' END AS observed FROM customer) c")
def currency_checks(t):
    observed = F.get(F.array(F.lit(" eur"), F.lit("USD"), F.lit("EUR"), F.lit("EURO")), (F.col("c_custkey") % 4).cast("int"))
    return t.customer.select("c_custkey", scalar.currency_ok(F.lit("EUR "), observed, F.col("c_acctbal")).alias("ok"))


@query("event_page", "SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
def event_page(t):
    return page(t.events.filter("user_id = 7"), [F.desc("ts"), F.desc("event_id")], 20, 5).select("event_id", "ts")


@query("legacy_tracker", "SELECT o_orderkey, NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P')) AS ok FROM orders")
def legacy_tracker(t):
    state = F.when(F.col("o_orderstatus") == "O", "researching").when(F.col("o_orderstatus") == "P", "ready_to_apply").otherwise("submitted")
    submitted = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", services.submitted_ok(state, submitted).alias("ok"))


@query("history_opt_out", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def history_opt_out(t):
    out = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return t.conversations.join(out, "conv_id", "left_anti").select("conv_id", "turn")


@query(
    "expired_conversations",
    "SELECT c.conv_id, coalesce(l.quality = 0, false) AS cleared, CASE WHEN coalesce(l.quality = 0, false) THEN 0 ELSE count(*) END AS messages FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id WHERE NOT coalesce(l.quality = 0 AND l.toxic = 1, false) GROUP BY 1, 2",
)
def expired_conversations(t):
    """Messages of expired conversations are cleared and their flag is set; those whose feedback expired too are gone."""
    state = t.labels.select(F.col("doc_id").alias("conv_id"), "quality", "toxic")
    kept = without_where(t.conversations.join(state, "conv_id", "left"), (F.col("quality") == 0) & (F.col("toxic") == 1))
    counted = kept.groupBy("conv_id", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("cleared")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("conv_id", "cleared", F.when(F.col("cleared"), F.lit(0)).otherwise(F.col("n")).alias("messages"))


PATHS = ["/api/v1/auth/login", "/api/v1/document-lab/x", "/api/v1/community", "/api/v1/assistant/ask", "/api/v1/applications/1", "/api/v1/opportunities", "/health/live", "/about", "/api/v2"]


@query("route_classes", f"SELECT page_id, CASE WHEN starts_with(path, '/api/v1/auth') THEN 'auth' WHEN starts_with(path, '/api/v1/document-lab') THEN 'document_lab' WHEN starts_with(path, '/api/v1/community') THEN 'community' WHEN starts_with(path, '/api/v1/assistant') THEN 'assistant' WHEN starts_with(path, '/api/v1/applications') THEN 'applications' WHEN starts_with(path, '/api/v1') THEN 'api' WHEN starts_with(path, '/health') THEN 'health' ELSE 'frontend' END AS class FROM (SELECT page_id, list_extract({PATHS}, CAST(page_id % 9 + 1 AS BIGINT)) AS path FROM pages) p")
def route_classes(t):
    path = F.get(F.array(*[F.lit(x) for x in PATHS]), (F.col("page_id") % 9).cast("int"))
    return t.pages.select("page_id", scalar.route_class(path).alias("class"))


@query(
    "intake_readiness",
    "SELECT event_type, production, scanner = 'clamav' OR (NOT production AND scanner = 'test') AS scanner_ready, fresh AND NOT failed AS worker_ready, NOT production OR ((scanner = 'clamav' OR (NOT production AND scanner = 'test')) AND fresh AND NOT failed) AS accepting FROM "
    "(SELECT event_type, production, CASE event_type WHEN 'click' THEN 'clamav' WHEN 'view' THEN 'clamav' WHEN 'error' THEN 'none' ELSE 'test' END AS scanner, last >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 60 MINUTE AS fresh, worst > 500 AS failed FROM (SELECT event_type, max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') AS last, max(value) AS worst FROM events GROUP BY 1) e, (SELECT unnest([true, false]) AS production) b) x",
)
def intake_readiness(t):
    last = t.events.groupBy("event_type").agg(F.max(F.when(F.col("ts") <= clock(EVENT_CLOCK), F.col("ts"))).alias("last"), F.max("value").alias("worst"))
    both = last.withColumn("production", F.explode(F.array(F.lit(True), F.lit(False))))
    scanner = F.when(F.col("event_type").isin("click", "view"), "clamav").when(F.col("event_type") == "error", "none").otherwise("test")
    ready = services.intake_readiness(scanner, F.col("production"), F.lit(True), F.col("last"), F.when(F.col("worst") > 500, "failed"), clock(EVENT_CLOCK), 60)
    return both.select("event_type", "production", ready.alias("r")).select("event_type", "production", "r.*")


@query("document_stages", "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'scan' WHEN length(text) = 0 OR length(text) > 5000 THEN 'extract' ELSE 'analyse' END AS stage, CASE WHEN doc_id % 17 = 0 THEN 'malware_detected' WHEN length(text) = 0 THEN 'no_text_found' WHEN length(text) > 5000 THEN 'text_too_long' END AS failure_code FROM documents")
def document_stages(t):
    return t.documents.select("doc_id", services.document_stage(F.col("doc_id") % 17 != 0, F.col("text"), 5000).alias("s")).select("doc_id", "s.*")


@query(
    "feedback_positions",
    "SELECT doc_id, nth - 1 AS position, list_extract(items, nth).category AS category, list_extract(items, nth).text AS text FROM (SELECT doc_id, items, unnest(range(1, len(items) + 1)) AS nth FROM (SELECT doc_id, list_concat(list_transform(CASE WHEN doc_id % 2 = 0 THEN [source, lang] ELSE [] END, lambda x: {'category': 'strength', 'text': x}), list_transform(CASE WHEN n_chars > 300 THEN [lang] ELSE [] END, lambda x: {'category': 'gap', 'text': x})) AS items FROM documents) a) b",
)
def feedback_positions(t):
    none = F.array().cast("array<string>")
    items = services.feedback_items(strength=F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(none), gap=F.when(F.col("n_chars") > 300, F.array("lang")))
    return t.documents.select("doc_id", F.posexplode(items).alias("position", "x")).select("doc_id", F.col("position").cast("long").alias("position"), "x.category", "x.text")


FAULT_SQL = (
    "CASE WHEN contains(lower(body), 'guarantee') OR contains(lower(body), 'plagiarism') THEN 'unsafe' WHEN rubric IS NULL OR rubric = '' OR confidence NOT IN ('low', 'medium', 'high') THEN 'unstructured' WHEN general AND coalesce(excerpt, '') <> '' THEN 'unsafe' "
    "WHEN NOT general AND (coalesce(excerpt, '') = '' OR NOT contains(text, excerpt)) THEN 'ungrounded' END"
)
FEEDBACK = {
    "body": "CASE WHEN doc_id % 11 = 0 THEN 'We Guarantee it' WHEN doc_id % 13 = 0 THEN 'no Plagiarism' ELSE 'fine' END",
    "rubric": "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 19 = 0 THEN NULL ELSE 'clarity' END",
    "confidence": "CASE WHEN doc_id % 23 = 0 THEN 'sure' ELSE 'low' END",
    "general": "doc_id % 3 = 0",
    "excerpt": "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'no such words at all' ELSE substr(text, 3, 10) END",
}


@query("feedback_faults", f"SELECT doc_id, {FAULT_SQL} AS fault FROM (SELECT doc_id, text, {', '.join(f'{e} AS {n}' for n, e in FEEDBACK.items())} FROM documents) f")
def feedback_faults(t):
    items = t.documents.selectExpr("doc_id", "text", *[f"{e} AS {n}" for n, e in FEEDBACK.items()])
    return items.select("doc_id", scalar.feedback_fault(*[F.col(c) for c in ("body", "rubric", "confidence", "general", "excerpt", "text")]).alias("fault"))


@query("upper_codes", "SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) AS code FROM customer")
def upper_codes(t):
    return t.customer.select("c_custkey", scalar.upper_code(F.concat(F.lit("\t "), F.lower(F.substring("c_mktsegment", 1, 3)), F.lit("\n"))).alias("code"))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS at FROM events")
def iso_times(t):
    return t.events.select("event_id", scalar.iso_utc(F.col("ts")).alias("at"))


@query("archive_checks", "SELECT l_orderkey, sum(CAST(l_extendedprice AS BIGINT)) <= 300000 AND sum(CAST(l_extendedprice AS BIGINT)) <= 1500 * greatest(sum(CAST(l_quantity AS BIGINT)), 1) AS ok FROM lineitem GROUP BY 1")
def archive_checks(t):
    entries = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.round("l_extendedprice").cast("long")).alias("sizes"), F.collect_list(F.round("l_quantity").cast("long")).alias("packed"))
    return entries.select("l_orderkey", scalar.archive_ok(F.col("sizes"), F.col("packed"), 300_000, 1500).alias("ok"))


UPLOAD = {
    "filename": "CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'notes.txt' WHEN 2 THEN 'a.PDF' WHEN 3 THEN 'b.docx' ELSE 'page.pdf' END",
    "declared_type": "CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf; x=y' ELSE 'Application/PDF ' END",
    "body": "CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN html WHEN 2 THEN '%PDF-' || html WHEN 3 THEN '%PDF- /Encrypt ' || html || ' startxref %%EOF' WHEN 4 THEN '%PDF-' || html || ' startxref %%EOF' ELSE '%PDF- /Type /Page ' || repeat('/Type/Page ', CAST(page_id % 80 AS INT)) || html || 'startxref %%EOF' END",
}
UPLOAD_SQL = (
    "CASE WHEN filename = '' THEN 'invalid_filename' WHEN strlen(body) > 8000 THEN 'file_too_large' WHEN body = '' THEN 'empty_file' WHEN filename = 'notes.txt' OR declared_type = 'text/html' THEN 'unsupported_format' WHEN filename = 'b.docx' OR body NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'mime_or_magic_mismatch' "
    "WHEN NOT contains(body, 'startxref') THEN 'malformed_pdf' WHEN contains(body, '/Encrypt ') THEN 'password_protected_document' WHEN pages = 0 THEN 'image_only_or_malformed_pdf' WHEN pages > 50 THEN 'page_limit_exceeded' END"
)


@query(
    "upload_checks",
    f"SELECT page_id, {UPLOAD_SQL} AS rejection, CASE WHEN {UPLOAD_SQL} IS NULL THEN pages END AS page_count FROM (SELECT *, CASE WHEN page_id % 7 IN (5, 6) THEN 1 + page_id % 80 ELSE 0 END AS pages FROM (SELECT page_id, {', '.join(f'{e} AS {n}' for n, e in UPLOAD.items())} FROM pages) u) p",
)
def upload_checks(t):
    """Pages as uploads under several names, types and contents."""
    made = t.pages.selectExpr("page_id", *[f"{e} AS {n}" for n, e in UPLOAD.items()])
    files = made.select("page_id", "filename", "declared_type", F.col("body").cast("binary").alias("content"))
    return uploads.checked(files, most_bytes=8000).select("page_id", "rejection", "page_count")


# Addresses for each host of the pages; the first and the seventh are safe.
URLS = ["https://{}/x", "http://{}/x", "https://user:pass@{}/", "https://localhost/a", "https://10.0.0.1/", "https://{}:8443/", "https://{}:443/y", "ftp://{}/"]


@query("url_checks", "SELECT page_id, page_id % 8 IN (0, 6) AS safe FROM pages")
def url_checks(t):
    made = F.get(F.array(*[F.lit(u) for u in URLS]), (F.col("page_id") % 8).cast("int"))
    host = F.try_parse_url("url", F.lit("HOST"))
    return t.pages.select("page_id", scalar.url_safe(F.replace(made, F.lit("{}"), host)).alias("safe"))


RECOMMENDED = {"name": "c_name", "balance": "CASE WHEN c_acctbal > 2000 THEN c_acctbal END", "segment": "CASE WHEN c_nationkey % 3 > 0 THEN c_mktsegment END", "english_test_status": "CASE WHEN c_nationkey % 4 > 0 THEN 'taken' END", "nation": "CASE WHEN c_nationkey > 5 THEN c_nationkey END"}
CGPA, SCALE = "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END", "CASE WHEN c_custkey % 6 = 0 THEN 4 END"


@query(
    "profile_page",
    f"SELECT c_custkey, CAST(round_even(greatest(slots - len(missing), 0) * 100.0 / slots, 0) AS BIGINT) AS completeness, array_to_string(missing, ',') AS missing FROM (SELECT c_custkey, CASE WHEN {CGPA} IS NULL THEN 6 ELSE 7 END AS slots, list_filter(["
    + ", ".join(f"CASE WHEN {e} IS NULL THEN '{n}' END" for n, e in RECOMMENDED.items())
    + f", CASE WHEN {CGPA} IS NULL THEN 'cgpa_or_percentage' WHEN {SCALE} IS NULL THEN 'grading_scale' END], lambda x: x IS NOT NULL) AS missing FROM customer) t",
)
def profile_page(t):
    made = t.customer.selectExpr("c_custkey", f"{CGPA} AS cgpa", f"{SCALE} AS scale", *[f"{e} AS {n}" for n, e in RECOMMENDED.items()])
    missing, completeness = temporal.profile_gaps({n: F.col(n) for n in RECOMMENDED}, F.col("cgpa"), F.lit(None), F.col("scale"))
    return made.select("c_custkey", completeness.alias("completeness"), F.array_join(missing, ",").alias("missing"))


@query("first_values", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY first_at) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) t GROUP BY 1")
def first_values(t):
    """Distinct values in the order of their first occurrence."""
    firsts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_at"))
    listed = firsts.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("first_at", "o_orderpriority"))).alias("all"))
    return listed.select("o_custkey", F.array_join(F.transform("all", lambda x: x.o_orderpriority), ",").alias("priorities"))


RUNS_SQL = "SELECT user_id % 10 AS job, event_id, ts AS completed_at, coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS started_at, CAST(floor(value) AS BIGINT) AS processed, CASE WHEN event_type = 'error' THEN 'Error' || (event_id % 3) END AS error FROM events"
LONG_SQL = "greatest(0, (epoch_us(completed_at) - epoch_us(started_at)) // 1000)"


@query(
    "job_totals",
    f"SELECT job, CAST(sum(CASE WHEN error IS NULL THEN greatest(processed, 0) ELSE 0 END) AS BIGINT) AS processed, count(error) AS failed, max_by(coalesce(error, ''), (completed_at, started_at, coalesce(error, ''))) AS last_error, CAST(sum({LONG_SQL}) AS BIGINT) AS duration_ms, max({LONG_SQL}) AS longest_ms FROM ({RUNS_SQL}) r GROUP BY 1",
)
def job_totals(t):
    """A run ends with each event of a user and began with the one before."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("Error"), (F.col("event_id") % 3).cast("string")))
    runs = t.events.select((F.col("user_id") % 10).alias("job"), F.col("ts").alias("completed_at"), F.coalesce(before, "ts").alias("started_at"), F.floor("value").alias("processed"), error.alias("error"))
    return metrics.job_totals(runs).withColumn("last_error", F.coalesce("last_error", F.lit("")))


@query("change_records", "SELECT page_id, lag(page_id) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://[^/]+') ORDER BY page_id) AS previous FROM pages")
def change_records(t):
    host = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    return t.pages.select("page_id", F.lag("page_id").over(Window.partitionBy(host).orderBy("page_id")).alias("previous"))


@query(
    "canonical_identity_classes",
    "SELECT p_partkey, min(p_partkey) OVER w AS first_id, count(*) OVER w AS copies FROM part WINDOW w AS (PARTITION BY p_brand, p_type, p_size)",
)
def canonical_identity_classes(t):
    """Records of one canonical identity as classes: each with the first of its class and the number of members, not all pairs."""
    return dedup.exact_groups(t.part, "p_partkey", F.struct("p_brand", "p_type", "p_size"))


SLOTS = {
    "nationality": "c_name", "residence": "CASE WHEN c_nationkey % 2 = 0 THEN 'land' ELSE '' END", "education": "CASE WHEN c_nationkey % 3 > 0 THEN 'bachelor' END", "degree": "c_mktsegment", "field": "CASE WHEN c_acctbal > 0 THEN 'f' END",
    "grade": "CASE WHEN c_acctbal > 5000 THEN '3.1' END", "english": "CASE WHEN c_nationkey % 5 > 1 THEN 'taken' ELSE 'unknown' END", "countries": "CASE WHEN c_nationkey % 7 > 2 THEN 'x' END", "need": "CASE WHEN c_nationkey % 4 = 1 THEN 'yes' ELSE '' END", "intake": "CASE WHEN c_custkey % 3 = 0 THEN '2025' END",
}


def _filled_sql(name: str, expression: str) -> str:
    known = f" AND ({expression}) <> 'unknown'" if name == "english" else ""
    return f"CAST(coalesce(({expression}) <> '', false){known} AS INT)"


@query("matching_completeness", f"SELECT c_custkey, CAST(round_even(({' + '.join(_filled_sql(n, e) for n, e in SLOTS.items())}) * 100.0 / 10, 0) AS BIGINT) AS completeness FROM customer")
def matching_completeness(t):
    made = t.customer.selectExpr("c_custkey", *[f"{e} AS {n}" for n, e in SLOTS.items()])
    return made.select("c_custkey", temporal.slots_filled({n: F.col(n) for n in SLOTS}, unknown=("english",)).alias("completeness"))
