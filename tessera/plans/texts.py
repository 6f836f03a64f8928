"""Scalar text functions, evidence, change detection, duplicates, retrieval, community over pages, documents, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..operators import dedup, monitor, services
from ..operators.relational import exists, flagged, not_exists
from .registry import EVENT_CLOCK, clock, query

#: White space as trims know it.
WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in scalar.WHITE)
SLUG_SQL = "substr(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120)"


@query("slug_keys", f"SELECT p_partkey, {SLUG_SQL.format('p_name || p_brand')} AS slug FROM part")
def slug_keys(t):
    return t.part.select("p_partkey", scalar.slug(F.concat("p_name", "p_brand")).alias("slug"))


@query("value_keys", f"SELECT p_brand, string_agg(DISTINCT {SLUG_SQL.format('p_type')}, ',' ORDER BY {SLUG_SQL.format('p_type')}) AS keys FROM part GROUP BY 1")
def value_keys(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(scalar.slug(F.col("p_type")))), ",").alias("keys"))


CODES_SQL = lambda c, table: f"CASE replace(lower(trim({c})), '&', 'and') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
#: Fields that a customer may have typed, by its key.
TYPED_FIELDS = [" Computer Science", "AI", "Public health ", "history", "arts & crafts", "CS"]


@query("alias_codes", f"SELECT c_custkey, {CODES_SQL('n_name', scalar.COUNTRIES)} AS country_code, {CODES_SQL(f'list_extract({TYPED_FIELDS}, CAST(c_custkey % 6 + 1 AS BIGINT))', scalar.FIELDS)} AS field_code FROM customer JOIN nation ON n_nationkey = c_nationkey")
def alias_codes(t):
    """The codes behind the countries and fields of customers; null for what has none."""
    typed = F.get(F.array(*map(F.lit, TYPED_FIELDS)), (F.col("c_custkey") % 6).cast("int"))
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", scalar.mapped(F.col("n_name"), scalar.COUNTRIES).alias("country_code"), scalar.mapped(typed, scalar.FIELDS).alias("field_code"))


@query(
    "slug_disambiguation",
    f"SELECT p_partkey, CASE WHEN r = 1 THEN slug ELSE substr(slug, 1, 111) || '-' || p_partkey END AS slug FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS r FROM (SELECT p_partkey, {SLUG_SQL.format('p_name')} AS slug FROM part) a) b",
)
def slug_disambiguation(t):
    slugs = t.part.select("p_partkey", scalar.slug(F.col("p_name")).alias("slug"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    later = F.concat(F.substring("slug", 1, 111), F.lit("-"), F.col("p_partkey").cast("string"))
    return slugs.withColumn("place", place).select("p_partkey", F.when(F.col("place") == 1, F.col("slug")).otherwise(later).alias("slug"))


@query(
    "canonical_url",
    "SELECT page_id, lower(host) || coalesce(nullif(rtrim(substr(base, length(host) + 1), '/'), ''), '/') || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS url FROM "
    "(SELECT page_id, base, query, regexp_extract(base, '^[^/]+//[^/]*') AS host FROM (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS base, split_part(split_part(url, '#', 1), '?', 2) AS query FROM pages) a) b",
)
def canonical_url(t):
    return t.pages.select("page_id", scalar.canonical_url(F.col("url")).alias("url"))


EVIDENCE_SQL = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), "
    r"'<(h[1-6]|p|li|dt|dd|section|article|div)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\b[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\b', ' ', 'g'), '(?i)\b[a-f0-9]{12,}\b', ' ', 'g'), '\s+', ' ', 'g'))"
)


@query("html_evidence", f"SELECT page_id, length({EVIDENCE_SQL}) AS n_chars, sha256({EVIDENCE_SQL}) AS content_hash FROM pages")
def html_evidence(t):
    text = scalar.evidence_text(F.col("html"))
    return t.pages.select("page_id", F.length(text).cast("long").alias("n_chars"), scalar.content_hash(text).alias("content_hash"))


SECTION_SQL = """
WITH p AS (SELECT doc_id, text, lower(text) AS low FROM documents),
w AS (SELECT * FROM (VALUES (0, 'Deadline', 'deadline'), (0, 'Deadline', 'closing date'), (0, 'Deadline', 'application closes'), (0, 'Deadline', 'apply by'), (1, 'Eligibility', 'eligib'), (1, 'Eligibility', 'nationality'), (1, 'Eligibility', 'citizen'),
 (1, 'Eligibility', 'academic requirement'), (1, 'Eligibility', 'gpa'), (2, 'Funding', 'funding'), (2, 'Funding', 'tuition'), (2, 'Funding', 'stipend'), (2, 'Funding', 'allowance'), (2, 'Funding', 'coverage'), (2, 'Funding', 'benefit'),
 (3, 'Documents', 'document'), (3, 'Documents', 'transcript'), (3, 'Documents', 'recommendation'), (3, 'Documents', 'passport'), (3, 'Documents', 'cv'), (4, 'Application process', 'apply'), (4, 'Application process', 'application portal'),
 (4, 'Application process', 'application process'), (4, 'Application process', 'submit')) v(o, label, word)),
f AS (SELECT doc_id, min_by(label, pos * 10 + o) AS label, min(pos) AS pos FROM (SELECT doc_id, o, label, instr(low, word) AS pos FROM p, w) x WHERE pos > 0 GROUP BY 1)
SELECT doc_id, CASE WHEN length(text) < 20 THEN NULL ELSE coalesce(label, 'General scholarship evidence') END AS label,
 CASE WHEN length(text) < 20 THEN NULL WHEN label IS NULL THEN substr(text, 1, 500) ELSE trim(substr(text, greatest(1, pos - 120), 500), WHITE) END AS excerpt FROM p LEFT JOIN f USING (doc_id)
""".replace("WHITE", WHITE_SQL)


@query("evidence_section", SECTION_SQL)
def evidence_section(t):
    s = scalar.evidence_section(F.col("text"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", "s.label", "s.excerpt")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS valid FROM documents")
def content_hash(t):
    hashed = scalar.content_hash(F.col("text"))
    return t.documents.select("doc_id", hashed.alias("content_hash"), scalar.is_sha256(hashed).alias("valid"))


@query("normalized_text", r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS clean FROM documents")
def normalized_text(t):
    return t.documents.select("doc_id", scalar.squeezed(F.col("text")).alias("clean"))


@query("csv_cells", "SELECT doc_id, CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@') THEN '''' || text ELSE text END AS cell FROM documents")
def csv_cells(t):
    return t.documents.select("doc_id", scalar.csv_cell(F.col("text")).alias("cell"))


# Every third text gets carriage returns and tabs at its lines' ends, as uploads have them.
MARKED_SQL = "CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10) || chr(9)) ELSE text END"


@query("clean_lines", f"SELECT doc_id, length(text) AS n_before, (SELECT coalesce(string_agg(trim(l, {WHITE_SQL}), chr(10) ORDER BY i), '') FROM (SELECT unnest(string_split(marked, chr(10))) AS l, generate_subscripts(string_split(marked, chr(10)), 1) AS i) x WHERE trim(l, {WHITE_SQL}) <> '') AS clean FROM (SELECT *, {MARKED_SQL} AS marked FROM documents) d")
def clean_lines(t):
    marked = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n\t"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.length("text").cast("long").alias("n_before"), scalar.text_lines(marked).alias("clean"))


# Every eleventh page cannot be fetched.
FETCHED_SQL = f"SELECT page_id, url, {EVIDENCE_SQL} AS evidence, CASE WHEN page_id % 11 <> 5 THEN sha256({EVIDENCE_SQL}) END AS current, CASE WHEN page_id % 10 = 0 THEN NULL WHEN page_id % 3 = 0 THEN sha256(html) ELSE sha256({EVIDENCE_SQL}) END AS previous FROM pages"
CHANGED_SQL = f"SELECT *, CASE WHEN current IS NULL THEN 'failed' WHEN previous IS NULL THEN 'initialised' WHEN previous <> current THEN 'changed' ELSE 'unchanged' END AS change FROM ({FETCHED_SQL}) t"
CHANGE_SQL = f"SELECT page_id, change FROM ({CHANGED_SQL}) d"


def page_changes(t):
    text = scalar.evidence_text(F.col("html"))
    pages = t.pages.select("page_id", "url", "html", text.alias("evidence"))
    current = scalar.content_hash(F.col("evidence"))
    stored = pages.select("page_id", F.when(F.col("page_id") % 10 == 0, None).when(F.col("page_id") % 3 == 0, scalar.content_hash(F.col("html"))).otherwise(current).alias("content_hash"))
    return monitor.changes(stored, pages.select("page_id", "url", "evidence", F.when(F.col("page_id") % 11 != 5, current).alias("observed_hash")), "page_id")


@query("change_detection", CHANGE_SQL)
def change_detection(t):
    return page_changes(t).select("page_id", "change")


@query(
    "change_summary",
    f"SELECT count(*) AS candidates, count(*) FILTER (WHERE change <> 'failed') AS checked, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged, count(*) FILTER (WHERE change = 'initialised') AS initialised, count(*) FILTER (WHERE change = 'failed') AS failed FROM ({CHANGE_SQL}) c",
)
def change_summary(t):
    return monitor.summary(page_changes(t))


@query(
    "source_check_records",
    f"SELECT page_id, change, CASE change WHEN 'initialised' THEN 'Automated source monitor recorded initial content hash from ' WHEN 'changed' THEN 'Automated source monitor detected changed content at ' ELSE 'Automated source monitor found no content-hash change at ' END || url || '.' AS notes, "
    f"previous AS previous_hash, current AS current_hash, CASE WHEN change = 'changed' AND length(evidence) >= 20 THEN substr(evidence, 1, 500) END AS excerpt FROM ({CHANGED_SQL}) d WHERE change <> 'failed'",
)
def source_check_records(t):
    """The record of each check, with the excerpt of changed pages."""
    return monitor.records(page_changes(t), "page_id", "url", "evidence")


@query(
    "sources_after_check",
    f"SELECT page_id, coalesce(current, previous) AS content_hash, CASE WHEN change = 'changed' THEN 'needs_review' ELSE 'officially_verified' END AS verification_status, CASE WHEN current IS NULL THEN NULL ELSE TIMESTAMP '2024-01-20 00:00:00' END AS last_updated_at FROM ({CHANGED_SQL}) d",
)
def sources_after_check(t):
    """The sources as a run leaves them: hash, status and time of those that it could read."""
    found = page_changes(t)
    stored = found.select("page_id", "content_hash", F.lit("officially_verified").alias("verification_status"), F.lit(None).cast("timestamp_ntz").alias("last_updated_at"))
    return monitor.applied(stored, found, "page_id", clock(EVENT_CLOCK))


@query("hash_history", "SELECT o_custkey, o_orderkey, coalesce(lag(o_orderpriority) OVER w <> o_orderpriority, false) AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def hash_history(t):
    before = F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.coalesce(before != F.col("o_orderpriority"), F.lit(False)).alias("changed"))


@query("dup_pairs_exact", "SELECT a.doc_id AS doc_id, min(b.doc_id) AS first_id, count(*) AS copies FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) GROUP BY 1 HAVING count(*) > 1")
def dup_pairs_exact(t):
    return dedup.exact_groups(t.documents, "doc_id", scalar.content_hash(F.col("text"))).filter("copies > 1")


@query("dup_pairs_fuzzy")
def dup_pairs_fuzzy(t):
    """Parts that share a name, as members of a class, and names that are alike (0.8 or more) within a brand and type."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.concat_ws("|", "p_brand", "p_type").alias("block"))
    return dedup.class_suggestions(rows, least=0.8)


@query("retrieval_tokens", "SELECT conv_id, turn, coalesce(array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{3,}'), lambda x: x NOT IN ('a', 'an', 'and', 'are', 'for', 'from', 'how', 'i', 'in', 'is', 'me', 'of', 'or', 'scholarship', 'scholarships', 'the', 'to', 'what', 'with')), 1, 6), ' '), '') AS tokens FROM conversations")
def retrieval_tokens(t):
    return t.conversations.select("conv_id", "turn", F.array_join(scalar.query_tokens(F.col("text"), 6), " ").alias("tokens"))


@query(
    "intent_class",
    "SELECT conv_id, turn, CASE WHEN contains(l, 'changed') THEN 'what changed from source monitoring' WHEN contains(l, 'prioriti') OR contains(l, 'task') THEN 'application task prioritization' WHEN contains(l, 'progress') THEN 'private application progress summary' "
    "WHEN contains(l, 'deadline') OR contains(l, 'open') THEN 'deadline/status explanation' WHEN contains(l, 'fund') OR contains(l, 'coverage') THEN 'funding coverage explanation' WHEN contains(l, 'document') OR contains(l, 'requirement') THEN 'requirements checklist explanation' "
    "ELSE 'scholarship search' END AS intent FROM (SELECT conv_id, turn, lower(text) AS l FROM conversations) t",
)
def intent_class(t):
    return t.conversations.select("conv_id", "turn", scalar.intent(F.col("text")).alias("intent"))


# Questions for blocked phrases: the tables hold none, so each conversation's turn gets one, or a harmless one, by its id.
BLOCKED_PICK = "list_extract([" + ", ".join(f"'{b.title()}'" for b in scalar.BLOCKED) + ", 'what changed', 'my visa'], CAST(conv_id % 13 + 1 AS BIGINT))"


@query("blocked_terms", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(asked), '{b}')" for b in scalar.BLOCKED) + f" AS blocked FROM (SELECT *, text || ' ' || {BLOCKED_PICK} AS asked FROM conversations) c")
def blocked_terms(t):
    phrases = F.array(*[F.lit(b.title()) for b in scalar.BLOCKED], F.lit("what changed"), F.lit("my visa"))
    asked = F.concat("text", F.lit(" "), F.get(phrases, (F.col("conv_id") % 13).cast("int")))
    return t.conversations.select("conv_id", "turn", scalar.has_any(asked, scalar.BLOCKED).alias("blocked"))


TOKENS_SQL = "coalesce(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{3,}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in sorted(scalar.STOP_WORDS)) + ")), 1, 6), [])"
#: Candidates that a question's retrieval looks at.
SEEN = 32


@query(
    "retrieval",
    f"WITH q AS (SELECT DISTINCT conv_id, turn, {TOKENS_SQL} AS tokens FROM conversations WHERE role = 'user'), k AS (SELECT DISTINCT conv_id, turn, unnest(tokens) AS token FROM q), "
    "m AS (SELECT token, doc_id FROM (SELECT DISTINCT token FROM k) t JOIN documents ON contains(lower(text), token)), "
    "c AS (SELECT DISTINCT conv_id, turn, doc_id FROM k JOIN m USING (token) UNION ALL SELECT conv_id, turn, doc_id FROM q JOIN (SELECT DISTINCT doc_id FROM documents ORDER BY doc_id LIMIT 32) d ON len(tokens) = 0) "
    f"SELECT conv_id, turn, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY doc_id) AS nth FROM c) n WHERE nth <= {SEEN}",
)
def retrieval(t):
    """The first documents that hold one of a user turn's first six tokens anywhere, in words too; the first of all without tokens."""
    tokens = F.coalesce(scalar.query_tokens(F.col("text"), 6), F.array().cast("array<string>"))
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", tokens.alias("tokens")).distinct()
    records = t.documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("text"), F.lit(None).cast("string").alias("evidence"))
    return services.candidates(asked, records, ["conv_id", "turn"], SEEN, by_words=True).select("conv_id", "turn", F.explode("held.id").alias("doc_id"))


@query("post_search", "SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%th_t%' AND source NOT IN ('src1', 'src2') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
def post_search(t):
    visible = t.documents.filter(F.lower("text").like("%th_t%") & ~F.col("source").isin("src1", "src2"))
    return not_exists(visible, t.labels.filter("toxic = 1"), "doc_id").select("doc_id", "source")


@query("reply_counts", "SELECT conv_id, count(*) FILTER (WHERE turn > 0) AS total, count(*) FILTER (WHERE turn > 0 AND role <> 'assistant') AS visible FROM conversations GROUP BY 1")
def reply_counts(t):
    reply = F.col("turn") > 0
    return t.conversations.groupBy("conv_id").agg(F.count_if(reply).alias("total"), F.count_if(reply & (F.col("role") != "assistant")).alias("visible"))


@query("moderation_queue", "SELECT l.doc_id, coalesce(d.source, 'conversation') AS target, CASE WHEN d.doc_id IS NULL THEN c.text ELSE substr(d.text, 1, 180) END AS excerpt FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND l.doc_id % 2 = 0 LEFT JOIN conversations c ON c.conv_id = l.doc_id AND c.turn = 0 AND l.doc_id % 2 = 1 WHERE l.quality = 0 AND (d.doc_id IS NOT NULL OR c.conv_id IS NOT NULL)")
def moderation_queue(t):
    """Reports with what they report: a post or a reply, by the type that the report names, whatever else has that id."""
    kind = F.when(F.col("doc_id") % 2 == 0, "post").otherwise("reply")
    reports = t.labels.filter("quality = 0").select("doc_id", kind.alias("kind"))
    posts = t.documents.select("doc_id", F.lit("post").alias("kind"), F.col("source").alias("target"), F.substring("text", 1, 180).alias("excerpt"))
    replies = t.conversations.filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.lit("reply").alias("kind"), F.lit("conversation").alias("target"), F.col("text").alias("excerpt"))
    return reports.join(posts.unionByName(replies), ["doc_id", "kind"]).select("doc_id", F.coalesce("target", F.lit("conversation")).alias("target"), "excerpt")


@query("safe_erasure", "SELECT doc_id, CASE WHEN reported THEN 'anonymised' ELSE 'deleted' END AS action FROM (SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS reported FROM documents d WHERE source = 'src3') t")
def safe_erasure(t):
    own = flagged(t.documents.filter("source = 'src3'"), t.labels.filter("toxic = 1"), ["doc_id"], "reported")
    return own.select("doc_id", F.when(F.col("reported"), "anonymised").otherwise("deleted").alias("action"))


@query("erased_view", "SELECT doc_id, text FROM documents WHERE source <> 'src3' UNION ALL SELECT doc_id, '[removed]' FROM documents d WHERE source = 'src3' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def erased_view(t):
    own = t.documents.filter("source = 'src3'")
    kept = exists(own, t.labels.filter("toxic = 1"), "doc_id").select("doc_id", F.lit("[removed]").alias("text"))
    return t.documents.filter("source <> 'src3'").select("doc_id", "text").unionByName(kept)


@query(
    "policy_score",
    r"SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '(?i)(\b[\w.+-]+@[\w-]+\.[\w.-]+\b|\b(password|passcode|otp|verification code)\b)') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)(https?://|www\.|bit\.ly|tinyurl\.com|t\.me/|discord\.gg/)') THEN 2 ELSE 0 END AS BIGINT) AS score FROM documents",
)
def policy_score(t):
    text = F.col("text")
    score = F.when(scalar.policy_match(text, scalar.CONTACT), 5).otherwise(0) + F.when(scalar.policy_match(text, scalar.LINK), 2).otherwise(0)
    return t.documents.select("doc_id", score.cast("long").alias("score"))


def _re2(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("'", "''")


POINTS_SQL = f"CASE WHEN regexp_matches(text, '{_re2(scalar.CONTACT)}') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(text, '{_re2(scalar.OBFUSCATED)}') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(text, '{_re2(scalar.LINK)}') THEN 2 ELSE 0 END"


@query("policy_verdicts", f"SELECT doc_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 5 THEN 'contact' WHEN regexp_matches(text, '{_re2(scalar.PROHIBITED)}') THEN 'prohibited' ELSE 'ok' END AS verdict FROM (SELECT doc_id, text, {POINTS_SQL} AS score FROM documents) d")
def policy_verdicts(t):
    return t.documents.select("doc_id", scalar.policy_score(F.col("text")).cast("long").alias("score"), scalar.policy_verdict(F.col("text")).alias("verdict"))
