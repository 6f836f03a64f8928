"""Operators of the services around the catalogue: retrieval with evidence, verification, moderation, seats, jobs, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import flagged
from .search import first_holding, first_matches

# What a verification status makes of its record, and what a moderation action makes of its target.
VERIFICATION_STATUS = {"expired": "expired", "needs_review": "draft", "unverified": "draft", "conflicting_information": "draft"}
MODERATION = {"hide": ("content", "hidden"), "restore": ("content", "visible"), "suspend": ("member", "suspended"), "reinstate": ("member", "active"), "resolve": ("report", "resolved")}
#: States of an application before it is submitted.
BEFORE_SUBMISSION = ["interested", "researching", "preparing_documents", "waiting_for_recommendation", "ready_to_apply"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def evidence_state(records: DataFrame, sources: DataFrame, key: str, fresh: Column) -> DataFrame:
    """records with evidence: conflicting (any disqualifying source), unverified (no verified one), stale (none fresh), else accepted.

    sources has key, disqualifying, verified and the columns of `fresh`.
    """
    facts = sources.groupBy(key).agg(F.bool_or("disqualifying").alias("_bad"), F.bool_or("verified").alias("_good"), F.bool_or(F.col("verified") & fresh).alias("_fresh"))
    state = F.when(F.coalesce("_bad", F.lit(False)), "conflicting").when(~F.coalesce("_good", F.lit(False)), "unverified").when(~F.coalesce("_fresh", F.lit(False)), "stale").otherwise("accepted")
    return records.join(facts, key, "left").withColumn("evidence", state).drop("_bad", "_good", "_fresh")


def candidates(questions: DataFrame, records: DataFrame, keys: list[str], seen: int, by_words: bool = False) -> DataFrame:
    """keys and held: the first `seen` records by id, as structs (id, evidence), whose text holds a token of the question.

    questions has keys and tokens (at most a handful each); records has id, text (lower case) and evidence. Any record
    is a candidate of a question without tokens. A token's candidates are found once, through a trigram index over the
    texts, or with `by_words` over their words: that takes tokens of a-z and 0-9 only, three characters or more.
    """
    asked = questions.select(*keys, F.explode("tokens").alias("pattern")).distinct()
    by_token = (first_holding if by_words else first_matches)(asked.select("pattern"), records, seen)
    merged = asked.join(by_token, "pattern").groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))), 1, seen).alias("held"))
    any_ = records.select("id", "evidence").distinct().orderBy("id").limit(seen).agg(F.sort_array(F.collect_list(F.struct("id", "evidence"))).alias("any"))
    out = questions.select(*keys, (F.size("tokens") == 0).alias("open")).distinct().join(merged, keys, "left").join(F.broadcast(any_))  # one row
    return out.select(*keys, F.when(F.col("open"), F.col("any")).otherwise(F.coalesce("held", F.slice("any", 1, 0))).alias("held"))


def retrieved(questions: DataFrame, records: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """keys, accepted (ids, at most `most`), and the numbers rejected as unverified, stale or conflicting.

    The first 4 * most candidates() of a question are looked at.
    """
    out = candidates(questions, records, keys, 4 * most, by_words=True)
    count = lambda s: F.size(F.filter("held", lambda x: x.evidence == s)).cast("long").alias(s)
    accepted = F.slice(F.transform(F.filter("held", lambda x: x.evidence == "accepted"), lambda x: x.id), 1, most)
    return out.select(*keys, accepted.alias("accepted"), count("unverified"), count("stale"), count("conflicting"))


def claims(answers: DataFrame, keys: list[str], citations: DataFrame) -> DataFrame:
    """keys, claim_key (claim-1 on, in order), id, and the columns of citations (id, ...) if there is one."""
    placed = answers.select(*keys, F.posexplode("accepted").alias("at", "id"))
    return placed.join(citations, "id", "left").withColumn("claim_key", F.concat(F.lit("claim-"), (F.col("at") + 1).cast("string"))).drop("at")


def verified(records: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """records with the status that their verification update (key, verification_status) gives them."""
    return records.join(updates, key, "left").withColumn("status", F.coalesce(_lookup(VERIFICATION_STATUS, F.col("verification_status")), F.col("status")))


def picked_source(requests: DataFrame, sources: DataFrame, record: str, source: str) -> DataFrame:
    """requests (record, source or null) with outcome: picked, source_required (several or none) or source_not_found; and the source."""
    counts = sources.groupBy(F.col(record).alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.min(source).alias("_only"))
    own = sources.select(F.col(record).alias("_or"), F.col(source).alias("_os")).distinct()
    joined = requests.join(counts, F.col(record) == F.col("_r"), "left").join(own, (F.col(record) == F.col("_or")) & (F.col(source) == F.col("_os")), "left")
    none = F.col(source).isNull()
    outcome = F.when(none & (F.coalesce("_n", F.lit(0)) == 1), "picked").when(none, "source_required").when(F.col("_os").isNull(), "source_not_found").otherwise("picked")
    chosen = F.when(outcome == "picked", F.coalesce(F.col(source), F.col("_only")))
    return joined.select(*requests.columns, outcome.alias("outcome"), chosen.alias("chosen"))


def decided(suggestions: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """suggestions with status pending, confirmed_duplicate or dismissed by the decisions (key, is_duplicate)."""
    joined = suggestions.join(decisions, key, "left")
    status = F.when(F.col("is_duplicate").isNull(), "pending").when(F.col("is_duplicate"), "confirmed_duplicate").otherwise("dismissed")
    return joined.withColumn("status", status).drop("is_duplicate")


def pending_queue(suggestions: DataFrame, most: int = 50) -> DataFrame:
    """What is to be decided next: pending suggestions by falling score, then the time of their making and id."""
    return suggestions.filter("status = 'pending'").orderBy(F.desc("score"), "created_at", "id").limit(most)


def moderated(actions: DataFrame, targets: DataFrame) -> DataFrame:
    """actions (action, target_id) with outcome (applied, not_found or unsupported), target_type and the target's new status.

    targets has target_type (content, member, report) and target_id.
    """
    kind = _lookup({a: k for a, (k, _) in MODERATION.items()}, F.col("action"))
    typed = actions.withColumn("target_type", kind)
    found = flagged(typed, targets, ["target_type", "target_id"], "_found")
    outcome = F.when(F.col("target_type").isNull(), "unsupported").when(F.col("_found"), "applied").otherwise("not_found")
    status = _lookup({a: s for a, (_, s) in MODERATION.items()}, F.col("action"))
    return found.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "applied", status)).drop("_found")


def invitation_state(reserved: Column, verified_at: Column, expires: Column, now: Column) -> Column:
    """An invitation's state: redeemed if it was reserved and verified before it expired, expired once its time is up, reserved or pending before."""
    redeemed = reserved.isNotNull() & (reserved < expires) & verified_at.isNotNull() & (verified_at >= reserved) & (verified_at < expires)
    return F.when(F.coalesce(redeemed, F.lit(False)), "redeemed").when(expires <= now, "expired").when(reserved.isNotNull(), "reserved").otherwise("pending")


def submitted_ok(state: Column, submitted_at: Column) -> Column:
    """A submission date is not allowed in a state before submission."""
    return ~(submitted_at.isNotNull() & state.isin(*BEFORE_SUBMISSION))


def intake_readiness(scanner: Column, production: Column, enabled: Column, completed: Column, error: Column, now: Column, minutes: int) -> Column:
    """(scanner_ready, worker_ready, accepting): from the scanner's name, the last completed job and its error."""
    scanner_ready = F.coalesce((scanner == "clamav") | (~production & (scanner == "test")), F.lit(False))
    worker_ready = F.coalesce(completed >= now - F.make_dt_interval(mins=F.lit(minutes)), F.lit(False)) & error.isNull()
    return F.struct(scanner_ready.alias("scanner_ready"), worker_ready.alias("worker_ready"), (enabled & (~production | (scanner_ready & worker_ready))).alias("accepting"))


def document_stage(clean: Column, text: Column, most: int) -> Column:
    """Where a document's jobs end: scan, extract or analyse, and the failure code, null where analysis went through."""
    body = F.coalesce(text, F.lit(""))
    code = F.when(~clean, "malware_detected").when(F.length(body) == 0, "no_text_found").when(F.length(body) > most, "text_too_long")
    return F.struct(F.when(~clean, "scan").when(code.isNotNull(), "extract").otherwise("analyse").alias("stage"), code.alias("failure_code"))


def feedback_items(**lists: Column) -> Column:
    """Lists of feedback by category as one array of (category, text), in the order given; null lists have none."""

    def labelled(category: str, items: Column) -> Column:
        return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.struct(F.lit(category).alias("category"), x.alias("text")))

    return F.flatten(F.array(*[labelled(c, items) for c, items in lists.items()]))
