"""Multi-source event fusion and revision chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

# Source order of the announcement lane; a lane may prefer another order.
DEFAULT_PRIORITY = ("purchase", "signup", "view", "click", "error")


def provider_rank(provider: Column, priority: tuple[str, ...] = DEFAULT_PRIORITY) -> Column:
    return reduce(lambda acc, p: acc.when(provider == p[1], p[0]), enumerate(priority[1:], 1), F.when(provider == priority[0], 0))


def first_by_priority(rows: DataFrame, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Per key and attribute, the first non-null value in priority order.

    A minimum over structs aggregates on the map side, so no group is ever
    collected into a list.
    """
    return rows.groupBy(*keys).agg(
        *[F.min(F.when(F.col(n).isNotNull(), F.struct(*order, F.col(n)))).alias(n) for n in names]
    ).select(*keys, *[F.col(f"{n}.{n}").alias(n) for n in names])


# ---- source revisions -----------------------------------------------------------------


def revision_kinds(obs: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """Copies and distinct versions per provider revision.

    Two aggregations: equal copies collapse on the map side before versions of
    one revision meet.
    """
    versions = obs.groupBy(*key, *payload).agg(F.count(F.lit(1)).alias("_c"))
    g = versions.groupBy(*key).agg(F.sum("_c").alias("copies"), F.count(F.lit(1)).alias("versions"))
    kind = F.when(F.col("versions") > 1, "contradiction").when(F.col("copies") > 1, "duplicate").otherwise("unique")
    return g.withColumn("kind", kind)


# ---- identity -------------------------------------------------------------------------


def _candidates(rows: DataFrame, by: list[str], target: str) -> DataFrame:
    """Distinct targets per identity: how many, and which one if there is just one."""
    pairs = rows.filter(F.col(by[-1]).isNotNull()).select(*by, target).distinct()
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_one"))


def assign_identity(obs: DataFrame, scope: list[str], fact: str, document: str, title: str, day: str, id: str | None = None) -> DataFrame:
    """Identity of each observation: external fact, else document, else title and date.

    With ``id``, unique and not null, the lookups move only the columns that they compare and the rest joins at the end.

    An observation without a fact attaches to one when its document (or title
    and date) names exactly one; several candidates isolate it. Documents that
    share a title and date isolate each other. Lookup tables hold one row per
    identity, so joining a hot identity never multiplies rows.
    """
    if id is not None:
        told = assign_identity(obs.select(id, *scope, fact, document, title, day), scope, fact, document, title, day)
        return obs.join(told.select(id, "identity", "conflict"), id)
    td = [*scope, day, title]
    o = obs
    facts = o.filter(F.col(fact).isNotNull())
    doc_facts = _candidates(facts, [*scope, document], fact)
    title_facts = _candidates(facts, td, fact)
    clash = facts.join(
        doc_facts.filter("_n > 1").select(*scope, document), [*scope, document], "left_semi"
    ).select(*scope, fact).distinct().withColumn("_clash", F.lit(True))

    o = o.join(doc_facts.withColumnsRenamed({"_n": "_dn", "_one": "_df"}), [*scope, document], "left")
    o = o.join(title_facts.withColumnsRenamed({"_n": "_tn", "_one": "_tf"}), td, "left")
    own = F.col(fact).isNotNull()
    by_doc = ~own & (F.col("_dn") == 1)
    doc_unclear = ~own & (F.col("_dn") > 1)
    open_ = ~own & F.col("_dn").isNull()
    attached = F.when(own, F.col(fact)).when(by_doc, F.col("_df")).when(open_ & (F.col("_tn") == 1), F.col("_tf"))
    ambiguous = doc_unclear | (open_ & (F.col("_tn") > 1))
    o = o.withColumns({"_fact": attached, "_amb": F.coalesce(ambiguous, F.lit(False))}).drop("_dn", "_df", "_tn", "_tf")
    # the second stage reads the attached observations three times
    o = materialise(o, "attached")

    rest = F.col("_fact").isNull() & ~F.col("_amb")
    hashed = o.filter(rest & F.col(document).isNotNull())
    title_docs = _candidates(hashed, td, document)
    bad_docs = (
        hashed.join(title_docs.filter("_n > 1").select(*td), td, "left_semi")
        .select(*scope, document)
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    o = o.join(title_docs.withColumnsRenamed({"_n": "_hn", "_one": "_hd"}), td, "left")
    o = o.withColumn(
        "_doc",
        F.when(rest, F.coalesce(F.col(document), F.when(F.col("_hn") == 1, F.col("_hd")))),
    )
    lost = rest & F.col(document).isNull() & (F.col("_hn") > 1)
    o = o.withColumn("_lost", F.coalesce(lost, F.lit(False)))
    o = o.join(bad_docs.withColumnRenamed(document, "_doc"), [*scope, "_doc"], "left")
    o = o.join(clash.withColumnRenamed(fact, "_fact"), [*scope, "_fact"], "left")
    conflict = (
        F.when(F.col("_amb"), "ambiguous_external_fact_match")
        .when(F.col("_clash"), "external_fact_id_conflict")
        .when(F.col("_lost") | F.col("_bad"), "ambiguous_document_match")
    )
    identity = (
        F.when(F.col("_fact").isNotNull(), F.concat(F.lit("fact:"), F.col("_fact")))
        .when(F.col("_amb") | F.col("_lost"), F.lit(None))
        .when(F.col("_doc").isNotNull(), F.concat(F.lit("document:"), F.col("_doc")))
        .otherwise(F.concat(F.lit("title:"), F.col(title)))
    )
    return o.select(*obs.columns, identity.alias("identity"), conflict.alias("conflict"))


def shared_documents(obs: DataFrame, scope: list[str], fact: str, document: str, title: str, day: str) -> DataFrame:
    """Identities that point at several others: documents with several facts, titles with several documents."""
    d = _candidates(obs.filter(F.col(fact).isNotNull()), [*scope, document], fact).filter("_n > 1")
    t = _candidates(obs.filter(F.col(document).isNotNull()), [*scope, day, title], document).filter("_n > 1")
    a = d.select(*scope, F.lit("document").alias("kind"), F.col(document).alias("name"), F.col("_n").alias("candidates"))
    b = t.select(*scope, F.lit("title").alias("kind"), F.col(title).alias("name"), F.col("_n").alias("candidates"))
    return a.unionByName(b)


# ---- fusion ---------------------------------------------------------------------------

# Attributes that tell where an observation comes from, not what it says; names are compared in lower case.
PROVENANCE_NAMES = ("document_url", "ingested_at", "provider", "source_event_id", "source_url", "time_quality", "validation_status", "external_fact_id")
PROVENANCE_PREFIXES = ("raw_", "publisher", "extractor", "discovery")


def is_semantic(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda a, p: a & ~low.startswith(p), PROVENANCE_PREFIXES, ~low.isin(*PROVENANCE_NAMES))


def scalar_identity(value: Column) -> Column:
    """A JSON scalar so that equal values have equal texts: numbers without trailing zeros, everything else as it stands."""
    number = value.rlike(r"^-?[0-9]")
    plain = F.regexp_replace(F.when(number, value).cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.when(number, plain).otherwise(value)


def long_attributes(obs: DataFrame, columns: list[str], attributes: str) -> DataFrame:
    """One row (columns, name, value) for each entry of the attribute map; values are JSON scalars."""
    return obs.select(*columns, F.explode(attributes).alias("name", "value"))


def critical_conflicts(obs: DataFrame, keys: list[str], fields: dict[str, Column], fact: str | None = None, dated: str | None = None,
                       attributes: str | None = None) -> DataFrame:
    """(keys, code, name): one row for each way in which the observations of an identity disagree.

    ``fields`` maps a conflict code to the column that must not differ among the rows that state it. The code ``dated`` does not
    count where all stated external facts are one. ``attributes``, a map of JSON scalars, adds ``attribute_conflict`` for each
    semantic name with several values; a stated null is a value. Minima and maxima only: no group is collected.
    """
    spread = {n: F.coalesce(F.min(c) != F.max(c), F.lit(False)) for n, c in fields.items()}
    if dated is not None:
        spread[dated] = spread[dated] & F.coalesce(F.min(fact) != F.max(fact), F.lit(True))
    g = obs.groupBy(*keys).agg(*[c.alias(n) for n, c in spread.items()])
    named = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in fields]))
    out = g.select(*keys, F.explode(named).alias("code"), F.lit(None).cast("string").alias("name"))
    if attributes is None:
        return out
    said = long_attributes(obs, keys, attributes).filter(is_semantic(F.col("name"))).withColumn("_v", scalar_identity(F.col("value")))
    split = said.groupBy(*keys, "name").agg((F.min("_v") != F.max("_v")).alias("_split")).filter("_split")
    return out.unionByName(split.select(*keys, F.lit("attribute_conflict").alias("code"), "name"))


def fuse(obs: DataFrame, keys: list[str], rank: str, id: str, available: str, carry: list[str], conflicts: DataFrame, best_rank: int = 0,
         attributes: str | None = None) -> DataFrame:
    """One fused event per identity.

    The source order is fixed; the first source with a usable time is selected, and what it does not state is filled from the
    others in order, usable or not. Coverage says how much of the event can be traded on.

    ``attributes``, a map of JSON scalars, is fused by name in long form and folded back to a map: only names meet in a group,
    never its observations. A stated null is a value and is not filled.
    """
    usable = F.when(F.col(available).isNotNull(), 0).otherwise(1)

    def chosen(value: Column, stated: Column) -> list[Column]:
        """The value of the best source that states it, with and without regard to its time."""
        lead = F.min(F.when(stated, F.struct(usable.alias("u"), F.col(rank), F.col(id), value.alias("v"))))
        return [lead.alias("_lead"), F.min(F.when(stated, F.struct(F.col(rank), F.col(id), value.alias("v")))).alias("_fill")]

    def filled(lead: Column, fill: Column) -> Column:
        return F.when(lead[id] == F.col(f"_s.{id}"), lead["v"]).otherwise(fill["v"])

    first = F.min(F.struct(usable.alias("u"), F.col(rank), F.col(id), F.col(available)))
    kept = {c: F.struct(*chosen(F.col(c), F.col(c).isNotNull())) for c in carry}
    g = obs.groupBy(*keys).agg(first.alias("_s"), F.count(F.lit(1)).alias("sources"), *[v.alias(f"_f_{c}") for c, v in kept.items()])
    bad = conflicts.select(*keys).distinct().withColumn("_bad", F.lit(True))
    g = g.join(bad, keys, "left")
    coverage = (
        F.when(F.col("_bad"), "conflicted")
        .when(F.col("_s.u") == 1, "unavailable")
        .when(F.col(f"_s.{rank}") == best_rank, "complete")
        .otherwise("partial")
    )
    out = [
        F.col(f"_s.{id}").alias("selected"),
        F.when(F.col("_bad").isNull(), F.col(f"_s.{available}")).alias("available_at"),
        "sources",
        *[filled(F.col(f"_f_{c}._lead"), F.col(f"_f_{c}._fill")).alias(c) for c in carry],
        coverage.alias("coverage"),
    ]
    if attributes is not None:
        said = long_attributes(obs, [*keys, rank, id, available], attributes)
        by_name = said.groupBy(*keys, "name").agg(*chosen(F.col("value"), F.lit(True)))
        folded = by_name.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("name", "_lead", "_fill"))).alias("_names"))
        g = g.join(folded, keys, "left")
        entries = F.transform("_names", lambda x: F.struct(x["name"].alias("name"), filled(x["_lead"], x["_fill"]).alias("value")))
        out.append(F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<name:string,value:string>>"))).alias(attributes))
    return g.select(*keys, *out)


def provenance(obs: DataFrame, fused: DataFrame, keys: list[str], rank: str, id: str, columns: list[str]) -> DataFrame:
    """The sources of every fused event, one row each with ``selected`` and the source order; never one list per event."""
    picked = fused.select(*keys, F.col("selected").alias("_selected"))
    return obs.join(picked, keys).select(*keys, id, rank, *columns, (F.col(id) == F.col("_selected")).alias("selected"))


# ---- revision chains --------------------------------------------------------------------

# Spellings of the three revision roles.
ROLES = {
    "initial": ("initial", "initial_or_explicit_lifecycle", "original"),
    "supersession": ("amendment", "amended", "correction", "corrected", "revision", "supersession"),
    "withdrawal": ("cancellation", "cancelled", "delete", "revoked", "withdrawal", "withdrawn"),
}


def revision_role(raw: Column, revision_no: Column) -> Column:
    """Role of a revision; an unnamed revision zero is initial, anything unknown stays NULL."""
    text = F.lower(F.trim(raw))
    named = F.coalesce(*[F.when(text.isin(*words), F.lit(role)) for role, words in ROLES.items()])
    return F.when(raw.isNull(), F.when(revision_no == 0, "initial")).otherwise(named)


def resolve_chains(obs: DataFrame, keys: list[str], revision: str, role: str, available: str, cutoff: Column,
                   source: list[str] | None = None, content: list[str] | None = None, constant: list[str] | None = None,
                   fact: str | None = None, semantic: list[str] | None = None) -> DataFrame:
    """State of every revision chain from what was visible at a cut-off.

    Optional checks: ``source`` (provider first) and ``content`` name a provider's record and its immutable columns, ``constant``
    columns that a chain cannot mix, ``fact`` its external id, ``semantic`` columns in which the providers of one revision must
    agree where they state them. Whole-chain checks come first; then revisions are walked in order and the first bad one counts.
    """
    seen = F.col(available) <= cutoff
    differs = lambda c: (F.min(c) != F.max(c)) | (F.count(c).between(1, F.count(F.lit(1)) - 1))  # noqa: E731  a null beside a value differs
    varies = lambda c: F.coalesce(F.min(F.when(seen, F.col(c))) != F.max(F.when(seen, F.col(c))), F.lit(False))
    several = F.lit(False)
    for c in semantic or []:
        several = several | varies(c)
    if semantic:
        several = several & varies(source[0])
    per_revision = obs.groupBy(*keys, revision).agg(
        F.count_if(F.col(available).isNull()).alias("_untimed"), F.count_if(seen).alias("_seen"),
        F.min(F.when(seen, F.col(role))).alias("_r0"), F.max(F.when(seen, F.col(role))).alias("_r1"),
        F.count_if(seen & F.col(role).isNull()).alias("_unnamed"), several.alias("_several"),
    )
    r = F.col(revision)
    problem = (
        F.when(F.col("_seen") == 0, None)
        .when(F.col("_unnamed") > 0, "unknown_revision_role")
        .when(F.col("_r0") != F.col("_r1"), "multi_source_revision_conflict")
        .when(F.col("_several"), "multi_source_revision_semantic_conflict")
        .when((r == 0) != (F.col("_r0") == "initial"), "invalid_revision_sequence")
    )
    g = per_revision.withColumn("_problem", problem).groupBy(*keys).agg(
        F.sum("_untimed").alias("_untimed"),
        F.count_if(F.col("_seen") > 0).alias("revisions"),
        F.max(F.when(F.col("_seen") > 0, r)).alias("latest_revision"),
        F.min_by("_problem", F.when(F.col("_problem").isNotNull(), r)).alias("_problem"),
        F.max_by("_r0", F.when(F.col("_seen") > 0, r)).alias("_role"),
    )
    state = F.when(F.lit(False), "")
    if content:
        record = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
        told = obs.groupBy(*keys, *source, revision).agg((F.min(record) != F.max(record)).alias("_split"))
        g = g.join(told.groupBy(*keys).agg(F.bool_or("_split").alias("_split")), keys)
        state = state.when(F.col("_split"), "contradictory_provider_revision")
    if constant or fact:
        mixed, checks = F.lit(False), []
        for c in constant or []:
            mixed = mixed | differs(F.col(c))
        checks.append(F.coalesce(mixed, F.lit(False)).alias("_mixed"))
        named, rows = F.count(fact) if fact else F.lit(1), F.count(F.lit(1))
        checks.append(((named > 0) & ((named < rows) | (F.min(fact) != F.max(fact))) if fact else F.lit(False)).alias("_other_fact"))
        origin = F.to_json(F.struct(*source), {"ignoreNullFields": "false"}) if fact else F.lit("")
        checks.append(((named == 0) & (F.min(origin) != F.max(origin))).alias("_no_fact"))
        g = g.join(obs.groupBy(*keys).agg(*checks), keys)
        state = (state.when(F.col("_mixed"), "mixed_event_chain").when(F.col("_other_fact"), "conflicting_revision_chain_identity")
                 .when(F.col("_no_fact"), "missing_revision_chain_identity"))
    state = (
        state.when(F.col("_untimed") > 0, "missing_reliable_first_available_at")
        .when(F.col("revisions") == 0, "not_yet_available")
        .when(F.col("latest_revision") + 1 != F.col("revisions"), "revision_gap")
        .when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(F.col("_role") == "withdrawal", "withdrawn")
        .otherwise("active")
    )
    g = g.withColumn("state", state)
    resolved = F.col("state").isin("active", "withdrawn")
    return g.select(*keys, "revisions", "latest_revision", "state", F.when(F.col("state") == "active", F.col("latest_revision")).alias("active_revision"),
                    F.when(resolved, F.col("revisions") - 1).alias("superseded"))


def first_matching(events: DataFrame, key: str, matches: Column, order: list[str]) -> DataFrame:
    """Earliest revision of each event that satisfies the filter; later ones never rewrite it."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.filter(matches).groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_m")).select(key, "_m.*")


def session_events(events: DataFrame, sessions: DataFrame, instrument: str, id: str, available: str) -> DataFrame:
    """Events placed on their first session; only those at the session's earliest instant trigger it."""
    from tidemark.operators.asof import next_own_session

    e = events.withColumn("_day", F.to_date(available))
    placed = next_own_session(e, sessions, [instrument], "_day", "session_date").filter("session_date is not null").drop("_day")
    first = placed.groupBy(instrument, "session_date").agg(F.min(available).alias("_first"))
    hit = placed.join(first, [instrument, "session_date"]).filter(F.col(available) == F.col("_first"))
    return hit.select(instrument, "session_date", id, F.col(available).alias("available_at"))
