"""Published event fusion, revision and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import DAILY, Axis, crosses_above, crosses_below
from tidemark.functions.recurrence import discounted_sums
from tidemark.operators import events as E
from tidemark.plans.joins import FACTS, KEYS, sessions_of
from tidemark.plans.registry import query
from tidemark.plans.atoms import FFILL_PE
from tidemark.plans.sql import BARS, NUMBERED, cross, lag, roll
from tidemark.plans.text import KEYK
from tidemark.session import materialise
from tidemark.sources import market as mk
from tidemark.sources.tables import table

RANK = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"
OBS = f"""e0 AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type AS provider, {RANK} AS rank, {KEYK} AS k, value, ts FROM events),
ob AS (SELECT *, 'code' || k % 2 AS event_code, 'Notice ' || k % 7 AS title, CASE WHEN k % 3 = 0 THEN 'doc' || user_id % 50 || '-' || k % 5 END AS document,
 CASE WHEN k % 5 = 0 THEN 'fact' || user_id || '-' || k % 4 END AS fact, k % 3 AS revision_no, CASE WHEN value > 50 THEN 'up' ELSE 'down' END AS direction,
 CASE WHEN value < 100 AND k % 11 <> 0 THEN CASE WHEN date_trunc('second', ts) = ts THEN ts ELSE date_trunc('second', ts) + INTERVAL 1 SECOND END + to_seconds(k) END AS available,
 ['initial', 'Amended', 'withdrawn', NULL, 'odd', 'original', 'correction', NULL][k % 8 + 1] AS revision_type,
 CASE WHEN k % 4 <> 0 THEN day - CAST(k % 2 AS INT) END AS occurred FROM e0)"""
# Attributes of an observation: name, when it is stated, its JSON scalar. Two ways to write a number, a boolean, a stated null.
ATTRIBUTES = """atr AS (SELECT * FROM (SELECT *, unnest([{'n': 'direction', 'v': '"' || direction || '"'}, {'n': 'amount', 'v': CASE WHEN k % 3 <> 2 THEN CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR) || CASE WHEN k % 2 = 0 THEN '.50' ELSE '.5' END END},
 {'n': 'audited', 'v': CASE WHEN k % 5 = 1 THEN CASE WHEN value > 50 THEN 'true' ELSE 'false' END END}, {'n': 'counterparty', 'v': CASE WHEN k % 4 = 3 THEN '"c' || user_id % 2 || '"' WHEN k % 4 = 2 THEN 'null' END},
 {'n': 'raw_notice_date', 'v': '"' || day || '"'}, {'n': 'publisher_desk', 'v': CASE WHEN k % 2 = 0 THEN '"' || provider || '"' END}, {'n': 'Time_Quality', 'v': CASE WHEN available IS NOT NULL THEN '"second"' END}]) AS a FROM TABLE) WHERE a.v IS NOT NULL)"""


def observations(spark, folder):
    """Each stored event read as one provider's view of a disclosed event."""
    from tidemark.functions.text import market_time

    k = F.col("k")
    e = table(spark, folder, "events").select(
        "event_id", "user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("provider"), E.provider_rank(F.col("event_type")).alias("rank"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "value", "ts")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = lambda c: c.cast("string")
    vendor = F.col("ts") + F.make_dt_interval(secs=k.cast("decimal(18,6)"))
    roles = F.array(*[F.lit(x) for x in ("initial", "Amended", "withdrawn", None, "odd", "original", "correction", None)])
    return e.withColumns({
        "event_code": text("code", n(k % 2)), "title": text("Notice ", n(k % 7)),
        "document": F.when(k % 3 == 0, text("doc", n(F.col("user_id") % 50), "-", n(k % 5))),
        "fact": F.when(k % 5 == 0, text("fact", n(F.col("user_id")), "-", n(k % 4))), "revision_no": k % 3,
        "direction": F.when(F.col("value") > 50, "up").otherwise("down"),
        "available": market_time(F.col("ts"), vendor, F.col("value") < 100, k % 11 != 0),
        "revision_type": F.element_at(roles, (k % 8 + 1).cast("int")),
        "occurred": F.when(k % 4 != 0, F.date_sub("day", (k % 2).cast("int"))),
    }).withColumn("attributes", stated_attributes())


def stated_attributes():
    k, quoted = F.col("k"), lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    half = F.concat((F.floor("value") % 2).cast("string"), F.when(k % 2 == 0, ".50").otherwise(".5"))
    values = {
        "direction": quoted(F.col("direction")), "amount": F.when(k % 3 != 2, half),
        "audited": F.when(k % 5 == 1, F.when(F.col("value") > 50, "true").otherwise("false")),
        "counterparty": F.when(k % 4 == 3, F.concat(F.lit('"c'), (F.col("user_id") % 2).cast("string"), F.lit('"'))).when(k % 4 == 2, "null"),
        "raw_notice_date": quoted(F.col("day")), "publisher_desk": F.when(k % 2 == 0, quoted(F.col("provider"))),
        "Time_Quality": F.when(F.col("available").isNotNull(), '"second"'),
    }
    return F.map_filter(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())


REVKEY = "provider, user_id, day, revision_no"


@query("e01_provider_revisions", f"""WITH {OBS} SELECT {REVKEY}, count(*) AS copies, count(DISTINCT direction) AS versions,
 CASE WHEN count(DISTINCT direction) > 1 THEN 'contradiction' WHEN count(*) > 1 THEN 'duplicate' ELSE 'unique' END AS kind FROM ob GROUP BY ALL""")
def e01(spark, folder):
    return E.revision_kinds(observations(spark, folder), ["provider", "user_id", "day", "revision_no"], ["direction"])


SC = "user_id, event_code"
IDENT = f"""{OBS},
df AS (SELECT {SC}, document, count(DISTINCT fact) AS n, min(fact) AS f FROM ob WHERE fact IS NOT NULL AND document IS NOT NULL GROUP BY ALL),
tf AS (SELECT {SC}, day, title, count(DISTINCT fact) AS n, min(fact) AS f FROM ob WHERE fact IS NOT NULL GROUP BY ALL),
cf AS (SELECT DISTINCT {SC}, fact FROM ob JOIN df USING ({SC}, document) WHERE fact IS NOT NULL AND n > 1),
s1 AS (SELECT ob.*, CASE WHEN fact IS NOT NULL THEN fact WHEN df.n = 1 THEN df.f WHEN df.n IS NULL AND tf.n = 1 THEN tf.f END AS af,
  fact IS NULL AND (coalesce(df.n, 0) > 1 OR (df.n IS NULL AND coalesce(tf.n, 0) > 1)) AS amb FROM ob LEFT JOIN df USING ({SC}, document) LEFT JOIN tf USING ({SC}, day, title)),
hs AS (SELECT * FROM s1 WHERE af IS NULL AND NOT amb AND document IS NOT NULL),
td2 AS (SELECT {SC}, day, title, count(DISTINCT document) AS n, min(document) AS d FROM hs GROUP BY ALL),
bd2 AS (SELECT DISTINCT {SC}, document FROM hs JOIN td2 USING ({SC}, day, title) WHERE n > 1),
s2 AS (SELECT s1.*, CASE WHEN af IS NULL AND NOT amb THEN coalesce(document, CASE WHEN n = 1 THEN d END) END AS ad, af IS NULL AND NOT amb AND document IS NULL AND coalesce(n, 0) > 1 AS lost FROM s1 LEFT JOIN td2 USING ({SC}, day, title)),
id AS (SELECT s2.*, CASE WHEN amb THEN 'ambiguous_external_fact_match' WHEN cf.fact IS NOT NULL THEN 'external_fact_id_conflict' WHEN lost OR bd2.document IS NOT NULL THEN 'ambiguous_document_match' END AS conflict,
  CASE WHEN af IS NOT NULL THEN 'fact:' || af WHEN amb OR lost THEN NULL WHEN ad IS NOT NULL THEN 'document:' || ad ELSE 'title:' || title END AS identity
  FROM s2 LEFT JOIN bd2 ON bd2.user_id = s2.user_id AND bd2.event_code = s2.event_code AND bd2.document = s2.ad
  LEFT JOIN cf ON cf.user_id = s2.user_id AND cf.event_code = s2.event_code AND cf.fact = s2.af)"""
SCOPE = ["user_id", "event_code"]


def identified(spark, folder):
    return E.assign_identity(observations(spark, folder), SCOPE, "fact", "document", "title", "day", "event_id")


@query("e02_identity", f"WITH {IDENT} SELECT event_id, identity, conflict FROM id")
def e02(spark, folder):
    o = E.assign_identity(observations(spark, folder).select("event_id", *SCOPE, "fact", "document", "title", "day"), SCOPE, "fact", "document", "title", "day")
    return o.select("event_id", "identity", "conflict")


@query("e03_shared_identities", f"""WITH {OBS} SELECT {SC}, 'document' AS kind, document AS name, count(DISTINCT fact) AS candidates FROM ob WHERE fact IS NOT NULL AND document IS NOT NULL GROUP BY ALL HAVING count(DISTINCT fact) > 1
UNION ALL SELECT user_id, event_code, 'title', title, n FROM (SELECT {SC}, day, title, count(DISTINCT document) AS n FROM ob WHERE document IS NOT NULL GROUP BY ALL) WHERE n > 1""")
def e03(spark, folder):
    return E.shared_documents(observations(spark, folder), SCOPE, "fact", "document", "title", "day")


# title identities are per day, so the local date is part of the group key
GROUPED = f"""{IDENT}, gp AS (SELECT *, identity || CASE WHEN identity LIKE 'title:%' THEN '@' || day ELSE '' END AS gid FROM id WHERE conflict IS NULL AND identity IS NOT NULL),
{ATTRIBUTES.replace("TABLE", "gp")},
cc AS (SELECT {SC}, gid, unnest([{{'code': 'external_fact_id_conflict', 'bad': coalesce(min(fact) <> max(fact), false)}}, {{'code': 'occurred_at_conflict', 'bad': count(DISTINCT occurred) > 1}},
  {{'code': 'announcement_date_conflict', 'bad': min(day) <> max(day) AND count(DISTINCT fact) <> 1}}]) AS c FROM gp GROUP BY {SC}, gid),
ac AS (SELECT {SC}, gid, c.code AS code, CAST(NULL AS VARCHAR) AS name FROM cc WHERE c.bad UNION ALL
  SELECT {SC}, gid, 'attribute_conflict', a.n FROM atr WHERE a.n NOT IN ('raw_notice_date', 'publisher_desk', 'Time_Quality')
  GROUP BY {SC}, gid, a.n HAVING count(DISTINCT CASE WHEN a.n = 'amount' THEN CAST(TRY_CAST(a.v AS DOUBLE) AS VARCHAR) ELSE a.v END) > 1)"""
GROUP = ["user_id", "event_code", "gid"]


def grouped(spark, folder):
    o = identified(spark, folder).filter("conflict is null and identity is not null")
    dated = F.when(F.col("identity").startswith("title:"), F.concat(F.lit("@"), F.col("day").cast("string"))).otherwise("")
    return o.withColumn("gid", F.concat("identity", dated))


def conflicts_of(o):
    fields = {"external_fact_id_conflict": F.col("fact"), "instrument_conflict": F.col("user_id"), "event_code_conflict": F.col("event_code"),
              "occurred_at_conflict": F.col("occurred"), "announcement_date_conflict": F.col("day")}
    return E.critical_conflicts(o, GROUP, fields, "fact", "announcement_date_conflict", "attributes")


@query("e05_critical_conflicts", f"WITH {GROUPED} SELECT {SC}, gid, code, name FROM ac")
def e05(spark, folder):
    return conflicts_of(grouped(spark, folder))


@query("e05_document_conflicts", f"""WITH {OBS}, dc AS (SELECT document, unnest([{{'code': 'external_fact_id_conflict', 'bad': count(DISTINCT fact) > 1}}, {{'code': 'instrument_conflict', 'bad': count(DISTINCT user_id) > 1}},
 {{'code': 'event_code_conflict', 'bad': count(DISTINCT event_code) > 1}}, {{'code': 'occurred_at_conflict', 'bad': count(DISTINCT occurred) > 1}},
 {{'code': 'announcement_date_conflict', 'bad': count(DISTINCT day) > 1 AND count(DISTINCT fact) <> 1}}]) AS c FROM ob WHERE document IS NOT NULL GROUP BY 1) SELECT document, c.code AS code, CAST(NULL AS VARCHAR) AS name FROM dc WHERE c.bad""")
def e05_documents(spark, folder):
    """Observations that name one document, whatever instrument and event code they give it."""
    o = observations(spark, folder).filter("document is not null")
    fields = {"external_fact_id_conflict": F.col("fact"), "instrument_conflict": F.col("user_id"), "event_code_conflict": F.col("event_code"),
              "occurred_at_conflict": F.col("occurred"), "announcement_date_conflict": F.col("day")}
    return E.critical_conflicts(o, ["document"], fields, "fact", "announcement_date_conflict")


FUSED = f"""{GROUPED},
sl AS (SELECT *, first_value(event_id) OVER (PARTITION BY {SC}, gid ORDER BY available IS NULL, rank, event_id) AS sel FROM gp),
fu AS (SELECT {SC}, gid, any_value(sel) AS selected, arg_min(rank, {{'s': event_id <> sel, 'r': rank, 'e': event_id}}) AS sr, max(CASE WHEN event_id = sel THEN available END) AS av, count(*) AS sources, bool_and(available IS NULL) AS untimed,
 arg_min(fact, {{'s': event_id <> sel, 'r': rank, 'e': event_id}}) FILTER (WHERE fact IS NOT NULL) AS fact, arg_min(document, {{'s': event_id <> sel, 'r': rank, 'e': event_id}}) FILTER (WHERE document IS NOT NULL) AS document FROM sl GROUP BY ALL),
an AS (SELECT {SC}, gid, a.n AS n, arg_min(a.v, {{'s': event_id <> sel, 'r': atr.rank, 'e': event_id}}) AS v FROM atr JOIN (SELECT event_id, sel FROM sl) USING (event_id) GROUP BY ALL),
aj AS (SELECT {SC}, gid, '{{' || string_agg('"' || n || '":' || v, ',' ORDER BY n) || '}}' AS attributes FROM an GROUP BY ALL),
fz AS (SELECT fu.*, aj.attributes, b.gid IS NOT NULL AS bad FROM fu LEFT JOIN (SELECT DISTINCT {SC}, gid FROM ac) b USING ({SC}, gid) LEFT JOIN aj USING ({SC}, gid)),
fv AS (SELECT *, CASE WHEN bad THEN 'conflicted' WHEN untimed THEN 'unavailable' WHEN sr = 0 THEN 'complete' ELSE 'partial' END AS coverage FROM fz)"""


def fused(spark, folder):
    # identities feed the conflict check and the fusion: written once, read by both
    o = materialise(grouped(spark, folder), "identities")
    return E.fuse(o, GROUP, "rank", "event_id", "available", ["fact", "document"], conflicts_of(o), attributes="attributes"), o


@query("e04_fused_events", f"WITH {FUSED} SELECT {SC}, gid, selected, CASE WHEN NOT bad AND NOT untimed THEN av END AS available_at, sources, fact, document, attributes FROM fv")
def e04(spark, folder):
    entry = F.transform(F.map_entries("attributes"), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"]))
    text = F.concat(F.lit("{"), F.array_join(entry, ","), F.lit("}")).alias("attributes")
    return fused(spark, folder)[0].select(*GROUP, "selected", "available_at", "sources", "fact", "document", text)


@query("e04_provenance", f"WITH {FUSED} SELECT {SC}, gid, event_id, rank, provider, revision_no, available, event_id = sel AS selected FROM sl")
def e04_provenance(spark, folder):
    events, o = fused(spark, folder)
    return E.provenance(o, events, GROUP, "rank", "event_id", ["provider", "revision_no", "available"])


@query("a15_fusion_groups", f"WITH {GROUPED} SELECT {SC}, gid, count(*) AS observations, count(DISTINCT provider) AS providers, min(rank) AS best_rank, max(revision_no) AS last_revision FROM gp GROUP BY ALL")
def a15(spark, folder):
    return grouped(spark, folder).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("provider").alias("providers"), F.min("rank").alias("best_rank"), F.max("revision_no").alias("last_revision"))


@query("e06_coverage", f"WITH {FUSED} SELECT {SC}, gid, coverage, coverage IN ('complete', 'partial') AS tradable FROM fv")
def e06(spark, folder):
    return fused(spark, folder)[0].select(*GROUP, "coverage", F.col("coverage").isin("complete", "partial").alias("tradable"))


ROLE = "CASE WHEN revision_type IS NULL THEN CASE WHEN revision_no = 0 THEN 'initial' END WHEN revision_type IN ('initial', 'original') THEN 'initial' WHEN revision_type IN ('Amended', 'correction') THEN 'supersession' WHEN revision_type = 'withdrawn' THEN 'withdrawal' END"


CUT = "TIMESTAMP '2024-01-20'"
# The walk over visible revisions, one row at a time: the state of a chain after each of its revisions, or its first problem.
WALK = f"""vis AS (SELECT {{k}}, revision_no, list(DISTINCT coalesce(role, '?')) AS roles, {{semantic}} AS disagree FROM r WHERE available <= {CUT} GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY {{k}} ORDER BY revision_no) - 1 AS pos, count(*) OVER (PARTITION BY {{k}}) AS n FROM vis),
walk AS (SELECT {{k}}, pos, n, CASE WHEN list_contains(roles, '?') THEN 'unknown_revision_role' WHEN len(roles) > 1 THEN 'multi_source_revision_conflict'
  WHEN disagree THEN 'multi_source_revision_semantic_conflict' WHEN (pos = 0) <> (roles[1] = 'initial') THEN 'invalid_revision_sequence'
  WHEN pos + 1 = n THEN CASE WHEN roles[1] = 'withdrawal' THEN 'withdrawn' ELSE 'active' END END AS verdict FROM num),
fin AS (SELECT {{k}}, first(verdict ORDER BY pos) FILTER (WHERE verdict IS NOT NULL) AS verdict FROM walk GROUP BY {{k}}),
gap AS (SELECT {{k}}, CAST(count(*) AS BIGINT) AS revisions, max(revision_no) AS latest_revision, bool_or(revision_no <> pos) AS gap FROM num GROUP BY {{k}})"""
OUTCOME = "revisions, latest_revision, state, CASE WHEN state = 'active' THEN latest_revision END AS active_revision, CASE WHEN state IN ('active', 'withdrawn') THEN revisions - 1 END AS superseded"


@query("e07_revision_chains", f"""WITH {OBS}, r AS (SELECT *, {ROLE} AS role FROM ob), {WALK.format(k='user_id, day', semantic='false')},
st AS (SELECT c.user_id, c.day, coalesce(revisions, 0) AS revisions, latest_revision, CASE WHEN c.untimed THEN 'missing_reliable_first_available_at' WHEN revisions IS NULL THEN 'not_yet_available' WHEN gap THEN 'revision_gap' ELSE verdict END AS state
 FROM (SELECT user_id, day, bool_or(available IS NULL) AS untimed FROM r GROUP BY ALL) c LEFT JOIN gap USING (user_id, day) LEFT JOIN fin USING (user_id, day))
SELECT user_id, day, {OUTCOME} FROM st""")
def e07(spark, folder):
    o = observations(spark, folder).withColumn("role", E.revision_role(F.col("revision_type"), F.col("revision_no")))
    return E.resolve_chains(o, ["user_id", "day"], "revision_no", "role", "available", F.lit("2024-01-20").cast("timestamp_ntz"))


CHAIN = "user_id, title, event_code"


@query("e07_chain_identity", f"""WITH {OBS}, r AS (SELECT *, {ROLE} AS role FROM ob),
{WALK.format(k=CHAIN, semantic="count(DISTINCT provider) > 1 AND (count(DISTINCT direction) > 1 OR count(DISTINCT document) > 1)")},
sp AS (SELECT {CHAIN}, bool_or(n > 1) AS split FROM (SELECT {CHAIN}, provider, day, revision_no, count(DISTINCT (direction, coalesce(document, '-'), coalesce(fact, '-'))) AS n FROM r GROUP BY ALL) GROUP BY ALL),
id AS (SELECT {CHAIN}, count(DISTINCT fact) AS facts, bool_or(fact IS NULL) AS unnamed, count(DISTINCT (provider, day)) AS origins, bool_or(available IS NULL) AS untimed FROM r GROUP BY ALL),
st AS (SELECT user_id, title, event_code, coalesce(revisions, 0) AS revisions, latest_revision, CASE WHEN split THEN 'contradictory_provider_revision'
 WHEN facts > 1 OR (facts = 1 AND unnamed) THEN 'conflicting_revision_chain_identity' WHEN facts = 0 AND origins > 1 THEN 'missing_revision_chain_identity'
 WHEN untimed THEN 'missing_reliable_first_available_at' WHEN revisions IS NULL THEN 'not_yet_available' WHEN gap THEN 'revision_gap' ELSE verdict END AS state
 FROM sp JOIN id USING ({CHAIN}) LEFT JOIN gap USING ({CHAIN}) LEFT JOIN fin USING ({CHAIN}))
SELECT {CHAIN}, {OUTCOME} FROM st""")
def e07_identity(spark, folder):
    """Chains of one title and code of a user: contradictory records, identity and agreement of providers are checked too."""
    o = observations(spark, folder).withColumn("role", E.revision_role(F.col("revision_type"), F.col("revision_no")))
    return E.resolve_chains(o, CHAIN.split(", "), "revision_no", "role", "available", F.lit("2024-01-20").cast("timestamp_ntz"), source=["provider", "day"],
                            content=["direction", "document", "fact"], fact="fact", semantic=["direction", "document"])


@query("e08_revision_roles", f"WITH {OBS} SELECT event_id, {ROLE} AS role FROM ob")
def e08(spark, folder):
    return observations(spark, folder).select("event_id", E.revision_role(F.col("revision_type"), F.col("revision_no")).alias("role"))


@query("e09_first_matching", f"""WITH {OBS} SELECT title || '/' || user_id AS logical_id, min({{'a': available, 'e': event_id}}).a AS available, min({{'a': available, 'e': event_id}}).e AS event_id FROM ob WHERE direction = 'up' AND available IS NOT NULL GROUP BY 1""")
def e09(spark, folder):
    o = observations(spark, folder).select(F.concat("title", F.lit("/"), F.col("user_id").cast("string")).alias("logical_id"), "available", "event_id", "direction")
    hit = (F.col("direction") == "up") & F.col("available").isNotNull()
    return E.first_matching(o, "logical_id", hit, ["available", "event_id"]).select("logical_id", "available", "event_id")


@query("e10_event_timeline", f"""WITH {FACTS}, ss AS (SELECT DISTINCT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS d FROM lineitem),
t AS (SELECT instrument, revision_id, CAST(notice_date AS TIMESTAMP) + to_hours(CAST(revision_id % 3 AS INT)) AS av, (SELECT min(d) FROM ss WHERE ss.instrument = fx.instrument AND ss.d >= fx.notice_date) AS session_date FROM fx)
SELECT instrument, session_date, revision_id, av AS available_at FROM t WHERE session_date IS NOT NULL QUALIFY av = min(av) OVER (PARTITION BY instrument, session_date)""")
def e10(spark, folder):
    f = mk.facts(spark, folder).select(
        "instrument", "revision_id", (F.col("notice_date").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("revision_id") % 3).cast("int"))).alias("av"))
    return E.session_events(f, sessions_of(spark, folder), "instrument", "revision_id", "av")


@query("e11_lane_priority", f"""WITH {OBS}, p AS (SELECT * FROM (VALUES ('code0', 'purchase', 0), ('code0', 'signup', 1), ('code0', 'view', 2), ('code0', 'click', 3), ('code0', 'error', 4),
 ('code1', 'error', 0), ('code1', 'purchase', 1), ('code1', 'signup', 2), ('code1', 'view', 3), ('code1', 'click', 4)) t(event_code, provider, lane_rank))
SELECT user_id, day, ob.event_code, arg_min(event_id, {{'r': lane_rank, 'e': event_id}}) AS selected FROM ob JOIN p ON p.event_code = ob.event_code AND p.provider = ob.provider GROUP BY 1, 2, 3""")
def e11(spark, folder):
    """Each lane has its own source order: a ten-row dimension."""
    rows = [("code0", p, i) for i, p in enumerate(E.DEFAULT_PRIORITY)] + [("code1", p, i) for i, p in enumerate(("error", *E.DEFAULT_PRIORITY[:-1]))]
    lanes = spark.createDataFrame(rows, "event_code string, provider string, lane_rank int")
    o = observations(spark, folder).join(F.broadcast(lanes), ["event_code", "provider"])
    best = o.groupBy("user_id", "day", "event_code").agg(F.min(F.struct("lane_rank", "event_id")).alias("b"))
    return best.select("user_id", "day", "event_code", F.col("b.event_id").alias("selected"))


# ---- registries and alternative formulas ----------------------------------------------------

B = f"WITH RECURSIVE {BARS}, {NUMBERED}"


@query("d03_adjusted_rsi", f"""{B}, c AS (SELECT *, close - {lag('close')} AS d FROM v), g AS (SELECT instrument, session_date, rn, CASE WHEN d > 0 THEN d ELSE 0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0 END AS dn FROM c),
r AS (SELECT instrument, rn, CAST(up AS DOUBLE) AS n1, CAST(dn AS DOUBLE) AS n2, CAST(1 AS DOUBLE) AS w FROM g WHERE rn = 1 UNION ALL
 SELECT g.instrument, g.rn, r.n1 * 13 / 14 + g.up, r.n2 * 13 / 14 + g.dn, r.w * 13 / 14 + 1 FROM r JOIN g ON g.instrument = r.instrument AND g.rn = r.rn + 1)
SELECT v.instrument, v.session_date, CASE WHEN v.rn >= 14 AND n2 > 0 THEN round(100 - 100 / (1 + (n1 / w) / (n2 / w)), 4) END AS rsi_adjusted FROM v LEFT JOIN r USING (instrument, rn)""")
def d03(spark, folder):
    """RSI over bias-adjusted exponential means: weighted sum over sum of weights.

    The first row counts as no change; a zero mean loss leaves the value unknown.
    """
    ax = DAILY
    df = mk.bars_by_instrument(spark, folder).withColumns({"rn": ax.row(), "_d": F.col("close") - ax.lag("close")})
    a, zero = 13 / 14, F.lit(0.0)
    df = discounted_sums(df, ax, {
        "_g": (F.when(F.col("_d") > 0, F.col("_d")).otherwise(zero), a),
        "_l": (F.when(F.col("_d") < 0, -F.col("_d")).otherwise(zero), a), "_w": (F.lit(1.0), a)}, "rn")
    rs = F.try_divide(F.col("_g") / F.col("_w"), F.col("_l") / F.col("_w"))
    return df.select(*KEYS, F.when((F.col("rn") >= 14) & (F.col("_l") > 0), F.round(100 - 100 / (1 + rs), 4)).alias("rsi_adjusted"))


@query("d03_seeded_lines", f"""{B}, r AS (SELECT instrument, rn, CAST(close AS DOUBLE) AS f, CAST(close AS DOUBLE) AS s, CAST(close AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS d FROM v WHERE rn = 1 UNION ALL
 SELECT v.instrument, v.rn, r.f + 2.0 / 13 * (v.close - r.f), r.s + 2.0 / 27 * (v.close - r.s), r.e + 2.0 / 21 * (v.close - r.e),
  r.d + 2.0 / 10 * ((r.f + 2.0 / 13 * (v.close - r.f)) - (r.s + 2.0 / 27 * (v.close - r.s)) - r.d) FROM r JOIN v ON v.instrument = r.instrument AND v.rn = r.rn + 1)
SELECT v.instrument, v.session_date, CASE WHEN v.rn >= 20 THEN round(e, 4) END AS ema_20, CASE WHEN v.rn >= 34 THEN round(f - s, 4) END AS dif, CASE WHEN v.rn >= 34 THEN round(d, 4) END AS dea,
 CASE WHEN v.rn >= 34 THEN round(2 * (f - s - d), 4) END AS histogram FROM v JOIN r USING (instrument, rn)""")
def d03_lines(spark, folder):
    """EMA and MACD of the alternative backend: every mean starts at its first value and is shown once its periods are full."""
    from tidemark.functions.recurrence import ema

    df = mk.bars_by_instrument(spark, folder).withColumn("rn", DAILY.row())
    df = ema(df, DAILY, {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27), "e": ("close", 2 / 21)}, "rn").withColumn("d", F.col("fast") - F.col("slow"))
    df = ema(df, DAILY, {"s": ("d", 2 / 10)}, "rn")
    shown = lambda c, first, name: F.when(F.col("rn") >= first, F.round(c, 4)).alias(name)
    return df.select(*KEYS, shown(F.col("e"), 20, "ema_20"), shown(F.col("d"), 34, "dif"), shown(F.col("s"), 34, "dea"), shown(2 * (F.col("d") - F.col("s")), 34, "histogram"))


@query("d05_custom_atom", f"{B}, {FFILL_PE} SELECT instrument, session_date, CAST(rn > 20 AND coalesce(pe BETWEEN 1 AND 60 AND close > ({roll('avg', 'close', 20)}), false) AS INT) AS cheap_uptrend FROM vp")
def d05(spark, folder):
    """A user-registered atom over bars and a second table."""
    from tidemark.operators import atoms as A
    from tidemark.operators.asof import forward_fill

    if "cheap_uptrend" not in A.ATOMS:
        @A.family("custom_cheap", "fundamental", {"cheap_uptrend": 20}, ("ohlcv", "valuation"))
        def cheap(df, ax):
            df = df.withColumn("_m20c", ax.mean("close", 20))
            return df, {"cheap_uptrend": F.col("pe_ttm").between(1, 60) & (F.col("close") > F.col("_m20c"))}

    bars = forward_fill(mk.bars_daily(spark, folder), mk.valuation(spark, folder), ["instrument"], "session_date", ["pe_ttm"],
                        mk.series_parts(spark, folder))
    return A.with_atoms(bars, ["cheap_uptrend"]).select(*KEYS, "cheap_uptrend")


@query("d06_numeric_series", f"""{B}, s AS (SELECT *, ({roll('avg', 'close', 5)}) AS a, ({roll('avg', 'close', 10)}) AS b FROM v),
t AS (SELECT instrument, session_date, {cross('a', 'b', True)} AS crosses_above, {cross('a', 'b', False)} AS crosses_below, a > b AS above, a < 4000.0 AS below_value FROM s WHERE a IS NOT NULL AND b IS NOT NULL) SELECT * FROM t""")
def d06(spark, folder):
    """Conditions over a long table of dated named values: series against series and against a number."""
    base = mk.bars_by_instrument(spark, folder)
    wide = base.select(*KEYS, DAILY.mean("close", 5).alias("fast"), DAILY.mean("close", 10).alias("slow"))
    long = wide.select(*KEYS, F.explode(F.map_from_arrays(F.array(F.lit("fast"), F.lit("slow")), F.array("fast", "slow"))).alias("field", "value")).filter("value is not null")
    left = long.filter("field = 'fast'").select(*KEYS, F.col("value").alias("a"))
    right = long.filter("field = 'slow'").select(*KEYS, F.col("value").alias("b"))
    j = left.join(right, KEYS)
    ax = Axis(("instrument",), ("session_date",))
    return j.select(*KEYS, crosses_above(ax, "a", "b").alias("crosses_above"), crosses_below(ax, "a", "b").alias("crosses_below"),
                    (F.col("a") > F.col("b")).alias("above"), (F.col("a") < 4000).alias("below_value"))
