"""Queries: schema mapping, measures, names and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import columns as C
from corvane.functions import measures as M
from corvane.functions import names as N
from corvane.operators import catalog as K
from corvane.operators import events as E
from corvane.operators import filters as X
from corvane.plans import bindings as B
from corvane.plans.registry import query

ALIASES = {"duration": ["dwell", "L Quantity", "l_quantity"], "OSC": ["osc", "l_tax"], "entry_spike": ["spike"]}


@query("SELECT l_orderkey, l_quantity AS duration, l_tax AS osc, NULL::VARCHAR AS entry_spike FROM lineitem")
def resolve_columns(spark, sf_dir):
    df = B.table(spark, sf_dir, "lineitem").withColumnRenamed("l_quantity", " L Quantity ")
    out = C.resolve_columns(df, {"l_orderkey": ["l_orderkey"], **ALIASES})
    return out.withColumnRenamed("OSC", "osc")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN 12.5 WHEN 2 THEN 1000.0 END AS value FROM part""")
def coerce_numeric(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 5
    raw = F.when(n == 0, F.col("p_retailprice").cast("string")).when(n == 1, " 12.5 ").when(n == 2, "1e3").when(n == 3, "12,5d").otherwise("inf")
    return p.select("p_partkey", C.numeric(raw).alias("value"))


@query("""SELECT CASE WHEN l_linenumber <> 2 THEN l_orderkey END AS event_id, 'f' || l_suppkey AS file_name, NULL::VARCHAR AS sensor, NULL::VARCHAR AS analytes, NULL::VARCHAR AS solution, CASE WHEN l_linenumber <> 4 THEN l_returnflag END AS notes,
  l_quantity AS event_start, NULL::DOUBLE AS event_end, NULL::DOUBLE AS event_plateau, NULL::DOUBLE AS entry_base_t, NULL::DOUBLE AS entry_peak_t, NULL::DOUBLE AS exit_peak_t, NULL::DOUBLE AS exit_base_t,
  NULL::DOUBLE AS window_start, l_quantity + 1 AS window_end, l_extendedprice AS optical_base, l_extendedprice AS optical_rise, NULL::DOUBLE AS optical_end, NULL::DOUBLE AS opticalre_base, NULL::DOUBLE AS opticalre_rise,
  l_discount AS opticalre_end, NULL::DOUBLE AS entry_base, l_tax AS entry_peak, NULL::DOUBLE AS exit_peak, NULL::DOUBLE AS exit_base, CASE WHEN l_linenumber <> 3 THEN l_tax END AS stored FROM lineitem""")
def to_internal(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    raw = li.select(
        F.when(F.col("l_linenumber") != 2, F.col("l_orderkey").cast("string")).otherwise("1.5").alias("Event_ID"),
        F.concat(F.lit(" f"), "l_suppkey").alias("File_Name"),
        F.when(F.col("l_linenumber") != 4, F.col("l_returnflag")).otherwise("NaN").alias("notes"),
        F.col("l_quantity").cast("string").alias("event_start (s)"),
        (F.col("l_quantity") + 1).cast("string").alias("window_end"),
        F.col("l_extendedprice").cast("string").alias("Base (V)"),
        F.col("l_extendedprice").cast("string").alias("step (v)"),
        F.col("l_discount").alias("opticalre_end"),
        F.col("l_tax").cast("string").alias("entry Peak (pA)"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("entry spike"),
    )
    out = C.to_internal(raw)
    return out.select(*C.INTERNAL, F.col("derived")["entry spike"].alias("stored"))


@query(f"""WITH {B.FEAT} SELECT source_file, source_row, round((step - base) / nullif((step + base) / 2, 0) * 100, 6) AS osc FROM feat""")
def osc_signed(spark, sf_dir):
    return B.feat(spark, sf_dir).select("source_file", "source_row", F.round(M.step_signed(F.col("base"), F.col("step")), 6).alias("osc"))


@query(f"""WITH {B.FEAT} SELECT source_file, source_row, CASE WHEN entry_peak + exit_peak = 0 THEN 0.0 ELSE round(abs((entry_peak - exit_peak) / nullif((entry_peak + exit_peak) / 2, 0) * 100), 6) END AS osc FROM feat""")
def osc_abs(spark, sf_dir):
    return B.feat(spark, sf_dir).select("source_file", "source_row", F.round(M.step_absolute(F.col("exit_peak"), F.col("entry_peak")), 6).alias("osc"))


@query(f"""WITH {B.FEAT} SELECT source_file, source_row, round(cluster * 2 - duration, 6) AS length, round((step - base) / nullif((step + base) / 2, 0) * 100, 6) AS osc,
 round(entry_peak - exit_peak, 6) + 0.0 AS entry_spike, round(exit_peak - entry_peak, 6) + 0.0 AS exit_spike FROM feat""")
def derived_measures(spark, sf_dir):
    f = B.feat(spark, sf_dir)
    events = f.select(
        "source_file", "source_row", F.col("duration").alias("event_start"), (F.col("cluster") * 2).alias("event_end"), F.col("base").alias("optical_base"), F.col("step").alias("optical_rise"),
        F.col("step").alias("opticalre_base"), F.col("base").alias("opticalre_rise"), F.col("exit_peak").alias("entry_base"), "entry_peak", F.col("entry_peak").alias("exit_base"), "exit_peak",
    )
    out = M.derived_measures(events, "tagger")
    return out.select("source_file", "source_row", F.round("duration", 6).alias("length"), F.round("OSC", 6).alias("osc"), (F.round("entry spike", 6) + 0.0).alias("entry_spike"), (F.round("exit spike", 6) + 0.0).alias("exit_spike"))


@query(f"""WITH {B.FEAT}, c AS (SELECT source_file, count(CASE WHEN duration > 49 AND source_file = 'A' THEN entry_peak END) AS made, count(duration) AS given FROM feat GROUP BY 1)
SELECT source_file, source_row, round(CASE WHEN made >= 2 THEN abs(CASE WHEN duration > 49 AND source_file = 'A' THEN entry_peak END - exit_peak) WHEN given >= 2 THEN abs(duration) END, 6) AS entry_spike FROM feat JOIN c USING (source_file)""")
def spike_amplitude(spark, sf_dir):
    f = B.feat(spark, sf_dir).withColumn("peak", F.when((F.col("duration") > 49) & (F.col("source_file") == "A"), F.col("entry_peak")))
    return M.spike_amplitude(f, "source_file", "exit_peak", "peak", "duration", "entry_spike").select("source_file", "source_row", F.round("entry_spike", 6).alias("entry_spike"))


@query(f"""WITH {B.FEAT} SELECT source_file, source_row, round(coalesce(duration, CASE WHEN source_file = 'A' THEN abs((step - base) / nullif((step + base) / 2, 0) * 100) ELSE (step - base) / nullif((step + base) / 2, 0) * 100 END), 6) AS osc FROM feat""")
def derived_precedence(spark, sf_dir):
    f = B.feat(spark, sf_dir)
    formula = F.when(F.col("source_file") == "A", "nn").otherwise("tagger")
    return f.select("source_file", "source_row", F.round(M.derived(formula, F.col("duration"), F.col("base"), F.col("step")), 6).alias("osc"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 2 THEN round(l_tax - l_discount, 6) END AS entry_spike FROM lineitem""")
def fill_spikes(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    peak = F.when(F.col("l_linenumber") != 2, F.col("l_tax").cast("string")).otherwise("n/a")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(M.filled_spike(F.col("l_discount"), peak), 6).alias("entry_spike"))


def _landmarks(spark, sf_dir):
    li, n = B.table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    q, pick = F.col("l_quantity"), lambda c, at: F.when(c, at)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        pick(n < 3, q).alias("event_start"), pick(n < 2, q + 2).alias("event_end"),
        *[pick((n == 1) | ((n == 4) & F.lit(k < 2)), q + k).alias(f"e{k}") for k in range(4)],
        pick(n < 6, q - 1).alias("window_start"), pick(n < 5, q + 3).alias("window_end"),
    )


LM = """lm AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 3 THEN l_quantity END AS event_start, CASE WHEN l_linenumber < 2 THEN l_quantity + 2 END AS event_end,
 CASE WHEN l_linenumber IN (1, 4) THEN l_quantity END AS e0, CASE WHEN l_linenumber IN (1, 4) THEN l_quantity + 1 END AS e1, CASE WHEN l_linenumber = 1 THEN l_quantity + 2 END AS e2, CASE WHEN l_linenumber = 1 THEN l_quantity + 3 END AS e3,
 CASE WHEN l_linenumber < 6 THEN l_quantity - 1 END AS window_start, CASE WHEN l_linenumber < 5 THEN l_quantity + 3 END AS window_end FROM lineitem)"""


@query(f"""WITH {LM} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'tagged' WHEN l_linenumber IN (2, 4) THEN 'partial' WHEN l_linenumber < 6 THEN 'window only' ELSE 'empty' END AS status FROM lm""")
def event_status(spark, sf_dir):
    return _landmarks(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", M.event_status(["event_start", "event_end"], ["e0", "e1", "e2", "e3"], ["window_start", "window_end"]).alias("status"))


@query(f"""WITH {LM} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN window_start IS NOT NULL AND window_end IS NOT NULL THEN window_start ELSE least(event_start, event_end, e0, e3) END AS t0,
 CASE WHEN window_start IS NOT NULL AND window_end IS NOT NULL THEN window_end ELSE greatest(event_start, event_end, e0, e3) END AS t1 FROM lm""")
def event_span(spark, sf_dir):
    t0, t1 = M.event_span(F.col("window_start"), F.col("window_end"), [F.col(c) for c in ("event_start", "event_end", "e0", "e3")])
    return _landmarks(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", t0.alias("t0"), t1.alias("t1"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 1 AS a, l_quantity + l_linenumber * 10 AS b FROM lineitem), w AS (SELECT *, least(greatest((b - a) * 1.14, 0.1), 30.0) AS span, (a + b) / 2 AS mid FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(mid - span / 2, 0.0), 6) AS v0, round(least(mid + span / 2, 60.0), 6) AS v1 FROM w""")
def event_view_window(spark, sf_dir):
    v0, v1 = M.view_window(F.col("l_quantity") - 1, F.col("l_quantity") + F.col("l_linenumber") * 10, F.lit(60.0))
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", v0.alias("v0"), v1.alias("v1"))


@query("""WITH k AS (SELECT s_suppkey, s_suppkey % 6 AS k FROM supplier)
SELECT s_suppkey, CASE k WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS electrical, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS optical, CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 0 END AS reference FROM k""")
def channel_roles(spark, sf_dir):
    """Volts with and without a name in ref, units in any case, none in volts, one channel only."""
    kinds = [
        [("I", "pA"), ("Opt", "V"), ("OptRef", "V")],
        [("Opt", "v"), ("I", "nA"), ("Other", "V")],
        [("I", "PA"), ("Opt", "mV"), ("Ref", "mV")],
        [("ref", "V"), ("Opt", "V"), ("I", "uA")],
        [("x", "mV"), ("y", "V")],
        [("x", "V")],
    ]
    ch = lambda i, name, unit: F.struct(F.lit(i).alias("index"), F.lit(name).alias("name"), F.lit(unit).alias("units"))
    channels = F.get(F.array(*[F.array(*[ch(i, *c) for i, c in enumerate(cs)]) for cs in kinds]), (F.col("s_suppkey") % 6).cast("int"))
    roles = B.table(spark, sf_dir, "supplier").withColumn("channels", channels)
    return roles.select("s_suppkey", K.channel_roles(F.col("channels")).alias("r")).select("s_suppkey", "r.*")


@query(f"""WITH {B.FEAT} SELECT source_file, source_row, round((ln(1 + duration) - (SELECT avg(ln(1 + duration)) FROM feat)) / (SELECT stddev_pop(ln(1 + duration)) FROM feat), 6) AS duration,
 round((entry_peak - (SELECT avg(entry_peak) FROM feat)) / (SELECT stddev_pop(entry_peak) FROM feat), 6) AS entry_peak FROM feat""")
def standardize(spark, sf_dir):
    f = B.feat(spark, sf_dir).select("source_file", "source_row", "duration", "entry_peak")
    out = M.standardize(f, ["duration", "entry_peak"], ("duration",))
    return out.select("source_file", "source_row", *[F.round(c, 6).alias(c) for c in ("duration", "entry_peak")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem""")
def drop_empty_columns(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit(None).cast("double").alias("never"), "l_tax")
    return C.drop_empty_columns(li, ["l_quantity", "never", "l_tax"])


_EXPORT = """SELECT {columns} FROM (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN row_number() OVER (PARTITION BY l_linenumber % 2 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) ELSE l_orderkey END AS event_id,
  CASE WHEN l_linenumber % 2 = 1 THEN upper(s_name) || '.ABF' ELSE 'own' END AS file_name, l_extendedprice * (1 - l_discount) AS step, CASE WHEN l_linenumber <> 3 THEN l_tax END AS exit_base FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_EXPORT_HEAD = """event_id, file_name, '' AS sensor, l_returnflag AS analytes, '' AS solution, l_quantity AS "event_start (s)", l_quantity + l_linenumber AS "event_end (s)", '' AS notes, l_extendedprice AS "Base (V)", step AS "Step (V)",
  l_tax AS "RefBase (V)", l_discount AS "RefStep (V)", l_discount AS "entry Base (pA)", l_tax AS "entry Peak (pA)", l_discount + 2 AS "exit Peak (pA)", exit_base AS "exit Base (pA)",
  CASE WHEN l_linenumber = 4 THEN 7.5 ELSE round(l_quantity + l_linenumber - l_quantity, 6) END AS duration"""
_EXPORT_TAIL = """round(l_tax - l_discount, 6) + 0.0 AS "entry spike", round(l_discount + 2 - exit_base, 6) AS "exit spike", l_quantity + 0.5 AS event_plateau, NULL::DOUBLE AS entry_base_t, NULL::DOUBLE AS entry_peak_t, NULL::DOUBLE AS exit_peak_t, l_quantity AS exit_base_t"""
_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def _export_events(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    even, q, d = F.col("l_linenumber") % 2 == 0, F.col("l_quantity"), F.col("l_discount")
    return li.select(
        *_ORDER, F.col("l_suppkey").alias("rec_id"), F.when(even, F.col("l_orderkey")).alias("event_id"), F.when(even, "own").alias("file_name"), F.col("l_returnflag").alias("analytes"),
        q.alias("event_start"), (q + F.col("l_linenumber")).alias("event_end"), (q + 0.5).alias("event_plateau"), F.col("l_extendedprice").alias("optical_base"), (F.col("l_extendedprice") * (1 - d)).alias("optical_rise"),
        F.col("l_tax").alias("opticalre_base"), d.alias("opticalre_rise"), d.alias("entry_base"), F.col("l_tax").alias("entry_peak"), (d + 2).alias("exit_peak"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("exit_base"),
        q.alias("exit_base_t"), q.alias("window_end"), F.when(F.col("l_linenumber") == 4, F.create_map(F.lit("duration"), F.lit(7.5))).alias("derived"),
    )


def _rounded(df):
    return df.withColumns({c: F.round(f"`{c}`", 6) + 0.0 for c in C.DERIVED})


@query(_EXPORT.format(columns=_EXPORT_HEAD + """, round((step - l_extendedprice) / nullif((step + l_extendedprice) / 2, 0) * 100, 6) + 0.0 AS "OSC", round((l_discount - l_tax) / nullif((l_discount + l_tax) / 2, 0) * 100, 6) + 0.0 AS "RefOSC", """ + _EXPORT_TAIL + ", NULL::DOUBLE AS window_start, l_quantity AS window_end"))
def to_legacy(spark, sf_dir):
    return _rounded(E.to_legacy(_export_events(spark, sf_dir), B.rec(spark, sf_dir), _ORDER))


@query(_EXPORT.format(columns=_EXPORT_HEAD + """, CASE WHEN step + l_extendedprice = 0 THEN 0 ELSE round(abs((step - l_extendedprice) / ((step + l_extendedprice) / 2) * 100), 6) END AS "OSC", CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE round(abs((l_discount - l_tax) / nullif((l_discount + l_tax) / 2, 0) * 100), 6) END AS "RefOSC", l_quantity + 0.5 AS event_plateau_t, """ + _EXPORT_TAIL))
def to_predicted(spark, sf_dir):
    return _rounded(E.to_predicted(_export_events(spark, sf_dir), B.rec(spark, sf_dir), _ORDER))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '2026_09_14 B3S8-15 100 aM SiO2' WHEN 1 THEN '2026_09_14 ' || c_name ELSE c_name END AS experiment,
 CASE c_custkey % 3 WHEN 0 THEN 'AC-AOM' WHEN 1 THEN 'baseline' ELSE '' END AS condition, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0') END AS run FROM customer""")
def parse_file_name(spark, sf_dir):
    n = F.col("c_custkey")
    run = F.lpad((n % 1000).cast("string"), 4, "0")
    name = F.when(n % 3 == 0, F.concat(F.lit("C:\\data\\2026_09_14_"), run, F.lit(" B3S8-15  100 aM SiO2 ac-aom.abf"))).when(n % 3 == 1, F.concat(F.lit("2026_09_14_"), run, F.lit(" "), F.col("c_name"), F.lit(" Baseline.abf"))).otherwise(F.col("c_name"))
    return N.parse_file_name(B.table(spark, sf_dir, "customer").withColumn("file", name), "file").select("c_custkey", "experiment", "condition", "run")


@query("""SELECT DISTINCT c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'baseline' WHEN 'MACHINERY' THEN 'AC-AOM' ELSE upper(c_mktsegment) END AS condition FROM customer""")
def normalize_condition(spark, sf_dir):
    seg = F.col("c_mktsegment")
    word = F.when(seg == "BUILDING", " Baseline ").when(seg == "MACHINERY", "ac_aom").otherwise(F.lower(seg))
    return B.table(spark, sf_dir, "customer").select("c_mktsegment", N.normalize_condition(word).alias("condition")).distinct()


@query("""SELECT s_suppkey, lower(replace(s_name, '#', ' ')) AS name_key, lower(replace(s_name, '#', '__')) AS stem FROM supplier""")
def name_key(spark, sf_dir):
    path = F.concat(F.lit("C:\\data\\"), F.regexp_replace("s_name", "#", "__"), F.lit(".ABF"))
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", N.name_key(path).alias("name_key"), N.stem(path).alias("stem"))


@query("""SELECT doc_id, nfc_normalize(replace(replace(text, 'ﬁ', 'fi'), '²', '2')) AS folded FROM documents""")
def nfkc(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", N.nfkc(F.col("text")).alias("folded"))


@query("""SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 60), ''), 'page') AS slug FROM pages""")
def slugify(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", N.slugify(F.col("url"), "page").alias("slug"))


@query("""WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_mktsegment || ' (' || 2 * (c_custkey % 4) || ')' END AS name FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 17 = 1), old AS (SELECT 'BUILDING' AS name UNION ALL SELECT 'BUILDING (3)' UNION ALL SELECT 'HOUSEHOLD (2)'),
own AS (SELECT name, count(*) AS n FROM b GROUP BY 1), form AS (SELECT name AS form, FALSE AS old FROM own UNION ALL SELECT name, TRUE FROM old),
used AS (SELECT DISTINCT regexp_extract(form, '^(.*) [(]([0-9]+)[)]$', 1) AS name, TRY_CAST(regexp_extract(form, '^(.*) [(]([0-9]+)[)]$', 2) AS INTEGER) AS i FROM form WHERE regexp_matches(form, ' [(][0-9]+[)]$') UNION SELECT form, 1 FROM form WHERE old),
nums AS (SELECT name, CAST(unnest(range(1, n + 10)) AS INTEGER) AS i FROM own), free AS (SELECT name, i, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM nums WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.name = nums.name AND used.i = nums.i AND used.i >= CASE WHEN used.i = 1 THEN 1 ELSE 2 END)),
p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) AS k FROM b) SELECT c_custkey, p.name, CASE WHEN i = 1 THEN p.name ELSE p.name || ' (' || i || ')' END AS unique_name FROM p JOIN free ON free.name = p.name AND free.k = p.k""")
def unique_names(spark, sf_dir):
    """Segments as names, some rows with a numbered form as their own, beside names that are taken already."""
    n = F.col("c_custkey")
    own = B.table(spark, sf_dir, "customer").where((n % 3 == 0) | (n % 17 == 1))
    named = own.select("c_custkey", F.when(n % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" ("), (2 * (n % 4)).cast("string"), F.lit(")"))).alias("name"))
    taken = B.table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "BUILDING").when(F.col("r_regionkey") == 1, "BUILDING (3)").otherwise("HOUSEHOLD (2)").alias("name"))
    return N.unique_names(named, "name", ["c_custkey"], taken=taken)


@query(f"""WITH {B.FEAT} SELECT source_file, source_row, round_even(duration / 32, 4) AS t, round_even(duration / 16, 3) AS m, round_even(duration / 8, 2) AS p FROM feat""")
def rounded(spark, sf_dir):
    """Binary fractions, so that halves are exact and go to the even digit."""
    f = B.feat(spark, sf_dir).select("source_file", "source_row", *[(F.col("duration") / n).alias(c) for c, n in (("t", 32), ("m", 16), ("p", 8))])
    return M.rounded(f, ["t"], ["m"], ["p"])


@query(f"""WITH {B.SIG} SELECT event, CASE WHEN event % 7 = 0 THEN '' ELSE strftime(make_timestamp(CAST(floor(t) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END AS at FROM sig""")
def format_times(spark, sf_dir):
    s = B.sig(spark, sf_dir)
    return s.select("event", N.format_time(F.when(F.col("event") % 7 != 0, F.col("t"))).alias("at"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS again FROM events""")
def json_columns(spark, sf_dir):
    e = K.json_columns(B.table(spark, sf_dir, "events"), "props", "k long", "p")
    return e.select("event_id", F.col("p.k").alias("k"), F.col("p_json").alias("again"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS base, greatest(l_quantity + l_tax * 100 - 4, l_quantity + 0.002) AS plateau, greatest(50 - l_quantity, greatest(l_quantity + l_tax * 100 - 4, l_quantity + 0.002) + 0.002) AS stop FROM lineitem""")
def enforce_order(spark, sf_dir):
    q = F.col("l_quantity")
    a, b, c = M.ordered(q, q + F.col("l_tax") * 100 - 4, 50 - q, 0.002)
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("base"), b.alias("plateau"), c.alias("stop"))


@query(f"WITH {B.FEAT} SELECT source_file, source_row, duration FROM feat WHERE duration > 5 AND duration <= 30")
def duration_filter(spark, sf_dir):
    return X.duration_filter(B.feat(spark, sf_dir), 5, 30).select("source_file", "source_row", "duration")


@query(f"WITH {B.FEAT} SELECT source_file, source_row, duration, entry_peak FROM feat WHERE duration IS NOT NULL AND entry_peak IS NOT NULL")
def drop_missing(spark, sf_dir):
    return X.drop_missing(B.feat(spark, sf_dir), ["duration", "entry_peak"], True).select("source_file", "source_row", "duration", "entry_peak")


@query(f"""WITH {B.FEAT}, f AS (SELECT source_file, 'duration' AS feature, duration AS v FROM feat UNION ALL SELECT source_file, 'never', NULL FROM feat UNION ALL SELECT source_file, 'same', 1.0 FROM feat)
SELECT source_file, feature, count(v) AS n, CASE WHEN count(v) < 2 THEN 'too few values' WHEN min(v) = max(v) THEN 'constant' ELSE 'usable' END AS reason FROM f GROUP BY 1, 2""")
def feature_usability(spark, sf_dir):
    f = B.feat(spark, sf_dir).withColumn("never", F.lit(None).cast("double")).withColumn("same", F.lit(1.0))
    return X.feature_usability(f, "source_file", ["duration", "never", "same"])


@query(f"WITH {B.FEAT} SELECT source_file, source_row, duration, entry_peak FROM feat")
def pooled_features(spark, sf_dir):
    f = B.feat(spark, sf_dir).withColumn("same", F.lit(1.0))
    return f.select("source_file", "source_row", *X.pooled_features(f, ["duration", "same", "entry_peak"]))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'DC' ELSE 'other' END AS condition FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def condition_filter(spark, sf_dir):
    p = F.col("o_orderpriority")
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.when(p == "1-URGENT", "DC").when(p == "5-LOW", "").otherwise("AC").alias("condition"))
    return X.condition_filter(o, "condition", ["DC", "other"])


@query(f"WITH {LM} SELECT l_orderkey, l_linenumber, l_partkey FROM lm WHERE event_start BETWEEN 10 AND 12 OR event_end BETWEEN 10 AND 12 OR e0 BETWEEN 10 AND 12 OR window_start BETWEEN 10 AND 12")
def events_in_range(spark, sf_dir):
    return X.any_in_range(_landmarks(spark, sf_dir), ["event_start", "event_end", "e0", "window_start"], 10, 12).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {B.FEAT} SELECT count(CASE WHEN duration >= 5 AND duration <= 30 AND entry_peak <= 6 THEN 1 END) AS kept, count(*) AS total FROM feat")
def axis_limits(spark, sf_dir):
    return X.axis_limits(B.feat(spark, sf_dir), {"duration": (5, 30), "entry_peak": (None, 6), "exit_peak": (None, None)})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '?' ELSE o_orderstatus END AS author FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus <> 'F'""")
def author_filter(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("author"))
    listed = B.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderstatus").alias("author")).distinct()
    return X.author_filter(o, "author", listed, listed.where("author = 'O'"))


@query("""SELECT CASE WHEN l_linenumber = 5 THEN 'recording not found' WHEN l_partkey % 11 = 1 THEN 'open failed: no header' WHEN l_linenumber = 4 THEN 'no window' WHEN l_quantity > 45 THEN 'window too long' WHEN l_suppkey % 50 < 3 THEN 'too few samples' WHEN l_partkey % 11 = 2 THEN 'model failure: singular' ELSE 'ok' END AS note, count(*) AS n FROM lineitem GROUP BY 1""")
def failure_notes(spark, sf_dir):
    n, p = F.col("l_linenumber"), F.col("l_partkey") % 11
    note = X.failure_note(n != 5, F.lit(0.0), F.when(n != 4, F.when(F.col("l_quantity") > 45, 61.0).otherwise(2.0)), 29 + F.col("l_suppkey") % 50, open_error=F.when(p == 1, "no header"), model_error=F.when(p == 2, "singular"))
    return B.table(spark, sf_dir, "lineitem").groupBy(F.coalesce(note, F.lit("ok")).alias("note")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {B.FEAT}, k AS (SELECT min(CASE WHEN duration > 40 THEN source_row END) AS a, min(CASE WHEN duration <= 40 THEN source_row END) AS b FROM feat WHERE source_file = 'A')
SELECT source_file, source_row, duration, cluster, duration > 40 AS excluded FROM feat, k WHERE source_file = 'A' AND source_row IN (a, b) AND duration IS NOT NULL""")
def inspect_event(spark, sf_dir):
    """One excluded row and one that is not."""
    f = B.feat(spark, sf_dir).select("source_file", "source_row", "duration", "cluster")
    low = F.min(F.when(F.col("duration") > 40, F.col("source_row"))), F.min(F.when(F.col("duration") <= 40, F.col("source_row")))
    rows = f.where("source_file = 'A'").agg(*low).first()
    found = [X.inspect_event(f, f.where("duration > 40"), {"source_file": "A", "source_row": r}) for r in rows]
    return found[0].unionByName(found[1])


@query("SELECT o_orderkey, o_totalprice AS duration FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 200000")
def validate_input(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("duration"))
    C.require_columns(o, ["o_orderkey", "duration"])
    C.check_settings(0.05, 8, 1000, 200000, 25)
    return X.duration_filter(o, 1000, 200000)
