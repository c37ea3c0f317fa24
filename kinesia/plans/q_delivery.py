"""Queries of the clip requests, the labels and the delivered tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesia.operators import delivery, labels, qc, tab
from kinesia.operators import gestures as G
from kinesia.plans.adapters import POSE_SQL, pose_long, rounded, rounded_sql, table, wide
from kinesia.plans.frames_sql import FRAMES_SQL
from kinesia.plans.q_gesture import SUMMARY_SQL
from kinesia.plans.registry import register
from kinesia.sources import readers

TAB_SQL = """tab AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE 6 END AS n_fields, (CASE WHEN o_custkey % 2 = 0 THEN '2017' ELSE '2016' END) || '-show-' || (o_custkey % 7) || '.txt' AS program,
  'c_' || (o_orderkey % 900) || CASE WHEN o_orderkey % 3 = 0 THEN '-' || (o_orderkey % 900 + 3) || '_word' ELSE '.25_' || (o_orderkey % 900 + 1) || '.5' END AS clip,
  (o_orderkey % 900)::VARCHAR AS start_sec, '25' AS start_frac, CASE WHEN o_orderkey % 13 = 0 THEN (o_orderkey % 900 - 1)::VARCHAR WHEN o_orderkey % 11 = 0 THEN 'x' ELSE (o_orderkey % 900 + 1)::VARCHAR END AS end_sec, '50' AS end_frac FROM orders),
w0 AS (SELECT *, CASE WHEN starts_with(program, '2017') THEN 1000 ELSE 100 END AS d FROM tab),
w1 AS (SELECT *, try_cast(start_sec AS BIGINT) + try_cast(start_frac AS BIGINT) / d AS raw_start, try_cast(end_sec AS BIGINT) + try_cast(end_frac AS BIGINT) / d AS raw_end FROM w0),
windows AS (SELECT *, round(raw_start - 2.0, 3) AS start, round(raw_end + 2.0, 3) AS "end", round((raw_start + raw_end) / 2, 6) AS centre FROM w1)"""


def tab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    m = k % 900
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 9 == 0, 5).otherwise(6).alias("n_fields"), F.concat(F.when(F.col("o_custkey") % 2 == 0, "2017").otherwise("2016"), F.lit("-show-"), text(F.col("o_custkey") % 7), F.lit(".txt")).alias("program"),
        F.concat(F.lit("c_"), text(m), F.when(k % 3 == 0, F.concat(F.lit("-"), text(m + 3), F.lit("_word"))).otherwise(F.concat(F.lit(".25_"), text(m + 1), F.lit(".5")))).alias("clip"),
        text(m).alias("start_sec"), F.lit("25").alias("start_frac"), F.when(k % 13 == 0, text(m - 1)).when(k % 11 == 0, "x").otherwise(text(m + 1)).alias("end_sec"), F.lit("50").alias("end_frac"),
    )


@register("tab_parse", f"WITH {TAB_SQL} SELECT k, program, {rounded_sql('start')}, round(\"end\" + 1e-9, 6) + 0.0 AS \"end\", {rounded_sql('centre')}, replace(program, '.txt', '') || '_' || start || '_' || \"end\" || '_x' AS id FROM windows WHERE raw_end IS NOT NULL")
def tab_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tab.windows(tab_lines(spark, sf_dir)).where("raw_end IS NOT NULL")
    return rounded(x.select("k", "program", "start", "end", "centre", tab.clip_name(F.col("program"), F.col("start"), F.col("end"), "x").alias("id")))


@register("tab_check", f"""WITH {TAB_SQL}, r AS (SELECT *, CASE WHEN clip LIKE '%-%' THEN regexp_extract(clip, '_([0-9]+)-', 1)::DOUBLE ELSE regexp_extract(clip, '_([0-9.]+)_', 1)::DOUBLE END AS a,
  CASE WHEN clip LIKE '%-%' THEN regexp_extract(clip, '-([0-9]+)', 1)::DOUBLE ELSE regexp_extract(clip, '_[0-9.]+_([0-9.]+)', 1)::DOUBLE END AS b, CASE WHEN clip LIKE '%-%' THEN 1.0 ELSE 0.01 END AS tol FROM windows)
SELECT k, n_fields < 6 AS short, coalesce(raw_start >= raw_end, false) AS inverted, coalesce(CASE WHEN raw_end IS NULL THEN abs(raw_start - a) ELSE greatest(abs(raw_start - a), abs(raw_end - b)) END > tol, false) AS mismatch FROM r""")
def tab_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab.check(tab_lines(spark, sf_dir)).select("k", "short", "inverted", "mismatch")


@register("parse_id", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'bad name' ELSE 'a_b_' || c_custkey || '.5_' || (c_custkey + 2) || '.25_x' END AS name FROM customer)
SELECT k, CASE WHEN k % 5 <> 0 THEN 'a_b' END AS program, CASE WHEN k % 5 <> 0 THEN k + 0.5 END::DOUBLE AS start, CASE WHEN k % 5 <> 0 THEN k + 2.25 END::DOUBLE AS "end" FROM c""")
def parse_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "bad name").otherwise(F.concat(F.lit("a_b_"), k.cast("string"), F.lit(".5_"), (k + 2).cast("string"), F.lit(".25_x")))
    p = tab.parse_name(name, "x")
    return table(spark, sf_dir, "customer").select(k.alias("k"), p["program"].alias("program"), p["start"].alias("start"), p["end"].alias("end"))


ASKED_SQL = """asked AS (SELECT 'r' || p_partkey AS id, 'p' || (p_partkey % 40) AS program, (p_partkey % 61)::DOUBLE AS raw_start, (p_partkey % 61 + p_size)::DOUBLE AS raw_end FROM part),
clips AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'r' || p_partkey ELSE 'z' || p_partkey END AS id, 'p' || (p_partkey % 40) AS program, p_partkey % 61 - 2.5 AS start, p_partkey % 61 + p_size + CASE WHEN p_partkey % 7 = 0 THEN 3.5 ELSE 2.5 END AS "end" FROM part)"""


def asked_and_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    base, text = k % 61, k.cast("string")
    program = F.concat(F.lit("p"), (k % 40).cast("string")).alias("program")
    asked = p.select(F.concat(F.lit("r"), text).alias("id"), program, base.cast("double").alias("raw_start"), (base + F.col("p_size")).cast("double").alias("raw_end"))
    asked = asked.withColumn("centre", F.round((F.col("raw_start") + F.col("raw_end")) / 2, 6))
    clips = p.select(F.concat(F.when(k % 3 == 0, "r").otherwise("z"), text).alias("id"), program, (base - 2.5).cast("double").alias("start"), (base + F.col("p_size") + F.when(k % 7 == 0, 3.5).otherwise(2.5)).cast("double").alias("end"))
    return asked, clips


MATCH_SQL = f"""{ASKED_SQL}, a AS (SELECT *, (raw_start + raw_end) / 2 AS centre FROM asked), bc AS (SELECT program, centre, count(*) AS n, min(id) AS c, min(raw_start) AS s FROM a GROUP BY ALL),
m AS (SELECT c.*, a.id AS x, a.raw_start AS xs, bc.n, bc.c AS cc, bc.s FROM clips c LEFT JOIN a ON a.id = c.id LEFT JOIN bc ON bc.program = c.program AND bc.centre = (c.start + c."end") / 2),
matched AS (SELECT id, program, start::DOUBLE AS start, "end"::DOUBLE AS "end", CASE WHEN x IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'window_center' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS match,
  CASE WHEN x IS NOT NULL THEN x WHEN n = 1 THEN cc END AS request, round(CASE WHEN x IS NOT NULL THEN xs WHEN n = 1 THEN s END - start, 3)::DOUBLE AS padding FROM m)"""


@register("tab_match", f"WITH {MATCH_SQL} SELECT * FROM matched")
def tab_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab.match(*asked_and_clips(spark, sf_dir))


@register("padding_guard", f"WITH {MATCH_SQL} SELECT padding, count(*) AS n_clips FROM matched WHERE padding IS NOT NULL GROUP BY padding")
def padding_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab.paddings(tab.match(*asked_and_clips(spark, sf_dir)))


@register("padding", """WITH p AS (SELECT (l_extendedprice / 1000 + 4 - l_extendedprice / 1000 + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) / 2 AS p FROM lineitem)
SELECT count(p) AS n, round(min(p) + 1e-9, 6) + 0.0 AS low, round(median(p) + 1e-9, 6) + 0.0 AS middle, round(max(p) + 1e-9, 6) + 0.0 AS high, count(*) FILTER (WHERE abs(p - 2) > 0.15) AS n_off, round(median(p) * 4) / 4 AS suggestion FROM p""")
def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("l_extendedprice") / 1000
    x = table(spark, sf_dir, "lineitem").select((raw + 4 + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)).alias("duration"), raw.alias("raw_duration"))
    return rounded(tab.padding_report(x))


def _answer(**fields: str) -> str:
    """A label object's text: the usual values, with those of ``fields`` as JSON in their place."""
    usual = {"indoor_outdoor": '"outdoor"', "show_type": '"monologue"', "hands_free": "0", "sitting_standing": '""', "screen_interaction": "1", "sex": '"male"', "age": '"n/a"'}
    return "{" + ", ".join(f'"{k}": {v}' for k, v in (usual | fields).items() if v) + "}"


#: Answers as models give them, with what the rules make of each: its error, or None and the values.
FORMS = [
    ("Sure: ```json\n" + _answer(indoor_outdoor='" Indoor"', show_type='"Interview"', hands_free='"yes"', sitting_standing='"unknown"', screen_interaction="true", sex="null", age="120") + "\n``` done", None, ("indoor", "interview", True, None, True, None, 120)),
    ('x {"age": 7} y', "keys differ", None),
    ("nothing here", "no object", None),
    ("a " + _answer(indoor_outdoor='"moon"', sex='"female"', age='"40"'), "indoor_outdoor: value not allowed", None),
    (_answer() + " thanks", None, ("outdoor", "monologue", False, None, True, "male", None)),
    (_answer(age="150"), "age: value not allowed", None),
    (_answer(hands_free="1.0", age="40.0"), None, ("outdoor", "monologue", True, None, True, "male", 40)),
    (_answer(age='"40.0"'), "age: value not allowed", None),
    (_answer(hands_free='"1.0"'), "hands_free: value not allowed", None),
    (_answer(hands_free="2"), "hands_free: value not allowed", None),
    (_answer(age="true"), "age: value not allowed", None),
    (_answer(age="40.5"), "age: value not allowed", None),
    (_answer(age='" 007 "', screen_interaction='"SI"'), None, ("outdoor", "monologue", False, None, True, "male", 7)),
    (_answer(sex="1"), "sex: value not allowed", None),
    (_answer(sex="[1]"), "sex: value not allowed", None),
    (_answer(extra="1"), "keys differ", None),
    ('[1, {"a": 2}]', "keys differ", None),
    (_answer(sex="{}"), "sex: value not allowed", None),
    (_answer(age="-1"), "age: value not allowed", None),
    (_answer(hands_free="false", screen_interaction='"No se"'), None, ("outdoor", "monologue", False, None, None, "male", None)),
]


def _sql(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (bool, int)) else "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ROWS = ", ".join(f"({i}, {_sql(text)}, {_sql(error)}, {', '.join(_sql(x) for x in values or [None] * 7)})" for i, (text, error, values) in enumerate(FORMS))
#: The engine's rules, stated as results: every form's verdict was worked out by hand.
RAW_SQL = f"""forms AS (SELECT * FROM (VALUES {_ROWS}) t(k, text, error, indoor_outdoor, show_type, hands_free, sitting_standing, screen_interaction, sex, age)),
raw AS (SELECT doc_id, quality, f.* FROM labels JOIN forms f ON f.k = doc_id % {len(FORMS)})"""


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(text) for text, _, _ in FORMS])
    return table(spark, sf_dir, "labels").select("doc_id", F.get(texts, (F.col("doc_id") % len(FORMS)).cast("int")).alias("text"))


@register("json_extract", f"WITH {RAW_SQL} SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1), ''), nullif(regexp_extract(text, '(?s)(\\{{.*\\}})', 1), '')) AS object FROM raw")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_labels(spark, sf_dir).select("doc_id", labels.json_in(F.col("text")).alias("object"))


@register("label_validate", f"WITH {RAW_SQL} SELECT doc_id, indoor_outdoor, show_type, hands_free, sitting_standing::VARCHAR AS sitting_standing, screen_interaction, sex, age::DOUBLE AS age, error FROM raw")
def label_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = raw_labels(spark, sf_dir).select("doc_id", labels.json_in(F.col("text")).alias("object"))
    return x.select("doc_id", labels.validated(F.col("object")).alias("v")).select("doc_id", "v.*").withColumn("age", F.col("age").cast("double"))


ANNOTATIONS_SQL = "annotations AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' ' WHEN doc_id % 4 = 1 THEN '429' END AS error FROM labels)"


@register("annotation_counts", f"WITH {ANNOTATIONS_SQL} SELECT count(*) FILTER (WHERE error IS NULL OR trim(error) = '') AS annotated, count(*) FILTER (WHERE trim(error) <> '') AS errors, count(*) AS total FROM annotations")
def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return labels.annotation_counts(table(spark, sf_dir, "labels").select(F.when(k % 4 == 0, " ").when(k % 4 == 1, "429").alias("error")))


@register("label_upsert", """WITH n AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, c_name, CASE WHEN n.id IS NOT NULL THEN n.status ELSE c_mktsegment END AS status FROM customer LEFT JOIN n ON c_custkey = n.id""")
def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_mktsegment").alias("status"))
    news = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return labels.upsert(base, news, "at", ("status",))


@register("merge_parts", "SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS s_name FROM supplier) ON c_custkey = s_suppkey")
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    speaker = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return labels.merge_parts(scene, speaker, ("name",))


@register("anti_semi", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"))
    return labels.todo(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), done)


@register("frame_picks", "SELECT o_orderkey AS k, list_distinct([(i * (o_custkey - 1) // 4)::BIGINT FOR i IN [0, 1, 2, 3, 4]])::VARCHAR AS picks, list_distinct([round_even(i * (o_custkey - 1) / 6.0, 0)::BIGINT FOR i IN range(7)])::VARCHAR AS spaced FROM orders WHERE o_custkey > 0".replace("list_distinct(", "list_sort(list_distinct(").replace("])::VARCHAR", "]))::VARCHAR"))
def frame_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey")
    return table(spark, sf_dir, "orders").where("o_custkey > 0").select(F.col("o_orderkey").alias("k"), labels.frame_picks(n).cast("string").alias("picks"), labels.spaced_picks(n, 7).cast("string").alias("spaced"))


@register("profile", "".join(f"{' UNION ALL ' if i else ''}SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, round(100 * count({c}) / count(*), 1) AS pct, {low}, {mid}, {high} FROM events"
    for i, (c, t) in enumerate([("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("late", "double")])
    for low, mid, high in [tuple(f"NULL::DOUBLE AS {n}" for n in ("low", "middle", "high")) if t == "string" else tuple(f"round({f}({c})::DOUBLE, 4) AS {n}" for f, n in (("min", "low"), ("median", "middle"), ("max", "high")))]).replace("FROM events", "FROM (SELECT *, CASE WHEN value > 20 THEN value END AS late FROM events)"))
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.when(F.col("value") > 20, F.col("value")).alias("late"))
    return delivery.profile(e)


#: One part of the events for each state a delivery's voice can be in: clean, with leftovers, of the old chain, and without any.
VOICE_PARTS = {"clean": ("pitch", "voice_present"), "leftovers": ("pitch", "voice_present"), "old": ("pitch",), "silent": ()}
VOICE_SQL = """v AS (SELECT *, CASE WHEN part = 'clean' THEN CASE WHEN value BETWEEN 3 AND 30 THEN value * 20 END WHEN event_type <> 'error' THEN value * 20 END AS pitch, (user_id % 7 - value / 3)::DOUBLE AS intensity,
  CASE WHEN part <> 'clean' AND event_id % 30 = 0 THEN -250.0 WHEN event_id % 31 = 0 THEN -200.0 ELSE 10.0 END::DOUBLE AS harmonicity, CASE WHEN part = 'clean' THEN least(value * 90, 5500) ELSE value * 90 END AS formant1,
  value * (event_id % 5) / 50 AS right_speed, CASE WHEN event_id % 11 <> 0 THEN event_id % 3 <> 0 END AS flag, part IN ('clean', 'leftovers') AS flagged
  FROM events, (SELECT unnest(['clean', 'leftovers', 'old', 'silent']) AS part)),
g AS (SELECT *, part <> 'silent' AS m, coalesce(CASE WHEN flagged THEN flag ELSE pitch >= 60 AND pitch <= 600 END, false) AS voiced FROM v),
s AS (SELECT part, count(*) AS n_frames, count(*) FILTER (WHERE m AND pitch = 0) AS n_zero, count(*) FILTER (WHERE m AND (pitch < 60 OR pitch > 600)) AS n_pitch_outside,
  count(*) FILTER (WHERE m AND harmonicity < -200) AS n_harmonicity_low, count(*) FILTER (WHERE m AND (formant1 < 0 OR formant1 > 5500)) AS n_formant_outside, count(*) FILTER (WHERE m AND voiced) AS n_voiced,
  count(*) FILTER (WHERE m AND (flag IS NULL OR NOT flagged)) AS n_untracked, count(*) FILTER (WHERE m AND intensity IS NOT NULL AND right_speed IS NOT NULL) AS n_pairs, count(*) FILTER (WHERE m AND voiced AND intensity IS NOT NULL AND right_speed IS NOT NULL) AS n_pairs_voiced,
  min(intensity) FILTER (WHERE m) AS intensity_low, max(intensity) FILTER (WHERE m) AS intensity_high, corr(intensity, right_speed) FILTER (WHERE m) AS r_all, corr(intensity, right_speed) FILTER (WHERE m AND voiced) AS r_voiced
  FROM g GROUP BY part),
r AS (SELECT *, CASE part WHEN 'silent' THEN 'no voice' WHEN 'old' THEN 'spline' ELSE CASE WHEN n_pitch_outside + n_harmonicity_low + n_formant_outside > 0 THEN 'segments with leftovers' ELSE 'segments' END END AS regime,
  CASE part WHEN 'silent' THEN 'n/a' WHEN 'old' THEN '60-600 Hz' ELSE 'voice_present' END AS gate FROM s)"""


def voice_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A delivered table's voice columns in each of the states of ``VOICE_PARTS``."""
    v, k = F.col("value"), F.col("event_id")
    out = {}
    for part, columns in VOICE_PARTS.items():
        clean = part == "clean"
        pitch = F.when(v.between(3, 30), v * 20) if clean else F.when(F.col("event_type") != "error", v * 20)
        low = F.when(k % 31 == 0, -200.0).otherwise(10.0) if clean else F.when(k % 30 == 0, -250.0).when(k % 31 == 0, -200.0).otherwise(10.0)
        optional = {"pitch": pitch, "voice_present": F.when(k % 11 != 0, k % 3 != 0)}
        out[part] = table(spark, sf_dir, "events").select(
            *[optional[c].alias(c) for c in columns], (F.col("user_id") % 7 - v / 3).alias("intensity"), low.alias("harmonicity"),
            (F.least(v * 90, F.lit(5500.0)) if clean else v * 90).alias("formant1"), (v * (k % 5) / 50).alias("right_speed"),
        )
    return out


@register("voice_sanity", f"""WITH {VOICE_SQL} SELECT part, n_frames, regime, gate, n_zero, n_pitch_outside, n_harmonicity_low, n_formant_outside, n_voiced, n_untracked, n_pairs, n_pairs_voiced, {rounded_sql("intensity_low intensity_high r_all r_voiced")} FROM r""")
def voice_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [rounded(delivery.voice_sanity(df)).withColumn("part", F.lit(part)) for part, df in voice_tables(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts)


@register("null_rates", f"WITH {POSE_SQL} SELECT id, round(avg((pitch IS NULL)::INT) + 1e-9, 6) + 0.0 AS pitch_null, round(avg((c IS NULL)::INT) + 1e-9, 6) + 0.0 AS c_null FROM pose_long GROUP BY id")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(delivery.null_rates(pose_long(spark, sf_dir), "id", ["pitch", "c"]))


@register("outliers", f"WITH {POSE_SQL} SELECT type_points, count(*) AS n FROM pose_long WHERE abs(nx) > 5 OR abs(ny) > 5 GROUP BY type_points")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.outliers(pose_long(spark, sf_dir))


_RULES = (("speed", "speed"), ("speed_*", "any speed"), ("speed_p*", "quantile"), ("n_*", "count"), ("*_std", "spread"), ("age", "age"))
#: Names of delivered columns that the rows of lineitem stand for: a hand, a measure and a statistic.
_PARTS = (("", "right_", "left_"), ("speed", "n_speed", "nx", "age", "other", "n_frames"), ("", "_p50", "_std", "_p95"))
_NAME_SQL = " || ".join(f"list_extract({list(p)}, 1 + {k} % {len(p)})" for p, k in zip(_PARTS, ("l_orderkey", "l_partkey", "l_suppkey"), strict=True))


@register("documentation", f"""WITH c AS (SELECT {_NAME_SQL} AS "column", count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT *, regexp_replace("column", '^(right|left)_', '') AS bare FROM c), r AS (SELECT * FROM (VALUES {", ".join(map(str, _RULES))}) v(pattern, text)),
hits AS (SELECT "column", n, pattern, text, CASE WHEN pattern IN ("column", bare) THEN 3 WHEN pattern LIKE '%*' AND starts_with(bare, rtrim(pattern, '*')) THEN 2 WHEN pattern LIKE '*%' AND ends_with(bare, ltrim(pattern, '*')) THEN 1 END AS k FROM b, r)
SELECT "column", n, arg_max(pattern, k * 1000 + length(pattern)) FILTER (WHERE k IS NOT NULL) AS pattern, arg_max(text, k * 1000 + length(pattern)) FILTER (WHERE k IS NOT NULL) AS text FROM hits GROUP BY ALL""")
def documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda parts, key: F.get(F.array(*[F.lit(p) for p in parts]), (F.col(key) % len(parts)).cast("int"))
    name = F.concat(*[pick(p, k) for p, k in zip(_PARTS, ("l_orderkey", "l_partkey", "l_suppkey"), strict=True)])
    columns = table(spark, sf_dir, "lineitem").groupBy(name.alias("column")).agg(F.count(F.lit(1)).alias("n"))
    return columns.join(delivery.documented(columns, spark.createDataFrame(list(_RULES), "pattern string, text string")), "column")


_FAMILIES = (("event_id", "number", "identity"), ("user_id", "person", "identity"), ("event_*", "kind", "identity"), ("late", "late value", "NULL rules"), ("value", "value", "measure of time"))
_ORDER = ("identity", "measure", "NULL")


def _documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("value", F.when(F.col("value") > 20, F.col("value")).alias("late"), "event_id", "user_id", "event_type")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return delivery.dictionary({"events": e, "customer": c}, spark.createDataFrame(list(_FAMILIES), "pattern string, text string, family string"), _ORDER)


_MEASURED = lambda name, source, number: (f"count({source}) AS non_null, round(100 * count({source}) / count(*), 1) AS pct, " + (f"round(min({source})::DOUBLE, 4) AS low, round(median({source})::DOUBLE, 4) AS middle, round(max({source})::DOUBLE, 4) AS high" if number else "NULL::DOUBLE AS low, NULL::DOUBLE AS middle, NULL::DOUBLE AS high"))
DICTIONARY_SQL = " UNION ALL ".join(
    f"""SELECT '{of}' AS "table", '{c}' AS "column", {place} AS place, '{kind}' AS dtype, {family} AS family, {_MEASURED(c, c, kind != "string")}, {text} AS text FROM {of}"""
    for of, c, place, kind, family, text in (
        ("e", "event_id", 1, "bigint", "'identity'", "'number'"), ("e", "user_id", 2, "bigint", "'identity'", "'person'"), ("e", "event_type", 3, "string", "'identity'", "'kind'"),
        ("e", "value", 4, "double", "'measure of time'", "'value'"), ("e", "late", 5, "double", "'NULL rules'", "'late value'"),
        ("customer", "c_custkey", 1, "bigint", "NULL::VARCHAR", "NULL::VARCHAR"), ("customer", "c_acctbal", 2, "double", "NULL::VARCHAR", "NULL::VARCHAR"),
    )
).replace("'e' AS \"table\"", "'events' AS \"table\"").replace("FROM e ", "FROM (SELECT *, CASE WHEN value > 20 THEN value END AS late FROM events) ")


@register("dictionary", DICTIONARY_SQL)
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documentation(spark, sf_dir)


@register("cover", """SELECT 1::INT AS place, 'customer' AS item, (SELECT count(*) FROM customer) || ' rows x 2 columns' AS value UNION ALL SELECT 2, 'events', (SELECT count(*) FROM events) || ' rows x 5 columns' UNION ALL SELECT 3, 'padding', '2.0'""")
def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = {name: table(spark, sf_dir, name).count() for name in ("events", "customer")}
    return delivery.cover(_documentation(spark, sf_dir), rows, {"padding": "2.0", "term": None})


@register("voice_section", f"""WITH {VOICE_SQL},
lines AS (SELECT part, CASE WHEN regime = 'no voice' THEN {list(delivery.VOICE_ADVICE["no voice"])} ELSE list_concat(['regime: ' || regime, 'gate: ' || gate, 'frames with pitch 0: ' || n_zero, 'frames with pitch out of bounds: ' || n_pitch_outside, 'frames with harmonicity below its floor: ' || n_harmonicity_low,
  'formants out of bounds: ' || n_formant_outside, 'frames with voice: ' || n_voiced, 'intensity: ' || printf('%.1f', intensity_low) || ' to ' || printf('%.1f', intensity_high) || ' dB',
  'intensity with right_speed: ' || coalesce(printf('%.3f', r_all), 'not computable') || ', with voice: ' || coalesce(printf('%.3f', r_voiced), 'not computable')],
  CASE WHEN regime = 'segments' THEN {list(delivery.VOICE_ADVICE["segments"])} ELSE {list(delivery.VOICE_ADVICE["spline"])} END) END AS x FROM r)
SELECT part, (i - 1)::INT AS place, x[i] AS line FROM lines, range(1, 20) t(i) WHERE i <= len(x)""")
def voice_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [delivery.voice_section(delivery.voice_sanity(df)).withColumn("part", F.lit(part)) for part, df in voice_tables(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts)


@register("annotation_gate", f"WITH {ANNOTATIONS_SQL}, c AS (SELECT count(*) FILTER (WHERE error IS NULL OR trim(error) = '') AS annotated, count(*) FILTER (WHERE trim(error) <> '') AS errors, count(*) AS total FROM annotations) SELECT *, annotated > 0 AS passes FROM c")
def annotation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.gate(annotation_counts(spark, sf_dir))


@register("media_totals", "WITH f AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'BAD' WHEN o_orderstatus = 'P' THEN 'EMPTY' ELSE 'OK' END AS status FROM orders) SELECT status, count(*) AS n, (SELECT count(*) FROM f) AS n_files, (SELECT count(*) = 0 FROM f WHERE status <> 'OK') AS all_ok FROM f GROUP BY status")
def media_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return readers.media_totals(o.select(F.when(F.col("o_orderkey") % 17 == 0, "BAD").when(F.col("o_orderstatus") == "P", "EMPTY").otherwise("OK").alias("status")))


@register("prosody_layout", """WITH f AS (SELECT CASE WHEN o_custkey % 5 <> 0 THEN 'c' || o_custkey END AS folder, 'r/' || CASE WHEN o_custkey % 5 <> 0 THEN 'c' || o_custkey || '/' ELSE '' END || 'k' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '_prosody.parquet' WHEN o_orderkey % 7 = 0 THEN '.json' ELSE '.parquet' END AS path FROM orders),
p AS (SELECT * FROM f WHERE path LIKE '%.parquet'), n AS (SELECT folder, bool_or(ends_with(path, '_prosody.parquet')) AS named FROM p WHERE folder IS NOT NULL GROUP BY folder)
SELECT coalesce(folder, replace(split_part(path, '/', -1), '.parquet', '')) AS id, path FROM p LEFT JOIN n USING (folder) WHERE folder IS NULL OR NOT named OR ends_with(path, '_prosody.parquet')""")
def prosody_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    folder = F.when(F.col("o_custkey") % 5 != 0, c)
    name = F.concat(F.lit("k"), k.cast("string"), F.when(k % 3 == 0, "_prosody.parquet").when(k % 7 == 0, ".json").otherwise(".parquet"))
    return readers.prosody_layout(table(spark, sf_dir, "orders").select(folder.alias("folder"), F.concat(F.lit("r/"), F.coalesce(F.concat(folder, F.lit("/")), F.lit("")), name).alias("path")))


CLIPS_SQL = "kept AS (SELECT DISTINCT id, 'pr' || (length(id) % 3) AS programme FROM wide WHERE id NOT LIKE '%5')"


def kept_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir).where("id NOT LIKE '%5'").select("id").distinct()
    return w.withColumn("programme", F.concat(F.lit("pr"), (F.length("id") % 3).cast("string")))


@register("final_frames", f"""WITH {FRAMES_SQL}, {CLIPS_SQL}, spread AS (SELECT id, people_id, frame, CASE WHEN nx_4 > 1 THEN nx_4 * 10 END AS pitch, CASE WHEN frame % 5 <> 0 THEN frame % 3 <> 0 END AS vad FROM wide)
SELECT f.id, f.frame, round(right_nx_smooth + 1e-9, 6) + 0.0 AS right_nx_smooth, f.source_observed, round(pitch + 1e-9, 6) + 0.0 AS pitch, vad, programme FROM frames f JOIN kept USING (id) LEFT JOIN spread s ON f.id = s.id AND f.people_id = s.people_id AND f.frame = s.frame""")
def final_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = qc.collapse_frames(pose_long(spark, sf_dir)).select("id", "people_id", "frame", "pitch", "vad")
    x = delivery.final_frames(G.gesture_frames(wide(spark, sf_dir)), metadata, kept_clips(spark, sf_dir))
    return rounded(x.select("id", "frame", "right_nx_smooth", "source_observed", "pitch", "vad", "programme"))


@register("final_videos", f"""WITH {SUMMARY_SQL}, {CLIPS_SQL}, notes AS (SELECT DISTINCT id, 'indoor' AS indoor_outdoor FROM wide WHERE id LIKE '%2')
SELECT s.id, people_id::BIGINT AS people_id, round(duration_s + 1e-9, 6) + 0.0 AS duration_s, round(right_mean_speed + 1e-9, 6) + 0.0 AS right_mean_speed, indoor_outdoor, programme FROM summary s JOIN kept USING (id) LEFT JOIN notes USING (id)""")
def final_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    notes = w.where("id LIKE '%2'").select("id").distinct().withColumn("indoor_outdoor", F.lit("indoor"))
    x = delivery.final_videos(G.sequence_features(w), notes, kept_clips(spark, sf_dir))
    return rounded(x.select("id", "people_id", "duration_s", "right_mean_speed", "indoor_outdoor", "programme"))


@register("clock_agreement", f"""WITH {FRAMES_SQL}, m AS (SELECT id, people_id, frame, CASE WHEN frame % 40 = 0 THEN frame_timestamp + 1 WHEN frame % 41 = 0 THEN NULL ELSE frame_timestamp END AS u FROM frames WHERE source_observed)
SELECT id, people_id, frame, round(frame_timestamp + 1e-9, 6) + 0.0 AS t, round(u + 1e-9, 6) + 0.0 AS u FROM frames JOIN m USING (id, people_id, frame) WHERE (frame_timestamp IS NULL) <> (u IS NULL) OR abs(frame_timestamp - u) > 1e-6""")
def clock_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = G.gesture_frames(wide(spark, sf_dir))
    t = F.col("frame_timestamp")
    m = f.where("source_observed").select("id", "people_id", "frame", F.when(F.col("frame") % 40 == 0, t + 1).when(F.col("frame") % 41 != 0, t).alias("frame_timestamp"))
    return rounded(delivery.clock_disagreements(f, m))


@register("sample_facts", f"""WITH {SUMMARY_SQL}, speeds AS (SELECT id, people_id, count(right_speed) AS r, count(left_speed) AS l FROM frames GROUP BY id, people_id),
top AS (SELECT id, greatest(right_max_speed, left_max_speed) AS speed FROM summary WHERE coalesce(right_max_speed, left_max_speed) IS NOT NULL ORDER BY speed DESC, id DESC LIMIT 1)
SELECT count(*) FILTER (WHERE r >= 30 AND l >= 30) AS n_both, (SELECT id FROM top) AS fastest, (SELECT round(speed + 1e-9, 4) + 0.0 FROM top) AS fastest_speed FROM speeds""")
def sample_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.sequence_features(wide(spark, sf_dir), extended=True)
    return rounded(delivery.sample_facts(s), 4)
