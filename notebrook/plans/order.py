"""Queries over cell order: prompted notebooks, segments by gaps and headings, ends, soft labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notebrook.functions import arrays as A
from notebrook.operators import ordered
from notebrook.plans.corpus import SQL, cells, nested
from notebrook.session import latest, table


def w01_prompted(spark: SparkSession, d: str) -> DataFrame:
    return ordered.prompted(cells(spark, d, "notebook_id", "cell_id", "type"))


def w02_gap_ends(spark: SparkSession, d: str) -> DataFrame:
    return ordered.gap_ends(cells(spark, d, "notebook_id", "cell_id", "type"))


def w03_gap_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = ordered.gap_segments(cells(spark, d, "notebook_id", "cell_id", "type"))
    return segments.groupBy("notebook_id", "segment_id").agg(
        F.count("*").alias("n_cells"), F.min("cell_id").alias("first_cell"), F.max("cell_id").alias("last_cell"), F.max("pos").alias("last_pos")
    )


def _headed(spark: SparkSession, d: str) -> DataFrame:
    slim = (ordered.has_heading(F.col("content")).alias("heading"), F.size("content").alias("lines"))
    return ordered.heading_segments(cells(spark, d, "notebook_id", "cell_id", "type", *slim))


def w05_heading_segments(spark: SparkSession, d: str) -> DataFrame:
    return ordered.segment_summary(_headed(spark, d))


def w06_segment_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in pages of a thousand cell numbers. Order is found on slim rows; the text is shuffled to its cell and to its page."""
    slim = (ordered.has_heading(F.col("content")).alias("heading"), F.size("content").alias("lines"))
    newest = latest(table(spark, d, "cell").select("_id", "notebook_id", "cell_id", "type", *slim, "loaded_at"), ["_id"], "loaded_at")
    out = ordered.prompts(newest, table(spark, d, "cell").select("_id", "loaded_at", "content"), ["_id", "loaded_at"])
    return out.select("notebook_id", "segment_id", "page", F.size("prompts").cast("bigint").alias("n_prompts"), F.array_join("prompts", "\n").alias("prompts"))


def w07_running_ends(spark: SparkSession, d: str) -> DataFrame:
    return ordered.running_ends(ordered.segment_summary(_headed(spark, d)))


def w08_ends_from_nested(spark: SparkSession, d: str) -> DataFrame:
    """Cell ends straight from the nested notebooks; only the ends are deduplicated."""
    code = F.transform(F.filter("segments", lambda s: s["has_code"]), lambda s: F.size(F.filter(s["cells"], lambda c: c["type"] == "code")))
    ends = A.sizes_to_ends(code)
    return table(spark, d, "notebooksegments").where("segments is not null").select("_id", F.array_join(ends.cast("array<string>"), ",").alias("ends")).distinct()


def w11_resegmented(spark: SparkSession, d: str) -> DataFrame:
    """Parts that the ends cut a notebook's statements into; the rest is the last part."""
    books = nested(spark, d, "segment_ends", "n_ast_children_of_segments").where("segment_ends is not null and n_ast_children_of_segments > 0")
    inside = F.filter(A.clean_ends(F.col("segment_ends")), lambda e: e < F.col("n_ast_children_of_segments"))
    sizes = A.segment_sizes(inside, F.col("n_ast_children_of_segments"))
    return books.select("_id", F.posexplode(sizes).alias("segment_id", "size")).select("_id", "segment_id", F.col("size").cast("bigint"))


def j06_position_to_segment(spark: SparkSession, d: str) -> DataFrame:
    books = nested(spark, d, "segment_ends", "n_ast_children_of_segments").where("segment_ends is not null and n_ast_children_of_segments > 0")
    at = F.explode(A.positions(F.col("n_ast_children_of_segments"))).alias("position")
    return books.select("_id", "segment_ends", at).select("_id", "position", A.segment_of(F.col("segment_ends"), F.col("position")).alias("segment"))


def _labelled(spark: SparkSession, d: str, labels) -> DataFrame:
    books = nested(spark, d, "segment_ends", "n_ast_children_of_segments").where("segment_ends is not null and n_ast_children_of_segments > 0")
    books = books.withColumn("ends", F.filter(A.clean_ends(F.col("segment_ends")), lambda e: e < F.col("n_ast_children_of_segments")))
    out = books.select("_id", F.posexplode(labels(F.col("ends"), F.col("n_ast_children_of_segments"))).alias("position", "label"))
    return out.select("_id", "position", F.round("label", 6).alias("label"))


def w16_uniform_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, A.uniform_labels)


def w17_exponential_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, A.exponential_labels)


def w18_recorded_order(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user in the order of their recorded counter, ties by arrival."""
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    ranked = ordered.running(ev.select("event_id", "user_id", "k", "ts"), "user_id", "k", "ts", "event_id", block=None, turn=("sum", F.lit(1), True))
    return ranked.select("event_id", "user_id", "k", F.col("turn").cast("int").alias("turn"))


def w20_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring segment sizes over the corpus."""
    books = nested(spark, d, "segment_ends").where("segment_ends is not null")
    pairs = books.select(F.explode(A.ngrams(F.col("segment_ends"), 2)).alias("g")).select((F.col("g")[1] - F.col("g")[0]).alias("step"))
    return pairs.groupBy("step").agg(F.count("*").alias("n"))


def w21_moving_average(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.moving_average(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", 5, "mean")
    return out.select("event_id", F.round("mean", 6).alias("mean_of_5"))


QUERIES = {
    f.__name__: f
    for f in (
        w01_prompted, w02_gap_ends, w03_gap_segments, w05_heading_segments, w06_segment_prompts, w07_running_ends, w08_ends_from_nested,
        w11_resegmented, j06_position_to_segment, w16_uniform_labels, w17_exponential_labels, w18_recorded_order, w20_bigrams, w21_moving_average,
    )
}

_SUMMARY = """summary AS (SELECT notebook_id, segment_id, count(*) AS n_cells, count(*) FILTER (type = 'code') AS n_code, min(cell_id) AS first_cell, max(cell_id) AS last_cell,
  sum(CASE WHEN type = 'code' THEN coalesce(len(content), 0) ELSE 0 END)::BIGINT AS n_lines FROM headed GROUP BY ALL)"""
_CUT = """cut AS (SELECT _id, n_ast_children_of_segments AS n, list_sort(list_distinct(list_filter(segment_ends, lambda e: e >= 0 AND e < n_ast_children_of_segments))) AS ends
  FROM nested WHERE segment_ends IS NOT NULL AND n_ast_children_of_segments > 0),
closed AS (SELECT _id, n, CASE WHEN coalesce(list_max(ends), -1) < n - 1 THEN list_append(ends, n - 1) ELSE ends END AS ends FROM cut),
sized AS (SELECT _id, n, i - 1 AS segment_id, ends[i] - CASE WHEN i > 1 THEN ends[i - 1] ELSE -1 END AS size, ends[i] AS last
  FROM closed, unnest(range(1, len(ends) + 1)) AS t(i)),
placed AS (SELECT _id, p AS position, size, last - p AS back, p = last - size + 1 AS first FROM sized, unnest(range(last - size + 1, last + 1)) AS t(p))"""
ORACLE_SQL = {
    "w01_prompted": SQL + "x AS (SELECT 1) SELECT notebook_id, coalesce(bool_or(opens = 1), FALSE) AS prompted FROM gaps GROUP BY notebook_id",
    "w02_gap_ends": SQL + """e AS (SELECT notebook_id, segment_id, max(pos) AS e FROM gapped GROUP BY ALL)
SELECT notebook_id, e AS "end" FROM e QUALIFY segment_id < max(segment_id) OVER (PARTITION BY notebook_id)""",
    "w03_gap_segments": SQL + "x AS (SELECT 1) SELECT notebook_id, segment_id, count(*) AS n_cells, min(cell_id) AS first_cell, max(cell_id) AS last_cell, max(pos) AS last_pos FROM gapped GROUP BY ALL",
    "w05_heading_segments": SQL + _SUMMARY + " SELECT *, n_code > 0 AS has_code FROM summary",
    "w06_segment_prompts": SQL + """emit AS (SELECT *, lag(type) OVER (PARTITION BY notebook_id, segment_id ORDER BY cell_id) AS before FROM headed WHERE type = 'code' OR len(content) > 0),
lines AS (SELECT notebook_id, segment_id, cell_id, i, CASE WHEN type = 'code' THEN '$CODE$' ELSE content[i] END AS line
  FROM emit, unnest(range(1, CASE WHEN type = 'code' THEN 2 ELSE len(content) + 1 END)) AS t(i) WHERE NOT (type = 'code' AND before IS NOT DISTINCT FROM 'code')),
groups AS (SELECT DISTINCT notebook_id, segment_id, (cell_id // 1000)::BIGINT AS page FROM headed),
joined AS (SELECT notebook_id, segment_id, (cell_id // 1000)::BIGINT AS page, count(*) AS n, string_agg(line, chr(10) ORDER BY cell_id, i) AS p FROM lines GROUP BY ALL)
SELECT g.notebook_id, g.segment_id, g.page, coalesce(n, 0) AS n_prompts, coalesce(p, '') AS prompts
FROM groups g LEFT JOIN joined j ON g.notebook_id = j.notebook_id AND g.segment_id = j.segment_id AND g.page = j.page""",
    "w07_running_ends": SQL + _SUMMARY + """ SELECT notebook_id, segment_id, (sum(n_code) OVER w - 1)::BIGINT AS cell_end, (sum(n_lines) OVER w - 1)::BIGINT AS line_end
FROM summary WHERE n_code > 0 WINDOW w AS (PARTITION BY notebook_id ORDER BY segment_id)""",
    "w08_ends_from_nested": SQL + """s AS (SELECT _id, i, len(list_filter(segments[i].cells, lambda c: c.type = 'code')) AS n FROM nested, unnest(range(1, len(segments) + 1)) AS t(i) WHERE segments[i].has_code),
r AS (SELECT _id, sum(n) OVER (PARTITION BY _id ORDER BY i) - 1 AS e, i FROM s), f AS (SELECT _id, e, min(i) AS i FROM r GROUP BY ALL)
SELECT n._id, coalesce(string_agg(e::BIGINT::VARCHAR, ',' ORDER BY f.i), '') AS ends FROM nested n LEFT JOIN f ON n._id = f._id WHERE segments IS NOT NULL GROUP BY n._id""",
    "w11_resegmented": SQL + _CUT + " SELECT _id, segment_id::INT AS segment_id, size::BIGINT AS size FROM sized",
    "j06_position_to_segment": SQL + """p AS (SELECT _id, segment_ends, p AS position FROM nested, unnest(range(0, n_ast_children_of_segments)) AS t(p) WHERE segment_ends IS NOT NULL AND n_ast_children_of_segments > 0)
SELECT _id, position::INT AS position, coalesce(list_position(list_transform(segment_ends, lambda e: e >= position), TRUE), 0) - 1 AS segment FROM p""",
    "w16_uniform_labels": SQL + _CUT + " SELECT _id, position::INT AS position, round(1.0::DOUBLE / size, 6) AS label FROM placed",
    "w17_exponential_labels": SQL + _CUT + """, m AS (SELECT *, CASE WHEN first AND size = 1 THEN 1 - exp(-2.0) WHEN first THEN exp(-2.0 * back) ELSE exp(-2.0 * back) - exp(-2.0 * (back + 1)) END AS v FROM placed)
SELECT _id, position::INT AS position, round(CASE WHEN v < 1e-6 THEN 0.0 ELSE v END, 6) AS label FROM m""",
    "w18_recorded_order": "SELECT event_id, user_id, k, (row_number() OVER (PARTITION BY user_id ORDER BY k, ts, event_id))::INT AS turn FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)",
    "w20_bigrams": SQL + "s AS (SELECT segment_ends[i + 1] - segment_ends[i] AS step FROM nested, unnest(range(1, len(segment_ends))) AS t(i)) SELECT step, count(*) AS n FROM s GROUP BY step",
    "w21_moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean_of_5 FROM events",
}
