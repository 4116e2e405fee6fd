"""Queries of the dictionary operators: readings are votes of events, priority layers come from parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import dictionary as D
from textloom.operators.ranks import global_rank
from textloom.plans.common import table

_PAIRS = """
pairs AS (
  SELECT user_id % 7 AS book, event_type || CAST(user_id % 5 AS VARCHAR) AS base, event_type || CAST(user_id % 5 AS VARCHAR) || CASE WHEN event_id % 3 = 0 THEN 'ed' ELSE '' END AS surface,
         'r' || CAST(CASE WHEN k < 60 THEN 0 ELSE k % 4 END AS VARCHAR) AS reading, event_id AS seen
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)),
counts AS (SELECT base, reading, count(*) AS n, min(seen) AS first_seen FROM pairs GROUP BY base, reading),
chosen AS (SELECT base, arg_min(reading, -n * 1000000 + first_seen) AS reading, max(n) AS n, sum(n) AS total, count(*) AS readings FROM counts GROUP BY base)
"""


def pairs_of(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    base = F.concat("event_type", (F.col("user_id") % 5).cast("string"))
    return e.select((F.col("user_id") % 7).alias("book"), base.alias("base"), F.concat(base, F.when(F.col("event_id") % 3 == 0, "ed").otherwise("")).alias("surface"), F.concat(F.lit("r"), F.when(F.col("k") < 60, 0).otherwise(F.col("k") % 4).cast("string")).alias("reading"), F.col("event_id").alias("seen"))


def q_counts(spark, sf):
    return D.reading_counts(pairs_of(spark, sf), ["book"])


def q_majority(spark, sf):
    return D.majority(D.reading_counts(pairs_of(spark, sf), []), []).select("base", "reading", "n", "total")


def q_preferred(spark, sf):
    return D.majority(D.reading_counts(pairs_of(spark, sf), []), [], F.col("reading").isin("r1", "r2")).select("base", "reading", "n")


def q_distinct(spark, sf):
    return D.distinct_readings(pairs_of(spark, sf), ["book"])


def q_global(spark, sf):
    return D.global_entries(pairs_of(spark, sf))


def q_conflicts(spark, sf):
    return D.conflicts(D.reading_counts(pairs_of(spark, sf), []), [])


def q_promotions(spark, sf):
    known = pairs_of(spark, sf).select("base").filter("base LIKE 'view%'").distinct()
    return D.promotions(D.reading_counts(pairs_of(spark, sf), []), known, 5, 0.7)


def q_compounds(spark, sf):
    return D.compounds(pairs_of(spark, sf), ["book"])


def q_propagated(spark, sf):
    return pairs_of(spark, sf).groupBy("base").agg(F.array_join(F.sort_array(F.collect_set("reading")), ",").alias("readings"))


def q_merge(spark, sf):
    p = table(spark, sf, "part").select(F.lit(0).alias("priority"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("base"), F.when(F.col("p_size") > 45, F.col("p_brand")).alias("pattern"), F.col("p_brand").alias("reading"), F.when(F.length("p_name") < 10, "isolated").alias("mode"))
    chapter = p.filter("ord % 3 = 0").select(F.lit(1).alias("priority"), "ord", "base", "pattern", F.concat("reading", F.lit("!")).alias("reading"), "mode")
    return D.merge_overrides(p.unionByName(chapter))


def q_order(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("base"), F.when(F.col("p_size") > 40, F.col("p_type")).alias("pattern"))
    return D.application_order(p, ["book"]).select("book", "ord", "rank")


def q_ordered_union(spark, sf):
    p = table(spark, sf, "part")
    lists = p.select(F.col("p_brand").alias("book"), F.lit(0).alias("layer"), F.col("p_partkey").alias("ord"), F.initcap("p_name").alias("v")).unionByName(p.select(F.col("p_brand").alias("book"), F.lit(1).alias("layer"), F.col("p_partkey").alias("ord"), F.concat(F.col("p_name"), F.lit("  X")).alias("v")))
    return D.ordered_union(lists, ["book"], "v").select("book", "key", "layer", "ord")


def q_categories(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("book"), F.col("p_name").alias("key"), F.when(F.col("p_size") > 30, "title").otherwise("section").alias("category"))
    return D.category_map(p, ["book"])


def q_pairs_distinct(spark, sf):
    p = pairs_of(spark, sf)
    return p.filter("length(base) <> 1").groupBy("base", "reading").agg(F.min("seen").alias("ord"))


def q_rules_union(spark, sf):
    """Rule lists put together, duplicates kept."""
    p = table(spark, sf, "part")
    return p.select(F.lit("default").alias("origin"), F.col("p_type").alias("pattern")).unionByName(p.filter("p_size > 25").select(F.lit("book").alias("origin"), F.col("p_type").alias("pattern"))).groupBy("origin", "pattern").agg(F.count(F.lit(1)).alias("n"))


def q_rules_minus(spark, sf):
    """Rules of a book that are not among the defaults."""
    p = table(spark, sf, "part")
    rule = F.concat_ws(" ", "p_type", "p_brand").alias("pattern")
    return p.filter("p_size > 25").select(rule).join(p.filter("p_size <= 20").select(rule), "pattern", "left_anti").distinct()


def q_missing_comments(spark, sf):
    """New lines that are neither comments nor entries yet."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    new = c.select(F.concat(F.lit("# "), F.lpad((F.col("c_custkey") % 400).cast("string"), 4, "0")).alias("line"))
    old = s.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("# "), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("line"))
    entries = s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("# "), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("line"))
    return new.subtract(old).subtract(entries)


def q_skip_bases(spark, sf):
    """Global entries without those whose base a chapter overrides itself."""
    p = pairs_of(spark, sf)
    return p.select("base", "reading").distinct().join(p.filter("book = 3 AND seen % 40 = 0").select("base").distinct(), "base", "left_anti")


def q_library_order(spark, sf):
    """Titles by their key without a leading article."""
    n = table(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 4 == 0, "The ").when(F.col("p_size") % 4 == 1, "A ").when(F.col("p_size") % 4 == 2, "an ").otherwise(""), "p_name").alias("title"))
    key = F.regexp_replace(F.lower("title"), "^(the|a|an) ", "")
    return global_rank(n, [key, F.col("title"), F.col("p_partkey")], "place").select("p_partkey", F.col("place").cast("int").alias("place"))


_LAYERS = """
layers AS (
  SELECT 0 AS priority, p_partkey AS ord, p_name AS base, CASE WHEN p_size > 45 THEN p_brand END AS pattern, p_brand AS reading, CASE WHEN length(p_name) < 10 THEN 'isolated' END AS mode FROM part
  UNION ALL SELECT 1, p_partkey, p_name, CASE WHEN p_size > 45 THEN p_brand END, p_brand || '!', CASE WHEN length(p_name) < 10 THEN 'isolated' END FROM part WHERE p_partkey % 3 = 0),
keyed AS (SELECT *, CASE WHEN pattern IS NOT NULL THEN 're:' || pattern ELSE 'lit:' || base END AS key FROM layers)
"""

QUERIES = {
    "a1_reading_counts": q_counts, "a3_majority": q_majority, "a4_preferred": q_preferred, "a5_distinct_readings": q_distinct, "a6_global_entries": q_global, "a7_conflicts": q_conflicts, "a8_promotions": q_promotions, "a9_compounds": q_compounds,
    "a10_propagated": q_propagated, "a24_categories": q_categories, "a25_pairs": q_pairs_distinct, "j14_skip_bases": q_skip_bases, "j21_merge_overrides": q_merge, "o1_application_order": q_order, "o4_library_order": q_library_order,
    "u1_rules_union": q_rules_union, "u2_rules_minus": q_rules_minus, "u3_ordered_union": q_ordered_union, "u6_missing_comments": q_missing_comments,
}

ORACLES = {
    "a1_reading_counts": f"WITH {_PAIRS} SELECT book, base, reading, count(*) AS n, min(seen) AS first_seen FROM pairs GROUP BY ALL",
    "a3_majority": f"WITH {_PAIRS} SELECT base, reading, n, CAST(total AS BIGINT) AS total FROM chosen",
    "a4_preferred": f"""WITH {_PAIRS}, r AS (SELECT *, max(n) OVER (PARTITION BY base) AS most FROM counts),
x AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY CASE WHEN reading IN ('r1', 'r2') AND n = most THEN 0 WHEN reading IN ('r1', 'r2') THEN 1 ELSE 2 END, n DESC, first_seen) AS rn FROM r) SELECT base, reading, n FROM x WHERE rn = 1""",
    "a5_distinct_readings": f"WITH {_PAIRS} SELECT book, base, CASE WHEN count(DISTINCT reading) = 1 THEN 'replacement' ELSE 'conflict' END AS kind, string_agg(DISTINCT reading, ',' ORDER BY reading) AS readings FROM pairs GROUP BY book, base",
    "a6_global_entries": f"""WITH {_PAIRS}, l AS (SELECT base, surface, reading, count(*) AS n FROM pairs GROUP BY ALL),
m AS (SELECT l.base, surface, sum(l.n) AS total, arg_min(l.reading, -l.n * 1000000 + first_seen) AS reading, max(l.n) AS n FROM l JOIN counts USING (base, reading) GROUP BY l.base, surface)
SELECT base, '' AS pattern, '' AS context, reading, n, CAST(total AS BIGINT) AS total FROM chosen WHERE readings = 1
UNION ALL SELECT m.base, m.base || '(?=' || substr(surface, length(m.base) + 1) || ')', surface, m.reading, m.n, CAST(m.total AS BIGINT) FROM m JOIN chosen c ON c.base = m.base
WHERE c.readings > 1 AND 2 * c.n > c.total AND 2 * m.n > m.total AND m.reading = c.reading AND surface <> m.base""",
    "a7_conflicts": f"WITH {_PAIRS} SELECT base, string_agg(reading || ':' || n, ',' ORDER BY n DESC, first_seen) AS readings FROM counts GROUP BY base HAVING count(*) > 1",
    "a8_promotions": f"WITH {_PAIRS} SELECT base, reading, n, CAST(total AS BIGINT) AS total FROM chosen WHERE readings > 1 AND n >= 5 AND n >= 0.7 * total AND base NOT LIKE 'view%'",
    "a9_compounds": f"""WITH {_PAIRS}, c AS (SELECT book, base, reading, count(*) AS n, min(seen) AS f FROM pairs GROUP BY ALL)
SELECT book, base, reading, n FROM (SELECT book, base, arg_min(reading, -n * 1000000 + f) AS reading, max(n) AS n, sum(n) AS total FROM c GROUP BY book, base) WHERE n >= 2 AND 2 * n > total""",
    "a10_propagated": f"WITH {_PAIRS} SELECT base, string_agg(DISTINCT reading, ',' ORDER BY reading) AS readings FROM pairs GROUP BY base",
    "a24_categories": "SELECT p_brand AS book, p_name AS key, CASE WHEN max(p_size) > 30 THEN 'title' ELSE 'section' END AS category FROM part GROUP BY ALL",
    "a25_pairs": f"WITH {_PAIRS} SELECT base, reading, min(seen) AS ord FROM pairs WHERE length(base) <> 1 GROUP BY ALL",
    "j14_skip_bases": f"WITH {_PAIRS} SELECT DISTINCT base, reading FROM pairs WHERE base NOT IN (SELECT base FROM pairs WHERE book = 3 AND seen % 40 = 0)",
    "j21_merge_overrides": f"""WITH {_LAYERS}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, ord DESC) AS rn FROM keyed), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, ord) AS rn FROM keyed)
SELECT w.key, w.base, w.pattern, w.reading, w.mode, f.priority AS at_priority, f.ord AS at_ord FROM w JOIN f ON w.key = f.key AND w.rn = 1 AND f.rn = 1""",
    "o1_application_order": "SELECT p_brand AS book, p_partkey AS ord, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 40, CASE WHEN p_size > 40 THEN 0 ELSE -length(p_name) END, p_partkey) AS INT) AS rank FROM part",
    "o4_library_order": """WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'The ' WHEN 1 THEN 'A ' WHEN 2 THEN 'an ' ELSE '' END || p_name AS title FROM part)
SELECT p_partkey, CAST(row_number() OVER (ORDER BY regexp_replace(lower(title), '^(the|a|an) ', ''), title, p_partkey) AS INT) AS place FROM t""",
    "u1_rules_union": "SELECT 'default' AS origin, p_type AS pattern, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'book', p_type, count(*) FROM part WHERE p_size > 25 GROUP BY p_type",
    "u2_rules_minus": "SELECT p_type || ' ' || p_brand AS pattern FROM part WHERE p_size > 25 EXCEPT SELECT p_type || ' ' || p_brand FROM part WHERE p_size <= 20",
    "u3_ordered_union": r"""WITH l AS (SELECT p_brand AS book, 0 AS layer, p_partkey AS ord, lower(p_name) AS key FROM part UNION ALL SELECT p_brand, 1, p_partkey, regexp_replace(lower(p_name || '  X'), '\s+', ' ', 'g') FROM part)
SELECT book, key, CAST(min(layer * 1000000000 + ord) // 1000000000 AS INT) AS layer, min(layer * 1000000000 + ord) % 1000000000 AS ord FROM l GROUP BY book, key""",
    "u6_missing_comments": """SELECT '# ' || lpad(CAST(c_custkey % 400 AS VARCHAR), 4, '0') AS line FROM customer EXCEPT SELECT '# ' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') FROM supplier WHERE s_suppkey % 2 = 0 EXCEPT SELECT '# ' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') FROM supplier WHERE s_suppkey % 3 = 0""",
}
