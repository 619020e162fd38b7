"""SQL that the queries of `core` are checked against."""

from __future__ import annotations

from orebody.functions.hashing import HASH_TABLE
from orebody.operators.recommend import LEXICON



def _newest(table: str, key: str, newest: str, columns: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in [newest, *columns.split(", ")])
    return f"(SELECT {key}, {columns} FROM {table} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


def _users(columns: str) -> str:
    return f"WITH u AS {_newest('users', 'user_id', 'review_count', columns)}"


U = f"u AS {_newest('users', 'user_id', 'review_count', 'name, review_count, yelping_since, useful, funny, cool, fans, average_stars')}"
V = f"v AS (SELECT review_id, user_id AS u, business_id AS i, stars FROM {_newest('review', 'review_id', 'loaded_at', 'user_id, business_id, stars')})"
R = "r AS (SELECT user_id AS u, business_id AS i, avg(stars) AS r FROM yelp_train WHERE user_id IS NOT NULL AND business_id IS NOT NULL AND stars IS NOT NULL GROUP BY 1, 2)"
T = f"{V}, t AS (SELECT u, i, avg(stars) AS stars FROM v WHERE u IS NOT NULL AND i IS NOT NULL AND stars IS NOT NULL GROUP BY 1, 2)"
X = "x AS (SELECT DISTINCT business_id AS s, user_id AS t FROM yelp_train WHERE business_id IS NOT NULL AND user_id IS NOT NULL), n AS (SELECT s, count(*) AS n FROM x GROUP BY s)"
BIAS = f"""{R}, {T},
  um AS (SELECT u, avg(r) AS um FROM r GROUP BY u), im AS (SELECT i, avg(r) AS im FROM r GROUP BY i),
  p AS (SELECT t.u, t.i, t.stars, um + im - (SELECT avg(r) FROM r) AS raw FROM t JOIN um USING (u) JOIN im USING (i))"""
H = f"h AS (SELECT * FROM (VALUES {', '.join(f'({j}, {a}, {b}, {p})' for j, (a, b, p) in enumerate(HASH_TABLE))}) AS h(j, a, b, p))"


def _pearson(n: str = "n", x: str = "x", y: str = "y", xy: str = "xy", xx: str = "xx", yy: str = "yy") -> str:
    vx, vy = f"({n} * {xx} - {x} * {x})", f"({n} * {yy} - {y} * {y})"
    return f"round(CASE WHEN {vx} < 1e-9 OR {vy} < 1e-9 THEN 0.0 ELSE ({n} * {xy} - {x} * {y}) / sqrt({vx} * {vy}) END, 9)"


def _sums(of: str, over: str, where: str = "") -> str:
    return f"SELECT a.{of} AS a, b.{of} AS b, count(*) AS n, sum(a.r) AS x, sum(b.r) AS y, sum(a.r * b.r) AS xy, sum(a.r * a.r) AS xx, sum(b.r * b.r) AS yy FROM r a JOIN r b ON a.{over} = b.{over} {where} GROUP BY 1, 2"


def _similar(formula: str, least: float, size: int = 1) -> str:
    return f"""{X}, y AS (SELECT x.*, n FROM x JOIN n USING (s) WHERE n >= {size}),
  q AS (SELECT a.s AS id_1, b.s AS id_2, a.n AS n1, b.n AS n2, count(*)::DOUBLE AS c FROM y a JOIN y b ON a.t = b.t AND a.s < b.s GROUP BY 1, 2, 3, 4),
  sim AS (SELECT id_1, id_2, {formula} AS similarity FROM q WHERE {formula} >= {least})"""


JACCARD = "c / (n1 + n2 - c)"
SIG = f"""{X}, {H}, ids AS (SELECT t, dense_rank() OVER (ORDER BY t) - 1 AS x FROM (SELECT DISTINCT t FROM x)), m AS (SELECT greatest(1, count(*) // 36) AS m FROM ids),
  g AS (SELECT s, j, min(((a * x + b) % p) % m) AS v FROM x JOIN ids USING (t), h, m GROUP BY s, j)"""
LSH = f"""{SIG}, bd AS (SELECT s, j // 2 AS band, string_agg(v, ',' ORDER BY j) AS key FROM g GROUP BY 1, 2),
  cand AS (SELECT DISTINCT a.s AS id_1, b.s AS id_2, na.n AS n1, nb.n AS n2 FROM bd a JOIN bd b ON a.band = b.band AND a.key = b.key AND a.s < b.s
           JOIN n na ON na.s = a.s JOIN n nb ON nb.s = b.s WHERE 2 * least(na.n, nb.n) >= greatest(na.n, nb.n))"""
LSH_SIM = f"""{LSH}, q AS (SELECT id_1, id_2, n1, n2, count(*)::DOUBLE AS c FROM cand JOIN x a ON a.s = id_1 JOIN x b ON b.s = id_2 AND b.t = a.t GROUP BY 1, 2, 3, 4),
  sim AS (SELECT id_1, id_2, {JACCARD} AS similarity FROM q WHERE {JACCARD} >= 0.5)"""
PAIRS = "SELECT id_1 AS business_id_1, id_2 AS business_id_2, round(similarity, 6) AS similarity FROM sim"


def _itemsets(rows: str, least: int, most: int) -> str:
    """Levels up to `most`, each by one more self-join over frequent items."""
    parts, sql = [], f"WITH w AS ({rows}), f AS (SELECT i FROM w GROUP BY i HAVING count(*) >= {least}), z AS (SELECT b, i FROM w SEMI JOIN f USING (i)), o1 AS (SELECT b, i::VARCHAR AS s, i AS l FROM z), l1 AS (SELECT s, count(*) AS n FROM o1 GROUP BY s HAVING count(*) >= {least})"
    for k in range(2, most + 1):
        sql += f", o{k} AS (SELECT o.b, o.s || ',' || z.i AS s, z.i AS l FROM o{k - 1} o SEMI JOIN l{k - 1} USING (s) JOIN z ON z.b = o.b AND z.i > o.l), l{k} AS (SELECT s, count(*) AS n FROM o{k} GROUP BY s HAVING count(*) >= {least})"
    parts = [f"SELECT {k}::INT AS k, s AS itemset, n AS support FROM l{k}" for k in range(1, most + 1)]
    return f"{sql} {' UNION ALL '.join(parts)}"


def _baskets(key: str, item: str) -> str:
    return f"SELECT DISTINCT {key} AS b, {item} AS i FROM yelp_train WHERE {key} IS NOT NULL AND {item} IS NOT NULL"


CASE1 = _itemsets(_baskets("user_id", "business_id"), 8, 7)
EDGES = f"""{X}, m AS (SELECT count(DISTINCT t) AS m FROM x), y AS (SELECT x.*, n FROM x JOIN n USING (s), m WHERE n >= 8 AND 5 * n <= m),
  e0 AS (SELECT a.s AS src, b.s AS dst FROM y a JOIN y b ON a.t = b.t AND a.s < b.s, m GROUP BY 1, 2, a.n, b.n, m HAVING count(*) >= 8 AND count(*) * m >= 5 * a.n * b.n),
  e AS (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0)"""
LPA = f"{EDGES}, p0 AS (SELECT DISTINCT src AS id, src AS label FROM e)" + "".join(
    f", p{k} AS (SELECT id, label FROM (SELECT e.src AS id, label, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, label) AS o FROM e JOIN p{k - 1} q ON q.id = e.dst GROUP BY e.src, label) WHERE o = 1)" for k in range(1, 6)
)
COMPONENTS = f"WITH RECURSIVE {EDGES}, c(id, root) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, c.root FROM c JOIN e ON e.src = c.id), k AS (SELECT id, min(root) AS component FROM c GROUP BY id)"
BYTES = "list_transform(range(1, length(hex(encode({0}))) // 2 + 1), lambda q: ((strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * q - 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * q, 1)) - 1)::BIGINT)"
CODE = "list_reduce(list_prepend(0::BIGINT, bytes), lambda acc, z: (acc * 256 + z) % p)"
TAGS = "SELECT lower(trim(w.h.text)) AS tag, count(*) AS n FROM {}, unnest(hashtags) AS w(h) GROUP BY 1"
TOP5 = "SELECT tag, n, rank FROM (SELECT tag, n, rank() OVER (ORDER BY n DESC)::INT AS rank FROM ({})) WHERE rank <= 5"

SQL = {
    "user_totals": f"{_users('review_count')} SELECT count(*) AS n_users, sum(review_count)::BIGINT AS n_reviews FROM u",
    "avg_reviews": f"{_users('review_count')} SELECT round(avg(review_count), 6) AS avg_reviews FROM u",
    "distinct_names": f"{_users('name')} SELECT count(DISTINCT name) AS n_names FROM u",
    "joined_in_year": f"{_users('yelping_since')} SELECT count(*) FILTER (contains(yelping_since, '2015')) AS n_users FROM u",
    "top_names": f"{_users('name')} SELECT name, count(*) AS n FROM u WHERE name IS NOT NULL GROUP BY name ORDER BY n DESC, name LIMIT 10",
    "top_reviewers": f"{_users('review_count')} SELECT user_id, review_count FROM u WHERE review_count IS NOT NULL ORDER BY review_count DESC, user_id LIMIT 10",
    "state_avg": f"WITH {V}, b AS (SELECT business_id AS i, state FROM {_newest('business', 'business_id', 'loaded_at', 'state')}) SELECT state, round(avg(stars), 6) AS stars FROM v JOIN b USING (i) WHERE state IS NOT NULL AND stars IS NOT NULL GROUP BY state",
    "rating_report": f"WITH {BIAS}, e AS (SELECT abs(least(5.0, greatest(1.0, raw)) - stars) AS e FROM p) SELECT " + ", ".join(f"count(*) FILTER (e >= {k} AND e < {k + 1}) AS errors_{k}_{k + 1}" for k in range(4)) + ", count(*) FILTER (e >= 4) AS errors_4_up, round(sqrt(avg(e * e)), 6) AS rmse FROM e",
    "pair_precision_recall": f"WITH {LSH_SIM}, ex AS (SELECT a.s AS id_1, b.s AS id_2 FROM x a JOIN n na ON na.s = a.s JOIN x b ON a.t = b.t AND a.s < b.s JOIN n nb ON nb.s = b.s GROUP BY 1, 2, na.n, nb.n HAVING 2 * count(*) >= na.n + nb.n - count(*)), k AS (SELECT (SELECT count(*) FROM sim) AS f, (SELECT count(*) FROM ex) AS t, (SELECT count(*) FROM sim JOIN ex USING (id_1, id_2)) AS h) SELECT f AS n_found, t AS n_true, round(h / f, 6) AS precision, round(h / t, 6) AS recall FROM k",
    "jaccard_exact": f"WITH {_similar(JACCARD, 0.5)} {PAIRS}",
    "cosine_exact": f"WITH {_similar('c / sqrt((n1 * n2)::DOUBLE)', 0.6)} {PAIRS}",
    "minhash_signatures": f"WITH {SIG} SELECT s AS business_id, string_agg(v, ',' ORDER BY j) AS signature FROM g GROUP BY s",
    "lsh_candidates": f"WITH {LSH} SELECT id_1 AS business_id_1, id_2 AS business_id_2 FROM cand",
    "lsh_jaccard": f"WITH {LSH_SIM} {PAIRS}",
    "itemsets_case1": CASE1,
    "itemsets_case2": _itemsets(_baskets("business_id", "user_id"), 15, 5),
    "itemsets_daily": _itemsets("SELECT DISTINCT b, i FROM (SELECT strftime(ts, '%Y-%m-%d') || '-' || user_id AS b, event_type AS i, count(*) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') || '-' || user_id) AS c FROM events) WHERE c > 2", 20, 7),
    "itemset_report": f"WITH found AS ({CASE1}) SELECT k, string_agg('(''' || replace(itemset, ',', ''', ''') || ''')', ',' ORDER BY '(''' || replace(itemset, ',', ''', ''') || ''')') AS line FROM found GROUP BY k",
    "user_means": f"WITH {R} SELECT u AS user_id, round(avg(r), 6) AS mean, count(*) AS n FROM r GROUP BY u",
    "pearson_items": f"WITH {R}, q AS ({_sums('i', 'u', 'AND a.i < b.i')}) SELECT a AS business_id_1, b AS business_id_2, n, {_pearson()} AS w FROM q WHERE n >= 2",
    "user_cf": f"""WITH {R}, {T}, um AS (SELECT u, avg(r) AS m FROM r GROUP BY u), q AS ({_sums('u', 'i', 'AND a.u IN (SELECT u FROM t)')}), w AS (SELECT a, b, {_pearson()} AS w FROM q WHERE n >= 2),
        s AS (SELECT t.u, t.i, sum((r.r - um.m) * w) AS top, sum(abs(w)) AS below FROM t JOIN w ON w.a = t.u AND w <> 0 JOIN r ON r.u = w.b AND r.i = t.i JOIN um ON um.u = r.u GROUP BY 1, 2)
        SELECT t.u AS user_id, t.i AS business_id, round(least(5.0, greatest(1.0, coalesce(um.m + coalesce(CASE WHEN below <> 0 THEN top / below END, 0.0), 3.0))), 6) AS prediction FROM t LEFT JOIN um ON um.u = t.u LEFT JOIN s ON s.u = t.u AND s.i = t.i""",
    "item_cf": f"ITEM_CF {_similar(JACCARD, 0.5, 2)}",
    "item_cf_lsh": f"ITEM_CF {LSH_SIM}",
    "top5_item_cf": f"""WITH {R}, {T}, um AS (SELECT u, avg(r) AS m FROM r GROUP BY u), q AS ({_sums('i', 'u', 'AND a.i <> b.i')}), w AS (SELECT a, b, w FROM (SELECT a, b, {_pearson()} AS w FROM q WHERE n >= 2) WHERE w <> 0),
        o AS (SELECT a, b, w, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS o, count(*) FILTER (w > 0) OVER (PARTITION BY a) AS up, count(*) FILTER (w < 0) OVER (PARTITION BY a) AS down FROM w),
        k AS (SELECT a, b, w FROM o WHERE CASE WHEN w > 0 THEN o ELSE o + (SELECT count(DISTINCT i) FROM r) - 1 - up - down END <= 5),
        s AS (SELECT t.u, t.i, sum(w * coalesce(r.r, um.m)) AS top, sum(abs(w)) AS below FROM t JOIN um ON um.u = t.u JOIN k ON k.a = t.i LEFT JOIN r ON r.u = t.u AND r.i = k.b GROUP BY 1, 2)
        SELECT t.u AS user_id, t.i AS business_id, round(CASE WHEN um.m IS NULL THEN 3.0 WHEN t.i NOT IN (SELECT i FROM r) THEN um.m ELSE coalesce(CASE WHEN below <> 0 THEN top / below END, 3.0) END, 6) AS prediction
        FROM t LEFT JOIN um ON um.u = t.u LEFT JOIN s ON s.u = t.u AND s.i = t.i""",
    "cold_start_default": f"WITH {BIAS} SELECT t.u AS user_id, t.i AS business_id, round(CASE WHEN raw IS NULL THEN 3.0 ELSE least(5.0, greatest(1.0, raw)) END, 6) AS prediction FROM t LEFT JOIN p ON p.u = t.u AND p.i = t.i",
    "clamp_ratings": f"WITH {BIAS} SELECT u AS user_id, i AS business_id, round(raw, 6) AS raw, round(least(5.0, greatest(1.0, raw)), 6) AS prediction FROM p",
    "left_join_dedup": f"WITH {V}, d AS (SELECT review_id, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY doc_id) AS o FROM documents WHERE review_id IS NOT NULL) WHERE o = 1) SELECT v.review_id, stars, doc_id, n_chars FROM v LEFT JOIN d ON d.review_id = v.review_id",
    "bloom_fpr": f"""WITH {H}, f AS (SELECT state, min(seq) AS f, arg_min(date_trunc('hour', received_at), seq) AS hour, {BYTES.format('state')} AS bytes FROM business_stream WHERE state IS NOT NULL GROUP BY state),
        b AS (SELECT DISTINCT f, hour, (({CODE} * a + b) % p) % 200 AS bit FROM f, h), s AS (SELECT bit, min(f) AS since FROM b GROUP BY bit),
        k AS (SELECT f, hour, bool_and(since < f) AS fp FROM b JOIN s USING (bit) GROUP BY 1, 2), c AS (SELECT hour, count(*) FILTER (fp) AS fp, count(*) FILTER (NOT fp) AS tn FROM k GROUP BY hour),
        d AS (SELECT DISTINCT date_trunc('hour', received_at) AS hour FROM business_stream WHERE received_at IS NOT NULL),
        r AS (SELECT d.hour, sum(coalesce(fp, 0)) OVER o AS fp, sum(coalesce(tn, 0)) OVER o AS tn FROM d LEFT JOIN c ON c.hour = d.hour WINDOW o AS (ORDER BY d.hour))
        SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, fp::BIGINT AS fp, tn::BIGINT AS tn, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM r""",
    "fm_estimate": f"""WITH {H}, w AS (SELECT DISTINCT (epoch(received_at)::BIGINT // 7200 - k) * 7200 AS w, city FROM business_stream, (SELECT unnest(range(3)) AS k) WHERE city IS NOT NULL AND received_at IS NOT NULL),
        c AS (SELECT city, {BYTES.format('city')} AS bytes FROM (SELECT DISTINCT city FROM w)), v AS (SELECT city, j, bin((({CODE} * a + b) % p) % 200) AS v FROM c, h),
        z AS (SELECT w, j, max(length(v) - length(rtrim(v, '0'))) AS r FROM w JOIN v USING (city) GROUP BY 1, 2), g AS (SELECT w, j // 9 AS g, avg(pow(2, r)) AS g_mean FROM z GROUP BY 1, 2),
        s AS (SELECT w, list_sort(list(g_mean))[3] AS estimate FROM g GROUP BY w), n AS (SELECT w, count(*) AS n_distinct FROM w GROUP BY w)
        SELECT strftime(epoch_ms(w * 1000), '%Y-%m-%d %H:%M:%S') AS window_start, n_distinct, round(estimate, 6) AS estimate FROM s JOIN n USING (w)""",
    "reservoir_tags": TOP5.format(TAGS.format("(SELECT hashtags FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY batch_no, arrived_at) AS o FROM tweet WHERE len(hashtags) > 0 AND tweet_id IS NOT NULL) WHERE o = 1 ORDER BY md5(tweet_id::VARCHAR) LIMIT 150)")),
    "top_tags_ties": TOP5.format(TAGS.format("tweet")),
    "components": f"{COMPONENTS} SELECT id AS business_id, component FROM k",
    "component_lines": f"{COMPONENTS} SELECT count(*)::INT AS size, string_agg('''' || id || '''', ', ' ORDER BY id) AS members FROM k GROUP BY component",
    "label_propagation": f"WITH {LPA} SELECT id AS business_id, label FROM p5",
    "modularity": f"""WITH {LPA}, k AS (SELECT count(*)::DOUBLE AS k FROM e0), d AS (SELECT label, count(*) AS d FROM e JOIN p5 ON p5.id = e.src GROUP BY label),
        l AS (SELECT a.label, count(*) AS l FROM e0 JOIN p5 a ON a.id = src JOIN p5 b ON b.id = dst AND b.label = a.label GROUP BY a.label)
        SELECT round(sum(coalesce(l, 0) / k - pow(d / (2 * k), 2)), 6) AS modularity FROM d LEFT JOIN l ON l.label = d.label, k""",
    "sentiment_score": f"""WITH lex AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in sorted(LEXICON.items()))}) AS lex(w, v)),
        t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE source = 'tip'), s AS (SELECT doc_id, sum(v) AS s FROM t JOIN lex USING (w) GROUP BY doc_id)
        SELECT d.doc_id, round(coalesce(s / sqrt(s * s + 15), 0.0), 6) AS score FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id WHERE source = 'tip'""",
}
for _name in ("item_cf", "item_cf_lsh"):
    _similar_part = SQL[_name].removeprefix("ITEM_CF ")
    SQL[_name] = f"""WITH {_similar_part}, {R}, {T}, nb AS (SELECT id_1 AS a, id_2 AS b FROM sim UNION SELECT id_2, id_1 FROM sim),
        c AS (SELECT nb.a, nb.b, count(*) AS n, sum(p.r) AS x, sum(q2.r) AS y, sum(p.r * q2.r) AS xy, sum(p.r * p.r) AS xx, sum(q2.r * q2.r) AS yy FROM nb JOIN r p ON p.i = nb.a JOIN r q2 ON q2.i = nb.b AND q2.u = p.u GROUP BY 1, 2),
        w AS (SELECT a, b, w FROM (SELECT a, b, {_pearson()} AS w FROM c) WHERE w > 0),
        ag AS (SELECT t.u, t.i, sum(w * r.r) / sum(abs(w)) AS p FROM t JOIN w ON w.a = t.i JOIN r ON r.u = t.u AND r.i = w.b GROUP BY 1, 2)
        SELECT t.u AS user_id, t.i AS business_id, round(least(5.0, greatest(1.0, coalesce(ag.p, 3.0))), 6) AS prediction FROM t LEFT JOIN ag ON ag.u = t.u AND ag.i = t.i"""
