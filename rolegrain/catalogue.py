"""Every registered query of the feature engine, with its SQL where SQL can express it.

Queries are registered by @query; the SQL string beside each runs in DuckDB on
the same tables and gives the same columns. Doubles are rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import categorical as C
from .operators import dates, insight, metrics, models, numeric, reader, relational, target
from .plans import pipelines
from .plans.automl import Algo, AutoML
from .plans.reading import Reader
from .plans.roles import Role, RoleFrame
from .plans.validation import Validation
from .sources import io

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def t(spark, d, name):
    return io.read(spark, f"{d}/{name}.parquet")


def r6(c):
    return F.round(F.col(f"`{c}`") if isinstance(c, str) else c, 6)


def rounded(df, keep, cols, names=None):
    names = names or cols
    return df.select(*keep, *[r6(c).alias(n) for c, n in zip(cols, names)])


# ---------------------------------------------------------------- labels

_LABELS = "SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS i FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > {m}"


@query(f"WITH p AS ({_LABELS.format(c='o_orderpriority', t='orders', m=5)}), s AS ({_LABELS.format(c='o_orderstatus', t='orders', m=5)}) SELECT o_orderkey, CAST(coalesce(p.i, 0) AS INT) AS priority, CAST(coalesce(s.i, 0) AS INT) AS status FROM orders LEFT JOIN p ON o_orderpriority = p.v LEFT JOIN s ON o_orderstatus = s.v")
def label_encode_orders(spark, d):
    df, cols = t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"]
    out = C.label_encode(df, C.fit_labels(df, cols, 5), cols)
    return out.select("o_orderkey", F.col("le__o_orderpriority").alias("priority"), F.col("le__o_orderstatus").alias("status"))


@query(f"WITH m AS ({_LABELS.format(c='p_brand', t='part', m=75)}) SELECT p_partkey, CAST(coalesce(i, 0) AS INT) AS code FROM part LEFT JOIN m ON p_brand = v")
def rare_to_default(spark, d):
    df = t(spark, d, "part")
    return C.label_encode(df, C.fit_labels(df, ["p_brand"], 75), ["p_brand"]).select("p_partkey", F.col("le__p_brand").alias("code"))


@query("WITH m AS (SELECT o_custkey AS v, row_number() OVER (ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) AS i FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1) SELECT o_orderkey, CAST(coalesce(i, 0) AS INT) AS code FROM orders LEFT JOIN m ON o_custkey = v WHERE o_orderkey % 5 = 0")
def unseen_to_default(spark, d):
    df = t(spark, d, "orders")
    model = C.fit_labels(df.where("o_orderkey % 5 <> 0"), ["o_custkey"])
    return C.label_encode(df.where("o_orderkey % 5 = 0"), model, ["o_custkey"]).select("o_orderkey", F.col("le__o_custkey").alias("code"))


@query("SELECT 'o_orderpriority' AS col, o_orderpriority AS val, count(*) AS cnt, row_number() OVER (ORDER BY count(*), o_orderpriority) AS idx FROM orders GROUP BY 2")
def labels_by_rarity(spark, d):
    return C.fit_labels(t(spark, d, "orders"), ["o_orderpriority"], order="frequencyAsc")


@query("WITH m AS (SELECT lang AS v, row_number() OVER (ORDER BY lang) AS i FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT doc_id, CAST(coalesce(i, 0) AS DOUBLE) AS lang_code, CAST(n_chars AS DOUBLE) AS n FROM documents LEFT JOIN m ON lang = v")
def ordinal_encode(spark, d):
    df, cols = t(spark, d, "documents"), ["lang", "n_chars"]
    out = C.ordinal_encode(df, C.fit_labels(df, ["lang"], order="alphabetAsc", nan_last=True), cols)
    return out.select("doc_id", F.col("ord__lang").alias("lang_code"), F.col("ord__n_chars").alias("n"))


@query("WITH m AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, l_partkey, l_linenumber, CAST(coalesce(n, 1) AS INT) AS freq FROM lineitem LEFT JOIN m ON l_partkey = v")
def freq_encode(spark, d):
    df = t(spark, d, "lineitem")
    return C.freq_encode(df, C.fit_counts(df, ["l_partkey"]), ["l_partkey"]).select("l_orderkey", "l_partkey", "l_linenumber", F.col("freq__l_partkey").alias("freq"))


def _inter(n):
    v = " || '_' || ".join(["l_returnflag", "l_linestatus", "CAST(l_linenumber AS VARCHAR)"][:n])
    return f"WITH b AS (SELECT l_orderkey, l_partkey, {v} AS v FROM lineitem), m AS (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS i FROM b GROUP BY v HAVING count(*) > 5) SELECT l_orderkey, l_partkey, b.v AS combo, CAST(coalesce(i, 0) AS INT) AS code FROM b LEFT JOIN m ON b.v = m.v"


def _intersect(spark, d, n):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"][:n]
    df, names = C.with_intersections(t(spark, d, "lineitem"), cols, intersections=[tuple(cols)])
    out = C.label_encode(df, C.fit_labels(df, names, 5), names)
    return out.select("l_orderkey", "l_partkey", F.col(f"`{names[0]}`").alias("combo"), F.col(f"`le__{names[0]}`").alias("code"))


@query(_inter(2))
def cat_intersect_2(spark, d):
    return _intersect(spark, d, 2)


@query(_inter(3))
def cat_intersect_3(spark, d):
    return _intersect(spark, d, 3)


@query("SELECT n_nationkey, CAST(n_regionkey = 0 AS INT) AS r0, CAST(n_regionkey = 1 AS INT) AS r1, CAST(n_regionkey = 2 AS INT) AS r2 FROM nation")
def one_hot(spark, d):
    out = C.one_hot(t(spark, d, "nation"), "n_regionkey", 3)
    return out.select("n_nationkey", *[F.col(f"ohe_{k}__n_regionkey").alias(f"r{k}") for k in range(3)])


@query("SELECT p_type, count(*) AS cnt FROM part GROUP BY p_type ORDER BY cnt DESC, p_type LIMIT 5")
def top_categories(spark, d):
    return C.top_categories(t(spark, d, "part"), "p_type", 5)


# ---------------------------------------------------------------- reader


def _with_gaps(spark, d):
    """orders with NULL prices on every 7th key and empty priorities on every 5th."""
    k = F.col("o_orderkey")
    return t(spark, d, "orders").withColumns({"o_totalprice": F.when(k % 7 != 0, F.col("o_totalprice")), "o_orderpriority": F.when(k % 5 != 0, F.col("o_orderpriority")), "one": F.lit("x")})


_GAPS = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority, 'x' AS one FROM orders)"
_GAP_COLS = ["o_totalprice", "o_orderpriority", "one"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM {_GAPS}" for c in _GAP_COLS))
def null_rates(spark, d):
    return rounded(reader.null_rates(_with_gaps(spark, d), _GAP_COLS), ["col"], ["null_rate"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, round(max(n) / sum(n), 6) AS constant_rate FROM (SELECT count(*) AS n FROM {_GAPS} GROUP BY {c})" for c in _GAP_COLS))
def constant_rates(spark, d):
    return rounded(reader.constant_rates(_with_gaps(spark, d), _GAP_COLS), ["col"], ["constant_rate"])


@query("WITH g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, (SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM {_GAPS}) AS a, (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM {_GAPS} GROUP BY {c})) AS b" for c in _GAP_COLS) + ") SELECT col, a < 0.19 AND b < 0.999 AS ok FROM g")
def ok_features(spark, d):
    return reader.ok_features(_with_gaps(spark, d), _GAP_COLS, 0.19, 0.999).select("col", "ok")


@query("SELECT * FROM (VALUES ('event_id', 'Numeric'), ('ts', 'Datetime'), ('event_type', 'Category'), ('value', 'Numeric'), ('number_text', 'Numeric'), ('time_text', 'Datetime')) v(col, role)")
def guess_roles(spark, d):
    df = t(spark, d, "events").withColumn("number_text", F.col("user_id").cast("string")).withColumn("time_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return reader.guess_roles(df, ["event_id", "ts", "event_type", "value", "number_text", "time_text"])


@query("SELECT o_orderstatus AS label, CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS idx FROM orders GROUP BY 1")
def target_class_map(spark, d):
    return reader.class_map(t(spark, d, "orders"), "o_orderstatus")


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS INT) AS fold FROM orders")
def fold_assign(spark, d):
    return reader.assign_folds(t(spark, d, "orders"), 5, "o_orderkey").select("o_orderkey", "fold")


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) IS NULL AS missing, round(coalesce(TRY_CAST(nullif(regexp_extract(props, '[0-9]+'), '') AS DOUBLE), -1), 6) AS x FROM events")
def convert_numeric(spark, d):
    df = t(spark, d, "events").withColumn("raw", F.nullif(F.regexp_extract("props", "[0-9]+", 0), F.lit("")))
    out = reader.convert(df, {"raw": Role.of("Numeric")})
    return out.select("event_id", F.isnan("raw").alias("missing"), F.round(F.nanvl("raw", F.lit(-1.0)), 6).alias("x"))


@query("SELECT count(*) AS n, count(*) AS n_ok, true AS valid FROM orders")
def validate_datetime(spark, d):
    df = t(spark, d, "orders").withColumn("s", F.date_format("o_orderdate", "dd.MM.yyyy"))
    return reader.validate_datetime(df, "s", "dd.MM.yyyy")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 < 3")
def sample_deterministic(spark, d):
    return reader.sample_by_key(t(spark, d, "orders"), "o_orderkey", 3, 10).select("o_orderkey")


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS _id FROM nation")
def row_ids(spark, d):
    return reader.with_row_id(t(spark, d, "nation"), ["n_name"]).select("n_nationkey", "_id")


# ---------------------------------------------------------------- numbers


def _dirty(spark, d):
    """lineitem with NaN discounts on every 7th order and infinite taxes on every 11th."""
    k = F.col("l_orderkey")
    df = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return df.withColumns({"l_discount": F.when(k % 7 == 0, X.nan()).otherwise(F.col("l_discount")), "l_tax": F.when(k % 11 == 0, F.lit(float("inf"))).otherwise(F.col("l_tax"))})


_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_K = ", ".join(_KEY)
_DIRTY = f"(SELECT {_K}, l_quantity, l_extendedprice, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS disc, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem)"


@query(f"SELECT {_K}, CAST(CASE WHEN disc IS NULL THEN 1 ELSE 0 END AS FLOAT) AS flag FROM {_DIRTY}")
def nan_flags(spark, d):
    df = _dirty(spark, d)
    out = numeric.nan_flags(df, numeric.fit_numeric(df, ["l_discount", "l_quantity"]))
    return out.select(*_KEY, F.col("nanflg__l_discount").alias("flag"))


@query(f"SELECT {_K}, tax IS NULL AS gone, round(coalesce(tax, 0), 6) AS tax FROM {_DIRTY}")
def fill_inf(spark, d):
    out = numeric.fill_inf(_dirty(spark, d), ["l_tax"])
    return out.select(*_KEY, F.isnan("fillinf__l_tax").alias("gone"), r6(F.nanvl("fillinf__l_tax", F.lit(0.0))).alias("tax"))


@query(f"SELECT {_K}, round(coalesce(disc, (SELECT quantile_cont(disc, 0.5) FROM {_DIRTY})), 6) AS disc FROM {_DIRTY}")
def fill_median(spark, d):
    df = _dirty(spark, d)
    return rounded(numeric.fill_median(df, numeric.fit_numeric(df, ["l_discount"])), _KEY, ["fillnamed__l_discount"], ["disc"])


@query(f"SELECT {_K}, round(ln(greatest(least(p, 1 - 1e-7), 1e-7) / (1 - greatest(least(p, 1 - 1e-7), 1e-7))), 6) AS lo FROM (SELECT {_K}, l_quantity / 50 AS p FROM lineitem)")
def log_odds(spark, d):
    df = t(spark, d, "lineitem").withColumn("p", F.col("l_quantity") / 50)
    return rounded(numeric.log_odds(df, ["p"]), _KEY, ["logodds__p"], ["lo"])


@query("WITH m AS (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS s FROM customer) SELECT c_custkey, round((c_acctbal - a) / s, 6) AS z FROM customer, m")
def standard_scale(spark, d):
    df = t(spark, d, "customer")
    return rounded(numeric.standard_scale(df, numeric.fit_numeric(df, ["c_acctbal"])), ["c_custkey"], ["scaler__c_acctbal"], ["z"])


@query("WITH m AS (SELECT quantile_cont(s_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM supplier) SELECT s_suppkey, CAST(1 + len(list_filter(list_distinct(q), lambda e: s_acctbal >= e)) AS INT) AS bin FROM supplier, m")
def quantile_bin(spark, d):
    df = t(spark, d, "supplier")
    return numeric.quantile_bin(df, numeric.fit_bins(df, ["s_acctbal"])).select("s_suppkey", F.col("qntl__s_acctbal").alias("bin"))


@query(f"WITH f AS (SELECT {_K}, coalesce(disc, (SELECT quantile_cont(disc, 0.5) FROM {_DIRTY})) AS x, coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM {_DIRTY})) AS y FROM {_DIRTY}), m AS (SELECT avg(x) AS ax, stddev_samp(x) AS sx, avg(y) AS ay, stddev_samp(y) AS sy FROM f) SELECT {_K}, round((x - ax) / sx, 6) AS x, round((y - ay) / sy, 6) AS y FROM f, m")
def dense_chain(spark, d):
    df, cols = _dirty(spark, d), ["l_discount", "l_tax"]
    frame = RoleFrame(df.withColumn("_id", F.lit(0)), "_id", {c: Role.of("Numeric") for c in cols})
    apply = pipelines._dense(cols).fit(frame, df)
    return rounded(apply(df, True), _KEY, [f"scaler__fillnamed__fillinf__{c}" for c in cols], ["x", "y"])


@query()
def pca_customers(spark, d):
    out = numeric.pca(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 2)
    return out.select(*_KEY, F.round(F.abs(F.col(out.columns[-1])), 4).alias("second"))


# ---------------------------------------------------------------- target encoding

_ALPHAS = "(VALUES (0.5), (1.0), (2.0), (5.0), (10.0), (50.0), (250.0), (1000.0)) al(alpha)"


def _te_sql(y, cat="CAST(l_linenumber AS VARCHAR)"):
    return f"""b AS (SELECT {_K}, {cat} AS c, l_orderkey % 5 AS f, {y} AS y FROM lineitem),
fp AS (SELECT f, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS prior FROM (SELECT f, sum(y) AS s, count(*) AS n FROM b GROUP BY f)),
cell AS (SELECT c, f, sum(y) AS s, sum(y * y) AS q, count(*) AS n FROM b GROUP BY c, f),
o AS (SELECT *, sum(s) OVER (PARTITION BY c) - s AS so, sum(n) OVER (PARTITION BY c) - n AS no FROM cell),
cand AS (SELECT o.*, alpha, (so + alpha * prior) / (no + alpha) AS cand FROM o JOIN fp ON fp.f = o.f, (SELECT CAST(alpha AS DOUBLE) AS alpha FROM {_ALPHAS}))"""


_LOGLOSS = "sum(-(s * ln(least(greatest(cand, 1e-15), 1 - 1e-15)) + (n - s) * ln(1 - least(greatest(cand, 1e-15), 1 - 1e-15)))) / sum(n)"
_SQUARE = "sum(q - 2 * cand * s + n * cand * cand) / sum(n)"
_FLAG = "CAST(l_returnflag = 'R' AS DOUBLE)"
_BEST = "sc AS (SELECT alpha, {loss} AS score FROM cand GROUP BY alpha), best AS (SELECT alpha FROM sc ORDER BY round(score, 12), alpha LIMIT 1)"


def _te_frame(spark, d):
    return t(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int")).withColumn("fold", X.fold_of(F.col("l_orderkey")))


@query(f"WITH {_te_sql(_FLAG)} SELECT f AS fold, round(prior, 6) AS prior FROM fp")
def fold_priors(spark, d):
    return target.fold_priors(_te_frame(spark, d), "fold", "y").select(F.col("fold").cast("long").alias("fold"), r6("prior").alias("prior"))


@query(f"WITH {_te_sql(_FLAG)}, {_BEST.format(loss=_LOGLOSS)} SELECT 'l_linenumber' AS col, alpha, round(score, 6) AS score FROM sc")
def te_alpha_scores(spark, d):
    return rounded(target.alpha_scores(_te_frame(spark, d), ["l_linenumber"], "fold", "y"), ["col", "alpha"], ["score"])


@query(f"WITH {_te_sql(_FLAG)}, {_BEST.format(loss=_LOGLOSS)} SELECT c AS cat, round((sum(s) + max(best.alpha) * (SELECT avg(y) FROM b)) / (sum(n) + max(best.alpha)), 6) AS enc FROM cell, best GROUP BY c")
def te_binary_full(spark, d):
    model, _ = target.fit_te(_te_frame(spark, d), ["l_linenumber"], "fold", "y")
    return rounded(model.where("fold is null"), ["cat"], ["enc"])


@query(f"WITH {_te_sql(_FLAG)}, {_BEST.format(loss=_LOGLOSS)} SELECT {_K}, round(cand, 6) AS enc FROM b JOIN cand ON cand.c = b.c AND cand.f = b.f JOIN best ON best.alpha = cand.alpha")
def te_binary_oof(spark, d):
    df = _te_frame(spark, d)
    model, _ = target.fit_te(df, ["l_linenumber"], "fold", "y")
    return rounded(target.apply_te(df, model, ["l_linenumber"], 0.5, "fold"), _KEY, ["oof__l_linenumber"], ["enc"])


@query(f"WITH {_te_sql('l_extendedprice', 'l_returnflag')}, {_BEST.format(loss=_SQUARE)} SELECT c AS cat, f AS fold, round(cand, 4) AS enc FROM cand JOIN best ON best.alpha = cand.alpha")
def te_reg(spark, d):
    df = _te_frame(spark, d)
    model, _ = target.fit_te(df, ["l_returnflag"], "fold", "l_extendedprice", "reg")
    return model.where("fold is not null").select("cat", F.col("fold").cast("long").alias("fold"), F.round("enc", 4).alias("enc"))


@query(f"WITH {_te_sql(_FLAG, chr(39).join(['l_linestatus || ', '_', ' || CAST(l_linenumber AS VARCHAR)']))}, {_BEST.format(loss=_LOGLOSS)} SELECT {_K}, round(cand, 6) AS enc FROM b JOIN cand ON cand.c = b.c AND cand.f = b.f JOIN best ON best.alpha = cand.alpha")
def te_on_intersections(spark, d):
    df, names = C.with_intersections(_te_frame(spark, d), ["l_linestatus", "l_linenumber"])
    model, _ = target.fit_te(df, names, "fold", "y")
    return rounded(target.apply_te(df, model, names, 0.5, "fold"), _KEY, [f"oof__{names[0]}"], ["enc"])


@query("""WITH m AS (SELECT o_orderstatus AS l, row_number() OVER (ORDER BY o_orderstatus) - 1 AS k FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS c, o_orderkey % 5 AS f, k AS y FROM orders JOIN m ON l = o_orderstatus),
p AS (SELECT f, y, count(*) AS n FROM b GROUP BY f, y),
pr AS (SELECT f, y, (sum(n) OVER (PARTITION BY y) - n) / (sum(n) OVER () - sum(n) OVER (PARTITION BY f)) AS fp, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS prior FROM p),
g AS (SELECT cf.c, cf.f, k AS y, coalesce(n, 0) AS n FROM (SELECT DISTINCT c, f FROM b) cf CROSS JOIN m LEFT JOIN (SELECT c, f, y, count(*) AS n FROM b GROUP BY c, f, y) x ON x.c = cf.c AND x.f = cf.f AND x.y = k),
h AS (SELECT *, sum(n) OVER (PARTITION BY c, f) AS nf, sum(n) OVER (PARTITION BY c, y) - n AS oc, sum(n) OVER (PARTITION BY c) - sum(n) OVER (PARTITION BY c, f) AS o FROM g),
cand AS (SELECT h.*, alpha, (oc + alpha * fp) / (o + alpha) AS cand FROM h JOIN pr ON pr.f = h.f AND pr.y = h.y, (SELECT CAST(alpha AS DOUBLE) AS alpha FROM """ + _ALPHAS + """)),
best AS (SELECT alpha FROM (SELECT alpha, sum(-ln(greatest(cand, 1e-15)) * n) AS loss FROM cand GROUP BY alpha) ORDER BY round(loss, 9), alpha LIMIT 1)
SELECT c AS cat, y AS cls, f AS fold, round(cand, 6) AS enc FROM cand JOIN best ON best.alpha = cand.alpha""")
def te_multiclass(spark, d):
    df = t(spark, d, "orders").withColumn("fold", X.fold_of(F.col("o_orderkey")))
    k = reader.class_map(df, "o_orderstatus")
    df = df.join(F.broadcast(k), F.col("o_orderstatus") == F.col("label"))  # a row per class
    model = target.fit_multiclass_te(df, "o_orderpriority", "fold", "idx")
    return model.where("fold is not null").select("cat", F.col("cls").cast("long").alias("cls"), F.col("fold").cast("long").alias("fold"), r6("enc").alias("enc"))


# ---------------------------------------------------------------- dates


@query("SELECT o_orderkey, round((epoch(o_orderdate) - epoch(TIMESTAMP '2020-01-01')) / 86400, 6) AS days FROM orders")
def time_to_num(spark, d):
    return rounded(dates.time_to_num(t(spark, d, "orders"), ["o_orderdate"]), ["o_orderkey"], ["dtdiff__o_orderdate"], ["days"])


@query(f"SELECT {_K}, round((epoch(l_shipdate) - epoch(o_orderdate)) / 3600, 6) AS hours FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def base_diff(spark, d):
    df = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(dates.base_diff(df, ["o_orderdate"], ["l_shipdate"], "HOUR"), _KEY, ["basediff_o_orderdate__l_shipdate"], ["hours"])


@query("SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(isodow(ts) - 1 AS INT) AS wd, CAST(hour(ts) AS INT) AS hour, CAST(minute(ts) AS INT) AS min, CAST(second(ts) AS INT) AS sec, 0 AS ms FROM events")
def seasons(spark, d):
    kinds = ("y", "m", "d", "wd", "hour", "min", "sec", "ms")
    return dates.seasons(t(spark, d, "events"), ["ts"], kinds).select("event_id", *[F.col(f"season_{k}__ts").alias(k) for k in kinds])


_DAYS = ["1996-01-01", "1996-05-01", "1997-12-25", "1999-07-04"]


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') IN ({', '.join(repr(x) for x in _DAYS)}) AS holiday FROM orders")
def is_holiday(spark, d):
    days = spark.range(1).select(F.lit("o_orderdate").alias("col"), F.explode(F.array(*map(F.lit, _DAYS))).alias("day"))
    return dates.is_holiday(t(spark, d, "orders"), days, ["o_orderdate"]).select("o_orderkey", F.col("season_hol__o_orderdate").alias("holiday"))


# ---------------------------------------------------------------- relational


@query("SELECT c_custkey, c_acctbal, c_mktsegment, n.n AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) n ON o_custkey = c_custkey")
def concat_frames(spark, d):
    c = t(spark, d, "customer")
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return relational.concat([c.select("c_custkey", "c_acctbal"), c.select("c_custkey", "c_mktsegment", "c_acctbal"), n], "c_custkey").select("c_custkey", "c_acctbal", "c_mktsegment", "orders")


@query("SELECT o_orderkey, round(o_totalprice * (1 + o_orderkey % 5), 4) AS prediction FROM orders")
def stitch_folds(spark, d):
    df = t(spark, d, "orders").withColumn("fold", X.fold_of(F.col("o_orderkey")))
    parts = [v.select("o_orderkey", (F.col("o_totalprice") * (1 + k)).alias("prediction")) for k, (_, v) in enumerate(relational.folds(df, "fold", 5))]
    return relational.stitch_folds(df.select("o_orderkey"), parts, "o_orderkey").select("o_orderkey", F.round("prediction", 4).alias("prediction"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS is_val FROM orders")
def union_train_valid(spark, d):
    df = t(spark, d, "orders").select("o_orderkey")
    return relational.union_train_valid(df.where("o_orderkey % 5 <> 0"), df.where("o_orderkey % 5 = 0"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem")
def uniques_exact(spark, d):
    return t(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps"))


@query()
def uniques_approx(spark, d):
    return t(spark, d, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_suppkey").alias("supps"))


@query("SELECT vec_id, embedding[1] AS e_0, embedding[2] AS e_1, embedding[3] AS e_2 FROM embeddings")
def vector_expand(spark, d):
    return relational.expand_vector(t(spark, d, "embeddings"), "embedding", 3, "e_{i}").select("vec_id", "e_0", "e_1", "e_2")


@query("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + embedding[2]) / 2, 6) AS m0, round((CAST(embedding[3] AS DOUBLE) + embedding[4]) / 2, 6) AS m1 FROM embeddings")
def vector_average(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    v = X.vector_average(F.array(F.array(e(0), e(2)), F.lit(None).cast("array<double>"), F.array(e(1), e(3))), 2)
    return t(spark, d, "embeddings").select("vec_id", r6(F.get(v, F.lit(0))).alias("m0"), r6(F.get(v, F.lit(1))).alias("m1"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_tax + l_discount) / 2, 6) AS m FROM lineitem")
def scalar_average(spark, d):
    return t(spark, d, "lineitem").select(*_KEY, r6(X.scalar_average(F.array("l_tax", F.lit(None).cast("double"), "l_discount"))).alias("m"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings")
def argmax_vector(spark, d):
    return t(spark, d, "embeddings").select("vec_id", X.argmax(F.col("embedding")).alias("best"))


# ---------------------------------------------------------------- metrics


def _scored(spark, d):
    return t(spark, d, "lineitem").select(*_KEY, (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("s"), (F.col("l_quantity") > 25).cast("int").alias("p"))


_SC = "b AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_quantity / 50 AS s, CAST(l_quantity > 25 AS INT) AS p FROM lineitem)"
_CUM = f"WITH {_SC}, g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY s), c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM g)"


@query(f"WITH {_SC}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM b) SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r")
def auc_rank(spark, d):
    return rounded(metrics.auc(_scored(spark, d), "y", "s"), [], ["auc"])


@query(_CUM + " SELECT round(sum(tp / (tp + fp) * pos / pp), 6) AS aupr FROM c")
def aupr(spark, d):
    return rounded(metrics.average_precision(_scored(spark, d), "y", "s"), [], ["aupr"])


@query(f"WITH {_SC} SELECT round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(s, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)) END), 6) AS logloss FROM b")
def logloss(spark, d):
    return rounded(metrics.log_loss(_scored(spark, d), "y", "s"), [], ["logloss"])


@query("WITH b AS (SELECT p_retailprice AS y, 900 + p_size * 10.0 AS p FROM part) SELECT round(avg(abs(p - y)), 6) AS mae, round(quantile_cont(abs(p - y), 0.5), 6) AS median_ae, round(avg((p - y) * (p - y)), 6) AS mse, round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS r2, round(1 - var_pop(p - y) / var_pop(y), 6) AS explained_variance FROM b")
def regression_metrics(spark, d):
    df = t(spark, d, "part").select(F.col("p_retailprice").alias("y"), (900 + F.col("p_size") * 10.0).alias("p"))
    return rounded(metrics.regression(df, "y", "p"), [], ["mae", "median_ae", "mse", "r2", "explained_variance"])


@query(f"WITH {_SC} SELECT y AS actual, p AS predicted, count(*) AS cnt FROM b GROUP BY 1, 2")
def confusion(spark, d):
    return metrics.confusion(_scored(spark, d), "y", "p")


_PRF = f"WITH {_SC}, k AS (SELECT k AS cls FROM range(2) r(k)), c AS (SELECT cls, sum(CAST(y = cls AS INT)) AS support, sum(CAST(p = cls AS INT)) AS said, sum(CAST(y = cls AND p = cls AS INT)) AS tp FROM b, k GROUP BY cls), m AS (SELECT cls, support, tp / said AS precision, tp / support AS recall, 2 * tp / (said + support) AS f1 FROM c)"


@query(_PRF + " SELECT CAST(cls AS INT) AS cls, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def prf_per_class(spark, d):
    return rounded(metrics.per_class(_scored(spark, d), "y", "p"), ["cls", "support"], ["precision", "recall", "f1"])


@query(_PRF + " SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM m")
def prf_macro_weighted(spark, d):
    df = metrics.averages(_scored(spark, d), "y", "p")
    return rounded(df, [], df.columns)


@query(_CUM + " SELECT round(s, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / pp, 6) AS tpr FROM c")
def roc_points(spark, d):
    return rounded(metrics.roc_points(_scored(spark, d), "y", "s"), [], ["threshold", "fpr", "tpr"])


@query(_CUM + " SELECT round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall FROM c")
def pr_points(spark, d):
    return rounded(metrics.pr_points(_scored(spark, d), "y", "s"), [], ["threshold", "precision", "recall"])


@query(_CUM + " SELECT round(s, 6) AS threshold, round(2 * tp / (tp + fp + pp), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall FROM c ORDER BY round(2 * tp / (tp + fp + pp), 12) DESC, s DESC LIMIT 1")
def best_f1(spark, d):
    return rounded(metrics.best_f1(_scored(spark, d), "y", "s"), [], ["threshold", "f1", "precision", "recall"])


def _gini_sql(c):
    return f"SELECT '{c}' AS col, round(abs(2 * (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) - 1), 6) AS gini FROM (SELECT y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk FROM (SELECT CAST(l_returnflag = 'R' AS INT) AS y, {c} FROM lineitem))"


@query(" UNION ALL ".join(_gini_sql(c) for c in ("l_quantity", "l_tax", "l_linenumber")))
def gini_per_column(spark, d):
    df = t(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(metrics.gini(df, "y", ["l_quantity", "l_tax", "l_linenumber"]), ["col"], ["gini"])


# ---------------------------------------------------------------- insight


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS nan_rate, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {tb})" for c, tb in (("l_quantity", "lineitem"), ("l_tax", "lineitem"))))
def numeric_summary(spark, d):
    return rounded(insight.numeric_summary(t(spark, d, "lineitem"), ["l_quantity", "l_tax"]), ["col"], ["nan_rate", "min", "p25", "mean", "p50", "p75", "max"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, round(coalesce(sum(n) FILTER ({c} IS NULL), 0) / sum(n), 6) AS nan_rate, count({c}) AS n_unique, max_by({c}, (n, {c})) FILTER ({c} IS NOT NULL) AS most, round(max(n) FILTER ({c} IS NOT NULL) / sum(n), 6) AS most_share, min_by({c}, (n, {c})) FILTER ({c} IS NOT NULL) AS least, round(min(n) FILTER ({c} IS NOT NULL) / sum(n), 6) AS least_share FROM (SELECT {c}, count(*) AS n FROM {_GAPS} GROUP BY 1)" for c in ("o_orderpriority", "one")))
def category_summary(spark, d):
    return rounded(insight.category_summary(_with_gaps(spark, d), ["o_orderpriority", "one"]), ["col", "n_unique", "most", "least"], ["nan_rate", "most_share", "least_share"])


@query("SELECT 'o_orderdate' AS col, 0.0::DOUBLE AS nan_rate, CAST(epoch(min(o_orderdate)) AS BIGINT) AS min, CAST(epoch(max(o_orderdate)) AS BIGINT) AS max FROM orders")
def datetime_summary(spark, d):
    out = insight.datetime_summary(t(spark, d, "orders"), ["o_orderdate"])
    return out.select("col", "nan_rate", *[F.unix_timestamp(F.col(c).cast("timestamp")).alias(c) for c in ("min", "max")])


@query("WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS z FROM orders) SELECT CAST(least(7, floor((o_totalprice - a) / ((z - a) / 8))) AS INT) AS bin, count(*) AS cnt FROM orders, e GROUP BY 1")
def hist_equal_width(spark, d):
    return insight.histogram(t(spark, d, "orders"), "o_totalprice", 8).select("bin", "cnt")


def _price(df):
    """A closed-form scorer."""
    return df.withColumn("prediction", F.col("l_quantity") * (1 - F.col("l_discount")) + F.length("l_returnflag") * F.ascii("l_returnflag"))


@query("SELECT v AS value, round(avg(v * (1 - l_discount) + ascii(l_returnflag)), 6) AS mean FROM lineitem, (VALUES (10.0::DOUBLE), (20.0), (30.0)) g(v) GROUP BY v")
def pdp_numeric(spark, d):
    return rounded(insight.pdp(t(spark, d, "lineitem"), "l_quantity", [10.0, 20.0, 30.0], _price), ["value"], ["mean"])


@query("SELECT v AS value, round(avg(l_quantity * (1 - l_discount) + ascii(v)), 6) AS mean FROM lineitem, (SELECT l_returnflag AS v FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) GROUP BY v")
def pdp_categorical(spark, d):
    df = t(spark, d, "lineitem")
    return rounded(insight.pdp(df, "l_returnflag", [r[0] for r in C.top_categories(df, "l_returnflag", 2).collect()], _price), ["value"], ["mean"])


@query("SELECT CAST(v AS INT) AS value, round(avg(v * 100 + least(day(o_orderdate), day(last_day(make_date(year(o_orderdate), CAST(v AS BIGINT), 1))))), 6) AS mean FROM orders, range(1, 13) g(v) GROUP BY v")
def pdp_datetime(spark, d):
    score = lambda df: df.withColumn("prediction", F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate"))
    return rounded(insight.pdp_datetime(t(spark, d, "orders"), "o_orderdate", "month", list(range(1, 13)), score), ["value"], ["mean"])


# ---------------------------------------------------------------- plans and models


def _frame(spark, d):
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    df = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("id", F.concat_ws("-", *_KEY)).withColumn("y", (F.col("l_returnflag") == "R").cast("int")).withColumn("fold", X.fold_of(F.col("l_orderkey")))
    roles = {"l_linestatus": "Category", "o_orderpriority": "Category", "l_shipdate": "Datetime", "l_quantity": "Numeric", "l_tax": "Numeric"}
    return RoleFrame(df, "id", {c: Role.of(r) for c, r in roles.items()}, "y", "fold")


_JOINED = f"j AS (SELECT concat_ws('-', {_K}) AS id, CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_orderkey % 5 AS INT) AS fold, * FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(f"WITH {_JOINED}, s AS (SELECT l_linestatus AS v, row_number() OVER (ORDER BY l_linestatus) AS i FROM j GROUP BY 1), p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) AS i FROM j GROUP BY 1) SELECT id, y, fold, CAST(s.i AS DOUBLE) AS ord__l_linestatus, CAST(p.i AS DOUBLE) AS ord__o_orderpriority, round((epoch(l_shipdate) - epoch(TIMESTAMP '2020-01-01')) / 86400, 6) AS dtdiff__l_shipdate, l_quantity, l_tax FROM j JOIN s ON s.v = l_linestatus JOIN p ON p.v = o_orderpriority")
def tree_simple_features(spark, d):
    f = _frame(spark, d)
    out = pipelines.tree_simple(f).fit_transform(f)
    return out.withColumn("dtdiff__l_shipdate", r6("dtdiff__l_shipdate"))


@query()
def tree_advanced_features(spark, d):
    f = _frame(spark, d)
    out = pipelines.tree_advanced(f, auto_unique=3).fit_transform(f)
    return out.toDF(*[c.replace("(", "_").replace(")", "_") for c in out.columns])


_Q9 = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
_LINEAR = f"""WITH {_JOINED}, b AS (SELECT *, (epoch(l_shipdate) - epoch(TIMESTAMP '2020-01-01')) / 86400 AS dt FROM j),
m AS (SELECT avg(l_quantity) AS aq, stddev_samp(l_quantity) AS sq, avg(l_tax) AS ax, stddev_samp(l_tax) AS sx, avg(dt) AS ad, stddev_samp(dt) AS sd, list_distinct(quantile_cont(l_quantity, {_Q9})) AS eq, list_distinct(quantile_cont(l_tax, {_Q9})) AS ex FROM b),
s AS (SELECT l_linestatus AS v, row_number() OVER (ORDER BY count(*) DESC, l_linestatus) AS i FROM j GROUP BY 1 HAVING count(*) > 5),
p AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS i FROM j GROUP BY 1 HAVING count(*) > 5)
SELECT id, y, fold, CAST(year(l_shipdate) AS INT) AS season_y__l_shipdate, CAST(month(l_shipdate) AS INT) AS season_m__l_shipdate, CAST(isodow(l_shipdate) - 1 AS INT) AS season_wd__l_shipdate,
round((l_quantity - aq) / sq, 6) AS scaler__fillnamed__fillinf__l_quantity, round((l_tax - ax) / sx, 6) AS scaler__fillnamed__fillinf__l_tax, round((dt - ad) / sd, 6) AS scaler__fillnamed__fillinf__dtdiff__l_shipdate,
CAST(1 + len(list_filter(eq, lambda e: l_quantity >= e)) AS INT) AS qntl__l_quantity, CAST(1 + len(list_filter(ex, lambda e: l_tax >= e)) AS INT) AS qntl__l_tax,
CAST(coalesce(s.i, 0) AS INT) AS le__l_linestatus, CAST(coalesce(p.i, 0) AS INT) AS le__o_orderpriority
FROM b CROSS JOIN m LEFT JOIN s ON s.v = l_linestatus LEFT JOIN p ON p.v = o_orderpriority"""


@query(_LINEAR)
def linear_features(spark, d):
    f = _frame(spark, d)
    out = pipelines.linear(f).fit_transform(f)
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith("scaler__")})


# ---------------------------------------------------------------- whole runs


def _orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", X.fold_of(F.col("o_orderkey")).alias("fold"))


def _read(spark, d):
    return Reader("multiclass").fit_read(_orders(spark, d), "o_orderstatus", key="o_orderkey", fold="fold")


@query("WITH k AS (SELECT o_orderstatus AS l, CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS i FROM orders GROUP BY 1) SELECT o_orderkey, i AS status, CAST(o_orderkey % 5 AS INT) AS fold, o_totalprice, o_orderpriority FROM orders JOIN k ON l = o_orderstatus")
def reader_fit_read(spark, d):
    return _read(spark, d).df.select("o_orderkey", F.col("o_orderstatus").alias("status"), "fold", "o_totalprice", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0")
def holdout_iterator(spark, d):
    ((_, valid),) = Validation(_read(spark, d)).to_holdout()
    return valid.select("o_orderkey", "o_totalprice")


def _run(spark, d):
    """Large orders by customer segment and date, from two models of two folds."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "o_orderpriority", "c_mktsegment", F.when(F.col("o_totalprice") + 20 * F.col("c_acctbal") > 250_000, "large").otherwise("small").alias("size"), "c_acctbal")
    run = AutoML("binary", [[Algo("lin", params={"regParam": 0.01}), Algo("gbt", "gbt", "tree_simple", {"maxIter": 3})]], "mean", folds=2)
    return run, run.fit_predict(df, "size", key="o_orderkey"), df


@query()
def automl_fit_predict(spark, d):
    return _run(spark, d)[1].select("o_orderkey", "size", F.round("prediction", 4).alias("prediction"))


@query()
def automl_predict_new(spark, d):
    run, _, df = _run(spark, d)
    return run.predict(df.drop("size")).select("o_orderkey", F.round("prediction", 4).alias("prediction"))


def _quality(spark, d):
    docs = t(spark, d, "documents").join(t(spark, d, "labels").where("quality is not null"), "doc_id")
    return docs.select("doc_id", F.col("quality").alias("y"), X.fold_of(F.col("doc_id"), 3).alias("fold"), F.col("n_chars").cast("double").alias("n"), (F.length(F.regexp_replace("text", "[^!#$%&*|]", "")) / (1 + F.length("text"))).alias("signs"), (F.length(F.regexp_replace("text", "[^ ]", "")) / (1 + F.length("text"))).alias("spaces"))


_QF = ["n", "signs", "spaces"]


@query()
def cv_linear_oof(spark, d):
    return models.cross_validate(_quality(spark, d), _QF, "y", "fold", "doc_id", "binary", "linear", regParam=0.001)[0]


@query()
def cv_gbt_oof(spark, d):
    return models.cross_validate(_quality(spark, d), _QF, "y", "fold", "doc_id", "binary", "gbt", maxIter=5)[0]


@query()
def stacking_2level(spark, d):
    df, names = models.stack(_quality(spark, d), [[("lin", "linear", {"regParam": 0.001})], [("gbt", "gbt", {"maxIter": 3})]], _QF, "y", "fold", "doc_id")
    return df.select("doc_id", *names)


def _preds(spark, d):
    return t(spark, d, "lineitem").select(*_KEY, (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_tax", "l_discount", (F.col("l_quantity") / 50).alias("q"))


@query(f"SELECT {_K}, round((l_tax + l_discount + l_quantity / 50) / 3, 6) AS blend FROM lineitem")
def mean_blend(spark, d):
    return rounded(models.mean_blend(_preds(spark, d), ["l_tax", "l_discount", "q"]), _KEY, ["blend"])


@query(f"SELECT {_K}, round(0.5 * l_tax + 0.3 * l_discount + 0.2 * l_quantity / 50, 6) AS blend FROM lineitem")
def weighted_blend(spark, d):
    return rounded(models.weighted_blend(_preds(spark, d), ["l_tax", "l_discount", "q"], [0.5, 0.3, 0.2]), _KEY, ["blend"])


@query("WITH g AS (" + " UNION ALL ".join(_gini_sql(c).replace("abs(2 * ", "(1 + 2 * ").replace(" - 1), 6)", " - 1) / 2, 6)") for c in ("l_tax", "l_discount")) + ") SELECT col AS best FROM g ORDER BY gini DESC, col LIMIT 1")
def best_model(spark, d):
    best, _ = models.best_model(_preds(spark, d), ["l_tax", "l_discount"], "binary", "y")
    return spark.range(1).select(F.lit(best).alias("best"))


@query()
def permutation_importance(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 200_000).cast("int").alias("y"), "o_totalprice", F.col("o_custkey").cast("double").alias("c"))
    got = insight.permutation_importance(df, ["o_totalprice", "c"], "o_orderkey", lambda x: models.score(x.withColumn("s", F.col("o_totalprice") + 0 * F.col("c")), "binary", "y", "s"))
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("col"), F.lit(float(v)).alias("drop")) for k, v in got.items()])).alias("r")).select("r.*")
