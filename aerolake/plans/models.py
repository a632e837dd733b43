"""Queries that fit models or iterate; those that SQL can express have twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolake.operators import affinity, agglomerate, anomaly, cluster, density, features, inference, layout, ml, networks
from aerolake.operators.neighbours import nearest
from aerolake.plans.oracle import sql
from aerolake.plans.wifi import over, r6
from aerolake.registry import query
from aerolake.runtime import materialize

_BEHAVIOUR = ["packet_interval_mean", "packet_interval_std", "data_to_mgmt_ratio", "rssi_std", "power_save_rate", "avg_snr", "avg_mcs_rate", "avg_session_duration"]


_WIDTH = 64
_XS = [f"x{i}" for i in range(_WIDTH)]


def _coordinates():
    return [F.element_at("x", i + 1).alias(c) for i, c in enumerate(_XS)]


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")


@over("F1_best_k")
def f1(e):
    frame = features.client_behaviour(e, wanted=_BEHAVIOUR)
    return e.sparkSession.createDataFrame([(cluster.best_k(frame, _BEHAVIOUR),)], "k int")


@over("F2_client_clusters")
def f2(e):
    frame = features.client_frame(e)
    return cluster.clustered(frame, _BEHAVIOUR, 4, weights={"packet_": 1.5, "rssi_": 0.5}).select("client", "original_macs", "cluster")


@query("F10_algorithms")
def f10(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", *_coordinates())
    out = None
    for name in ("kmeans", "hierarchical", "gmm"):
        one = cluster.clustered(rows, _XS, 5, name).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("algorithm"), "cluster", "n")
        out = one if out is None else out.unionByName(one)
    return out


_V = "select vec_id as id, label as c, embedding::double[] as x from embeddings"


@query("F11_dbscan", f"""
with recursive v as ({_V}), near as (select a.id, b.id as other from v a, v b where list_distance(a.x, b.x) <= 0.05),
core as (select id from near group by id having count(*) >= 5),
walk as (select id, id as r from core union select walk.id, near.other from walk join near on walk.r = near.id join core on near.other = core.id),
comp as (select id, min(r) as cluster from walk group by id),
edge as (select near.id, min(cluster) as touched from near join comp on near.other = comp.id group by near.id)
select v.id, coalesce(comp.cluster, edge.touched, -1)::bigint as cluster, comp.id is not null as core from v left join comp on v.id = comp.id left join edge on v.id = edge.id""")
def f11(spark, sf_dir):
    return cluster.dbscan(_vectors(spark, sf_dir), 0.05, 5)


@query("F12_quality", f"""
with v as ({_V}), l as (select id, c, unnest(x) as v, generate_subscripts(x, 1) as i from v), m as (select c, i, avg(v) as m from l group by c, i), g as (select i, avg(v) as m from l group by i),
w as (select l.id, l.c, sum((v - m) ** 2) as q from l join m on l.c = m.c and l.i = m.i group by l.id, l.c),
s as (select c, count(*) as n, sum(q) as inside, avg(sqrt(q)) as spread from w group by c),
b as (select sum(n * far) as between_ from (select m.c, sum((m.m - g.m) ** 2) as far from m join g on m.i = g.i group by m.c) join s using (c)),
db as (select avg(worst) as db from (select a.c, max((sa.spread + sb.spread) / far) as worst from (select a.c, z.c as o, sqrt(sum((a.m - z.m) ** 2)) as far from m a join m z on a.i = z.i and a.c <> z.c group by a.c, z.c) a join s sa on sa.c = a.c join s sb on sb.c = a.o group by a.c)),
p as (select a.id, a.c, z.c as o, sum(list_distance(a.x, z.x)) as far from v a, v z group by a.id, a.c, z.c),
q as (select id, max(far / greatest(n - 1, 1)) filter (p.c = o) as own, max(n) filter (p.c = o) as n, min(far / n) filter (p.c <> o) as other from p join s on s.c = p.o group by id)
select round(between_ / (k - 1) / (inside / (n - k)), 6) as calinski_harabasz, round(db, 6) as davies_bouldin, k::int as n_clusters, 0::bigint as n_noise, (select round(avg(case when n > 1 then (other - own) / greatest(own, other) else 0 end), 6) from q) as silhouette
from b, db, (select count(*) as k, sum(n) as n, sum(inside) as inside from s)""")
def f12(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    out = cluster.quality(v, "x", "label").withColumn("silhouette", F.lit(cluster.silhouette(v, "x", "label")))
    return out.select(r6("calinski_harabasz"), r6("davies_bouldin"), "n_clusters", "n_noise", r6("silhouette"))


@query("F14_projection")
def f14(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", "label", *_coordinates())
    return cluster.projected(rows, _XS).select("id", "label", "pc1", "pc2")


@query("F14_umap")
def f14_umap(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return layout.umap(v).join(v.select("id", "label"), "id").select("id", "label", F.round("y0", 4).alias("u0"), F.round("y1", 4).alias("u1"))


@query("F14_layout_quality")
def f14_quality(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = materialize(nearest(v.select("id", "x"), layout.NEIGHBOURS), "nearest")  # once, for the map and for both comparisons
    kept = {"umap": layout.preserved(v, layout.umap(v, near=near), near=near), "principal": layout.preserved(v, layout.principal(v.select("id", "x")), near=near)}
    return spark.createDataFrame([(k, round(s, 6)) for k, s in kept.items()], "layout string, preserved double")


def _pairs(e):
    p = materialize(inference.scored(features.pairs(e)), "scored-pairs")  # fits and splits read it many times
    return p.withColumn("id", F.concat_ws("|", "ssid", "bssid")).withColumn("label", (F.col("score") + F.pmod(F.xxhash64("ssid", "bssid"), F.lit(100)) / 500 > 0.7).cast("double"))


_PAIR = ["beacon_count", "probe_resp_count", "supporting_clients", "rssi_mean", "rssi_std", "channel", "cap_count", "ie_count", "seq_support"]


@over("J1_pair_classifier")
def j1(e):
    _, scores = ml.train_pairs(_pairs(e), _PAIR)
    return e.sparkSession.createDataFrame([(float(scores["auc"]), float(scores["brier"]))], "auc double, brier double")


@over("E3_blended")
def e3(e):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    rows = _pairs(e)
    scored = rows.drop("id", "label")
    numbers = [c for c, t in scored.dtypes if t in ("int", "bigint", "double") and c != "score"]
    model = Pipeline(stages=[LogisticRegression(maxIter=20)]).fit(ml.assembled(rows, numbers))
    return inference.blended(scored, model).select("ssid", "bssid", r6("score"))


@over("J3_behaviour_classifier")
def j3(e):
    rows = materialize(features.client_behaviour(e), "behaviour")
    labels = rows.select(F.upper("client").alias("mac"), F.when(F.col("data_to_mgmt_ratio") > 0.66, "laptop").otherwise("phone").alias("device_type"))
    model, names = ml.train_behaviour(rows, labels, _BEHAVIOUR, trees=20)
    out = model.transform(ml.assembled(rows, _BEHAVIOUR, "raw"))
    return out.select("client", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("prediction") + 1).cast("int")).alias("device_type"))


@query("J4_J11_device_classifiers")
def j4(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", F.col("label").cast("double").alias("label"), *_coordinates())
    _, _, scores = ml.train_device(rows, _XS)
    return spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "model string, accuracy double")


@over("J5_anomalies")
def j5(e):
    rows = features.client_behaviour(e)
    return ml.anomaly_scores(rows, _BEHAVIOUR, "client").select("client", r6("distance"), "anomaly")


def _behaviour(e):
    return anomaly.vectors(materialize(features.client_behaviour(e, wanted=_BEHAVIOUR), "behaviour"), _BEHAVIOUR, "client", scale=True)


@over("J5_isolation_forest")
def j5_forest(e):
    return anomaly.isolation_forest(_behaviour(e), "client").select("client", r6("score"), "anomaly")


@query("J5_local_outlier_factor", """
with v as (select vec_id as id, embedding::double[] as x from embeddings),
d as (select a.id, b.id as other, list_distance(a.x, b.x) as d from v a join v b on a.id <> b.id),
near as (select * from d qualify row_number() over (partition by id order by d, other) <= 20),
far as (select id, max(d) as kd from near group by id),
dense as (select near.id, 1 / (avg(greatest(d, kd)) + 1e-10) as density from near join far on near.other = far.id group by near.id),
f as (select near.id, avg(o.density) / any_value(m.density) as score from near join dense o on near.other = o.id join dense m on near.id = m.id group by near.id)
select id, round(score, 6) as score, score > (select quantile_cont(score, 0.9) from f) as anomaly from f""")
def j5_factor(spark, sf_dir):
    return anomaly.local_outlier_factor(_vectors(spark, sf_dir)).select("id", r6("score"), "anomaly")


@over("J5_elliptic_envelope")
def j5_envelope(e):
    return anomaly.elliptic_envelope(_behaviour(e), "client").select("client", r6("score"), "anomaly")


@over("J5_one_class_svm")
def j5_svm(e):
    return anomaly.one_class_svm(_behaviour(e), "client").select("client", r6("score"), "anomaly")


@over("J5_detectors")
def j5_detectors(e):
    rows = _behaviour(e).select(F.xxhash64("client").alias("id"), "x")
    out = anomaly.compared(rows)
    return out.select("detector", "anomaly_count", *[r6(c) for c in ("anomaly_rate", "mean_score", "std_score")], "best")


@over("J6_regressors")
def j6(e):
    rows = materialize(features.client_behaviour(e), "behaviour").withColumnRenamed("client", "id").withColumn("label", F.col("avg_snr"))
    _, _, scores = ml.train_regressor(rows, ["rssi_std", "data_to_mgmt_ratio", "avg_mcs_rate"])
    return e.sparkSession.createDataFrame([(k, float(v)) for k, v in scores.items()], "model string, r2 double")


@over("J8_imputed", sql("""
select event_id, coalesce(noise, (select quantile_cont(noise, 0.5) from e))::double as noise, coalesce(seq, (select quantile_cont(seq, 0.5) from e))::double as seq from e""", "e"))
def j8(e):
    return ml.imputed(e.select("event_id", "noise", "seq"), ["noise", "seq"])


@query("J10_confusion", "select (label % 3)::int as y, (vec_id % 3)::int as z, count(*) as n from embeddings group by 1, 2")
def j10(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select((F.col("label") % 3).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("prediction"))
    return ml.confusion(rows)


@query("J10_classification_report", """
with c as (select label % 3 as y, vec_id % 3 as z, count(*) as n from embeddings group by 1, 2),
p as (select y as k, sum(n) as support, coalesce(sum(n) filter (y = z), 0) as tp, (select coalesce(sum(n), 0) from c d where d.z = c.y) as said from c group by y),
q as (select support, tp, tp / support as r, case when said > 0 then tp / said else 0 end as p from p)
select round(sum(tp) / sum(support), 6) as accuracy, round(sum(p * support) / sum(support), 6) as precision, round(sum(r * support) / sum(support), 6) as recall, round(sum(case when p + r > 0 then 2 * p * r / (p + r) else 0 end * support) / sum(support), 6) as f1 from q""")
def j10c(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select((F.col("label") % 3).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("prediction"))
    out = ml.classification_report(rows)
    return out.select(*[r6(c) for c in out.columns])


@query("J10_regression_report", """
select round(avg(d * d), 6) as mse, round(sqrt(avg(d * d)), 6) as rmse, round(avg(abs(d)), 6) as mae, round(1 - avg(d * d) / var_pop(value), 6) as r2, round(avg(abs(d / value)) filter (value <> 0), 4) as mape
from (select value, value - (value * 0.9 + user_id % 7) as d from events)""")
def j10r(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("value as label", "value * 0.9D + user_id % 7 as prediction")
    out = ml.regression_report(rows)
    return out.select(*[r6(c) for c in ("mse", "rmse", "mae", "r2")], F.round("mape", 4).alias("mape"))


@over("J9_inference")
def j9(e):
    rows = materialize(features.client_behaviour(e), "behaviour")
    labels = rows.select(F.col("client").alias("mac"), F.when(F.col("data_to_mgmt_ratio") > 0.66, "laptop").otherwise("phone").alias("device_type"))
    model, names = ml.train_behaviour(rows, labels, _BEHAVIOUR, trees=20)
    return ml.usage(ml.infer(model, rows, _BEHAVIOUR, names, "client"))


@query("J11_vote", "select vec_id as id, case when (vec_id % 3 = 0)::int + (vec_id % 2 = 0)::int + (vec_id % 5 = 0)::int >= 2 then 1.0 else 0.0 end::double as prediction from embeddings")
def j11(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id")
    return ml.vote([v.withColumn("prediction", (F.col("id") % k == 0).cast("double")) for k in (3, 2, 5)])


@query("J10_roc_auc", """
with r as (select (label % 2)::int as y, vec_id % 37 as s from embeddings), c as (select s, sum(y) as p, sum(1 - y) as n from r group by s)
select round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) as auc from (select p, n, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from c)""")
def j10_auc(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select((F.col("label") % 2).alias("label"), (F.col("id") % 37).cast("double").alias("score"))
    return spark.createDataFrame([(round(ml.roc_auc(rows), 6),)], "auc double")


@query("J11_soft_vote", """
with p as (select vec_id as id, c, (case when vec_id % 3 = c then 0.6 else 0.2 end + case when vec_id % 2 = c then 0.5 else 0.25 end) / 2 as p from embeddings, (select unnest([0, 1, 2]) as c))
select id, arg_max(c, p * 10 - c / 1000.0)::double as prediction, round(max(p), 6) as confidence from p group by id""")
def j11_soft(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id")
    of = lambda k, high, low: v.withColumn("probability", F.array(*[F.when(F.col("id") % k == c, high).otherwise(low) for c in range(3)]))
    return ml.soft_vote([of(3, 0.6, 0.2), of(2, 0.5, 0.25)]).select("id", "prediction", r6("confidence"))


@query("J12_ensemble")
def j12(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", F.col("label").cast("double").alias("label"), *_coordinates())
    scores, _ = ml.ensemble(rows, _XS, more=("adaboost", "bagging"))
    return spark.createDataFrame([(k, float(v)) for k, v in scores.items()], "model string, accuracy double")


@query("F10_spectral")
def f10_spectral(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", *_coordinates())
    return cluster.spectral(rows, _XS, 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("F10_hdbscan")
def f10_hdbscan(spark, sf_dir):
    return density.hdbscan(_vectors(spark, sf_dir), 5)


@query("F10_optics", f"""
with recursive v as ({_V}), d as (select a.id, b.id as other, list_distance(a.x, b.x) as d from v a, v b),
core as (select id, max(d) as core from (select * from d qualify row_number() over (partition by id order by d) <= 5) group by id having max(d) <= 1.17),
near as (select d.id, d.other from d join core a on d.id = a.id join core b on d.other = b.id where d <= 1.17),
walk as (select id, id as r from core union select walk.id, near.other from walk join near on walk.r = near.id),
comp as (select id, min(r) as cluster from walk group by id)
select v.id, coalesce(comp.cluster, -1)::bigint as cluster from v left join comp on v.id = comp.id""")
def f10_optics(spark, sf_dir):
    return density.optics(_vectors(spark, sf_dir), 1.17, 5)


@query("F10_ward")
def f10_ward(spark, sf_dir):
    return agglomerate.ward(_vectors(spark, sf_dir), 5)


@over("F10_mean_shift")
def f10_mean_shift(e):
    wanted = ["rssi_std", "avg_snr"]
    rows = anomaly.vectors(materialize(features.client_behaviour(e, wanted=wanted), "behaviour"), wanted, "client", scale=True)
    return agglomerate.mean_shift(rows.select(F.xxhash64("client").alias("id"), "x"), 0.8).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("F10_affinity_propagation")
def f10_affinity(spark, sf_dir):
    return affinity.affinity_propagation(_vectors(spark, sf_dir))


@over("F3_autoencoder")
def f3(e):
    out = networks.autoencoded(_behaviour(e))
    return out.select("client", *[F.round(F.element_at("code", k + 1), 4).alias(f"code_{k}") for k in range(2)], F.round("loss", 4).alias("loss"))


@query("F13_best_algorithm")
def f13(spark, sf_dir):
    return cluster.best_algorithm(_vectors(spark, sf_dir).select(*_coordinates()), _XS)


@over("J2_retrain_gate")
def j2(e):
    return e.sparkSession.createDataFrame([(ml.retrain(_pairs(e), _PAIR) is not None,)], "trained boolean")
