"""Queries of data preparation, classifier evaluation and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import BOUNDARIES
from ..operators import classifier as V
from ..operators import dataprep as D
from ..operators import flywheel as Y
from .tables import CLASSES, CLASSES_SQL, LABELLED_SQL, SCORED_SQL, Registry, labelled, read, scored

QUERIES = Registry()
add = QUERIES.add
_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ''), '[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '')"


def strip_sql(c: str) -> str:
    return _STRIP.format(c)


def with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(labelled(spark, sf_dir).withColumnRenamed("id", "doc_id"), "doc_id")


@add("d1_clean_mask")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", D.cleaned(F.col("text")).alias("clean"))


@add("d2_augment")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_labels(spark, sf_dir).select("doc_id", F.concat(F.lit("请问快递怎么退款吗？"), F.col("text")).alias("text"), "labels")
    return D.augmented(docs, "doc_id", "text").select("doc_id", "variant", F.md5("text").alias("text_md5"), F.array_join("labels", ",").alias("labels"))


@add(
    "d3_stratified_split",
    f"""with {LABELLED_SQL}, n as (select labels[1] as label, count(*) as n from labelled group by 1),
    t as (select label, n, cast(floor(n * 0.8) as bigint) as a, cast(floor(n * 0.1) as bigint) as b from n)
    select label, 'train' as split, a as n from t where a > 0 union all select label, 'val', b from t where b > 0 union all select label, 'test', n - a - b from t where n - a - b > 0""",
)
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.stratified_split(labelled(spark, sf_dir), "id", "labels")
    return s.groupBy(F.element_at("labels", 1).alias("label"), "split").agg(F.count("*").alias("n"))


def split_of(id: str) -> Column:
    return F.when(F.col(id) % 10 < 8, "train").when(F.col(id) % 10 == 8, "val").otherwise("test")


_LEAK = f"""with t as (select {strip_sql('text')} as t, case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end as s from documents),
    g as (select t, max(s = 'train') as a, max(s = 'val') as b, max(s = 'test') as c from t where t <> '' group by t)
    select count_if(a)::bigint as train, count_if(b)::bigint as val, count_if(c)::bigint as test, count_if(a and b)::bigint as train_val, count_if(a and c)::bigint as train_test, count_if(b and c)::bigint as val_test,
    count_if((a and b) or (a and c) or (b and c)) = 0 as passed from g"""


@add("d4_leakage_gate", _LEAK)
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.leakage(read(spark, sf_dir, "documents").withColumn("split", split_of("doc_id")), "text")


@add("d5_multi_hot", f"with {LABELLED_SQL} select id, array_to_string(list_transform({CLASSES_SQL}, lambda c: case when list_contains(labels, c) then '1' else '0' end), '') as hot from labelled")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = F.array_join(F.transform(D.multi_hot(F.col("labels"), CLASSES), lambda x: x.cast("int").cast("string")), "")
    return labelled(spark, sf_dir).select("id", hot.alias("hot"))


@add(
    "d6_positive_weights",
    f"""with {LABELLED_SQL}, c as (select l as class, count(*) as n from (select distinct id, unnest(labels) as l from labelled) group by 1), t as (select count(*) as total from labelled),
    k as (select unnest({CLASSES_SQL}) as class)
    select class, coalesce(n, 0)::bigint as n, round(greatest(1.0, least(5.0, sqrt((total - coalesce(n, 0)) / greatest(coalesce(n, 0), 1)))), 6) as weight from k left join c using (class), t""",
)
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.positive_weights(labelled(spark, sf_dir), "labels").withColumn("weight", F.round("weight", 6))


@add(
    "d7_dataset_inventory",
    f"""with x as (select text, {strip_sql('text')} as t, case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end as split from documents),
    g as (select t, split, count(*) over (partition by t) as k from (select distinct t, split from x where t <> '')), o as (select split, sum((select count(*) from g h where h.t = g.t and h.split <> g.split))::bigint as leaked from g where k > 1 group by 1)
    select split, count(*) as n, sum(length(text))::bigint as chars, sum(octet_length(encode(text)))::bigint as bytes, coalesce(any_value(leaked), 0) as leaked, (select count(*) from o) = 0 as passed from x left join o using (split) group by 1""",
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.inventory(read(spark, sf_dir, "documents").withColumn("split", split_of("doc_id")), "text")


_CONF = "conf as (select class, ord, count_if(score >= {t} and truth)::bigint as tp, count_if(score >= {t} and not truth)::bigint as fp, count_if(not score >= {t} and truth)::bigint as fn, count_if(not score >= {t} and not truth)::bigint as tn from scored group by 1, 2)"
_RATES = "rates as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1 from conf)"


@add("v1_confusion", f"with {SCORED_SQL}, {_CONF.format(t=0.35)} select class, ord::bigint as ord, tp, fp, fn, tn from conf")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.confusion(scored(spark, sf_dir), 0.35, ["class", "ord"]).withColumn("ord", F.col("ord").cast("long"))


@add(
    "v2_averages",
    f"""with {SCORED_SQL}, {_CONF.format(t=0.35)}, {_RATES}, s as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from conf)
    select round(avg(p), 4) as macro_p, round(avg(r), 4) as macro_r, round(avg(f1), 4) as macro_f1, round(avg(f1) filter (ord < 13), 4) as core_macro_f1,
    (select round(tp / (tp + fp), 4) from s) as micro_p, (select round(tp / (tp + fn), 4) from s) as micro_r, (select round(2 * tp / (2 * tp + fp + fn), 4) from s) as micro_f1 from rates""",
)
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.averages(V.confusion(scored(spark, sf_dir), 0.35, ["class", "ord"]), F.col("ord"))


_SWEEP = """with lines as (select (x * 5)::double / 100 as t from range(6, 15) r(x)),
    c as (select t, class, count_if(score >= t and truth) as tp, count_if(score >= t and not truth) as fp, count_if(score < t and truth) as fn from scored, lines group by 1, 2),
    m as (select t as threshold, round(avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 4) as macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) as micro_f1 from c group by 1)
    select *, row_number() over (order by micro_f1 desc, threshold) = 1 as best from m"""


@add("v3_threshold_sweep", f"with {SCORED_SQL}, v3 as ({_SWEEP}) select * from v3")
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.threshold_sweep(scored(spark, sf_dir))


_TIERS = "tiers as (select class, case when ord < 5 then 'strict' when ord < 13 then 'medium' else 'loose' end as tier, case when ord < 5 then 0.90 when ord < 13 then 0.80 end::double as line from cls)"


@add(
    "v4_redlines",
    f"with {SCORED_SQL}, {_CONF.format(t=0.35)}, {_RATES}, {_TIERS} select class, tier, round(f1, 4) as f1, line, case when line is null then 'none' when f1 >= line then 'pass' else 'fail' end as status, case when line is null then '—' when f1 >= line then '✅' else '❌' end as symbol, case when line is null then '不设线（宽档）' when f1 >= line then '达标' else printf('先回头搞数据 (F1: %.2f < %.2f)', f1, line) end as message from rates join tiers using (class)",
)
def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.redlines(V.confusion(scored(spark, sf_dir), 0.35))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.transform(F.array_sort(F.filter(F.collect_list(F.when(c, F.struct("ord", "class"))), lambda x: x.isNotNull())), lambda x: x["class"])
    return scored(spark, sf_dir).groupBy("id").agg(pick(F.col("truth")).alias("true_labels"), pick(F.col("score") >= 0.35).alias("pred_labels"))


_ERR = """pred as (select id, coalesce(list(class order by ord) filter (truth), []) as t, coalesce(list(class order by ord) filter (score >= 0.35), []) as p from scored group by id),
es as (select id, list_sort(list_filter(t, lambda x: not list_contains(p, x))) as ms, list_sort(list_filter(p, lambda x: not list_contains(t, x))) as xs from pred), e as (select id, len(ms) as m, len(xs) as x from es)"""
_KNOWN = ", ".join(f"('{a}', '{b}', '{note}')" for (a, b), note in BOUNDARIES.items())
_NOTES = f"""kn(a, b, note) as (values {_KNOWN}), pn as (select id, string_agg(a || ' ↔ ' || b || ': ' || note, '；' order by a, b) as note from (select id, unnest(ms) as a, xs from es) join kn using (a) where list_contains(xs, b) group by 1),
an as (select id, string_agg(a || ': ' || note, '；' order by a) as note from (select id, unnest(ms) as a from es) join (select distinct a, note from kn) using (a) group by 1)"""


@add(
    "v5_error_accounting",
    f"with {SCORED_SQL}, {_ERR}, {_NOTES} select id, least(m, x)::bigint as displaced, (m - least(m, x))::bigint as under, (x - least(m, x))::bigint as over, (m + x)::bigint as penalty, coalesce(pn.note, an.note, '—') as note from e left join pn using (id) left join an using (id) where m + x > 0",
)
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda n: F.col(n).cast("long").alias(n)
    return V.errors(predictions(spark, sf_dir)).select("id", c("displaced"), c("under"), c("over"), c("penalty"), "note")


@add(
    "v6_balance_check",
    f"""with {SCORED_SQL}, {_ERR}, {_CONF.format(t=0.35)}, b as (select count_if(m + x > 0)::bigint as wrong, sum(m - least(m, x))::bigint as under, sum(x - least(m, x))::bigint as over, sum(least(m, x))::bigint as displaced, sum(m + x)::bigint as penalty from e)
    select b.*, (select sum(fp + fn)::bigint from conf) as fp_fn, penalty = (select sum(fp + fn) from conf) as balanced from b""",
)
def v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.balanced(V.errors(predictions(spark, sf_dir)), V.confusion(scored(spark, sf_dir), 0.35))


@add(
    "v7_evaluation_report",
    f"""with {SCORED_SQL}, {_ERR}, {_CONF.format(t=0.35)}, {_RATES}, s as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from conf)
    select 'class' as part, class || '.precision' as name, round(p, 4) as value from rates union all select 'class', class || '.recall', round(r, 4) from rates union all select 'class', class || '.f1', round(f1, 4) from rates
    union all select 'errors', 'wrong', count_if(m + x > 0)::double from e union all select 'errors', 'under', sum(m - least(m, x))::double from e union all select 'errors', 'over', sum(x - least(m, x))::double from e
    union all select 'errors', 'displaced', sum(least(m, x))::double from e union all select 'errors', 'penalty', sum(m + x)::double from e
    union all select 'summary', 'macro_p', round(avg(p), 4) from rates union all select 'summary', 'macro_r', round(avg(r), 4) from rates union all select 'summary', 'macro_f1', round(avg(f1), 4) from rates union all select 'summary', 'core_macro_f1', round(avg(f1) filter (ord < 13), 4) from rates
    union all select 'summary', 'micro_p', round(tp / (tp + fp), 4) from s union all select 'summary', 'micro_r', round(tp / (tp + fn), 4) from s union all select 'summary', 'micro_f1', round(2 * tp / (2 * tp + fp + fn), 4) from s""",
)
def v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.report(V.confusion(scored(spark, sf_dir), 0.35, ["class", "ord"]), V.errors(predictions(spark, sf_dir)), F.col("ord"))


@add(
    "v8_model_parity",
    """with x as (select vec_id, unnest(embedding)::double as logit from embeddings)
    select round(max(abs(logit - logit * 1.00001)), 8) as max_diff, bool_and((1 / (1 + exp(-logit)) >= 0.5) = (1 / (1 + exp(-(logit * 1.00001))) >= 0.5)) as same_labels, round(max(abs(logit - logit * 1.00001)), 8) < 1e-4 as passed from x""",
)
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("class", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return V.parity(a, a.withColumn("logit", F.col("logit") * 1.00001))


@add(
    "v9_gate_calibration",
    """with s as (select l.quality = 1 as truth, (doc_id * 7919 % 1000) / 2000.0 + case when quality = 1 then 0.4 else 0.1 end as score from labels l),
    lines as (select (x * 2)::double / 100 as t from range(10, 41) r(x)),
    c as (select t as threshold, count_if(score >= t and truth)::bigint as tp, count_if(score >= t and not truth)::bigint as fp, count_if(score < t and not truth)::bigint as tn, count_if(score < t and truth)::bigint as fn from s, lines group by 1),
    g as (select threshold, tp, fp, tn, fn, round(tp / (tp + fn) - fp / (fp + tn), 4) as youden, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 4) as f1 from c),
    r as (select *, row_number() over (order by youden desc, threshold) = 1 as recommended from g) select *, recommended and abs(threshold - 0.4) > 0.01 as mismatch from r""",
)
def v9(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("truth"), (F.col("doc_id") * 7919 % 1000 / 2000.0 + F.when(F.col("quality") == 1, 0.4).otherwise(0.1)).alias("score"))
    return V.calibration(s, 0.4)


@add(
    "o4_calibration_drift",
    """with s as (select l.quality = 1 as truth, (doc_id * 7919 % 1000) / 2000.0 + case when quality = 1 then 0.4 else 0.1 end as score from labels l),
    lines as (select (x * 2)::double / 100 as t from range(10, 41) r(x)),
    c as (select t as threshold, round(count_if(score >= t and truth) / count_if(truth) - count_if(score >= t and not truth) / count_if(not truth), 4) as youden from s, lines group by 1)
    select threshold as recommended, abs(threshold - 0.4) > 0.001 as drifted from c order by youden desc, threshold limit 1""",
)
def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.observability import drifted

    return v9(spark, sf_dir).filter("recommended").select(F.col("threshold").alias("recommended"), drifted(F.col("threshold"), F.lit(0.4)).alias("drifted"))


_SAY = "case when ok is null then 'missing' when ok then 'pass' else 'fail' end as status"


@add(
    "v10_acceptance_gates",
    f"""with {SCORED_SQL}, {_ERR}, {_CONF.format(t=0.35)}, {_RATES}, {_TIERS}, d4 as ({_LEAK}), v3 as ({_SWEEP}),
    g as (select 'leakage' as gate, bool_and(passed) as ok from d4 union all select 'redlines', bool_and(line is null or f1 >= line) from rates join tiers using (class)
    union all select 'accounting', (select sum(m + x) from e) = (select sum(fp + fn) from conf) union all select 'threshold', bool_and(abs(threshold - 0.35) <= 1e-4) from v3 where best union all select 'classified', count(*) > 0 from labelled)
    select gate, {_SAY} from g""",
)
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.confusion(scored(spark, sf_dir), 0.35)
    return V.acceptance(d4(spark, sf_dir), V.redlines(c), V.balanced(V.errors(predictions(spark, sf_dir)), c), V.threshold_sweep(scored(spark, sf_dir)), 0.35, labelled(spark, sf_dir))


@add("f9_unclassified", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.unclassified(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id", "doc_id")


@add("f10_batch_gate", "select count(*) as n, case when count(*) = 0 then 'empty' when count(*) >= 10 then 'run' else 'skip' end as gate from documents where doc_id not in (select doc_id from labels)")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f9(spark, sf_dir)
    return rows.agg(F.count("*").alias("n")).withColumn("gate", F.lit(Y.batch_gate(rows)))


@add(
    "f11_score_to_labels",
    f"with {SCORED_SQL} select id, coalesce(string_agg(class, ',' order by round(score, 4) desc, class) filter (round(score, 4) >= 0.35), '') as labels from scored group by id",
)
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("m"))
    return m.select("id", F.array_join(Y.labels_of(F.col("m"), 0.35), ",").alias("labels"))


@add("f12_insert_new", f"with {LABELLED_SQL} select id as question_id, case when quality = 1 then array_to_string(labels, ',') else '其他' end as labels from labelled where quality = 1 or toxic = 0 or id % 3 = 0")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good questions are classified already; a run classifies those that aren't toxic anew, and every third one twice."""
    rows = labelled(spark, sf_dir).select(F.col("id").alias("question_id"), "labels", "quality", "toxic")
    new = rows.filter("toxic = 0").unionByName(rows.filter("question_id % 3 = 0")).select("question_id", F.array(F.lit("其他")).alias("labels"))
    got = Y.insert_new(rows.filter("quality = 1").select("question_id", "labels"), new)
    return got.select("question_id", F.array_join("labels", ",").alias("labels"))


@add(
    "f13_topic_distribution",
    f"""with {LABELLED_SQL}, t as (select l as class, count(*) as n from (select unnest(labels) as l from labelled) group by 1), cls as (select unnest({CLASSES_SQL}) as class, generate_subscripts({CLASSES_SQL}, 1) - 1 as ord),
    x as (select class, ord, coalesce(n, 0) as n from cls left join t using (class)), y as (select *, row_number() over (order by n desc, ord) as place, sum(n) over () as tags from x), {_TIERS}
    select class, tier, n::bigint as n, round(n * 100.0 / tags, 2) as tag_share, round(n * 100.0 / (select count(*) from labelled), 2) as question_share, place <= 3 and n > 0 as top, (select count(*) from documents) - (select count(*) from labelled) as unclassified from y join tiers using (class)""",
)
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = read(spark, sf_dir, "documents").agg(F.count("*").alias("pool"))
    return Y.topic_distribution(labelled(spark, sf_dir), F.lit(pool.first()["pool"]))
