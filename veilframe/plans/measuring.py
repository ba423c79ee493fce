"""Queries of span algebra and evaluation: labelled spans as gold, names written with an initial as predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import evaluation as ev
from veilframe.operators.spans import SPANS, drop_nested, find_spans, fully_covered, merge_glued, normal_spans, resolve_overlaps, touched
from veilframe.plans.registry import query
from veilframe.session import table

_RULE = r"[А-ЯЁ]\. ?[А-ЯЁ][а-яё]+"
#: One row of each record, its gold spans and the predicted ones with offsets, in SQL.
_BASE = rf"""
with r as (select rec_id, min(text) as text, min(spans) as spans, min(source) as source from train_negatives where text is not null group by rec_id),
g as (select rec_id, source, x.start_pos as s, x.stop_pos as e, x.entity_type as t from (select rec_id, source, unnest(spans) as x from r)),
h as (select rec_id, source, unnest(regexp_extract_all(text, '{_RULE}')) as m, unnest(string_split_regex(text, '{_RULE}')[:len(regexp_extract_all(text, '{_RULE}'))]) as b, generate_subscripts(regexp_extract_all(text, '{_RULE}'), 1) as i from r),
p as (select rec_id, source, m, i, cast(sum(length(b) + length(m)) over (partition by rec_id order by i) - length(m) as int) as s, cast(sum(length(b) + length(m)) over (partition by rec_id order by i) as int) as e from h)
"""


def examples(spark, sf_dir, name="train_negatives"):
    """One row of each record with text: gold and predicted spans."""
    r = table(spark, sf_dir, name).filter("text is not null").groupBy("rec_id").agg(F.min("text").alias("text"), F.min("spans").alias("raw"), F.min("source").alias("source"))
    gold = F.transform(F.coalesce("raw", F.array().cast("array<struct<start_pos:int,stop_pos:int,entity_type:string>>")), lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start_pos"].alias("start_pos"), s["stop_pos"].alias("end_pos"), F.lit(1.0).alias("score")))
    return r.select("rec_id", "text", "source", gold.alias("gold"), find_spans(F.col("text"), _RULE, "PERSON", 0.8).alias("predicted"))


@query("find_spans", _BASE + "select rec_id, s as start_pos, e as end_pos from p")
def find_spans_query(spark, sf_dir):
    return examples(spark, sf_dir).select("rec_id", F.explode("predicted").alias("s")).select("rec_id", "s.start_pos", "s.end_pos")


@query("prj_norm_span", _BASE + r""", v as (select g.rec_id, s, e, substr(text, s + 1, e - s) as v from g join r using (rec_id))
select distinct rec_id, cast(s + length(v) - length(regexp_replace(v, '^[\s\p{Z}]+', '')) as int) as start_pos, cast(e - length(v) + length(regexp_replace(v, '[\s\p{Z}]+$', '')) as int) as end_pos from v
where length(regexp_replace(v, '[\s\p{Z}]+', '', 'g')) > 0""")
def prj_norm_span(spark, sf_dir):
    return examples(spark, sf_dir).select("rec_id", F.explode(normal_spans(F.col("text"), F.col("gold"))).alias("s")).select("rec_id", "s.start_pos", "s.end_pos")


@query("jn_strict", _BASE + "select r.rec_id, cast((select count(*) from (select distinct s, e from g where g.rec_id = r.rec_id) x join (select distinct s, e from p where p.rec_id = r.rec_id) y using (s, e)) as int) as n from r")
def jn_strict(spark, sf_dir):
    return examples(spark, sf_dir).select("rec_id", ev.strict_matches(F.col("gold"), F.col("predicted")).alias("n"))


@query("sp_touch", _BASE + "select rec_id, s as start_pos, e as end_pos, exists(select 1 from p where p.rec_id = g.rec_id and p.s < g.e and g.s < p.e) as touched from g")
def sp_touch(spark, sf_dir):
    x = examples(spark, sf_dir).select("rec_id", F.explode("gold").alias("g"), "predicted")
    return x.select("rec_id", "g.start_pos", "g.end_pos", touched(F.col("g"), F.col("predicted")).alias("touched"))


@query("jn_best_overlap", _BASE + """, o as (select g.rec_id, g.s, g.e, p.s as ps, p.e as pe, least(g.e, p.e) - greatest(g.s, p.s) as o, p.i from g join p on p.rec_id = g.rec_id and p.s < g.e and g.s < p.e)
select rec_id, s as start_pos, e as end_pos, ps as best_start, pe as best_end from (select *, row_number() over (partition by rec_id, s, e order by o desc, i) as k from o) where k = 1""")
def jn_best_overlap(spark, sf_dir):
    x = examples(spark, sf_dir).select("rec_id", F.explode("gold").alias("g"), "predicted").select("rec_id", "g", F.posexplode("predicted").alias("i", "p"))
    o = x.withColumn("o", F.least("g.end_pos", "p.end_pos") - F.greatest("g.start_pos", "p.start_pos")).filter("o > 0")
    best = o.groupBy("rec_id", F.col("g.start_pos").alias("start_pos"), F.col("g.end_pos").alias("end_pos")).agg(F.max(F.struct("o", (-F.col("i")).alias("i"), F.col("p.start_pos").alias("s"), F.col("p.end_pos").alias("e"))).alias("m"))
    return best.select("rec_id", "start_pos", "end_pos", F.col("m.s").alias("best_start"), F.col("m.e").alias("best_end"))


_COUNTS = _BASE + """, c as (select r.rec_id, r.source,
  (select count(*) from (select distinct s, e from g where g.rec_id = r.rec_id) x join (select distinct s, e from p where p.rec_id = r.rec_id) y using (s, e)) as tp,
  (select count(*) from p where p.rec_id = r.rec_id) as n_pred, (select count(*) from g where g.rec_id = r.rec_id) as n_gold from r)
"""


@query("ag_counts", _COUNTS + "select rec_id, cast(tp as int) as tp, cast(n_pred as int) as n_pred, cast(n_gold as int) as n_gold, cast(n_gold = 0 as int) as n_neg, cast(n_gold = 0 and n_pred > 0 as int) as neg_hit from c")
def ag_counts(spark, sf_dir):
    return ev.example_counts(examples(spark, sf_dir), "text", "gold", "predicted").select("rec_id", "tp", "n_pred", "n_gold", "n_neg", "neg_hit")


@query("ag_summary", _COUNTS + """, t as (select sum(tp) as tp, sum(n_pred) as n_pred, sum(n_gold) as n_gold, sum((n_gold = 0)::int) as n_neg, sum((n_gold = 0 and n_pred > 0)::int) as neg_hit from c)
select round(case when n_pred = 0 then 0 else tp / n_pred end, 9) as precision, round(case when n_gold = 0 then 0 else tp / n_gold end, 9) as recall,
  round(case when tp = 0 then 0 else 2.0 * tp / (n_pred + n_gold) end, 9) as f1, round(case when n_neg = 0 then 0 else neg_hit / n_neg end, 9) as neg_fp_rate from t""")
def ag_summary(spark, sf_dir):
    s = ev.summary(ev.cluster_counts(ev.example_counts(examples(spark, sf_dir), "text", "gold", "predicted"), "source"))
    return s.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "neg_fp_rate")])


@query("ag_subgroup", _COUNTS + "select source, cast(sum(tp) as bigint) as tp, cast(sum(n_pred) as bigint) as n_pred, cast(sum(n_gold) as bigint) as n_gold from c group by source")
def ag_subgroup(spark, sf_dir):
    return ev.cluster_counts(ev.example_counts(examples(spark, sf_dir), "text", "gold", "predicted"), "source").select("source", "tp", "n_pred", "n_gold")


@query("ag_prf", _COUNTS + """, t as (select source, sum(tp) as tp, sum(n_pred) as n_pred, sum(n_gold) as n_gold from c group by source)
select source, round(case when n_pred = 0 then 0 else tp / n_pred end, 9) as p0, round(case when n_pred = 0 then 1 else tp / n_pred end, 9) as p1 from t""")
def ag_prf(spark, sf_dir):
    """Precision by source under both conventions for empty denominators."""
    c = ev.cluster_counts(ev.example_counts(examples(spark, sf_dir), "text", "gold", "predicted"), "source")
    return c.select("source", F.round(ev.safe_ratio(F.col("tp"), F.col("n_pred")), 9).alias("p0"), F.round(ev.safe_ratio(F.col("tp"), F.col("n_pred"), 1.0), 9).alias("p1"))


@query("jn_overlap_greedy")
def jn_overlap_greedy(spark, sf_dir):
    return examples(spark, sf_dir).select("rec_id", ev.greedy_matches(F.col("gold"), F.col("predicted")).alias("n"))


@query("jn_type_first")
def jn_type_first(spark, sf_dir):
    return examples(spark, sf_dir).select("rec_id", ev.type_matches(F.col("gold"), F.col("predicted")).alias("n"))


@query("sp_coverage")
def sp_coverage(spark, sf_dir):
    x = examples(spark, sf_dir).select("rec_id", "text", F.explode("gold").alias("g"), "predicted")
    return x.select("rec_id", "g.start_pos", "g.end_pos", fully_covered(F.col("text"), F.col("g"), F.col("predicted")).alias("covered"))


@query("ag_muc")
def ag_muc(spark, sf_dir):
    t = ev.taxonomy(examples(spark, sf_dir), "gold", "predicted")
    return t.groupBy("source").agg(*[F.sum(c).cast("long").alias(c) for c in ("correct", "partial", "missing", "spurious")])


@query("ag_bootstrap")
def ag_bootstrap(spark, sf_dir):
    return ev.bootstrap(ev.cluster_counts(ev.example_counts(examples(spark, sf_dir), "text", "gold", "predicted"), "source").fillna("none"), "source")


@query("ag_confusion", _BASE + """, o as (select g.rec_id, g.s, g.e, g.t, count(p.s) as n from g left join p on p.rec_id = g.rec_id and p.s < g.e and g.s < p.e group by all)
select t as gold_type, case when n > 0 then 'PERSON' else 'NONE' end as predicted_type, cast(count(*) as bigint) as count from o group by all""")
def ag_confusion(spark, sf_dir):
    return ev.confusion(examples(spark, sf_dir), "gold", "predicted")


@query("res_overlap", _BASE + ", q as (select rec_id, s, e, 1.0 as sc from g union all select rec_id, s, e, 0.8 from p) select rec_id, s as start_pos, e as end_pos from q where sc = 1.0 or not exists(select 1 from g where g.rec_id = q.rec_id and g.s < q.e and q.s < g.e)")
def res_overlap(spark, sf_dir):
    """Gold spans win over predicted ones they meet; gold spans don't meet each other."""
    x = examples(spark, sf_dir).select("rec_id", F.explode(resolve_overlaps(F.concat("predicted", "gold"))).alias("s"))
    return x.select("rec_id", "s.start_pos", "s.end_pos")


@query("sp_nest_dedup", _BASE + ", q as (select distinct rec_id, s, e from (select rec_id, s, e from g union select rec_id, s, e from p)) select rec_id, s as start_pos, e as end_pos from q where not exists(select 1 from q as k where k.rec_id = q.rec_id and k.s <= q.s and q.e <= k.e and (k.s < q.s or q.e < k.e))")
def sp_nest_dedup(spark, sf_dir):
    x = examples(spark, sf_dir).select("rec_id", F.explode(drop_nested(F.array_distinct(F.transform(F.concat("gold", "predicted"), lambda s: s.withField("score", F.lit(1.0)))))).alias("s"))
    return x.select("rec_id", "s.start_pos", "s.end_pos")


@query("sp_merge_glue")
def sp_merge_glue(spark, sf_dir):
    """Capitalised words of each record glued where only spaces or dots part them."""
    words = find_spans(F.col("text"), r"\p{Lu}\p{L}+", "PERSON", 0.5)
    x = examples(spark, sf_dir).select("rec_id", F.explode(merge_glued(F.col("text"), words.cast(SPANS))).alias("s"))
    return x.select("rec_id", "s.start_pos", "s.end_pos")


@query("ag_verdict", "select source, case when avg(n_chars) - 700 > 0 then 'win' when avg(n_chars) - 600 < 0 then 'loss' else 'tie' end as verdict from documents where n_chars is not null group by source")
def ag_verdict(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("n_chars is not null").groupBy("source").agg(F.avg("n_chars").alias("m"))
    return d.select("source", ev.verdict(F.col("m") - 700, F.col("m") - 600, F.lit(False)).alias("verdict"))


@query("ag_gate", """
with m as (select source as dataset, avg((lang is null)::int) as leak_rate, avg((n_chars > 900)::int) as neg, avg((n_chars > 300)::int) as pers from documents where source is not null group by source)
select dataset, leak_rate > 0.05 + 1e-9 as leak_bad, neg > 0.3 + 1e-9 as neg_bad, pers < 0.7 - 1e-9 as person_bad from m where leak_rate > 0.05 + 1e-9 or neg > 0.3 + 1e-9 or pers < 0.7 - 1e-9""")
def ag_gate(spark, sf_dir):
    """Rates of each source of documents held against fixed thresholds."""
    d = table(spark, sf_dir, "documents").filter("source is not null").groupBy(F.col("source").alias("dataset")).agg(F.avg(F.col("lang").isNull().cast("int")).alias("leak_rate"), F.avg((F.col("n_chars") > 900).cast("int")).alias("neg_any_mask_rate"), F.avg((F.col("n_chars") > 300).cast("int")).alias("person_full_masked"))
    limits = d.select("dataset", F.lit(0.05).alias("max_leak_rate"), F.lit(0.3).alias("max_neg_any_mask_rate"), F.lit(0.7).alias("min_person_full_masked"))
    v = ev.gate_violations(d, limits)
    return v.select("dataset", F.array_contains("violated", "leak_rate").alias("leak_bad"), F.array_contains("violated", "neg_any_mask_rate").alias("neg_bad"), F.array_contains("violated", "person_full_masked").alias("person_bad"))
