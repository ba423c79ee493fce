"""Queries that compare two systems, hold rates against rules, and write what is measured."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.operators import comparison as cp, evaluation as ev
from veilframe.operators.anonymize import anonymize
from veilframe.operators.persons import reject_reason
from veilframe.operators.spans import find_spans
from veilframe.plans.measuring import examples
from veilframe.plans.registry import query
from veilframe.session import forget, shared_dir, table
from veilframe.sources.readers import read_gold, read_predictions
from veilframe.sources.writers import fingerprint, write_dataset, write_predictions, write_report

#: Two systems: names with one initial, and with one or two.
_ONE, _TWO = r"[А-ЯЁ]\. ?[А-ЯЁ][а-яё]+", r"(?:[А-ЯЁ]\. ?){1,2}[А-ЯЁ][а-яё]+"


def _system(name: str, rule: str) -> str:
    found = f"regexp_extract_all(text, '{rule}')"
    return rf"""h_{name} as (select rec_id, unnest({found}) as m, unnest(string_split_regex(text, '{rule}')[:len({found})]) as b, generate_subscripts({found}, 1) as i from r),
{name} as (select rec_id, m, i, cast(sum(length(b) + length(m)) over (partition by rec_id order by i) - length(m) as int) as s, cast(sum(length(b) + length(m)) over (partition by rec_id order by i) as int) as e from h_{name})"""


_BASE = rf"""
with r as (select rec_id, min(text) as text, min(spans) as spans, min(source) as source from train_negatives where text is not null group by rec_id),
g as (select rec_id, source, x.start_pos as s, x.stop_pos as e, x.entity_type as t from (select rec_id, source, unnest(spans) as x from r)),
{_system("p", _ONE)}, {_system("q", _TWO)}"""


def _two(spark, sf_dir):
    """Each record with gold spans and the spans of both systems."""
    x = examples(spark, sf_dir)
    return x.withColumnsRenamed({"predicted": "before"}).withColumn("after", find_spans(F.col("text"), _TWO, "PERSON", 0.8))


@query("jn_gold_pred_inner", _BASE + " select rec_id, cast((select count(*) from p where p.rec_id = r.rec_id) as int) as n_before, cast((select count(*) from q where q.rec_id = r.rec_id) as int) as n_after from r")
def jn_gold_pred_inner(spark, sf_dir):
    x = _two(spark, sf_dir)
    j = cp.paired_predictions(x.select("rec_id", F.col("before").alias("spans")), x.select("rec_id", F.col("after").alias("spans")), "rec_id")
    return j.select("rec_id", F.size("before").alias("n_before"), F.size("after").alias("n_after"))


@query("jn_gold_pred_left", "select d.rec_id, coalesce(len(t.spans), 0)::int as n from (select distinct rec_id from dev_negatives) d left join (select rec_id, min(spans) as spans from train_negatives group by rec_id) t using (rec_id)")
def jn_gold_pred_left(spark, sf_dir):
    """Records of one split with the spans that the other has of their id: none, since the ids are apart."""
    gold = table(spark, sf_dir, "dev_negatives").select("rec_id").distinct()
    pred = table(spark, sf_dir, "train_negatives").select("rec_id", "spans", F.lit(1).alias("seq"))
    return ev.joined_predictions(gold, pred, "rec_id").select("rec_id", F.greatest(F.coalesce(F.size("predicted"), F.lit(0)), F.lit(0)).alias("n"))


@query("jn_cluster_keys", "select source, 'a' as only_in from (select distinct source from documents where n_chars >= 40) where source is not null and source not in (select source from mix_targets) union all select source, 'b' from (select distinct source from mix_targets) where source not in (select source from documents where n_chars >= 40 and source is not null) union all select null, 'a' where exists(select 1 from documents where source is null and n_chars >= 40)")
def jn_cluster_keys(spark, sf_dir):
    """Sources that documents and the targets of a mix don't share."""
    d = table(spark, sf_dir, "documents").filter("n_chars >= 40")
    return cp.unequal_keys(d, table(spark, sf_dir, "mix_targets"), "source")


@query("ag_type_scores", _BASE + """, m as (select g.rec_id, count(*) as tp from (select distinct rec_id, s, e from g) g where exists(select 1 from q where q.rec_id = g.rec_id and q.s < g.e and g.s < q.e) group by g.rec_id),
c as (select coalesce((select sum(tp) from m), 0) as tp, (select count(*) from q) as np, (select count(*) from g) as ng)
select l as level, case when l = 'type' then 'PERSON' end as entity_type, cast(tp as bigint) as tp, cast(np - tp as bigint) as fp, cast(ng - tp as bigint) as fn, round(tp / np, 9) as precision, round(tp / ng, 9) as recall, round(5 * (tp / np) * (tp / ng) / (4 * (tp / np) + tp / ng), 9) as f from c, (select unnest(['type', 'micro', 'macro']) as l)""")
def ag_type_scores(spark, sf_dir):
    """Counts and rates of the second system by type, with micro and macro; each gold name meets one prediction at most."""
    s = cp.type_scores(cp.type_counts(_two(spark, sf_dir), "gold", "after"))
    return s.select("level", "entity_type", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


@query("ag_type_labels")
def ag_type_labels(spark, sf_dir):
    """tp, fp, fn, precision, recall and F2 of all rules by type, micro and macro, over the labelled values that stand in their texts."""
    v = table(spark, sf_dir, "ru_training_data").filter("text is not null and entity_value <> ''").select("rec_id", "text", "entity_type", F.instr("text", F.col("entity_value")).alias("at"), F.length("entity_value").alias("n")).filter("at > 0")
    gold = F.array_sort(F.collect_set(F.struct((F.col("at") - 1).cast("int").alias("start_pos"), (F.col("at") - 1 + F.col("n")).cast("int").alias("end_pos"), "entity_type", F.lit(1.0).alias("score"))))
    a = anonymize(v.groupBy("rec_id", "text").agg(gold.alias("gold")), "text")
    return cp.type_scores(cp.type_counts(a.select("gold", F.col("entities_found").alias("found")), "gold", "found"))


def _counts(x, which):
    c = ev.example_counts(x, "text", "gold", which)
    values = F.transform("gold", lambda s: F.substring("text", s["start_pos"] + 1, s["end_pos"] - s["start_pos"]))
    masked = F.regexp_replace("text", _ONE if which == "before" else _TWO, "<PERSON>")
    left = F.size(F.filter(values, lambda v: F.instr(masked, v) > 0))
    return c.withColumns({"n_clean": F.col("n_neg"), "clean_hit": (F.col("n_neg") == 1).cast("int") * (masked != F.col("text")).cast("int"), "n_values": F.size("gold"), "n_leaked": left})


_RATES = lambda p, rule: f"""  # noqa: E731
(select source, (select count(*) from (select distinct s, e from g where g.rec_id = r.rec_id) x join (select distinct s, e from {p} y where y.rec_id = r.rec_id) z using (s, e)) as tp,
  (select count(*) from {p} y where y.rec_id = r.rec_id) as np, (select count(*) from g where g.rec_id = r.rec_id) as ng,
  (select count(*) from g where g.rec_id = r.rec_id and exists(select 1 from {p} y where y.rec_id = g.rec_id and y.s <= g.s and g.e <= y.e)) as full_n,
  (select count(*) from g where g.rec_id = r.rec_id and contains(regexp_replace(r.text, '{rule}', '<PERSON>', 'g'), substr(r.text, g.s + 1, g.e - g.s))) as leaked from r)""".replace("  # noqa: E731", "")
_LONG = lambda p: f"""select source, unnest(['precision', 'recall', 'f1', 'extra_masks', 'missed_names', 'neg_person_rate', 'leak_rate']) as metric,
  unnest([case when sum(np) = 0 then 0 else sum(tp) / sum(np) end, case when sum(ng) = 0 then 0 else sum(tp) / sum(ng) end, case when sum(tp) = 0 then 0 else 2 * sum(tp) / (sum(np) + sum(ng)) end, sum(np) - sum(tp), sum(ng) - sum(full_n),
  case when sum((ng = 0)::int) = 0 then 0 else sum((ng = 0 and np > 0)::int) / sum((ng = 0)::int) end, case when sum(ng) = 0 then 0 else sum(leaked) / sum(ng) end]::double[]) as v from {p} group by source"""  # noqa: E731


@query("ag_category", _BASE + f", cb as {_RATES('p', _ONE)}, ca as {_RATES('q', _TWO)}, b as ({_LONG('cb')}), a as ({_LONG('ca')}) select b.source, b.metric, round(b.v, 9) as before, round(a.v, 9) as after, round(a.v - b.v, 9) as difference from b join a on a.metric = b.metric and a.source is not distinct from b.source")
def ag_category(spark, sf_dir):
    """Rates of both systems by source, side by side. A gold name is fully masked here if one mask covers it, which for masks of whole names is the same as word by word."""
    x = _two(spark, sf_dir)
    s = cp.side_by_side(cp.system_rates(_counts(x, "before"), ["source"]), cp.system_rates(_counts(x, "after"), ["source"]), ["source"])
    return s.filter("metric not in ('full_masked_rate', 'clean_mask_rate')").select("source", "metric", *[F.round(c, 9).alias(c) for c in ("before", "after", "difference")])


@query("ag_compare")
def ag_compare(spark, sf_dir):
    """All nine rates of both systems over all records."""
    x = _two(spark, sf_dir)
    return cp.side_by_side(cp.system_rates(_counts(x, "before")), cp.system_rates(_counts(x, "after")))


@query("ag_leak_part", r"""
with v as (select distinct rec_id, entity_value as v, regexp_replace(text, '[А-ЯЁ][а-яё]+', '<PERSON>', 'g') as masked from ru_training_data where entity_type = 'PERSON' and text is not null and entity_value is not null)
select cast(count(*) as bigint) as n, cast(count(*) filter (where contains(masked, v)) as bigint) as whole, cast(count(*) filter (where len(list_filter(string_split_regex(v, '[\s.]+'), lambda w: length(w) > 2 and contains(masked, w))) > 0) as bigint) as part from v""")
def ag_leak_part(spark, sf_dir):
    """Names that still stand, whole or in a part of over two characters, after capitalised words are masked."""
    v = table(spark, sf_dir, "ru_training_data").filter("entity_type = 'PERSON' and text is not null and entity_value is not null")
    v = v.select("rec_id", F.col("entity_value").alias("v"), F.regexp_replace("text", r"[А-ЯЁ][а-яё]+", "<PERSON>").alias("masked")).distinct()
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.instr("masked", F.col("v")) > 0).alias("whole"), F.count_if(cp.part_leaks(F.col("masked"), F.col("v"))).alias("part"))


@query("ag_name_recall", _BASE + r""", v as (select g.*, substr(text, s + 1, e - s) as v from g join r using (rec_id))
select case when regexp_matches(v, '\p{Lu}\.') then 'initials' else cast(len(list_filter(string_split_regex(v, '[\s.]+'), lambda x: x <> '')) as varchar) end as form, v = lower(v) as lower_case, cast(count(*) as bigint) as n,
  cast(count(*) filter (where exists(select 1 from q where q.rec_id = v.rec_id and q.s < v.e and v.s < q.e)) as bigint) as found from v group by all""")
def ag_name_recall(spark, sf_dir):
    """Gold names and those the second system meets, by form and letter case."""
    x = _two(spark, sf_dir).select("text", "after", F.explode("gold").alias("g"))
    v = F.substring("text", F.col("g.start_pos") + 1, F.col("g.end_pos") - F.col("g.start_pos"))
    hit = F.exists("after", lambda p: (p["start_pos"] < F.col("g.end_pos")) & (F.col("g.start_pos") < p["end_pos"]))
    return x.groupBy(cp.name_form(v).alias("form"), (v == F.lower(v)).alias("lower_case")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("found"))


@query("ag_na_rules", "select source, case when source in (select source from mix_targets) then 'na' when avg(n_chars) > 700 then 'win' when avg(n_chars) < 600 then 'loss' else 'tie' end as verdict from documents where n_chars is not null and source is not null group by source")
def ag_na_rules(spark, sf_dir):
    """Verdicts of documents by source; sources that are targets of the mix count as not comparable."""
    d = table(spark, sf_dir, "documents").filter("n_chars is not null and source is not null").groupBy("source").agg(F.avg("n_chars").alias("m"))
    v = d.select("source", ev.verdict(F.col("m") - 700, F.col("m") - 600, F.lit(False)).alias("verdict"))
    return cp.comparable_verdicts(v, table(spark, sf_dir, "mix_targets"), ["source"])


@query("ag_accept", _BASE + f""", ca as {_RATES('q', _TWO)}, m as (select 'precision' as metric, sum(tp) / sum(np) as value from ca union all select 'recall', sum(tp) / sum(ng) from ca union all select 'leak_rate', sum(leaked) / sum(ng) from ca)
select c.criterion, c.metric, round(m.value, 9) as value, c.bound, coalesce(case c.relation when '>=' then m.value >= c.bound - 1e-12 else m.value <= c.bound + 1e-12 end, false) as passed
from (values ('exact', 'precision', '>=', 0.9), ('complete', 'recall', '>=', 0.2), ('tight', 'leak_rate', '<=', 0.5), ('fast', 'ms', '<=', 150.0)) c(criterion, metric, relation, bound) left join m using (metric)""")
def ag_accept(spark, sf_dir):
    """The second system held against four criteria; one metric was never measured."""
    rates = cp.system_rates(_counts(_two(spark, sf_dir), "after"))
    m = rates.select(F.explode(F.create_map(*[x for k in ("precision", "recall", "leak_rate") for x in (F.lit(k), F.col(k))])).alias("metric", "value"))
    rules = spark.createDataFrame([("exact", "precision", ">=", 0.9), ("complete", "recall", ">=", 0.2), ("tight", "leak_rate", "<=", 0.5), ("fast", "ms", "<=", 150.0)], "criterion string, metric string, relation string, bound double")
    return cp.acceptance(m, rules).withColumn("value", F.round("value", 9))


@query("jn_contain", _BASE + " select rec_id, cast(count(*) as int) as n from p where exists(select 1 from q where q.rec_id = p.rec_id and q.s <= p.s and p.e <= q.e) group by rec_id")
def jn_contain(spark, sf_dir):
    x = _two(spark, sf_dir).select("rec_id", F.size(cp.contained(F.col("before"), F.col("after"))).alias("n"))
    return x.filter("n > 0")


@query("jn_cross_boundary", _BASE + " select g.rec_id, cast(count(*) as int) as n from g join r using (rec_id) where contains(substr(text, s + 1, e - s), ' ') group by g.rec_id")
def jn_cross_boundary(spark, sf_dir):
    """Gold spans that a space stands inside of."""
    x = _two(spark, sf_dir).select("rec_id", F.size(cp.crossing(F.col("text"), F.col("gold"), " ")).alias("n"))
    return x.filter("n > 0")


@query("jn_three_spans", _BASE + f""", {_system("n", "[A-Z]{2}[0-9]{6}")}
select rec_id, cast((select count(*) from g where g.rec_id = r.rec_id and not exists(select 1 from q where q.rec_id = g.rec_id and q.s < g.e and g.s < q.e)) as int) as missed,
  cast((select count(*) from q where q.rec_id = r.rec_id and exists(select 1 from n where n.rec_id = q.rec_id and n.s < q.e and q.s < n.e)) as int) as false_alarms,
  cast((select count(*) from q where q.rec_id = r.rec_id and exists(select 1 from p where p.rec_id = q.rec_id and p.s < q.e and q.s < p.e)) as int) as damaged from r""")
def jn_three_spans(spark, sf_dir):
    """The second system against gold, against codes (no names) and against the stretches the first system marks."""
    x = _two(spark, sf_dir).withColumn("codes", find_spans(F.col("text"), "[A-Z]{2}[0-9]{6}", "CODE", 1.0))
    return x.select("rec_id", cp.three_ways(F.col("after"), F.col("gold"), F.col("codes"), F.col("before")).alias("x")).select("rec_id", "x.*")


@query("so_sample", "select doc_id from documents order by md5('7:' || doc_id), doc_id limit 100")
def so_sample(spark, sf_dir):
    """A seeded sample of a hundred documents."""
    return cp.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 7)


@query("so_split_seeded", "select doc_id, case when u < 70 then 'train' when u < 85 then 'dev' else 'test' end as split from (select doc_id, ('0x' || substr(md5('3:' || doc_id), 1, 8))::bigint % 100 as u from documents)")
def so_split_seeded(spark, sf_dir):
    return cp.seeded_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"train": 70, "dev": 15, "test": 15}, 3)


def _dataset(spark, sf_dir):
    x = examples(spark, sf_dir)
    x = x.select(F.col("rec_id").cast("string").alias("id"), F.coalesce("source", F.lit("none")).alias("template_id"), "text", F.col("gold").alias("spans"))
    return cp.seeded_splits(x.withColumn("subset", F.when(F.size("spans") > 0, "pii").otherwise("neg")), "id", {"train": 80, "dev": 20}, 1)


@query("snk_dataset", _BASE + " select cast(rec_id as varchar) as id, coalesce(source, 'none') as template_id, case when len(spans) > 0 then 'pii' else 'neg' end as subset, text, cast(coalesce(len(spans), 0) as int) as n_spans from r")
def snk_dataset(spark, sf_dir):
    """Records written as JSON lines and CoNLL for each split, and read back from the lines."""
    at = f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    write_dataset(_dataset(spark, sf_dir), at)
    forget(spark, at)
    return read_gold(spark, f"{at}/jsonl/*", "set").select("id", "template_id", "subset", "text", F.size("spans").alias("n_spans"))


@query("snk_preds", _BASE + " select cast(rec_id as varchar) as id, cast((select count(*) from q where q.rec_id = r.rec_id) as int) as n_spans, regexp_replace(text, '" + _TWO + "', '<PERSON>', 'g') as anonymized from r")
def snk_preds(spark, sf_dir):
    """Predictions of the second system written as JSON lines, and read back."""
    at = f"{shared_dir(spark)}/preds-{uuid.uuid4().hex}"
    x = _two(spark, sf_dir).select(F.col("rec_id").cast("string").alias("id"), F.col("after").alias("spans"), F.regexp_replace("text", _TWO, "<PERSON>").alias("anonymized"))
    write_predictions(x, at)
    forget(spark, at)
    return read_predictions(spark, at).select("id", F.size("spans").alias("n_spans"), "anonymized")


@query("snk_report")
def snk_report(spark, sf_dir):
    """The rates of the second system written with their provenance, and both read back."""
    at = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(cp.system_rates(_counts(_two(spark, sf_dir), "after")), at, {"train_negatives": table(spark, sf_dir, "train_negatives")}, {"rule": _TWO})
    forget(spark, at)
    return spark.read.text([f"{at}/metrics", f"{at}/provenance"])


@query("snk_fingerprint", "select cast((select count(*) from train_negatives) as bigint) as n_rows, true as same")
def snk_fingerprint(spark, sf_dir):
    """The digest of a table is that of its rows in any order."""
    t = table(spark, sf_dir, "train_negatives")
    (n, a), (_, b) = fingerprint(t), fingerprint(t.repartition(7, "rec_id"))
    return spark.createDataFrame([(n, a == b)], "n_rows long, same boolean")


_NAMELIKE = r"(ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ына|ский|ская|цкий|цкая|енко|ук|юк|ович|евич|овна|евна)(а|у|ым|ом|ой|е|ы)?$"
_LEXICON_WORDS = r"(?:Заказ|Оплата|Склад|Возврат|Накладная|Паллета|Промокод)"


@query("pf_rules", _BASE + rf""", {_system("w", "[А-ЯЁ][а-яё]+")}, l as (select *, lower(m) as low from w)
select rec_id, s as start_pos, e as end_pos, case when regexp_matches(m, '^{_LEXICON_WORDS}$') and not regexp_matches(lower(substr(text, greatest(s - 50, 0) + 1, least(s, 50))), '(клиент|заявител|получател|уважаем)[а-яё]{{0,4}}([^а-яёa-z0-9_.!?\n«»"“”„]+[а-яёa-z0-9_]+){{0,2}}[^а-яёa-z0-9_.!?\n«»"“”„]{{0,3}}$')
  and not regexp_matches(lower(regexp_extract(substr(text, e + 1, 40), '^[ \t]+(\p{{L}}+)', 1)), '{_NAMELIKE}') and not regexp_matches(lower(regexp_extract(substr(text, greatest(s - 40, 0) + 1, least(s, 40)), '(\p{{L}}+)[ \t]+$', 1)), '{_NAMELIKE}') then 'F3' end as reason
from l join r using (rec_id) where regexp_matches(m, '^{_LEXICON_WORDS}$')""")
def pf_rules(spark, sf_dir):
    """Capitalised words of the records that a lexicon table calls common nouns, with the rule that drops them as names."""
    words = "заказ оплата склад возврат накладная паллета промокод".split()
    lexicon = spark.createDataFrame([(w, 0.0, 0.0, 0.9) for w in words], "word string, given double, surn double, common double")
    x = examples(spark, sf_dir).select("rec_id", "text", find_spans(F.col("text"), "[А-ЯЁ][а-яё]+", "PERSON", 0.8).alias("found"))
    r = reject_reason(x, "rec_id", "text", "found", lexicon)
    v = F.substring("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    return r.join(x.select("rec_id", "text"), "rec_id").filter(v.rlike(f"^{_LEXICON_WORDS}$")).select("rec_id", "start_pos", "end_pos", "reason")
