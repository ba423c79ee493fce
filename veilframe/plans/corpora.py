"""Queries of corpora, chat tables, sources, made-up records and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions.checks import digit_count, is_inn, is_luhn, is_snils
from veilframe.functions.synth import corrupted, filled, made_inn, made_phone, made_snils, rejections
from veilframe.functions.text import collapsed, decline_patronymic, decline_surname, plain_yo, word_set
from veilframe.operators.chats import anonymized_conversations, batch, conversation_contacts, entity_totals, message_counts
from veilframe.operators.corpus import accepted_in_order, duplicate_classes, first_copies, near_duplicates, not_held_out, shared_words
from veilframe.operators.evaluation import canonical_type
from veilframe.plans.registry import query
from veilframe.session import forget, shared_dir, table
from veilframe.sources.readers import handler_of, occurrences
from veilframe.sources.tagging import spans_of_tags, tags_of, tokens_of

_D = lambda i: f"cast(substr(d, {i}, 1) as int)"
_INN = " + ".join(f"{w} * {_D(i)}" for i, w in enumerate((2, 4, 10, 3, 5, 9, 4, 6, 8), 1))
_INN1 = " + ".join(f"{w} * {_D(i)}" for i, w in enumerate((7, 2, 4, 10, 3, 5, 9, 4, 6, 8), 1))
_INN2 = " + ".join(f"{w} * {_D(i)}" for i, w in enumerate((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8), 1))
_SN = " + ".join(f"{10 - i} * {_D(i)}" for i in range(1, 10))


@query("chk_numbers", f"""
with v as (select row_id, regexp_replace(entity_value, '[^0-9]', '', 'g') as d from ru_training_data where entity_value is not null)
select row_id, cast(length(d) as int) as n_digits,
  case when length(d) = 10 then ({_INN}) % 11 % 10 = {_D(10)} when length(d) = 12 then ({_INN1}) % 11 % 10 = {_D(11)} and ({_INN2}) % 11 % 10 = {_D(12)} else false end as inn,
  case when length(d) = 11 then (({_SN}) % 101) % 100 = cast(substr(d, 10, 2) as int) else false end as snils,
  case when length(d) = 0 then false else list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 0 then (2 * cast(substr(reverse(d), i, 1) as int)) % 10 + (2 * cast(substr(reverse(d), i, 1) as int)) // 10 else cast(substr(reverse(d), i, 1) as int) end)) % 10 = 0 end as luhn from v""")
def chk_numbers(spark, sf_dir):
    """Check digits of every labelled value, whatever its type."""
    v = F.col("entity_value")
    return table(spark, sf_dir, "ru_training_data").filter("entity_value is not null").select("row_id", digit_count(v).alias("n_digits"), is_inn(v).alias("inn"), is_snils(v).alias("snils"), is_luhn(v).alias("luhn"))


@query("src_offsets", "select row_id, coalesce(substr(text, start_pos + 1, end_pos - start_pos) = entity_value, false) as fits from ru_training_data")
def src_offsets(spark, sf_dir):
    """Whether the given offsets slice to the value."""
    fits = F.substring("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")) == F.col("entity_value")
    return table(spark, sf_dir, "ru_training_data").select("row_id", F.coalesce(fits, F.lit(False)).alias("fits"))


@query("src_entity_strings", "select row_id, cast(case when coalesce(entity_value, '') = '' or text is null then 0 else (length(text) - length(replace(text, entity_value, ''))) / length(entity_value) end as int) as n from ru_training_data")
def src_entity_strings(spark, sf_dir):
    """Occurrences of each value in its text."""
    n = F.size(F.coalesce(occurrences(F.col("text"), F.col("entity_value")), F.array().cast("array<struct<start_pos:int,end_pos:int>>")))
    return table(spark, sf_dir, "ru_training_data").select("row_id", F.when(F.col("text").isNull(), 0).otherwise(n).alias("n"))


@query("prj_type_map", "select row_id, case entity_type when 'PERSON' then 'PERSON' when 'PHONE_NUMBER' then 'PHONE' when 'EMAIL_ADDRESS' then 'EMAIL' else 'OTHER_' || entity_type end as kind from ru_training_data")
def prj_type_map(spark, sf_dir):
    kinds = {"PERSON": "PERSON", "PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL"}
    return table(spark, sf_dir, "ru_training_data").select("row_id", canonical_type(F.col("entity_type"), kinds).alias("kind"))


@query("flt_clean", "select rec_id, case when spans is null or len(spans) = 0 then 'neg' else 'pii' end as subset from train_negatives")
def flt_clean(spark, sf_dir):
    return table(spark, sf_dir, "train_negatives").select("rec_id", F.when(F.coalesce(F.size("spans"), F.lit(0)) > 0, "pii").otherwise("neg").alias("subset"))


@query("ag_type", """
select entity_type, cast(count(*) as bigint) as n, cast(count(distinct rec_id) as bigint) as n_records, cast(count(distinct entity_value) as bigint) as n_values from ru_training_data group by grouping sets ((entity_type), ())""")
def ag_type(spark, sf_dir):
    t = table(spark, sf_dir, "ru_training_data")
    return t.groupingSets([["entity_type"], []], "entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rec_id").alias("n_records"), F.countDistinct("entity_value").alias("n_values"))


@query("ag_name_slice", r"""
with p as (select entity_value as v from ru_training_data where entity_type = 'PERSON' and entity_value is not null)
select case when regexp_matches(v, '[А-ЯЁA-Z]\.') then 'initials' else cast(len(list_filter(string_split_regex(v, '[\s.]+'), lambda x: x <> '')) as varchar) end as form, v = lower(v) as lower_case, cast(count(*) as bigint) as n from p group by all""")
def ag_name_slice(spark, sf_dir):
    p = table(spark, sf_dir, "ru_training_data").filter("entity_type = 'PERSON' and entity_value is not null")
    form = F.when(F.col("entity_value").rlike(r"[А-ЯЁA-Z]\."), "initials").otherwise(F.size(F.filter(F.split("entity_value", r"[\s.]+"), lambda x: x != "")).cast("string"))
    return p.groupBy(form.alias("form"), (F.col("entity_value") == F.lower("entity_value")).alias("lower_case")).agg(F.count(F.lit(1)).alias("n"))


@query("ag_median", "select source, cast(median(n_chars) as double) as median, round(avg(n_chars), 6) as mean, round(stddev_pop(n_chars), 6) as deviation, cast(count(*) as bigint) as n from documents where n_chars is not null group by source")
def ag_median(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("n_chars is not null")
    return d.groupBy("source").agg(F.median("n_chars").cast("double").alias("median"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 6).alias("deviation"), F.count(F.lit(1)).alias("n"))


@query("so_topk", "select doc_id, n_chars from documents where n_chars is not null order by n_chars desc, doc_id limit 10")
def so_topk(spark, sf_dir):
    """The ten longest documents."""
    return table(spark, sf_dir, "documents").filter("n_chars is not null").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


@query("so_diverse", """
with r as (select rec_id, string_agg(distinct entity_type, ',' order by entity_type) as kinds from ru_training_data group by rec_id) select kinds, min(rec_id) as rec_id, cast(count(*) as bigint) as n from r group by kinds""")
def so_diverse(spark, sf_dir):
    """One record of each set of types."""
    r = table(spark, sf_dir, "ru_training_data").groupBy("rec_id").agg(F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("kinds"))
    return r.groupBy(F.when(F.col("kinds") != "", F.col("kinds")).alias("kinds")).agg(F.min("rec_id").alias("rec_id"), F.count(F.lit(1)).alias("n"))


@query("so_split")
def so_split(spark, sf_dir):
    """Documents in three splits of about 70, 15 and 15 percent by a hash of the id."""
    u = F.pmod(F.xxhash64(F.lit("split"), F.col("doc_id")), F.lit(100))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(u < 70, "train").when(u < 85, "dev").otherwise("test").alias("split"))


@query("so_msgs", "select distinct id, coalesce(conversation_id, -1) as conversation_id, cast(rank() over (partition by conversation_id order by created_at nulls first, id) as int) as place from (select distinct id, conversation_id, created_at from messages where id is not null)")
def so_msgs(spark, sf_dir):
    from veilframe.operators.ranking import spread_rank

    m = table(spark, sf_dir, "messages").filter("id is not null").select("id", "conversation_id", "created_at").distinct()
    return spread_rank(m, ["conversation_id"], ["created_at", "id"], "place").select("id", F.coalesce("conversation_id", F.lit(-1)).alias("conversation_id"), F.col("place").cast("int").alias("place"))


@query("jn_conv_msg", """
with m as (select distinct id, conversation_id from messages where id is not null), c as (select distinct id from conversations where id is not null)
select c.id, cast(count(m.id) as int) as n_messages from c left join m on m.conversation_id = c.id group by c.id""")
def jn_conv_msg(spark, sf_dir):
    return message_counts(table(spark, sf_dir, "conversations").select("id", "updated_at"), table(spark, sf_dir, "messages").select("id", "conversation_id", "updated_at"))


@query("jn_conv_contact", "select distinct v.id, coalesce(v.contact_id, -1) as contact_id, c.id is not null as known from conversations v left join (select distinct id from contacts) c on c.id = v.contact_id where v.id is not null")
def jn_conv_contact(spark, sf_dir):
    return conversation_contacts(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "contacts")).select("id", F.coalesce("contact_id", F.lit(-1)).alias("contact_id"), "known")


@query("jn_batch_in", "select cast((select count(*) from deletions where table_name = 'conversations') as bigint) as total, cast((select count(distinct id) from conversations where id in (select record_id from deletions where table_name = 'conversations')) as bigint) as processed")
def jn_batch_in(spark, sf_dir):
    """A batch of the ids of the log of removed conversations: asked for and found."""
    ids = table(spark, sf_dir, "deletions").filter("table_name = 'conversations'").select(F.col("record_id").alias("id"))
    return batch(table(spark, sf_dir, "conversations"), ids)[1]


@query("ag_conv_total")
def ag_conv_total(spark, sf_dir):
    """Entities and texts of each conversation, over identifier, contact and messages."""
    t = {n: table(spark, sf_dir, n) for n in ("conversations", "contacts", "messages")}
    return entity_totals(anonymized_conversations(t["conversations"], t["contacts"], t["messages"]))


@query("set_union", "select split, source, cast(count(*) as bigint) as n from (select distinct 'train' as split, source, rec_id from train_negatives union all select distinct 'dev', source, rec_id from dev_negatives union all select distinct 'test', source, rec_id from test_negatives) group by all")
def set_union(spark, sf_dir):
    """Records of each split and source."""
    parts = [table(spark, sf_dir, f"{s}_negatives").select(F.lit(s).alias("split"), "source", "rec_id").distinct() for s in ("train", "dev", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


_KEY = r"regexp_replace(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')"


@query("jn_anti_text", f"select distinct rec_id from dev_negatives where text is null or {_KEY} not in (select {_KEY} from train_negatives where text is not null)")
def jn_anti_text(spark, sf_dir):
    return not_held_out(table(spark, sf_dir, "dev_negatives"), table(spark, sf_dir, "train_negatives").select("text")).select("rec_id").distinct()


@query("exact_dup", f"select min(doc_id) as doc_id, cast(count(*) as bigint) as n_copies from documents where text is not null group by {_KEY}")
def exact_dup(spark, sf_dir):
    return first_copies(table(spark, sf_dir, "documents"), "doc_id")


_WORDS = r"select distinct unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')) as word from"


@query("jn_lex_disjoint", f"{_WORDS} dev_negatives intersect {_WORDS} test_negatives")
def jn_lex_disjoint(spark, sf_dir):
    """Words that both evaluation splits have."""
    w = lambda n: table(spark, sf_dir, n).select(F.explode(word_set(F.col("text"))).alias("word")).distinct()
    return shared_words(w("dev_negatives"), w("test_negatives"))


_SHINGLES = r"""
with w as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') as w from documents where text is not null),
s as (select doc_id, list_sort(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else w end)) as s from w where len(w) > 0),
c as (select min(doc_id) as id, s from s group by s), x as (select id, len(s) as n, unnest(s) as g from c)
"""


@query("jn_neardup", _SHINGLES + "select a.id as id_a, b.id as id_b from x a join x b on a.g = b.g and a.id < b.id group by a.id, b.id, a.n, b.n having count(*) / (a.n + b.n - count(*)) >= 0.6 - 1e-12")
def jn_neardup(spark, sf_dir):
    """Pairs of document classes with similar 3-word shingles; members of classes are in dup_classes."""
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id").select("id_a", "id_b")


@query("dup_classes", _SHINGLES + ", k as (select s, min(doc_id) as class_id from s group by s) select s.doc_id, k.class_id from s join k using (s)")
def dup_classes(spark, sf_dir):
    return duplicate_classes(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "class_id")


@query("sy_neardup")
def sy_neardup(spark, sf_dir):
    """Documents taken in order of id and dropped if similar to one kept before."""
    d = table(spark, sf_dir, "documents")
    classes = duplicate_classes(d, "doc_id").filter("doc_id = class_id")
    return accepted_in_order(near_duplicates(d, "doc_id"), classes, "doc_id")


@query("txt_norm", r"select doc_id, regexp_replace(regexp_replace(translate(lower(text), 'ё', 'е'), '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') as norm from documents")
def txt_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", collapsed(plain_yo(F.lower("text"))).alias("norm"))


@query("bio_round_trip", "select distinct rec_id, x.start_pos as start_pos, x.stop_pos as end_pos, x.entity_type as entity_type from (select rec_id, text, unnest(spans) as x from train_negatives where text is not null) where not regexp_matches(substr(text, x.start_pos, 1), '[\\p{L}\\p{N}_]') and not regexp_matches(substr(text, x.stop_pos + 1, 1), '[\\p{L}\\p{N}_]')".replace("\\\\", "\\"))
def bio_round_trip(spark, sf_dir):
    """Spans to tags of tokens and back: the spans that begin and end at word borders come back as they were."""
    r = table(spark, sf_dir, "train_negatives").filter("text is not null and size(spans) > 0")
    gold = F.transform("spans", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start_pos"].alias("start_pos"), s["stop_pos"].alias("end_pos"), F.lit(1.0).alias("score")))
    t = r.select("rec_id", "text", gold.alias("gold"), tokens_of(F.col("text")).alias("tokens"))
    t = t.withColumn("tags", tags_of(F.col("tokens"), F.col("gold"))).withColumn("words", F.transform("tokens", lambda x: F.substring("text", x["start_pos"] + 1, x["end_pos"] - x["start_pos"])))
    t = t.withColumn("back", spans_of_tags(F.col("text"), F.col("words"), F.col("tags")))
    one = t.select("rec_id", "text", F.explode("back").alias("s"))
    edge = lambda c: ~c.rlike(r"[\p{L}\p{N}_]")
    return one.filter(edge(F.substring("text", F.col("s.start_pos"), F.lit(1))) & edge(F.substring("text", F.col("s.end_pos") + 1, F.lit(1)))).select("rec_id", "s.start_pos", "s.end_pos", "s.entity_type").distinct()


@query("sy_values", "select doc_id, true as inn_ok, true as snils_ok, true as phone_ok from documents")
def sy_values(spark, sf_dir):
    """A tax number, an insurance number and a phone made for each document, all in their forms."""
    i = F.col("doc_id")
    phone = made_phone(i).rlike(r"^\+7 9[0-9]{2} [0-9]{3}-[0-9]{2}-[0-9]{2}$")
    return table(spark, sf_dir, "documents").select("doc_id", is_inn(made_inn(i)).alias("inn_ok"), is_snils(made_snils(i)).alias("snils_ok"), phone.alias("phone_ok"))


@query("sy_template", "select row_id, 'Клиент ' || entity_value || ' просит ответ, код ' || entity_value || '.' as text, cast(7 as int) as first_start, true as exact from ru_training_data where entity_value is not null")
def sy_template(spark, sf_dir):
    """A template with two slots filled with each labelled value; the spans slice to the value."""
    v = F.array(*[F.struct(F.col("entity_type").alias("entity_type"), F.col("entity_value").alias("value"))] * 2)
    t = table(spark, sf_dir, "ru_training_data").filter("entity_value is not null").select("row_id", "entity_value", filled(F.lit("Клиент {PERSON} просит ответ, код {X}."), v).alias("f"))
    exact = F.forall("f.spans", lambda s: F.substring("f.text", s["start_pos"] + 1, s["end_pos"] - s["start_pos"]) == F.col("entity_value"))
    return t.select("row_id", "f.text", F.get("f.spans", F.lit(0))["start_pos"].alias("first_start"), exact.alias("exact"))


@query("sy_corrupt", "select rec_id, cast(len(spans) as int) as n_spans, true as kept from train_negatives where text is not null and spans is not null")
def sy_corrupt(spark, sf_dir):
    """Typing errors in every labelled text; the protected values stand at their new offsets."""
    r = table(spark, sf_dir, "train_negatives").filter("text is not null and spans is not null")
    ends = F.array_sort(F.transform("spans", lambda s: F.array(s["start_pos"], s["stop_pos"])))
    c = r.select("rec_id", "text", ends.alias("spans")).withColumn("c", corrupted("text", "spans", F.col("rec_id")))
    same = F.forall(F.zip_with("spans", "c.spans", lambda a, b: F.substring("text", a[0] + 1, a[1] - a[0]) == F.substring("c.text", b[0] + 1, b[1] - b[0])), lambda x: x)
    return c.select("rec_id", F.size("c.spans").alias("n_spans"), same.alias("kept"))


@query("sy_qa", "select coalesce(reason, 'accepted') as reason, cast(count(*) as bigint) as n from (select case when n_chars < 20 then 'too_short' end as reason from documents where n_chars is not null) group by all")
def sy_qa(spark, sf_dir):
    """Documents by the first check they fail."""
    d = table(spark, sf_dir, "documents").filter("n_chars is not null")
    r = rejections(F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), F.col("n_chars"))
    return d.groupBy(F.coalesce(F.get(r, F.lit(0)), F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_decline", """
with b as (select * from (values ('Иванов', 'm'), ('Иванов', 'f'), ('Лунин', 'm'), ('Лунин', 'f'), ('Дюма', 'm')) t(base, gender)), c as (select unnest(['nom', 'gen', 'dat', 'acc', 'ins', 'prep']) as gcase)
select base, gender, gcase, case when base = 'Дюма' then base when gender = 'm' then base || case gcase when 'nom' then '' when 'gen' then 'а' when 'dat' then 'у' when 'acc' then 'а' when 'ins' then 'ым' else 'е' end
  else base || case gcase when 'nom' then 'а' when 'acc' then 'у' else 'ой' end end as surname,
  case when gender = 'm' then 'Петрович' || case gcase when 'nom' then '' when 'gen' then 'а' when 'dat' then 'у' when 'acc' then 'а' when 'ins' then 'ем' else 'е' end
  else 'Петровн' || case gcase when 'nom' then 'а' when 'gen' then 'ы' when 'dat' then 'е' when 'acc' then 'у' when 'ins' then 'ой' else 'е' end end as patronymic from b, c""")
def fn_decline(spark, sf_dir):
    """Surnames and patronymics in all cases: fixed words, no table."""
    b = spark.createDataFrame([("Иванов", "m"), ("Иванов", "f"), ("Лунин", "m"), ("Лунин", "f"), ("Дюма", "m")], "base string, gender string")
    c = b.withColumn("gcase", F.explode(F.array(*[F.lit(x) for x in ("nom", "gen", "dat", "acc", "ins", "prep")])))
    father = F.when(F.col("gender") == "f", "Петровна").otherwise("Петрович")
    return c.select("base", "gender", "gcase", decline_surname(F.col("base"), F.col("gender"), F.col("gcase")).alias("surname"), decline_patronymic(father, F.col("gender"), F.col("gcase")).alias("patronymic"))


@query("src_upload_dispatch", "select * from (values ('a.DOCX', 'docx'), ('b.pdf', 'pdf'), ('c.bin', 'pdf'), ('d.txt', 'unsupported')) t(path, handler)")
def src_upload_dispatch(spark, sf_dir):
    """Handlers of four names: fixed, no table."""
    d = spark.createDataFrame([("a.DOCX", None), ("b.pdf", "x/y"), ("c.bin", "application/pdf"), ("d.txt", "text/plain")], "path string, mime string")
    return d.select("path", handler_of(F.col("path"), F.col("mime")).alias("handler"))


def _stream_webhook(spark, sf_dir, names=None):
    import uuid

    from veilframe.streaming.webhook import run_webhook

    at = f"{shared_dir(spark)}/webhook-{uuid.uuid4().hex}"
    m = table(spark, sf_dir, "messages").filter("content is not null and id is not null").select("id", "content", "conversation_id", "message_type").distinct()
    m = m.groupBy("id", "content").agg(F.min("conversation_id").alias("conversation_id"))
    m.select(F.to_json(F.struct(F.lit("message_created").alias("event"), "id", "content", F.struct(F.col("conversation_id").alias("id")).alias("conversation"))).alias("value")).write.text(f"{at}/in")
    run_webhook(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", names=names).awaitTermination()
    forget(spark, at)  # deleted with the written tables
    return spark.read.parquet(f"{at}/out").select(F.col("id").cast("int").alias("id"), "n_entities")


@query("stream_webhook", r"select id, cast(len(regexp_extract_all(content, '(?i)[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}')) as int) as n_entities from (select distinct id, content from messages where content is not null and id is not null)")
def stream_webhook(spark, sf_dir):
    """All messages written as events, read as a stream and masked (e-mail addresses only)."""
    return _stream_webhook(spark, sf_dir, names=("rx_email",))


@query("stream_webhook_all")
def stream_webhook_all(spark, sf_dir):
    """All messages written as events, read as a stream and masked by all rules."""
    return _stream_webhook(spark, sf_dir)
