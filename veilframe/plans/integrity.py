"""Queries on references between tables."""

from __future__ import annotations

from veilframe.operators.references import orphan_references, orphan_report
from veilframe.plans.registry import query
from veilframe.session import table

_FOUND = """
with refs as (
  select distinct 'messages' as child_table, 'conversation_id' as child_field, 'conversations' as parent_table, id as child_id, conversation_id as key, created_at from messages
  union select distinct 'messages', 'contact_id', 'contacts', id, contact_id, created_at from messages
  union select distinct 'conversations', 'contact_id', 'contacts', id, contact_id, created_at from conversations),
parents as (
  select 'conversations' as parent_table, id as key, min(created_at) as made from conversations group by id
  union all select 'contacts', id, min(created_at) from contacts group by id),
hits as (
  select r.*, p.key is null as missing from refs r left join parents p on p.parent_table = r.parent_table and p.key = r.key
  where r.key is not null and (p.key is null or p.made > r.created_at))
"""


def _tables(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in ("messages", "conversations", "contacts")}


@query("p4_found", _FOUND + "select distinct child_table, child_field, cast(child_id as bigint) as child_id from hits")
def p4_found(spark, sf_dir):
    return orphan_references(_tables(spark, sf_dir)).select("child_table", "child_field", "child_id").distinct()


@query("p4_report", _FOUND + """, one as (
  select child_table, child_field, parent_table, child_id, key, min(created_at) as made_at, bool_or(missing) as missing from hits group by all)
select child_table, child_field, parent_table, strftime(made_at, '%Y-%m') as month,
  cast(count(*) filter (where missing) as bigint) as n_missing, cast(count(*) filter (where not missing) as bigint) as n_late
from one group by all""")  # fmt: skip
def p4_report(spark, sf_dir):
    return orphan_report(orphan_references(_tables(spark, sf_dir)))
