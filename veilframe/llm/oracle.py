"""SQL of the word-set and look-alike problems: the consistent form of a text by its tokens, and pairs over word lists."""

from __future__ import annotations

from veilframe.llm.lookalikes import _BASE, _FORMS, _SETTLED

_ESC = lambda n: f"\\x{{{n:x}}}"
_GONE = "[" + "".join(_ESC(n) for n, c in sorted(_BASE.items()) if c is None) + _ESC(0x200D) + "]"
_SWAP = [(chr(n), c) for n, c in sorted(_BASE.items()) if c is not None and len(c) == 1]
_FROM, _TO = ("".join(x).replace("'", "''") for x in zip(*_SWAP))


def _spelled(script: str) -> tuple[str, str]:
    """Two strings for translate(): look-alike letters, and their spelling in a script (else in Latin)."""
    pairs = [(c, f.get(script, f["Latin"])) for c, f in sorted(_FORMS.items()) if f.get(script, f["Latin"]) != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_LATIN, _CYRILLIC = _spelled("Latin"), _spelled("Cyrillic")
_L = "[" + "".join(c for c in _SETTLED.pattern if c.isascii() and c.isalpha()) + "]"
_C = "[" + "".join(c for c in _SETTLED.pattern if not c.isascii()) + "]"
_has = lambda w, cls: f"regexp_matches({w}, '{cls}')"
_to = lambda w, t: f"translate({w}, '{t[0]}', '{t[1]}')"


def _token(w: str, main: str) -> str:
    return (
        f"case when {_has(w, _C)} and {_has(w, _L)} then {w} when {_has(w, _C)} then {_to(w, _CYRILLIC)} when {_has(w, _L)} then {_to(w, _LATIN)}"
        f" when {_has(w, '[0-9]')} or {main} = 'L' then {_to(w, _LATIN)} else {_to(w, _CYRILLIC)} end"
    )


def forms(source: str, marks: bool) -> str:
    """CTEs over rows (id, text) of `source`: k has plain text t, its tokens and main script; marks: whether loose accents stay."""
    plain = f"nfc_normalize(translate(regexp_replace(text, '{_GONE}', '', 'g'), '{_FROM}', '{_TO}'))"
    if not marks:
        plain = rf"regexp_replace({plain}, '\p{{Mn}}', '', 'g')"
    settled = lambda a, b: f"len(list_filter(toks, lambda w: {_has('w', a)} and not {_has('w', b)}))"
    return rf"""x as ({source}), n as (select id, text, {plain} as t from x where id is not null and text is not null),
k0 as (select id, text, t, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') as toks from n),
k as (select *, case when {settled(_L, _C)} > {settled(_C, _L)} then 'L' else 'C' end as main from k0)"""


def word_pairs(source: str) -> str:
    """CTEs ending in near(a, b, share): pairs of different rows whose distinct words have a Jaccard similarity of 0.65 or more; source: distinct (id, side, text)."""
    return rf"""{forms(source, False)},
s as (select id, text, list_distinct(list_transform(toks, lambda w: lower({_token('w', 'main')}))) as ws from k where len(toks) > 0),
u as (select id, text, len(ws) as n, unnest(ws) as w from s),
near as (select a.id as a, b.id as b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as share from u a join u b on a.w = b.w and a.id < b.id
  group by a.id, a.text, b.id, b.text having count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.65 - 1e-12)"""


P1_FOUND_SQL = f"""with {word_pairs("select distinct rec_id as id, text from (select rec_id, text from train_negatives union all select rec_id, text from dev_negatives union all select rec_id, text from test_negatives)")},
tr as (select distinct rec_id from train_negatives)
select distinct cast(a as bigint) as id_a, cast(b as bigint) as id_b from near where (a in (select rec_id from tr)) <> (b in (select rec_id from tr))"""
P1_REPORT_SQL = f"""with {word_pairs("select distinct rec_id as id, text from (select rec_id, text from train_negatives union all select rec_id, text from dev_negatives union all select rec_id, text from test_negatives)")},
tr as (select distinct rec_id from train_negatives),
e as (select case when a in (select rec_id from tr) then b else a end as id, count(*) as n, max(share) as share from (select a, b, max(share) as share from near where (a in (select rec_id from tr)) <> (b in (select rec_id from tr)) group by a, b) group by 1),
r as (select distinct 'dev' as split, source, rec_id from dev_negatives union all select distinct 'test', source, rec_id from test_negatives)
select split, source, cast(count(distinct rec_id) as bigint) as n_records, cast(count(distinct rec_id) filter (where n > 0) as bigint) as n_overlapping, cast(count(distinct rec_id) filter (where share >= 1) as bigint) as n_exact, cast(coalesce(sum(n), 0) as bigint) as n_pairs
from r left join e on e.id = r.rec_id group by split, source"""
P3_FOUND_SQL = f"""with {word_pairs("select distinct rec_id as id, text from (select rec_id, text from ru_training_data union all select rec_id, text from dev_negatives)")}
select distinct cast(a as bigint) as id_a, cast(b as bigint) as id_b from near"""
P5_FOUND_SQL = rf"""with {forms("select distinct id, content as text from messages", True)},
f as (select id, text, array_to_string(list_transform(list_zip(string_split_regex(t, '[\p{{L}}\p{{N}}]+'), list_append(list_transform(toks, lambda w: {_token('w', 'main')}), '')), lambda z: z[1] || z[2]), '') as form from k)
select distinct cast(least(a.id, b.id) as bigint) as id_a, cast(greatest(a.id, b.id) as bigint) as id_b from f a join f b on a.form = b.form and a.text <> b.text and a.id < b.id where regexp_matches(a.form, '[^\s]')"""
