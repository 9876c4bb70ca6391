"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm.best_fit_packing import op3_best_fit_packing
from tidemark.llm.embedding_whitening import op13_embedding_whitening
from tidemark.llm.language_id import op4_language_id
from tidemark.llm.license_scan import op9_license_scan
from tidemark.llm.line_dedup import op10_line_dedup
from tidemark.llm.merkle_manifest import op11_merkle_manifest
from tidemark.llm.ngram_jaccard import op1_ngram_jaccard
from tidemark.llm.quality_rules import op5_quality_rules
from tidemark.llm.secret_scan import op6_secret_scan
from tidemark.llm.source_mix import op7_source_mix
from tidemark.llm.substring_dedup import op8_substring_dedup
from tidemark.llm.syncmer_fingerprint import op2_syncmer_fingerprint
from tidemark.llm.token_counts import op12_token_counts


def pipeline(spark, sf_dir: str):
    """All stages of corpus_pipeline.py, applied to documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_syncmer_fingerprint,
        op3_best_fit_packing,
        op4_language_id,
        op5_quality_rules,
        op6_secret_scan,
        op7_source_mix,
        op8_substring_dedup,
        op9_license_scan,
        op10_line_dedup,
        op11_merkle_manifest,
        op12_token_counts,
        op13_embedding_whitening,
        pipeline,
    )
}

_OP1 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, g from (select doc_id, ws[i : i + 3] as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0) a) b),
sizes as (select w.doc_id, cast(count(g) as bigint) as n from w left join s on w.doc_id = s.doc_id group by 1),
links as (select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g join sizes p on a.doc_id = p.doc_id join sizes q on b.doc_id = q.doc_id
  where a.doc_id <> b.doc_id and 100 * p.n >= 85 * q.n and 100 * q.n >= 85 * p.n group by 1, 2, p.n, q.n having 185 * count(*) >= 85 * (p.n + q.n)),
counted as (select x, count(*) as c from links group by x),
reach as (select doc_id as x, doc_id as y from w union select r.x, l.y from reach r join links l on r.y = l.x)
select z.doc_id, z.n as n_shingles, min(r.y) as component_id, cast(coalesce(any_value(c), 0) as bigint) as n_links
from sizes z join reach r on z.doc_id = r.x left join counted on z.doc_id = counted.x group by 1, 2"""

_OP8 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, ws[i : i + 12] as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13) a),
firsts as (select g, min(doc_id) as m from win group by g),
gone as (select distinct doc_id, i + j as p from win join firsts using (g), range(0, 13) r(j) where m < doc_id),
lost as (select doc_id, list(p) as ps from gone group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: not list_contains(coalesce(ps, []), i)), ' ')) as kept_sha256
from w left join lost l on w.doc_id = l.doc_id"""

_OP11 = r"""
with recursive d as (select row_number() over () as r, coalesce('=' || lang, '') as k, doc_id, source, lang, n_chars, text from documents),
h as (select *, '' || coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as fields,
  xor(list_reduce(list_prepend(4294967295::bigint, flatten([[ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::varchar, '')])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint) % 3 = 0 as chosen from d),
leaves as (select r, k, doc_id, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) as leaf,
  case when chosen then sha256(fields || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as tampered from h),
placed as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos from leaves),
trees as (
  select 0 as l, k, pos, leaf as digest, count(*) over (partition by k) as n from placed
  union all
  select any_value(l) + 1, k, pos // 8, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 7) // 8 from trees where n > 1 group by k, pos // 8),
tops as (
  select 0 as l, row_number() over (order by k) - 1 as pos, digest, count(*) over () as n from trees where n = 1
  union all
  select any_value(l) + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (any_value(n) + 7) // 8 from tops where n > 1 group by pos // 8),
subs as (select k, digest as subroot, l as height, row_number() over (order by k) - 1 as place from trees where n = 1),
groups as (select k, l, pos // 8 as g, list({p: pos % 8, x: digest} order by pos) as xs from trees where n > 1 group by all),
topgroups as (select l, pos // 8 as g, list({p: pos % 8, x: digest} order by pos) as xs from tops where n > 1 group by all),
ways as (
  select r, l, (pos >> (3 * l)) & 7 as own, xs from placed p join groups q on p.k = q.k and q.g = p.pos >> (3 * q.l + 3)
  union all
  select r, height + q.l, (place >> (3 * q.l)) & 7, xs from placed p join subs s on p.k = s.k join topgroups q on q.g = place >> (3 * q.l + 3)),
proofs as (select r, string_agg(array_to_string([e.x for e in xs if e.p <> own], ''), '' order by l) as proof, max(l) + 1 as steps from ways group by r),
folded as (
  select r, 0 as l, coalesce(tampered, leaf) as digest from placed
  union all
  select f.r, f.l + 1, sha256(array_to_string([case when e.p = own then f.digest else e.x end for e in xs], '')) from folded f join ways w on f.r = w.r and f.l = w.l)
select p.doc_id, p.leaf, s.subroot, t.digest as root, sha256(coalesce(proof, '')) as proof_sha256, f.digest as folded_root, f.digest = t.digest as verified
from placed p join subs s on p.k = s.k cross join (select digest from tops where n = 1) t left join proofs q on p.r = q.r join folded f on p.r = f.r and f.l = coalesce(steps, 0)"""

#: The others have no SQL form: learned models, sampling by hashes, tokenizers, cuts by rolling hashes, places of matches.
ORACLE: dict[str, str] = {"op1_ngram_jaccard": _OP1, "op8_substring_dedup": _OP8, "op11_merkle_manifest": _OP11}
