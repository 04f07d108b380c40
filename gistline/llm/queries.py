"""The registered queries of this folder and their SQL twins.

Twins stand where SQL can say the whole result: near duplicates, line frequencies, benchmark leaks, Merkle trees
and hard negatives. The other operators hold learned models, agendas or token files; tests compare them with plain versions.
"""

from __future__ import annotations

from gistline.llm import (
    chat_repair, ef_tokens, fss_dedup, leak_index, maxent_lm, merkle_manifest, nb_toxicity, pii_boost, piece_bpe, quality_lines,
    rtree_negatives, url_model, weighted_sampling,
)

QUERIES = {
    "op1_pii_boost": pii_boost.query,
    "op2_nb_toxicity": nb_toxicity.query,
    "op3_fss_dedup": fss_dedup.query,
    "op4_chat_repair": chat_repair.query,
    "op5_maxent_lm": maxent_lm.query,
    "op6_quality_lines": quality_lines.query,
    "op7_piece_bpe": piece_bpe.query,
    "op8_url_model": url_model.query,
    "op9_elias_fano_tokens": ef_tokens.query,
    "op10_leak_index": leak_index.query,
    "op11_weighted_sampling": weighted_sampling.query,
    "op12_merkle_manifest": merkle_manifest.query,
    "op13_rtree_negatives": rtree_negatives.query,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {WORDS.format(x=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 3], ' ') as shingle
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as n from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (select c.u, c.v from common c join n x on x.doc_id = c.u join n y on y.doc_id = c.v
  where 100 * c.n >= 80 * (x.n + y.n - c.n)),
reached(doc_id, least) as (select doc_id, doc_id from w union select r.doc_id, l.v from reached r join links l on l.u = r.least)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join n using (doc_id) join (select doc_id, min(least) as component_id from reached group by 1) c using (doc_id)"""

QUALITY = f"""
with d as (select doc_id, source, coalesce(text, '') as text, {WORDS.format(x="coalesce(text, '')")} as ws from documents),
win as (select doc_id, ws[i : i + 4] as win, i from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5)),
twice as (select doc_id, win, i, count(*) over (partition by doc_id, win) as k from win),
rep as (select doc_id, count(distinct i + o) as n from twice, (select unnest(range(5)) as o) where k > 1 group by doc_id),
raw as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, sum(k - 1) as n from (select doc_id, line, count(*) as k from raw where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  group by all) group by doc_id),
l as (select doc_id, source, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') as line
  from raw),
f as (select source, line, min(doc_id) as first_doc from l where line <> '' group by source, line
  having count(distinct text) > 10 and (count(distinct text) > 1000
    or count(distinct text) > 0.005 * (select count(distinct text) from d h where h.source = l.source))),
gone as (select l.doc_id, sum(len(string_split(l.line, ' '))) as words, count(distinct l.line) as lines
  from l join f on f.source = l.source and f.line = l.line and f.first_doc <> l.doc_id group by 1),
m as (select d.doc_id, len(ws) as n_words, len(text) - len(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
  len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
  coalesce(rep.n, 0) as n_repeat_words, cast(coalesce(gone.words, 0) as bigint) as removed_words, coalesce(gone.lines, 0) as removed_lines
  from d left join rep using (doc_id) left join dup using (doc_id) left join gone using (doc_id)),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not (removed_words > 0 and n_words - removed_words < 0.3e0 * n_words) as kept, removed_words, removed_lines from j"""


def _terms(x: str) -> str:
    return f"regexp_extract_all(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


LEAKS = f"""
with d as (select doc_id, {_terms('text')} as ws from documents),
b as (select cast(item_id as varchar) as item_id, {_terms('text')} as ws from benchmark),
win as (select distinct item_id, ws[i : i + 9] as win from (select item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from b where len(ws) > 0)),
sizes as (select distinct len(win) as n from win),
dw as (select doc_id, i, ws[i : i + n - 1] as win from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, sizes)),
hit as (select dw.doc_id, dw.i, win.win, win.item_id from dw join win on dw.win = win.win),
places as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + len(win))) as p from hit) group by 1),
items as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id, ',' order by item_id) as listed from hit group by 1)
select d.doc_id, len(d.ws) as n_words, coalesce(places.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
 sha256(coalesce(listed, '')) as items_sha256, coalesce(places.n, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)"""

SQL: dict[str, str] = {"op3_fss_dedup": NEAR_DUPLICATES, "op6_quality_lines": QUALITY, "op10_leak_index": LEAKS,
                      "op12_merkle_manifest": merkle_manifest.ORACLE, "op13_rtree_negatives": rtree_negatives.ORACLE}
