"""SQL that gives the same rows as the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach(x, y) as (select a, b from link union select b, a from link union select r.x, l.y from reach r join (select a x, b y from link union all select b, a from link) l on r.y = l.x)"

_OP3 = f"""with recursive d as (select doc_id, {_WORDS.format(text='lower("text")')} w from documents), b as (select item_id, {_WORDS.format(text='lower("text")')} w from benchmark),
 ds as (select doc_id, len(w) n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) s from d where len(w) >= 5),
 bs as (select item_id, len(w) m, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) s from b where len(w) >= 5),
 pair as (select distinct doc_id, item_id from (select doc_id, unnest(s) t from ds) join (select item_id, unnest(s) t from bs) using (t)),
 win as (select doc_id, item_id, m, n, bs.s item, ds.s doc, unnest(range(0, greatest(n - m, 0) + 1)) as p from pair join ds using (doc_id) join bs using (item_id)),
 cut as (select doc_id, item_id, p as start, least(m, n - p) n_words, item, doc[p + 1 : p + least(m, n - p) - 4] part from win),
 sim as (select doc_id, item_id, start, n_words, len(item) + len(part) size, list_sum(list_transform(list_distinct(item), lambda h: least(len(list_filter(part, lambda x: x = h)), len(list_filter(item, lambda x: x = h))))) shared from cut where len(list_intersect(part, item)) * 100 >= 30 * len(list_distinct(item)))
 select doc_id, item_id, start, n_words, shared / (size - shared) similarity from sim where shared * 100 >= 80 * (size - shared)
 qualify row_number() over (partition by doc_id, item_id order by shared / (size - shared) desc, start) = 1"""

_BITS = "array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(h, i, 1))]), '')"
_B32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(b, 5 * i + 1, 1)::int + 8 * substr(b, 5 * i + 2, 1)::int + 4 * substr(b, 5 * i + 3, 1)::int + 2 * substr(b, 5 * i + 4, 1)::int + substr(b, 5 * i + 5, 1)::int)::int, 1)), '')"
_OP5 = f"""with p as (select page_id, url, encode(coalesce(html, '')) x, sha1(coalesce(html, '')) h from pages), q as (select *, {_BITS} b, max(page_id) over (partition by h) newest from p)
 select page_id, octet_length(x)::bigint payload_bytes, {_B32} payload_digest, case when page_id = newest then 'response' else 'revisit' end record_type, case when page_id <> newest then newest end refers_to, coalesce(url, '') url from q"""

_OP6 = f"""with recursive d as (select doc_id, {_WORDS.format(text=_LOWER.format(text='"text"'))} w from documents),
 s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from d),
 u as (select doc_id, len(s) n, unnest(s) t from s),
 link as (select a, b from (select x.doc_id a, y.doc_id b, x.n nx, y.n ny, count(*) c from u x join u y on x.t = y.t and x.doc_id < y.doc_id group by all) where 100 * c >= 80 * (nx + ny - c)),
 {_REACH}
 select doc_id, len(s)::bigint n_shingles, least(doc_id, coalesce(m, doc_id)) component_id from s left join (select x, min(y) m from reach group by x) on x = doc_id"""

_OP7 = f"""with recursive v as (select vec_id, embedding::double[] e from embeddings),
 good as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0),
 link as (select x.vec_id a, y.vec_id b from good x join good y on x.vec_id < y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.95),
 {_REACH},
 n as (select a i, count(*) c from (select a, b from link union all select b, a from link) group by a)
 select vec_id, coalesce(c, 0)::bigint n_links, least(vec_id, coalesce(m, vec_id)) component_id, least(vec_id, coalesce(m, vec_id)) = vec_id kept from v left join (select x, min(y) m from reach group by x) on x = vec_id left join n on i = vec_id"""

_OP8 = f"""with d as (select doc_id, {_WORDS.format(text='"text"')} w from documents),
 win as (select doc_id, i, array_to_string(w[i:i+49], ' ') t from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
 old as (select t, min(doc_id) o from win group by t),
 gone as (select distinct doc_id, unnest(range(i, i + 50)) i from win join old using (t) where o < doc_id),
 dead as (select doc_id, list(i) l from gone group by doc_id)
 select doc_id, len(w)::bigint n_words, coalesce(len(l), 0)::bigint n_removed, sha256(array_to_string(case when l is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(l, i)), lambda i: w[i]) end, ' ')) kept_sha256 from d left join dead using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _OP3, "op5_warc": _OP5, "op6_ngram_jaccard": _OP6, "op7_embedding_dedup": _OP7, "op8_substring_dedup": _OP8}
