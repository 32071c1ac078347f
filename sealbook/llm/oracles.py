"""The same results in DuckDB's SQL, where it can express them."""

# Words of a text, as the contract of the operators has them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with recursive words as materialized (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents
), shingles as materialized (
  select distinct doc_id, s from (
    select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) s from words where len(w) >= 3
    union all select doc_id, array_to_string(w, ' ') from words where len(w) between 1 and 2)
), sizes as materialized (select doc_id, count(*) n from shingles group by 1
), pairs as materialized (
  select a.doc_id u, b.doc_id v, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as materialized (
  select u, v from pairs join sizes a on a.doc_id = u join sizes b on b.doc_id = v where 100 * c >= 90 * (a.n + b.n - c)
), edges as materialized (select u, v from links union all select v, u from links
), reach(node, root) as (
  select u, u from edges union select v, root from reach join edges on node = u
), smallest as (select node, min(root) root from reach group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(root, d.doc_id) component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join smallest on node = d.doc_id
"""

OP3 = r"""
with lines as materialized (
  select doc_id, i, string_split(text, chr(10))[i] line from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)
), full_ as materialized (
  select doc_id, i, line, row_number() over (partition by doc_id order by i) r from lines where regexp_matches(line, '[^\x20\x09-\x0D]')
), windows as materialized (
  select a.doc_id, a.r, a.line a, b.line b from full_ a join full_ b on a.doc_id = b.doc_id and b.r = a.r + 1
), later as (
  select doc_id, r, row_number() over (partition by a, b order by doc_id, r) k from windows
), gone as (
  select distinct doc_id, r from (select doc_id, r from later where k > 1 union all select doc_id, r + 1 from later where k > 1)
), marked as (
  select l.doc_id, l.i, l.line, f.r, g.r g from lines l left join full_ f on f.doc_id = l.doc_id and f.i = l.i
  left join gone g on g.doc_id = f.doc_id and g.r = f.r
)
select d.doc_id, count(r) n_lines, count(g) n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where g is null and i is not null), '')) kept_sha256
from documents d left join marked m on m.doc_id = d.doc_id group by d.doc_id
"""

OP6 = rf"""
with words as materialized (select doc_id, {_WORDS} w from documents
), windows as materialized (
  select doc_id, unnest(range(1, len(w) - 18)) i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i+19], ' '))) s
  from words where len(w) >= 20
), later as materialized (
  select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) k from windows) where k > 1
), gone as materialized (select distinct doc_id, unnest(range(i, i + 20)) p from later
), places as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) word from words
), marked as (select p.doc_id, p.p, word, g.p g from places p left join gone g on g.doc_id = p.doc_id and g.p = p.p)
select d.doc_id, count(m.p) n_words, count(g) n_removed,
  sha256(coalesce(string_agg(word, ' ' order by m.p) filter (where g is null and m.p is not null), '')) kept_sha256
from documents d left join marked m on m.doc_id = d.doc_id group by d.doc_id
"""


OP12 = rf"""
with pieces as materialized (
  select coalesce(lang, 'und') lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) p from documents
), words as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces
), n as (select lang, sum(len(w))::bigint n from words group by 1
), phrases as materialized (
  select lang, p, count(*) f from (
    select lang, unnest(w) p from words
    union all select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) p from words
    union all select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) p from words
  ) group by all having count(*) >= 10
), candidates as materialized (select lang, p, f a, string_split(p, ' ') w from phrases where contains(p, ' ')
), cuts as (
  select c.lang, c.p, a, k, l.f l, r.f r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) score
  from (select *, unnest(range(1, len(w))) k from candidates) c
  join phrases l on l.lang = c.lang and l.p = array_to_string(w[1:k], ' ')
  join phrases r on r.lang = c.lang and r.p = array_to_string(w[k+1:], ' ')
), best as (select * from (select *, row_number() over (partition by lang, p order by score, k) o from cuts) where o = 1
), inner_ as (
  select lang, q, max(a) longer from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) q from candidates where len(w) = 3) group by 1, 2
), ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, p) rank
  from best b left join inner_ i on i.lang = b.lang and i.q = b.p where i.q is null or 100 * longer < 50 * a
)
select r.lang, rank, p phrase, a, l, r, n, score::bigint score from ranked r join n on n.lang = r.lang where rank <= 2000
"""

OP13 = r"""
with vectors as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), numbered as materialized (select *, row_number() over (order by vec_id) r from vectors
), scored as (
  select q.vec_id query_id, q.r, c.vec_id, list_inner_product(q.v, c.v)::bigint score
  from numbered q join numbered c on q.r <> c.r where q.vec_id % 100 = 0
)
select query_id, rank::integer rank, vec_id, score from (
  select *, row_number() over (partition by query_id, r order by score desc, vec_id) rank from scored) where rank <= 10
"""


def oracles() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op3_line_dedup": OP3, "op6_substring_dedup": OP6, "op12_collocations": OP12, "op13_exact_top_k": OP13}
