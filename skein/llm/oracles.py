"""SQL for another engine, for the queries that SQL can express on whole tables."""

from __future__ import annotations

from skein.llm.license_scan import PHRASES, TEMPLATES, templates_of
from skein.llm.mixing import ANY, TARGETS, Mix
from skein.llm.quality_rules import FURNITURE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRING = f"""
with d as (select doc_id, {WORDS} w from documents),
 u as (select doc_id, generate_subscripts(w, 1) k, unnest(w) x from d),
 n as (select doc_id, k, array_to_string(list(x) over (partition by doc_id order by k rows between current row and 12 following), ' ') y, count(*) over (partition by doc_id order by k rows between current row and 12 following) c from u),
 g as (select doc_id, k, min(doc_id) over (partition by y) < doc_id gone from n where c = 13),
 m as (select u.doc_id, u.k, u.x, coalesce(max(g.gone::int) over (partition by u.doc_id order by u.k rows between 12 preceding and current row), 0) gone from u left join g using (doc_id, k)),
 s as (select doc_id, count(*) n_words, sum(gone)::bigint n_removed, coalesce(string_agg(x, ' ' order by k) filter (gone = 0), '') kept from m group by 1)
select doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join s using (doc_id)
"""

QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') t, {WORDS} w from documents),
 u as (select doc_id, generate_subscripts(w, 1) k, unnest(w) x from d),
 n as (select doc_id, k, array_to_string(list(x) over (partition by doc_id order by k rows between current row and 4 following), ' ') y, count(*) over (partition by doc_id order by k rows between current row and 4 following) c from u),
 g as (select doc_id, k, count(*) over (partition by doc_id, y) > 1 twice from n where c = 5),
 m as (select u.doc_id, coalesce(max(g.twice::int) over (partition by u.doc_id order by u.k rows between 4 preceding and current row), 0) twice from u left join g using (doc_id, k)),
 r as (select doc_id, sum(twice)::bigint n_repeat_words from m group by 1),
 l as (select doc_id, x, min(k) k, count(*) n from (select doc_id, generate_subscripts(p, 1) k, unnest(p) x from (select doc_id, string_split(t, chr(10)) p from d)) where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1, 2),
 f as (select *, (len(x) - len(regexp_replace(x, '[#*$%&|<>]+', '', 'g')) > len(x) * 0.04::double)
     or len(regexp_extract_all(x, ' [|>»•] ')) >= 3
     or len(regexp_extract_all(x, '!!|\?\?')) >= 3
     or stutters >= 3
     or regexp_matches(lower(x), '{FURNITURE}')
     or (not regexp_matches(x, '[.!?:;…。！？][\x22\x27’”»)\]]*[\x20\x09\x0D]*$') and not regexp_matches(x, '(?:[^\x20]+\x20+){{12}}')) fails
   from (select *, list_reduce(list_prepend({{'last': '', 'n': 0}}, list_transform(string_split(x, ' '), lambda y: {{'last': y, 'n': 0}})), lambda a, b: {{'last': case when a.last = b.last and b.last <> '' then '' else b.last end, 'n': a.n + (a.last = b.last and b.last <> '')::int}}).n stutters from l)),
 q as (select doc_id, sum(n * len(x)) total, coalesce(sum(len(x)) filter (not fails), 0) passed, sum(n - 1) dups from f group by 1),
 o as (select doc_id, len(w)::bigint n_words, len(array_to_string(w, ''))::bigint word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint n_symbols, coalesce(dups, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words, total, passed from d left join r using (doc_id) left join q using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and coalesce(total, 0) > 0 and 1 - passed::double / total <= 0.5::double kept from o
"""


def _license() -> str:
    phrases = " union all ".join(f"select '{label}' label, {p.split()!r} p" for p, label in PHRASES.items())
    templates = " union all ".join(f"select '{t.label}' label, {sorted(t.tokens)!r} s, {t.required} r, {t.span} span" for t in templates_of(TEMPLATES))
    return rf"""
with d as (select doc_id, {LOWER} t from documents),
 w as (select doc_id, t, regexp_extract_all(t, '{LICENSE_WORD}') w from d),
 u as (select doc_id, generate_subscripts(w, 1) - 1 k, w, unnest(w) x from w where regexp_matches(t, 'license|cc')),
 a as (select doc_id, k, label from u, ({phrases}) p where x = p[1] and list_slice(w, k + 1, k + len(p)) = p),
 b as (select doc_id, count(*) n_base, min(k) first_word, max(k) last_word, string_agg(distinct label, ',' order by label) base_labels from a group by 1),
 l as (select doc_id, w, label, s, r, span from (select doc_id, w, list_distinct(w) o from w), ({templates}) q where len(list_intersect(o, s)) >= r),
 h as (select doc_id, label, max(c) c from (select doc_id, label, r, len(list_intersect(list_distinct(list_slice(w, k, k + span - 1)), s)) n, n / len(s)::double c from (select *, unnest(range(1, len(w) + 1)) k from l)) where n >= r group by 1, 2),
 o as (select doc_id, max(c) c from h group by 1),
 z as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from a union select doc_id, label from h) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0) n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, case when n_base > 0 then 1.0::double else coalesce(c, 0.0::double) end score
from w left join b using (doc_id) left join z using (doc_id) left join o using (doc_id)
"""


def _mixing() -> str:
    plan = Mix(targets=TARGETS)
    keys = ["domain", "lang", "source"]
    parts = []
    for depth in (1, 2, 3):
        own, up = keys[:depth], keys[: depth - 1]
        same = " and ".join(f"n.{k} is not distinct from g.{k}" for k in up) or "true"
        above = f"join b{depth - 1} g on {same}" if up else f"cross join (select sum(n_tokens) * {plan.budget_share}::double budget from leaf) g"
        by = f"partition by {', '.join(up)}" if up else ""
        order = f"({by} order by supply / weight, {', '.join(own)} rows between "
        cols = ", ".join(own)
        given = sorted(((path, w) for path, w in plan.targets.items() if len(path) == depth), key=lambda x: x[0].count(ANY))
        when = " ".join("when " + " and ".join(f"{k} = '{x}'" for k, x in zip(own, path) if x != ANY) + f" then {w}::double" for path, w in given)
        target = f"case {when} end" if when else "null::double"
        parts.append(
            f"t{depth} as (select {cols}, sum(n_tokens) n_tokens, sum(n_tokens) * {plan.max_epochs}::double supply, greatest(power(sum(n_tokens)::double, {plan.temperature}::double), 1e-9) own, {target} target from leaf group by {cols}), "
            f"n{depth} as (select *, greatest(coalesce(target, greatest(1 - coalesce(sum(target) over ({by}), 0), 0) * own / sum(own) filter (target is null) over ({by})), 1e-9) weight from t{depth}), "
            f"x{depth} as (select *, (given - coalesce(sum(supply) over {order} unbounded preceding and 1 preceding), 0)) / sum(weight) over {order} current row and unbounded following) lev from (select n.*, g.budget given from n{depth} n {above})), "
            f"b{depth} as (select *, least(supply, coalesce(first_value(case when supply / weight > lev then lev end ignore nulls) over {order} unbounded preceding and unbounded following) * weight, supply)) budget from x{depth})"
        )
    number = "regexp_extract(source, '([0-9]{1,9})$', 1)"
    same = " and ".join(f"d.{k} is not distinct from b.{k}" for k in keys)
    return f"""
with d as (select doc_id, case when {number} = '' then source else 'domain' || ({number}::bigint % 4)::varchar end as domain, lang, source, len({WORDS})::bigint n_tokens from documents),
 leaf as (select domain, lang, source, sum(n_tokens) n_tokens from d group by 1, 2, 3), {", ".join(parts)},
 p as (select d.*, case when b.n_tokens > 0 then floor(budget / b.n_tokens) else 1 end::int as whole, budget, b.n_tokens all_tokens from d join b3 b on {same}),
 o as (select *, ('0x' || substr(md5('{plan.seed}:' || whole::varchar || ':' || doc_id::varchar), 1, 13))::bigint spot from p),
 c as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by spot, doc_id rows between unbounded preceding and 1 preceding), 0) before from o),
 e as (select *, whole + (budget - whole * all_tokens > 0 and before < budget - whole * all_tokens)::int n from c)
select doc_id, domain, lang, source, n_tokens, unnest(range(n::bigint))::int epoch from e
"""


TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

LEXICAL = f"""
with d as (select doc_id, regexp_extract_all({LOWER}, {TERMS}) w from documents),
 q as (select distinct item_id, unnest(regexp_extract_all({LOWER}, {TERMS})) x from benchmark),
 n as (select doc_id, len(w)::bigint n from d where len(w) > 0),
 s as (select count(*)::bigint docs, sum(n)::bigint length from n),
 f as (select doc_id, x, count(*) tf from (select doc_id, unnest(w) x from d) where x in (select x from q) group by 1, 2),
 g as (select x, count(*) df from f group by 1),
 w as (select x, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint w from g, s),
 m as (select doc_id, 10 + (90 * n * docs) // length m from n, s),
 c as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join f using (x) join w using (x) join m using (doc_id) group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from c where score > 0 qualify rank <= 10
"""


def _codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    near = lambda c: f"select vec_id, part, min(d * {entries} + entry) % {entries} entry, min(d) d from (select p.vec_id, p.part, c.entry, list_sum(list_transform(range(1, len(v) + 1), lambda k: (v[k] - c.c[k]) ** 2))::bigint d from p join {c} c using (part)) group by 1, 2"
    moved = "".join(
        f""" a{r} as ({near(f"c{r}")}),
 m{r} as (select part, entry, list(m order by k) m from (select part, entry, k, floor(sum(x)::double / count(*))::bigint m from (select part, entry, generate_subscripts(v, 1) k, unnest(v) x from p join a{r} using (vec_id, part)) group by 1, 2, 3) group by 1, 2),
 c{r + 1} as (select part, entry, coalesce(m, c) c from c{r} left join m{r} using (part, entry)),"""
        for r in range(rounds)
    )
    return f"""
with e as (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select vec_id, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) v from (select *, unnest(range({parts})) part from e)),
 c0 as (select part, (row_number() over (partition by part order by vec_id)) - 1 entry, v c from p qualify entry < {entries}),{moved}
 a as ({near(f"c{rounds}")}),
 o as (select vec_id, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from a group by 1),
 h as (select sha256(string_agg(x::varchar, ',' order by part, entry, k)) codebooks_sha256 from (select part, entry, generate_subscripts(c, 1) k, unnest(c) x from c{rounds}))
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from o join e using (vec_id), h
"""


SQL = {"op12_lexical_search": LEXICAL, "op13_vector_codes": _codes(), "op1_substring": SUBSTRING, "op7_license_scan": _license(), "op8_mixing": _mixing(), "op10_quality_rules": QUALITY}
