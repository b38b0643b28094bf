"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from ledgerwright.llm.quality_rules import BIT, POLICIES, POLICY

ORACLES: dict[str, str] = {}

_RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "endless_word": "longest_word > 2000",
}

_LEDGER = r"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), words as (
  select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    [l for l in string_split(t, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] as lines
  from texts
), windows as (
  select r, unnest(range(1, len(w) - 3)) as i,
    unnest([list_slice(w, i, i + 4) for i in range(1, len(w) - 3)]) as five
  from words where len(w) >= 5
), repeated as (
  select r, i from (select r, i, count(*) over (partition by r, five) as n from windows) where n > 1
), covered as (
  select r, count(distinct i + o) as n from repeated, (values (0), (1), (2), (3), (4)) v(o) group by r
), measured as (
  select doc_id, len(w)::bigint as n_words,
    coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines,
    coalesce(list_max([strlen(x) for x in w]), 0)::bigint as longest_word
  from words left join covered using (r)
), ledger as (
  select *, ({bits})::bigint as fail_bits from measured
)
""".replace(
    "{bits}", " + ".join(f"case when {c} then {BIT[r]} else 0 end" for r, c in _RULES.items())
)

ORACLES["op1_quality_rules"] = f"""{_LEDGER}
select *, fail_bits & {POLICIES["v1"]} <> 0 as base_failed, fail_bits & {POLICIES[POLICY]} = 0 as kept
from ledger"""

ORACLES["quality_ablations"] = f"""{_LEDGER}, cases(policy, rule, mask, bit) as (values {
    ", ".join(
        f"('{p}', '{r}', {m}, {b})" for p, m in POLICIES.items() for r, b in BIT.items() if b & m
    )
})
select policy, rule, count(*) filter (fail_bits & bit <> 0) as n_failed,
  count(*) filter (fail_bits & mask = bit) as n_only,
  count(*) filter (fail_bits & mask = 0) as n_kept
from ledger, cases group by policy, rule"""

ORACLES["op8_top_products"] = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank,
  vec_id, score
from scored
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


def _filled(depth: int, levels: list[str], source: str, weights: str) -> str:
    """One level of the budget tree, as a chain of common table expressions."""
    path = ", ".join(levels[:depth])
    parents = ", ".join(levels[: depth - 1]) or "0"
    if depth == 1:
        given = "least((select sum(tokens) * 80 // 100 from leaves), sum(sum(tokens)) over () * 2)"
        join, group = "", path
    else:
        given = "any_value(u.budget)"
        same = " and ".join(f"l.{c} is not distinct from u.{c}" for c in levels[: depth - 1])
        join, group = f"join {source} u on {same}", ", ".join(f"l.{c}" for c in levels[:depth])
    own = levels[depth - 1]
    w = f"(case {weights} else 1 end)" if weights else "1"
    over = f"partition by {parents} order by capacity / weight, {own} nulls first"
    return f"""nodes{depth} as (
  select {", ".join(f"l.{c}" for c in levels[:depth])}, sum(l.tokens)::bigint as tokens,
    sum(l.tokens)::bigint * 2 as capacity, {w.replace("$", f"l.{own}")} as weight,
    {given} as given
  from leaves l {join} group by {group}
), tried{depth} as (
  select *, capacity::hugeint * sum(weight) over ({over} rows between current row and unbounded following)
    <= weight::hugeint * (given - coalesce(sum(capacity) over ({over}
      rows between unbounded preceding and 1 preceding), 0)) as filled
  from nodes{depth}
), budget{depth} as (
  select * exclude (filled), case when filled then capacity else weight::hugeint
    * (given - coalesce(sum(capacity) filter (filled) over (partition by {parents}), 0))
    // sum(weight) filter (not filled) over (partition by {parents}) end::bigint as budget
  from tried{depth}
)"""


_LEVELS = ["domain", "language", "origin"]
ORACLES["op3_source_mix"] = f"""
with docs as (
  select doc_id, case when try_cast(substr(source, 4) as int) < 10 then 'web'
      when try_cast(substr(source, 4) as int) < 15 then 'books' else 'forum' end as domain,
    lang as language, source as origin,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens
  from documents
), leaves as (
  select domain, language, origin, sum(tokens)::bigint as tokens from docs group by all
), {_filled(1, _LEVELS, "", "$ when 'web' then 5 when 'books' then 3 when 'forum' then 2")},
{_filled(2, _LEVELS, "budget1", "$ when 'en' then 6 when 'de' then 2 when 'fr' then 2 when 'es' then 1")},
{_filled(3, _LEVELS, "budget2", "")},
plan as (
  select domain, language, origin, budget, case when tokens > 0 then budget // tokens else 0 end as full_epochs,
    case when tokens > 0 then budget % tokens else 0 end as rest
  from budget3
), keyed as (
  select d.*, p.budget, p.full_epochs, p.rest,
    md5('20|' || full_epochs::varchar || '|' || coalesce(doc_id::varchar, 'null')) as k
  from docs d join plan p on d.domain is not distinct from p.domain
    and d.language is not distinct from p.language and d.origin is not distinct from p.origin
), cuts as (
  select *, sum(tokens) over (partition by domain, language, origin order by k
    range between unbounded preceding and current row) as upto from keyed
), last as (
  select domain, language, origin, max(k) filter (rest > 0 and upto <= rest) as cut from cuts group by all
)
select doc_id, k.domain, k.language, k.origin, tokens, budget,
  (full_epochs + case when k <= cut then 1 else 0 end)::bigint as copies
from keyed k join last c on k.domain is not distinct from c.domain
  and k.language is not distinct from c.language and k.origin is not distinct from c.origin
"""

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '{_PARTS}', 1), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '{_PARTS}', 2)"


def _fits(host: str, path: str) -> str:
    return f"(h = '{host}' or ends_with(h, '.{host}')) and starts_with(p, '{path}')"


_RULE = f"""case when {_fits("www.example.com", "/en/")} then 'www.example.com/en/'
  when {_fits("example.com", "/en/")} then 'example.com/en/'
  when {_fits("net", "/es/")} then 'net/es/' when {_fits("net", "/fr/")} then 'net/fr/'
  when {_fits("com", "/")} then 'com/' end"""
_HREF = (
    r"""(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']""",
    r"""(?is)<link\b[^>]*\bhref\s*=\s*["'']([^"'']+)["''][^>]*\brel\s*=\s*["'']?canonical\b""",
    r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*([^"''\s>]+)""",
)
ORACLES["op10_url_verdicts"] = f"""
with recursive stated as (
  select url as src, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as site,
    unnest([{", ".join(f"regexp_extract(coalesce(html, ''), '{r}', 1)" for r in _HREF)}]) as href
  from pages where contains(url, '://')
), links as (
  select src, case when starts_with(href, '/') and not starts_with(href, '//') then site || href
    else href end as dst from stated
  union
  select url, 'https://' || regexp_replace({_host("url")}, '^(www|m)\\.', '')
    || regexp_replace({_path("url")}, '(\\.html|/)$', '') from pages where contains(url, '://')
), edges as (
  select src, dst from links where contains(dst, '://')
  union select dst, src from links where contains(dst, '://')
), reach(url, other) as (
  select src, src from edges union select r.url, e.dst from reach r join edges e on e.src = r.other
), judged as (
  select url, {_RULE.replace("h =", "oh =").replace("(h,", "(oh,").replace("(p,", "(op,")} as other_rule
  from (select url, {_host("other")} as oh, {_path("other")} as op from reach)
), aliases as (
  select url, bool_or(coalesce(other_rule in ('example.com/en/', 'net/es/', 'net/fr/'), false)) as blocks,
    bool_or(coalesce(other_rule in ('com/', 'www.example.com/en/'), false)) as allows
  from judged group by url
), ruled as (
  select page_id, url, h as host, p as path, {_RULE} as rule
  from (select page_id, url, {_host("url")} as h, {_path("url")} as p from pages)
)
select page_id, host, path, rule, case
    when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
    when blocks and not allows then 'block' else 'allow' end as verdict
from ruled left join aliases using (url)
"""

ORACLES["op12_collocations"] = r"""
with texts as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
),
pieces as (
  select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from texts
),
split as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as words from pieces
),
totals as (select lang, cast(sum(len(words)) as bigint) as n from split group by lang),
places as (select lang, words, unnest(range(1, len(words) + 1)) as i from split where len(words) > 0),
occurrences as (
  select lang, words[i : i + k - 1] as p, k
  from places, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(words)
),
counts as (
  select lang, array_to_string(p, ' ') as phrase, k, count(*) as a, any_value(p) as p
  from occurrences group by lang, array_to_string(p, ' '), k
),
frequent as (select * from counts where a >= 100),
inner_phrases as (
  select distinct l.lang, x.part as phrase
  from frequent l,
       lateral (select array_to_string(l.p[1 : l.k - 1], ' ') as part
                union all select array_to_string(l.p[2 : l.k], ' ')) x
  join counts c on c.lang = l.lang and c.phrase = x.part and c.a <= l.a
  where l.k > 1
),
cuts as (
  select c.lang, c.phrase, c.a, f.a as l, r.a as r, t.n, j.j,
         cast((1000::hugeint * c.a * t.n) // (f.a::hugeint * r.a) as bigint) as score
  from frequent c
  join (select unnest(range(1, 5)) as j) j on j.j < c.k
  join frequent f on f.lang = c.lang and f.phrase = array_to_string(c.p[1 : j.j], ' ')
  join frequent r on r.lang = c.lang and r.phrase = array_to_string(c.p[j.j + 1 : c.k], ' ')
  join totals t on t.lang = c.lang
  where c.k > 1
    and not exists (select 1 from inner_phrases i where i.lang = c.lang and i.phrase = c.phrase)
),
lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
         phrase, a, l, r, n, score
  from lowest
)
select * from ranked where rank <= 2000
"""
