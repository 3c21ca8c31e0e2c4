"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_templates(depth: int = 4, z: float = 2.58, alpha: float = 4.0, beta: float = 10.0, reject_at: float = 0.7) -> str:
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    parts = "string_split(regexp_replace(shape, '^/', ''), '/')"
    segments = ", ".join(f"coalesce({parts}[{k + 1}], '') as s{k}" for k in range(depth))
    steps, tree = "", "tree0"
    for k in range(depth + 1):
        above = ", ".join(["host", *(f"t{i}" for i in range(k))])
        steps += f"""
    , nodes{k} as (select {above}, s{k}, sum(blocked) as b, sum(allowed) as a from {tree} group by all)
    , parents{k} as (select {above}, sum(b) as pb, sum(a) as pa from nodes{k} group by all)
    , shares{k} as (
        select {above}, s{k}, regexp_replace(regexp_replace(s{k}, '[A-Za-z]{{4,}}', '@', 'g'), '[A-Za-z]', 'a', 'g') as form, a + b as n, b / nullif(a + b, 0) as own,
            pb / nullif(pa + pb, 0) as share, pa + pb as total
        from nodes{k} join parents{k} using ({above}))
    , labelled{k} as (
        select {above}, s{k}, form, case when n = 0 then null when (own - share) * (own - share) * n <= {z}::double * {z}::double * (share * (1 - share) + 1 / total) then '~'
            else case when own > share then '+' else '-' end || least(floor(own * 5), 4)::int::varchar end as branch
        from shares{k})
    , variable{k} as (
        select {above}, form, min(branch) as usual from labelled{k} where branch is not null group by {above}, form having count(*) >= 2 and min(branch) = max(branch))
    , named{k} as (select {above}, s{k}, coalesce(branch, usual, '?' || form) as t{k} from labelled{k} left join variable{k} using ({above}, form))
    , tree{k + 1} as (select * from {tree} join named{k} using ({above}, s{k}))"""
        tree = f"tree{k + 1}"
    template = " || '/' || ".join(f"t{k}" for k in range(depth + 1))
    return f"""
    with parts as (
        select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
    , base as (
        select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts)
    , ruled as (
        select *, case when {fits('example.net', '/en/')} then 'example.net/en/' when {fits('example.com', '/de/')} then 'example.com/de/'
            when {fits('org', '/fr/')} then 'org/fr/' when {fits('net', '/')} then 'net/' end as rule,
            regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{12,}}', '{{#}}', 'g'), '[0-9]+', '{{0}}', 'g') as shape
        from base)
    , said as (select *, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end as says from ruled)
    , shapes as (
        select host, shape, count(*)::double as n, (count(*) filter (says = 'block'))::double as blocked, (count(*) filter (says = 'allow'))::double as allowed
        from said group by all)
    , tree0 as (
        select *, {segments}, coalesce(array_to_string({parts}[{depth + 1}:], '/'), '') as s{depth} from shapes){steps}
    , named as (select *, {template} as template from {tree})
    , hosts as (
        select host, (sum(blocked) + 0.5::double * (sum(n) - sum(blocked) - sum(allowed) + {beta}::double)) / (sum(n) + {beta}::double) as prior from named group by host)
    , stats as (select host, template, sum(blocked) as tb, sum(allowed) as ta from named group by all)
    , scored as (
        select host, template, case when tb + ta > 0 then (tb + {alpha}::double * prior) / (tb + ta + {alpha}::double) else least(prior, 0.5) end as purity from stats join hosts using (host))
    select page_id, said.host as host, path, rule, coalesce(says, case when purity >= {reject_at}::double then 'block' else 'allow' end) as verdict,
        named.template as template, round(purity, 9) as purity
    from said join named using (host, shape) join scored on scored.host = said.host and scored.template = named.template"""


def mixing(share: float = 0.3, alpha: float = 0.5, rounds: int = 25, seed: str = "mix") -> str:
    dims = ("source", "lang", "topic")
    goals, steps, last = "", "", "w0"
    for d in dims:
        goals += f"""
    , sums_{d} as (select {d}, sum(n)::double as s from cells group by {d} having sum(n) > 0)
    , goal_{d} as (select {d}, s ** {alpha}::double / (select sum(s ** {alpha}::double) from sums_{d}) * (select sum(n) from cells) as goal from sums_{d})"""
    for i in range(rounds):
        for d in dims:
            name = f"w{i}_{d}"
            steps += f"""
    , {name} as materialized (
        select {', '.join(dims)}, n, coalesce(w * goal / nullif(sum(w) over (partition by {d}), 0), 0) as w from {last} left join goal_{d} using ({d}))"""
            last = name
    return rf"""
    with keyed as (
        select doc_id, coalesce(source, '(missing)') as source, coalesce(lang, '(missing)') as lang,
            case when contains(text, ' | ') then 'table' when contains(text, 'icense') then 'licence'
                when regexp_matches(text, '[0-9]{{4}}') then 'record' else 'prose' end as topic,
            coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n_tokens
        from documents)
    , cells as materialized (select source, lang, topic, sum(n_tokens)::double as n from keyed group by all){goals}
    , w0 as (select *, n as w from cells){steps}
    , ratios as (select *, coalesce(w / nullif(n, 0), 0) as r from {last})
    , upto as (
        select *, coalesce(sum(n) over (order by r desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0) as before,
            sum(n * r) over (order by r desc, source, lang, topic rows between current row and unbounded following) as rest,
            row_number() over (order by r desc, source, lang, topic) as k
        from ratios)
    , scale as (
        select coalesce(arg_min(({share}::double * total - before) / rest, k), 'inf'::double) as s
        from upto, (select sum(n) as total from cells) where rest > 0 and ({share}::double * total - before) / rest * r <= 1)
    , probs as (select source, lang, topic, r, case when r > 0 then greatest(0, least(1, s * r)) else 0 end as p from upto, scale)
    select doc_id, source, lang, topic, n_tokens, round(r, 6) as weight, round(p, 6) as prob,
        ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {float(16**13)!r}::double < p as sampled
    from keyed join probs using (source, lang, topic)"""


def collocations(least: int = 30, top: int = 2000) -> str:
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    grams, tables = "", ""
    for k in range(1, 5):
        phrase = "w" + "".join(f" || ' ' || lead(w, {i}) over p" for i in range(1, k))
        grams += f"""
    , g{k} as (select lang, phrase, count(*) as f from (select lang, {phrase} as phrase from words window p as (partition by doc, piece order by place)) where phrase is not null group by all)"""
    for k in range(2, 5):
        cuts = ", ".join(f"array_to_string(ws[1:{j}], ' ') as h{j}, array_to_string(ws[{j + 1}:], ' ') as t{j}" for j in range(1, k))
        joins = " ".join(f"join g{j} as x{j} on x{j}.lang = c.lang and x{j}.phrase = h{j} join g{k - j} as y{j} on y{j}.lang = c.lang and y{j}.phrase = t{j}" for j in range(1, k))
        scores = ", ".join(f"{{'score': ((2000000::hugeint * c.a) // (x{j}.f + y{j}.f))::bigint, 'cut': {j}, 'l': x{j}.f, 'r': y{j}.f}}" for j in range(1, k))
        tables += f"""
    , c{k} as (select lang, phrase, f as a, string_split(phrase, ' ') as ws from g{k} where f >= {least})
    , s{k} as (select c.lang as lang, c.phrase as phrase, c.a as a, list_min([{scores}]) as best from (select *, {cuts} from c{k}) as c {joins})"""
    held = " union ".join(
        f"select s.lang, s.phrase from c{k} as s join (select lang, a, unnest([array_to_string(ws[i:i + {k - 1}], ' ') for i in range(1, {m - k + 2})]) as part from c{m}) as o on o.lang = s.lang and o.part = s.phrase where 100 * o.a >= 80 * s.a"
        for k in (2, 3) for m in range(k + 1, 5)
    )
    return rf"""
    with pieces as (
        select coalesce(lang, 'und') as lang, row_number() over () as doc, string_split_regex({low}, '[.,;:!?\x0A-\x0D]') as ps from documents)
    , split as (select lang, doc, unnest(ps) as p, generate_subscripts(ps, 1) as piece from pieces)
    , listed as (select lang, doc, piece, regexp_extract_all(p, '[^\x20\x09]+') as ws from split)
    , words as (select lang, doc, piece, unnest(ws) as w, generate_subscripts(ws, 1) as place from listed){grams}{tables}
    , held as ({held})
    , scored as (select * from s2 union all select * from s3 union all select * from s4)
    , ranked as (
        select *, row_number() over (partition by lang order by best.score desc, a desc, encode(phrase)) as rank from scored anti join held using (lang, phrase))
    select lang, rank, phrase, a, best.l as l, best.r as r, n, best.score as score from ranked join (select lang, count(*) as n from words group by lang) using (lang) where rank <= {top}"""
