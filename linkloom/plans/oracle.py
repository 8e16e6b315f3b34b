"""The operators in DuckDB SQL: common table expressions that build on each other."""

from __future__ import annotations

from linkloom.functions import vocab
from linkloom.sources.records import DUCKDB, records_sql


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map(words: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in words.items()) + "}"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in items) + "]"


def _look(words: dict[str, str], x: str) -> str:
    return f"coalesce({_map(words)}[{x}], {x})"


def clean(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {_q(vocab.MISSING)}, ' ', 'gi')"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def digits(x: str) -> str:
    return f"regexp_matches({x}, '^[0-9]+$')"


def deleet(t: str) -> str:
    return f"(case when regexp_matches({t}, '[a-z]') and regexp_matches({t}, '[0-9]') and not regexp_matches({t}, '^[0-9]+(st|nd|rd|th)$') then translate({t}, {_q(vocab.LEET[0])}, {_q(vocab.LEET[1])}) else {t} end)"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w_: w_ <> '')"


def variants(s: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({s}, {_q(vocab.ALIAS)}), lambda p: trim(p)), lambda p: p <> '')"
    bare = r"replace(regexp_replace(regexp_replace(p, '^www\.', ''), '\.[^.]*$', ''), '.co', '')"
    return f"(case when len({parts}) > 0 then list_transform({parts}, lambda p: case when regexp_matches(p, {_q(vocab.WEB)}) then {bare} else p end) else [{s}] end)"


def tokens(s: str) -> str:
    plain = f"translate(replace(replace(replace(replace({s}, '&', ' and '), '+', ' '), '''s ', 's '), '''', ''), '@$!', 'asi')"
    marked = f"list_transform(list_transform(regexp_extract_all({plain}, '[a-z0-9]+'), lambda t: {deleet('t')}), lambda t: case when regexp_matches(t, '^[a-z]$') then chr(2) || t || chr(3) else t end)"
    glued = f"replace(replace(replace(array_to_string({marked}, ' '), chr(3) || ' ' || chr(2), ''), chr(2), ''), chr(3), '')"
    return f"list_transform({words(glued)}, lambda t: {_look(vocab.NAME_WORDS, 't')})"


def core(toks: str) -> str:
    left = f"list_filter({toks}, lambda t: not list_contains({_list(vocab.LEGAL_WORDS)}, t))"
    return f"(case when len({left}) > 0 then {left} else {toks} end)"


def components(a: str, ctry: str) -> str:
    parts = f"list_filter(list_transform(string_split({a}, ','), lambda p: trim(regexp_replace(regexp_replace(p, '[^a-z0-9/\\- ]', ' ', 'g'), ' +', ' ', 'g'))), lambda p: p <> '')"
    return f"(case when {ctry} = 'us' then list_transform({parts}, lambda p: {_look(vocab.US_STATES, 'p')}) else {parts} end)"


def address_tokens(comps: str) -> str:
    glued = "'^([a-z]+)([0-9]+)$'"
    head = f"regexp_extract(t, {glued}, 1)"
    one = f"""case when regexp_matches(t, '^[0-9]+(st|nd|rd|th)$') then [regexp_extract(t, '^([0-9]+)', 1)]
        when regexp_matches(t, {glued}) then [{_look(vocab.ADDRESS_WORDS, head)}, regexp_extract(t, {glued}, 2)]
        when regexp_matches(t, '^[0-9]+[a-z]$') then [regexp_extract(t, '^([0-9]+)', 1)] else [{_look(vocab.ADDRESS_WORDS, 't')}] end"""
    return f"coalesce(flatten(list_transform({comps}, lambda p: flatten(list_transform(regexp_extract_all(p, '[a-z0-9]+'), lambda t: {one})))), []::varchar[])"


def skeleton(t: str) -> str:
    mapped = f"translate({t}, {_q(vocab.CONSONANTS[0])}, {_q(vocab.CONSONANTS[1])})"
    rest = f"regexp_replace(substr({mapped}, 2), '[aeiouyhw]', '', 'g')"
    once = f"array_to_string(list_transform(range(1, len({rest}) + 1), lambda i_: case when i_ = 1 or substr({rest}, i_::int, 1) <> substr({rest}, i_::int - 1, 1) then substr({rest}, i_::int, 1) else '' end), '')"
    return f"(case when regexp_matches({t}, '^[0-9]*$') then {t} else substr({mapped}, 1, 1) || coalesce({once}, '') end)"


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(case when {union} > 0 then len(list_intersect({a}, {b}))::double / {union} else 0.0 end)"


_NO = f"not {digits('t')}"
_PLACE = f"{_NO} and not list_contains({_list(vocab.PLACE_STOP)}, t) and len(t) >= 3"
_ADDR_WORDS = f"list_filter({{}}, lambda t: {_NO} and not list_contains({_list(vocab.ADDRESS_STOP)}, t))"
_NUMS = f"list_transform(list_filter({{}}, lambda t: {digits('t')}), lambda t: regexp_replace(t, '^0+', ''))"

#: Distinct elements in order of first place.
def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e_, k_: list_position({x}, e_) = k_)"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "biz": (records_sql(DUCKDB), ()),
    "raw1": (f"select entity_id, {fold(clean('business_name'))} as n, {fold(clean('business_address'))} as a, coalesce(nullif(trim({fold('country')}), ''), '_unk') as ctry from biz", ("biz",)),
    "raw2": (f"select entity_id, ctry, list_transform({variants('n')}, lambda v: {tokens('v')}) as fulls, {components('a', 'ctry')} as cl from raw1", ("raw1",)),
    "raw3": (f"select entity_id, ctry, fulls, cl, list_transform(fulls, lambda f: array_to_string({core('f')}, ' ')) as cores from raw2", ("raw2",)),
    "prep": (f"""select entity_id, array_to_string(fulls[len(fulls)], ' ') as name_full, cores[len(cores)] as name_core, array_to_string({_ordered_distinct('cores')}, '|') as name_vars,
        array_to_string({address_tokens('cl')}, ' ') as addr_n, array_to_string(cl, '|') as comps, ctry from raw3""", ("raw3",)),
    "vars_": (f"select entity_id, ctry, addr_n, {words('v')} as toks from (select *, unnest(string_split(name_vars, '|')) as v from prep) where len({words('v')}) > 0", ("prep",)),
    "addr": (f"""select entity_id, ctry, aw, list_slice({_NUMS.format('aw')}, 1, 3) as nums, list_filter(aw, lambda t: {_PLACE}) as alpha from (select entity_id, ctry, {words('addr_n')} as aw from prep)""", ("prep",)),
    "place": (f"select *, {_ordered_distinct('alpha')} as da from addr", ("addr",)),
    "name_in": (f"""select v.entity_id, v.ctry, toks, array_to_string(toks, '') as g, list_filter(toks, lambda t: len(t) >= 2)[1] as lead, nums,
        list_transform(list_slice(da, greatest(len(da) - 3, 1), len(da)), lambda t: {skeleton('t')}) as places from vars_ v join place p using (entity_id)""", ("vars_", "place")),
    "keys_all": (f"""
        select entity_id, ctry, 't' || unnest(list_filter(toks, lambda t: len(t) >= 2 and {_NO})) as key from name_in
        union all select entity_id, ctry, 'k' || unnest(list_transform(list_filter(toks, lambda t: len(t) >= 4), lambda t: {skeleton('t')})) from name_in
        union all select entity_id, ctry, 'g' || g from name_in
        union all select entity_id, ctry, 'u' || substr(g, unnest(range(1, len(g) - 3))::int, 5) from name_in where len(toks) = 1 and len(g) >= 10
        union all select entity_id, ctry, 'u' || substr(unnest(list_filter(toks, lambda t: len(t) >= 5)), 1, 5) from name_in
        union all select entity_id, ctry, 'h' || substr(g, 1, 6) from name_in where len(g) >= 8
        union all select entity_id, ctry, 'b' || least(toks[i], toks[i + 1]) || '_' || greatest(toks[i], toks[i + 1]) from (select *, unnest(range(1, len(toks))) as i from name_in)
        union all select entity_id, ctry, 'b' || least(toks[1], toks[3]) || '_' || greatest(toks[1], toks[3]) from name_in where len(toks) >= 3
        union all select entity_id, ctry, 'x' || lead || '_' || unnest(nums) from name_in where lead is not null
        union all select entity_id, ctry, 'y' || lead || '_' || unnest(places) from name_in where lead is not null
        union all select entity_id, ctry, 'q' || array_to_string(list_sort(string_split(g, '')), '') from name_in where len(g) >= 6
        union all select entity_id, ctry, 'a' || array_to_string(list_transform(toks, lambda t: substr(t, 1, 1)), '') from name_in where len(toks) >= 2
        union all select entity_id, ctry, 'a' || toks[1] from name_in where len(toks) = 1 and len(toks[1]) between 2 and 5
        union all select entity_id, ctry, 'z' || unnest(list_filter(aw, lambda t: regexp_matches(t, '^[0-9]{{5,6}}$'))) from addr
        union all select entity_id, ctry, 's' || {skeleton('x')} || '_' || {skeleton('y')} from (select entity_id, ctry, alpha[i] as x, alpha[i + 1] as y from (select *, unnest(range(1, len(alpha))) as i from addr))
        union all select entity_id, ctry, 'n' || regexp_replace(t, '^0+', '') || '_' || {skeleton('street')} from (
            select *, row_number() over (partition by entity_id order by i) as nth from (
                select entity_id, ctry, i, aw[i] as t, list_filter(list_slice(aw, i + 1, i + 2), lambda u: not {digits('u')} and not list_contains({_list(vocab.HOUSE_SKIP)}, u) and len(u) >= 2)[1] as street
                from (select *, unnest(range(1, len(aw) + 1)) as i from addr)) where {digits('t')} and street is not null) where nth <= 3""", ("name_in", "addr")),
    "keys_": ("select distinct entity_id, ctry, key from keys_all", ("keys_all",)),
    "lk": ("select * from keys_ where entity_id like 'S1-%'", ("keys_",)),
    "rk": ("select * from keys_ where entity_id not like 'S1-%'", ("keys_",)),
    "shard": ("select ctry, count(*) as n_right from prep where entity_id not like 'S1-%' and ctry in (select ctry from prep where entity_id like 'S1-%') group by ctry", ("prep",)),
    "kdf": ("select ctry, key, count(*) as df from rk group by ctry, key having count(*) <= 500", ("rk",)),
    "kidf": ("select k.ctry, key, df, ln(1 + n_right / df) as idf from kdf k join shard using (ctry)", ("kdf", "shard")),
    "met": ("select lk.entity_id as i, rk.entity_id as j, lk.key, idf from lk join kidf using (ctry, key) join rk using (ctry, key)", ("lk", "rk", "kidf")),
    "scores": ("select i, j, round(sum(cast(idf as decimal(20, 12)))::double, 6) as kscore from met group by i, j", ("met",)),
    "best": ("select * from (select *, row_number() over (partition by i order by kscore desc, j) as rank from scores) where rank <= 40", ("scores",)),
    "pairs": ("""select b.i, b.j, b.kscore, l.name_vars as vl, r.name_vars as vr, l.name_core as nl, r.name_core as nr, l.addr_n as al, r.addr_n as ar, l.comps as cl, r.comps as cr
        from best b join prep l on l.entity_id = b.i join prep r on r.entity_id = b.j""", ("best", "prep")),
    "lists": (f"select *, {words('nl')} as tl, {words('nr')} as tr, list_distinct({words('al')}) as sl, list_distinct({words('ar')}) as sr, list_distinct(string_split(cl, '|')) as kl, list_distinct(string_split(cr, '|')) as kr from pairs", ("pairs",)),
    "sets": (f"select *, {_ADDR_WORDS.format('sl')} as wl, {_ADDR_WORDS.format('sr')} as wr, list_distinct({_NUMS.format('sl')}) as dl, list_distinct({_NUMS.format('sr')}) as dr from lists", ("lists",)),
    "scored": (f"select i, j, kscore, round(0.5 * {jaccard('tl', 'tr')} + 0.3 * {jaccard('dl', 'dr')} + 0.2 * {jaccard('wl', 'wr')}, 6) as p2 from sets", ("sets",)),
    "truth_": ("select l.entity_id as i, r.entity_id as j from biz l join biz r on l.nm = r.nm and l.lang = r.lang and l.entity_id like 'S1-%' and r.entity_id not like 'S1-%'", ("biz",)),
    "s1": ("select entity_id as i from biz where entity_id like 'S1-%'", ("biz",)),
    "excl": ("select i, j, case when p2 >= max(p2) over (partition by j) then p2 else 0.0 end as p from scored", ("scored",)),
    "grid": ("select mode, tau from (values ('thr'), ('exp')) m(mode), (values (0.3), (0.35), (0.4), (0.45), (0.5), (0.55), (0.6), (0.65), (0.7)) t(tau)", ()),
    "valued": ("""select i, j, p, m, tau, none_, case when p < tau then -1.0 else 1.25 * cum / (0.25 * tot + m) end as val from (
        select i, j, p, tau, row_number() over (partition by tau, i order by p desc, j) as m,
            sum(cast(p as decimal(20, 15))) over (partition by tau, i order by p desc, j rows between unbounded preceding and current row)::double as cum,
            sum(cast(p as decimal(20, 15))) over (partition by tau, i)::double as tot, exp(sum(ln(1 - least(p, 1 - 1e-9))) over (partition by tau, i)) as none_
        from excl, (select distinct tau::double as tau from grid) where p > 0)""", ("excl", "grid")),
    "chosen": ("select tau, i, j, p, m from (select *, min(case when val = bv then m end) over (partition by tau, i) as cut from (select *, max(val) over (partition by tau, i) as bv from valued)) where bv > none_ and m <= cut", ("valued",)),
    "anchor": ("select i, j as anchor, p2 from (select *, row_number() over (partition by i order by p2 desc, kscore desc, j) as nth from scored where p2 >= 0.5) where nth <= 4", ("scored",)),
    "met_r": ("select a.entity_id as i, b.entity_id as j, idf from rk a join kidf_r using (ctry, key) join rk b using (ctry, key)", ("rk", "kidf_r")),
    "kidf_r": ("select k.ctry, key, ln(1 + n / df) as idf from kdf k join (select ctry, count(*) as n from prep where entity_id not like 'S1-%' group by ctry) using (ctry)", ("kdf", "prep")),
    "near": ("""select i as a, j as n, kscore as score from (select *, row_number() over (partition by i order by kscore desc, j) as rank from
        (select i, j, round(sum(cast(idf as decimal(20, 12)))::double, 6) as kscore from met_r group by i, j)) where rank <= 7 and i <> j""", ("met_r",)),
    "cut_": ("select *, p2 >= 0.2 as ok from scored", ("scored",)),
}


def duck(sql: str, *needs: str) -> str:
    """``sql`` after the expressions that it needs, each after its own needs."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for n in CTES[name][1]:
                add(n)
            done.append(name)

    for n in needs:
        add(n)
    if not done:
        return sql
    return "with " + ",\n".join(f"{n} as materialized ({CTES[n][0]})" for n in done) + "\n" + sql
