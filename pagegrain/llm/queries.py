"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pagegrain.llm.dac import op10
from pagegrain.llm.decontam import op3
from pagegrain.llm.divergence import op13
from pagegrain.llm.infill import op12
from pagegrain.llm.langid import op4
from pagegrain.llm.mixlm import op2
from pagegrain.llm.near import op9
from pagegrain.llm.packing import op7
from pagegrain.llm.personal import op11
from pagegrain.llm.quality import op5
from pagegrain.llm.repeats import op6
from pagegrain.llm.rules import op1
from pagegrain.llm.secrets import op8


def queries() -> dict:
    return {
        "op1_quality_rules": op1,
        "op2_lm_scoring": op2,
        "op3_benchmark_decontamination": op3,
        "op4_language_id": op4,
        "op5_quality_classifier": op5,
        "op6_substring_dedup": op6,
        "op7_best_fit_packing": op7,
        "op8_secret_scans": op8,
        "op9_minhash_near_dedup": op9,
        "op10_token_codes": op10,
        "op11_personal_data": op11,
        "op12_fill_in_middle": op12,
        "op13_source_divergence": op13,
    }


WORDS = "d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents)"

OP6_SQL = f"""with {WORDS},
win as (select doc_id, i as pos, array_to_string(w[i:i + 12], ' ') as k from d, unnest(range(1, len(w) - 11)) t(i)),
early as (select k, min(doc_id) as least from win group by k),
gone as (select distinct win.doc_id, pos + j as i from win join early using (k), unnest(range(0, 13)) u(j) where least < win.doc_id),
every as (select doc_id, i, w[i] as word from d, unnest(range(1, len(w) + 1)) t(i)),
kept as (select every.doc_id, string_agg(word, ' ' order by every.i) as t, count(*) as n from every anti join gone on every.doc_id = gone.doc_id and every.i = gone.i group by every.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

OP9_SQL = f"""with recursive {WORDS},
sh as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
sz as (select doc_id, count(*) as n, sha256(string_agg(s, '|' order by s)) as sig from sh group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b using (s) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
pairs as (select a, b from met join sz x on x.doc_id = a join sz y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)),
reach(x, y) as (select doc_id, doc_id from d union select r.x, p.b from reach r join pairs p on r.y = p.a),
same as (select doc_id, count(*) over (partition by sig) as n_same from sz)
select d.doc_id, min(y) as class_id, any_value(coalesce(n_same, 1)) as n_same from d join reach on x = d.doc_id left join same on same.doc_id = d.doc_id group by d.doc_id"""


OP12_SQL = r"""with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
u as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as u, [cast('0x' || substr(x, 8 * k + 1, 8) as bigint) for k in [0, 1, 2, 3]] as h from d),
c as (select *, len(u) as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as b from u),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') as pre, coalesce(array_to_string(u[a + 1:b], ''), '') as mid, coalesce(array_to_string(u[b + 1:n], ''), '') as suf,
    case when t = '' or regexp_matches(t, '<[PSM]>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p"""

OP13_SQL = r"""with d as (select coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as c from w group by all),
kept as (select lang, term from w group by all having count(distinct r) >= 30),
g as (select distinct lang, source from d),
cell as (select g.lang, g.source, term, coalesce(c, 0) as c from g join kept using (lang) left join c using (lang, source, term)),
p as (select *, 1 + 1000000000::hugeint * (c + 5) // (sum(c) over (partition by lang, source) + 5 * count(*) over (partition by lang, source)) as p from cell),
l as (select lang, term, sum(c) as c from cell group by all),
q as (select lang, term, 1 + 1000000000::hugeint * (c + 5) // (sum(c) over (partition by lang) + 5 * count(*) over (partition by lang)) as q from l),
dist as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join dist on dist.lang = a.lang and dist.source = a.source and dist.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term) z)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; tests compare the others with brute force."""
    return {"op6_substring_dedup": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL, "op12_fill_in_middle": OP12_SQL, "op13_source_divergence": OP13_SQL}
