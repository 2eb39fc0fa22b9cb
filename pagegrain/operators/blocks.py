"""Regions, blocks and roles: order, statistics, overlaps, comparisons of variants, grades."""

from pagegrain.plans.registry import op, view


def v_overlap(a, b):
    return f"greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) / greatest(1, least({a}.y1 - {a}.y0, {b}.y1 - {b}.y0))"


def h_overlap(a, b):
    return f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) / greatest(1, least({a}.x1 - {a}.x0, {b}.x1 - {b}.x0))"


@view
def median_h(d):
    """The upper median height of each section."""
    return """select section_id, h as med from (select section_id, y1 - y0 as h, row_number() over (partition by section_id order by y1 - y0, region_id) as r,
        count(*) over (partition by section_id) as n from regions) q where r = cast(floor(n / 2) as bigint) + 1"""


@op("C1_reading_order")
def c1(d):
    tol = d.floordiv("m.med", "2")
    return f"""select r.section_id, r.region_id, row_number() over (partition by r.section_id order by {d.floordiv('r.y0', f'greatest(10, {tol})')}, r.x0, r.region_id) - 1 as pos
        from regions r join median_h m on r.section_id = m.section_id"""


@op("C2_overlap_ratios")
def c2(d):
    return f"""select a.section_id, a.region_id, {d.bround(v_overlap('a', 'b'), 6)} as v_overlap, {d.bround(h_overlap('a', 'b'), 6)} as h_overlap
        from regions a join regions b on a.section_id = b.section_id and b.region_id = a.region_id + 1"""


@op("C3_gutters")
def c3(d):
    """x gaps between boxes of a section that no box covers, at least max(20, width / 16) wide."""
    return f"""with w as (select section_id, max(x1) as w from regions group by section_id),
        reach as (select section_id, x0, max(x1) over (partition by section_id order by x0, region_id rows between unbounded preceding and 1 preceding) as far from regions)
        select r.section_id, r.far as g0, r.x0 as g1 from reach r join w on r.section_id = w.section_id where r.far is not null and r.x0 - r.far >= greatest(20, {d.floordiv('w.w', '16')}) and r.far > 0"""


@view
def built(d):
    """Lines of regions as blocks: union box, text in reading order, upper median height."""
    return f"""select section_id, line_no + 1 as block_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, {d.joined('text', '|', 'region_id')} as text,
        count(*) as n_regions, max(y1 - y0) as font_h from regions group by section_id, line_no"""


@op("C6_build_blocks")
def c6(d):
    return f"select section_id, block_id, x0, y0, x1, y1, {d.sha('text')} as text_sha, n_regions, font_h from built"


@view
def fonts(d):
    """Quartiles of the heights of a section's regions, over one row for each height."""
    q = lambda p: f"min(case when upto > cast(floor(n * {p}) as bigint) then h end)"
    return f"""select section_id, {q(0.75)} as big, {q(0.25)} as small from (select section_id, h, sum(c) over (partition by section_id order by h) as upto, sum(c) over (partition by section_id) as n
        from (select section_id, y1 - y0 as h, count(*) as c from regions group by section_id, y1 - y0) p) q group by section_id"""


@op("C7_font_stats")
def c7(d):
    return "select section_id, big, small from fonts"


@view
def roles(d):
    price, caution = "[0-9]+([.,][0-9]+)? ?(eur|usd|[$])", "^(note|caution)|[#*]{3}"
    return f"""select b.section_id, b.block_id, case when {d.matches('lower(b.text)', price)} and length(b.text) <= 40 then 'price' when {d.matches('lower(b.text)', caution)} then 'caution'
        when b.font_h >= f.big and b.n_lines <= 2 then 'title' when b.font_h <= f.small and length(b.text) <= 25 then 'caption' else 'body' end as role
        from blocks b join fonts f on b.section_id = f.section_id"""


@op("C8_classify_role")
def c8(d):
    return "select section_id, block_id, role from roles"


@op("C10_apply_merge_plan")
def c10(d):
    """A plan that puts neighbouring blocks together is accepted only if it covers each block once."""
    return f"""with plan as (select section_id, {d.floordiv('block_id', '2')} as part, block_id from blocks where section_id % 7 <> 3 or block_id > 1),
        seen as (select b.section_id, count(*) as n, count(p.block_id) as covered from blocks b left join plan p on b.section_id = p.section_id and b.block_id = p.block_id group by b.section_id)
        select b.section_id, p.part, min(b.x0) as x0, min(b.y0) as y0, max(b.x1) as x1, max(b.y1) as y1, count(*) as n from blocks b join plan p on b.section_id = p.section_id and b.block_id = p.block_id
        join seen s on s.section_id = b.section_id where s.n = s.covered group by b.section_id, p.part"""


@op("C11_role_counts")
def c11(d):
    cols = ", ".join(f"count(case when role = '{r}' then 1 end) as n_{r}" for r in ("title", "body", "caption", "price", "caution"))
    return f"select section_id, {cols} from roles group by section_id"


@op("C12_overlap_pairs")
def c12(d):
    """Pairs meet in bands of 64 pixels; the band where both are first seen owns the pair."""
    band = lambda t: d.series(d.floordiv("y0", "64"), d.floordiv("y1", "64"), "band", t)
    return f"""with banded as (select section_id, region_id, x0, y0, x1, y1, band from regions {band('s')})
        select a.section_id, a.region_id as a, b.region_id as b from banded a join banded b on a.section_id = b.section_id and a.band = b.band and a.region_id < b.region_id
        where least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0) and a.band = {d.floordiv('greatest(a.y0, b.y0)', '64')}"""


@op("C13_hetero_blocks")
def c13(d):
    return "select section_id, line_no + 1 as block_id from regions group by section_id, line_no having max(y1 - y0) > 1.5 * min(y1 - y0)"


@view
def signatures(d):
    one = lambda t, v: f"select '{v}' as variant, section_id, block_id, {d.sha('text')} as sig from {t}"
    return f"{one('blocks', 'a')} union all {one('blocks_b', 'b')}"


@view
def agreements(d):
    return f"""select section_id, count(distinct case when n = 2 then sig end) as same, sum(na) as n_a, sum(nb) as n_b from
        (select section_id, sig, count(distinct variant) as n, count(case when variant = 'a' then 1 end) as na, count(case when variant = 'b' then 1 end) as nb from signatures group by section_id, sig) q group by section_id"""


@op("C14_agreement")
def c14(d):
    return f"select section_id, same, {d.bround('same / ((n_a + n_b) / 2e0)', 6)} as agreement from agreements"


@op("C15_variant_diff")
def c15(d):
    return """select section_id, sig, case when count(case when variant = 'b' then 1 end) = 0 then 'only_a' else 'only_b' end as side from signatures
        group by section_id, sig having count(distinct variant) = 1"""


@op("C16_propagate_verdicts")
def c16(d):
    """The grade of a section goes to the sections of the other variant with the same set of blocks."""
    return f"""with sets as (select variant, section_id, {d.sha(d.joined('sig', ',', 'sig'))} as set_sig from signatures group by variant, section_id)
        select b.section_id, g.grade from sets a join sets b on a.set_sig = b.set_sig and a.section_id = b.section_id and a.variant = 'a' and b.variant = 'b' join grades g on g.unit_id = a.section_id"""


@view
def merge_grades(d):
    rate = "(split_err + 2 * over_err) / greatest(1, n_blocks)"
    return f"select unit_id, variant, grade, case when n_blocks < 10 and split_err <= 1 and over_err = 0 then 'A' when {rate} <= 0.10 and over_err = 0 then 'A' when {rate} <= 0.25 then 'B' else 'C' end as auto_grade from grades"


@op("C17_grade_merge")
def c17(d):
    return "select unit_id, auto_grade from merge_grades"


@op("C18_grade_role")
def c18(d):
    return """select unit_id, case when n_blocks - n_labels <= 0 then '-' when split_err / (n_blocks - n_labels) <= 0.10 then 'A'
        when split_err / (n_blocks - n_labels) <= 0.25 then 'B' else 'C' end as role_grade from grades"""


@op("C19_grade_gate")
def c19(d):
    return """select variant, count(case when g = 'A' then 1 end) as a, count(case when g = 'B' then 1 end) as b, count(case when g = 'C' then 1 end) as c,
        count(case when g in ('A', 'B') then 1 end) >= 0.7 * count(*) as passed from (select variant, coalesce(nullif(grade, '-'), auto_grade) as g from merge_grades) q group by variant"""


@op("C20_no_text_units")
def c20(d):
    """Sections in which the second variant has no text."""
    return "select s.section_id from sections s left join (select distinct section_id from blocks_b where trim(text) <> '') t on s.section_id = t.section_id where t.section_id is null"


@op("C21_role_listing")
def c21(d):
    return "select r.section_id, r.block_id, r.role, substr(b.text, 1, 40) as clipped from roles r join blocks b on r.section_id = b.section_id and r.block_id = b.block_id where r.role in ('price', 'caution')"


@op("C22_changed_sections")
def c22(d):
    return "select section_id, n_a + n_b - 2 * same as changed from agreements where n_a <> same or n_b <> same order by changed desc, section_id limit 5"
