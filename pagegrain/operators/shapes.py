"""Style, lengths, components, profiles of boxes and sources."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.operators import suppress
from pagegrain.plans.registry import frame, op, view


@view
def otsu_t(d):
    """Per return flag, the quantity that splits it with the greatest variance between the sides; ties: the least."""
    return """with h as (select l_returnflag as g, cast(l_quantity as bigint) as v, count(*) as c from lineitem group by l_returnflag, cast(l_quantity as bigint)),
        w as (select g, v, sum(c) over (partition by g order by v) as n0, sum(c * v) over (partition by g order by v) as s0, sum(c) over (partition by g) as n, sum(c * v) over (partition by g) as s from h),
        b as (select g, v, n0, case when n0 < n then cast(n0 as double) * (n - n0) * (s0 / cast(n0 as double) - (s - s0) / cast(n - n0 as double)) * (s0 / cast(n0 as double) - (s - s0) / cast(n - n0 as double)) end as var_ from w)
        select g, v as t from (select g, v, row_number() over (partition by g order by var_ desc nulls last, v) as r from b) q where r = 1"""


@op("G1_otsu")
def g1(d):
    return "select g, t from otsu_t"


@view
def sides(d):
    return """select l.l_returnflag as g, l.l_quantity <= o.t as lower_, count(*) as n, count(case when l.l_linenumber = 1 then 1 end) as border, avg(cast(l.l_extendedprice as double)) as mean
        from lineitem l join otsu_t o on l.l_returnflag = o.g group by l.l_returnflag, l.l_quantity <= o.t"""


@op("G2_fg_bg_border")
def g2(d):
    """The side with the larger share of the border is background; ties: the upper side."""
    return f"select g, lower_, {d.bround('mean', 4)} as mean, row_number() over (partition by g order by border desc, lower_) = 1 as background from sides"


@op("G3_fg_bg_minor")
def g3(d):
    return "select g, lower_, n, row_number() over (partition by g order by n, lower_) = 1 as is_text from sides"


def channel(x):
    return f"(case when {x} / 255e0 <= 0.03928 then {x} / 255e0 / 12.92 else pow(({x} / 255e0 + 0.055) / 1.055, 2.4) end)"


@view
def contrasts(d):
    lum = lambda a, b, c: f"(0.2126 * {channel(a)} + 0.7152 * {channel(b)} + 0.0722 * {channel(c)})"
    fg, bg = lum("fr", "fg", "fb"), lum("br", "bg_", "bb")
    return f"""select section_id, region_id, score, (greatest(l1, l2) + 0.05) / (least(l1, l2) + 0.05) as contrast, fr, br from (select section_id, region_id, score, fr, br, {fg} as l1, {bg} as l2 from
        (select section_id, region_id, score, (length(text) * 7) % 256 as fr, (length(text) * 13) % 256 as fg, (length(text) * 29) % 256 as fb, (x0 * 3) % 256 as br, (y0 * 5) % 256 as bg_, (x1 * 11) % 256 as bb from regions) q) z"""


@op("G4_contrast_ratio")
def g4(d):
    return f"select section_id, region_id, {d.bround('contrast', 5)} as contrast from contrasts"


@view
def aligns(d):
    """The axis with the least spread of a block's boxes, if clear enough."""
    spread = lambda e: f"(max({e}) - min({e})) / cast(greatest(1, max(x1) - min(x0)) as double)"
    return f"""select section_id, block_id, case when n = 1 or w <= 0 then 'single' when l <= 0.12 and c <= 0.12 and r <= 0.12 then 'any' when least(l, c, r) > 0.12 then 'unknown'
        when l = least(l, c, r) and least(c, r) - l >= 0.03 then 'left' when c = least(l, c, r) and least(l, r) - c >= 0.03 then 'center' when r = least(l, c, r) and least(l, c) - r >= 0.03 then 'right' else 'unknown' end as align
        from (select section_id, {d.floordiv('line_no', '3')} as block_id, count(*) as n, max(x1) - min(x0) as w, {spread('x0')} as l, {spread('(x0 + x1) / 2e0')} as c, {spread('x1')} as r from regions group by section_id, {d.floordiv('line_no', '3')}) q"""


@op("G6_block_align")
def g6(d):
    return "select section_id, block_id, align from aligns"


@op("G7_est_em")
def g7(d):
    return f"select section_id, region_id, {d.bround('(y1 - y0) * 0.75e0')} as font_px, {d.bround('(y1 - y0) * 1.35e0')} as em from regions"


@op("G8_style_rows")
def g8(d):
    return f"select c.section_id, c.region_id, {d.bround('c.contrast', 5)} as contrast, not b.is_label as target from contrasts c join regions r on c.section_id = r.section_id and c.region_id = r.region_id join blocks b on b.section_id = r.section_id and b.block_id = r.line_no + 1"


@op("G9_contrast_stats")
def g9(d):
    """Count below 1.5 and the upper median of each section."""
    return f"""select section_id, count(case when contrast < 1.5 then 1 end) as low, {d.bround('max(case when k = cast(floor(n / 2) as bigint) + 1 then contrast end)', 5)} as median from
        (select section_id, contrast, row_number() over (partition by section_id order by contrast, region_id) as k, count(*) over (partition by section_id) as n from contrasts) q group by section_id"""


@op("G10_variant_color_gap")
def g10(d):
    return f"select section_id, max(abs(fr - br)) as gap, {d.bround('count(case when abs(fr - br) > 16 then 1 end) / cast(count(*) as double)', 6)} as share from contrasts group by section_id"


@op("G11_align_dist")
def g11(d):
    return "select align, count(*) as n from aligns group by align"


@op("G14_low_contrast_list")
def g14(d):
    return "select c.section_id, c.region_id, substr(r.text, 1, 30) as clipped from contrasts c join regions r on c.section_id = r.section_id and c.region_id = r.region_id where c.contrast < 1.5"


@op("K1_typeset_targets")
def k1(d):
    return f"select section_id, block_id, 1 + length(text) - length(replace(text, chr(10), '')) as src_lines from blocks where not is_label and {d.matches('text', '[a-z]')}"


@op("K2_max_chars")
def k2(d):
    return f"select section_id, block_id, cast(greatest(4, {d.bround('(x1 - x0) * n_lines / (0.5e0 * font_h)')}) as bigint) as cap from blocks"


@view
def widths(d):
    """Width of a text from its characters: wide letters 0.9, narrow ones 0.3, others 0.55 of the size."""
    narrow = f"(length(text) - length({d.replace_all('text', '[iljtf.,]', '')}))"
    wide = f"(length(text) - length({d.replace_all('text', '[mwMW]', '')}))"
    return f"select section_id, block_id, font_h, x1 - x0 as box_w, y1 - y0 as box_h, font_h * (0.3e0 * {narrow} + 0.9e0 * {wide} + 0.55e0 * (length(text) - {narrow} - {wide})) as w from blocks"


@op("K3_text_width")
def k3(d):
    return f"select section_id, block_id, {d.bround('w', 3)} as w from widths"


@op("K5_needed_height")
def k5(d):
    return f"select section_id, block_id, {d.bround('ceil(w / greatest(1, box_w)) * font_h * 1.2e0', 3)} as need, ceil(w / greatest(1, box_w)) * font_h * 1.2e0 <= box_h * 1.3e0 + 1 as in_grow from widths"


@op("K7_overflow_rate")
def k7(d):
    return f"select target, {d.bround('avg(case when overflow then 1e0 else 0e0 end)', 6)} as rate from lengths group by target"


@op("K8_absorb_curve")
def k8(d):
    """The rows are read once and counted under each scale."""
    t = "case k " + " ".join(f"when {k} then {x}e0" for k, x in enumerate((1.0, 0.9, 0.8, 0.7, 0.5))) + " end"
    return f"select target, scale, {d.bround('count(case when need_scale >= scale then 1 end) / cast(count(*) as double)', 6)} as absorbed from (select target, need_scale, {t} as scale from lengths {d.series('0', '4', 'k')}) q group by target, scale"


@op("K9_expansion_stats")
def k9(d):
    """Upper median and maximum of the width ratio of each document."""
    return f"""select doc_id, target, {d.bround('max(case when k = cast(floor(n / 2) as bigint) + 1 then ratio end)', 6)} as median, {d.bround('max(ratio)', 6)} as highest from
        (select *, row_number() over (partition by doc_id, target order by ratio, seg_id) as k, count(*) over (partition by doc_id, target) as n from lengths) q group by doc_id, target"""


@op("K10_overflow_by")
def k10(d):
    return f"select role, count(*) as n, {d.bround('avg(case when overflow then 1e0 else 0e0 end)', 6)} as rate from lengths group by rollup (role)"


@op("K11_em_sensitivity")
def k11(d):
    return " union all ".join(f"select {e}e0 as em, count(case when w * {e}e0 > box_w then 1 end) as over_, count(*) as n from widths" for e in (0.9, 1.0, 1.1, 1.35))


@op("K12_top_expansion")
def k12(d):
    return f"select seg_id, target, {d.bround('ratio', 6)} as ratio from lengths order by ratio desc, seg_id, target limit 10"


@op("K13_sample_delta")
def k13(d):
    return f"""select role, {d.bround('new_ - old_', 6)} as delta, new_ >= old_ - 0.05 as holds from (select role, avg(case when target = 'a' then need_scale end) as old_, avg(case when target = 'b' then need_scale end) as new_ from lengths group by role) q"""


@view
def component_colors(d):
    return f"select page_id, {d.floordiv('y', '20')} as comp, {d.floordiv('gray', '8')} as k, count(*) as c from pixels group by page_id, {d.floordiv('y', '20')}, {d.floordiv('gray', '8')}"


@view
def components(d):
    return """select page_id, comp, cast(sum(c) as bigint) as area, count(case when c >= greatest(1, 0.005 * n) then 1 end) as colors from (select *, sum(c) over (partition by page_id, comp) as n from component_colors) q group by page_id, comp"""


@op("M1_color_count")
def m1(d):
    return "select page_id, comp, colors from components"


@op("M2_keep_components")
def m2(d):
    return "select page_id, comp from components where area >= 640 and colors >= 10"


@op("M3_component_rollup")
def m3(d):
    return "select page_id, count(*) as n, count(case when area >= 640 and colors >= 10 then 1 end) as kept, count(case when area >= 640 and colors >= 10 then 1 end) = 0 as none_left from components group by page_id"


@op("M4_pick_summary")
def m4(d):
    return "select page_id, count(case when colors >= 12 then 1 end) as rich, count(case when colors between 8 and 11 then 1 end) as plain_, count(case when colors < 8 then 1 end) as poor, count(distinct case when colors >= 12 then 1 else 0 end) > 1 as mixed from components group by page_id"


@op("M6_reading_relabel")
def m6(d):
    return f"select section_id, region_id, row_number() over (partition by section_id order by {d.floordiv('y0', '40')}, x0, region_id) as label from regions"


@view
def covers(d):
    """Part of each region under boxes of the second reading: their union, row stretch by row stretch."""
    key = "section_id, region_id"
    return f"""with parts as (select a.section_id, a.region_id, greatest(a.x0, b.x0) as x0, least(a.x1, b.x1) as x1, greatest(a.y0, b.y0) as y0, least(a.y1, b.y1) as y1 from pairs_ab p
        join regions a on p.section_id = a.section_id and p.a = a.region_id join regions_b b on p.section_id = b.section_id and p.b = b.region_id),
        steps as (select {key}, y as s0, lead(y) over (partition by {key} order by y) as s1 from (select {key}, y0 as y from parts union select {key}, y1 as y from parts) e),
        spans as (select s.section_id, s.region_id, s.s0, s.s1, p.x0, p.x1, max(p.x1) over (partition by s.section_id, s.region_id, s.s0 order by p.x0, p.x1 rows between unbounded preceding and 1 preceding) as far
        from steps s join parts p on s.section_id = p.section_id and s.region_id = p.region_id where s.s1 is not null and p.y0 <= s.s0 and p.y1 >= s.s1),
        areas as (select {key}, sum((s1 - s0) * greatest(0, x1 - greatest(x0, coalesce(far, x0)))) as area from spans group by {key})
        select r.section_id, r.region_id, coalesce(a.area, 0) / cast(greatest(1, (r.x1 - r.x0) * (r.y1 - r.y0)) as double) as cover from regions r left join areas a on r.section_id = a.section_id and r.region_id = a.region_id"""


def _m7(d):
    return "select section_id, count(case when cover >= 0.3 then 1 end) as n from covers group by section_id"


def _d1(d):
    return f"select section_id, region_id, {d.bround('cover', 6)} as cover, cover > 0.5 as label from covers"


@frame("M7_text_on_foreground", "regions", "regions_b", check=_m7)
def m7(regions: DataFrame, regions_b: DataFrame) -> DataFrame:
    return suppress.covered(regions, regions_b).groupBy("section_id").agg(F.count(F.when(F.col("cover") >= 0.3, 1)).alias("n"))


@frame("D1_cover_ratio", "regions", "regions_b", check=_d1)
def d1(regions: DataFrame, regions_b: DataFrame) -> DataFrame:
    return suppress.covered(regions, regions_b).select("section_id", "region_id", F.bround("cover", 6).alias("cover"), (F.col("cover") > 0.5).alias("label"))


@op("D2_ring_std")
def d2(d):
    """Spread of the rows within two of a component, outside of it."""
    return f"""select page_id, comp, {d.bround('stddev_pop(gray)', 6)} as std from (select p.page_id, p.gray, c.comp from pixels p join components c on p.page_id = c.page_id and {d.floordiv('p.y + 2', '20')} = c.comp and p.y < c.comp * 20
        union all select p.page_id, p.gray, c.comp from pixels p join components c on p.page_id = c.page_id and {d.floordiv('p.y - 2', '20')} = c.comp and p.y >= c.comp * 20 + 20) q group by page_id, comp"""


@op("D3_poly_skew")
def d3(d):
    angle = d.hypot_deg("cast(region_id % 5 as double)", "cast(greatest(1, x1 - x0) as double)")
    return f"select section_id, line_no, {d.bround(f'max({angle})', 5)} as angle, max({angle}) > 2 as skewed from regions group by section_id, line_no"


@op("A1_read_regions")
def a1(d):
    """Region documents to rows: ids from 0 in stored order."""
    return f"select doc_id as section_id, pos as region_id, line as text from documents {d.split('text', chr(92) + 'n', 'line', 'pos')}"


@op("A2_read_blocks")
def a2(d):
    return f"select doc_id as section_id, pos + 1 as block_id, line as text from documents {d.split('text', chr(92) + 'n', 'line', 'pos')}"


@op("A3_read_sections")
def a3(d):
    return "select concat(cast(page_id as varchar(20)), '_', lpad(cast(idx as varchar(20)), 3, '0')) as name, section_id, y0, y1 from sections"


@op("A4_read_evalset")
def a4(d):
    return "select conv_id as doc_id, turn as seg_id, role, text as source from conversations"


@op("A6_read_scores")
def a6(d):
    """Rows whose axis is a number; others have an old form and are left out."""
    return f"select event_id, {d.json_int('props', 'k')} as k from events where {d.json_int('props', 'k')} is not null"


@op("A7_upsert_verdicts")
def a7(d):
    """A human's cell wins over the automatic one and survives a new run."""
    return "select m.unit_id, m.variant, coalesce(h.grade, m.auto_grade) as grade, h.grade is not null as by_hand from merge_grades m left join (select unit_id, grade from grades where unit_id % 3 = 0 and grade <> '-') h on m.unit_id = h.unit_id"


@op("A10_load_dict")
def a10(d):
    return "select brand, brand_key from brands"
