"""Row profiles, runs, cuts, sections and tiles."""

from pagegrain.plans.registry import op, view


@op("B1_row_std")
def b1(d):
    return f"select page_id, y, {d.bround('stddev_pop(gray)', 6)} as std from pixels group by page_id, y"


@op("B2_row_edge")
def b2(d):
    """Share of neighbours that differ by more than 12; a row is short, so the window is too."""
    return f"""select page_id, y, {d.bround('count(case when abs(gray - p) > 12 then 1 end) / cast(greatest(1, count(p)) as double)', 6)} as edge from
        (select page_id, y, gray, lag(gray) over (partition by page_id, y order by x) as p from pixels) q group by page_id, y"""


@view
def row_means(d):
    third = d.floordiv("x", "22")
    return f"select page_id, y, {', '.join(f'avg(case when {third} = {k} then gray end) as c{k}' for k in range(3))} from pixels group by page_id, y"


@op("B3_row_jump")
def b3(d):
    jump = ", ".join(f"abs(c{k} - lead(c{k}) over (partition by page_id order by y))" for k in range(3))
    return f"select page_id, y, {d.bround(f'greatest({jump})', 6)} as jump from row_means"


@view
def dominants(d):
    return f"""select page_id, y, k, n, share from (select page_id, y, k, n, n / cast(sum(n) over (partition by page_id, y) as double) as share, row_number() over (partition by page_id, y order by n desc, k) as r
        from (select page_id, y, {d.floordiv('gray', '16')} as k, count(*) as n from pixels group by page_id, y, {d.floordiv('gray', '16')}) q) z where r = 1"""


@op("B4_row_dominant")
def b4(d):
    return f"select page_id, y, k, {d.bround('share', 6)} as share from dominants"


@view
def blank_runs(d):
    """Rows with a value of at most 40 that follow each other, at least two long."""
    return """select page_id, min(y) as y0, max(y) + 1 as y1 from (select page_id, y, y - row_number() over (partition by page_id order by y) as g from pages_of_lengths where v <= 40) q
        group by page_id, g having count(*) >= 2"""


@op("B5_runs")
def b5(d):
    """With and without the run at the end of the page."""
    return "select r.page_id, r.y0, r.y1, r.y1 = p.h as trailing from blank_runs r join (select page_id, max(y) + 1 as h from pages_of_lengths group by page_id) p on r.page_id = p.page_id"


@view
def color_runs(d):
    return """select page_id, k, min(y) as y0, max(y) + 1 as y1 from (select *, sum(new) over (partition by page_id order by y rows between unbounded preceding and current row) as g
        from (select page_id, y, k, share, case when lag(k) over (partition by page_id order by y) = k and share >= 0.1 and lag(share) over (partition by page_id order by y) >= 0.1 then 0 else 1 end as new from dominants) q) z
        where share >= 0.1 group by page_id, k, g having count(*) >= 2"""


@op("B6_value_runs")
def b6(d):
    return "select page_id, k, y0, y1 from color_runs"


@op("B7_run_changes")
def b7(d):
    """Neighbouring runs whose colours lie 40 or more apart: two edges where the gap is wide, else its middle."""
    return f"""select page_id, case when ny0 - y1 >= 4 and e = 1 then ny0 when ny0 - y1 >= 4 then y1 else {d.floordiv('(y1 + ny0)', '2')} end as y from
        (select page_id, y1, ny0, e from (select page_id, k, y1, lead(k) over (partition by page_id order by y0) as nk, lead(y0) over (partition by page_id order by y0) as ny0 from color_runs) q
        {d.series('0', '1', 'e')} where nk is not null and 16 * abs(nk - k) >= 40) z where e = 0 or ny0 - y1 >= 4"""


@op("B8_major_runs")
def b8(d):
    """Blank runs that are wide, or whose surroundings of five rows differ by 30 in the mean."""
    side = lambda a, b: f"avg(case when p.y >= {a} and p.y < {b} then p.v end)"
    return f"""select page_id, y0, y1 from (select r.page_id, r.y0, r.y1, {side('r.y0 - 5', 'r.y0')} as before_, {side('r.y1', 'r.y1 + 5')} as after_ from blank_runs r
        join pages_of_lengths p on r.page_id = p.page_id and p.y >= r.y0 - 5 and p.y < r.y1 + 5 group by r.page_id, r.y0, r.y1) q where y1 - y0 >= 5 or abs(before_ - after_) >= 30"""


@op("B10_forced_split")
def b10(d):
    """Spans over 1200 in equal parts."""
    n = "cast(ceil((y1 - y0) / 1200.0) as bigint)"
    return f"select section_id, y0 + cast(floor((y1 - y0) * i / cast(n as double)) as bigint) as y, n from (select section_id, y0, y1, {n} as n from sections where y1 - y0 > 1200) q {d.series('1', 'n - 1', 'i')}"


@op("B11_snap")
def b11(d):
    """A change moves to the nearest centre of a blank run within 300, the earliest if two are as near."""
    return f"""select page_id, y, to_y from (select c.page_id, c.y, b.m as to_y, row_number() over (partition by c.page_id, c.y order by abs(b.m - c.y), b.m) as r
        from (select page_id, y from pages_of_lengths where v > 200) c join (select page_id, {d.floordiv('(y0 + y1)', '2')} as m from blank_runs) b on c.page_id = b.page_id and abs(b.m - c.y) <= 300) q where r = 1"""


@op("B14_sections_from_cuts")
def b14(d):
    return """select page_id, row_number() over (partition by page_id order by y) - 1 as idx, y as y0, coalesce(lead(y) over (partition by page_id order by y), h) as y1
        from (select distinct c.page_id, c.y, p.h from (select page_id, y from cuts union all select distinct page_id, cast(0 as bigint) as y from sections) c
        join (select page_id, max(y1) as h from sections group by page_id) p on c.page_id = p.page_id where c.y < p.h) q"""


@view
def crossings(d):
    """Boxes that a cut at each multiple of 200 crosses by 3 or more on both sides."""
    return f"select section_id, region_id, k * 200 as cut from regions {d.series(d.floordiv('(y0 + 3 + 199)', '200'), d.floordiv('(y1 - 3)', '200'), 'k')} where k > 0"


@op("B16_cut_crossings")
def b16(d):
    return "select section_id, region_id, cut from crossings"


@op("B17_check_sections")
def b17(d):
    return """select page_id, section_id, case when idx = 0 and y0 <> 0 then 'start' when prev is not null and prev <> y0 then 'gap' when y1 - y0 <> n_chars then 'height' else 'fine' end as state
        from (select *, lag(y1) over (partition by page_id order by idx) as prev from sections) q"""


@op("B18_cut_report")
def b18(d):
    return "select section_id % 4 as variant, count(*) as hits, count(distinct section_id * 100000 + cut) as hit_cuts from crossings group by section_id % 4"


@op("B19_split_stats")
def b19(d):
    return f"select page_id, count(*) as n, max(y1 - y0) as highest, {d.bround('median(y1 - y0)', 3)} as median, count(case when y1 - y0 > 3000 then 1 end) as forced from sections group by page_id"


@view
def tiles(d):
    """Bands of 200 with an overlap of 60; the last one keeps what lies below it too."""
    last = "max(y1)"
    return f"""select section_id, i as tile, i * 140 as y0, least(h, i * 140 + 200) as y1, case when i = 0 then 0 else i * 140 + 30 end as keep0, case when (i + 1) * 140 >= h - 60 then h else i * 140 + 170 end as keep1,
        (i + 1) * 140 >= h - 60 as last_ from (select section_id, {last} as h from regions group by section_id) q {d.series('0', f"greatest(0, {d.floordiv('(h - 61)', '140')})", 'i')}"""


@op("B20_tile_plan")
def b20(d):
    return "select section_id, tile, y0, y1, keep0, keep1 from tiles"


@view
def tiled(d):
    """Regions in every tile they lie in; the band number is the equi key."""
    return f"""select t.section_id, t.tile, t.y0 as ty0, t.y1 as ty1, t.keep0, t.keep1, t.last_, r.region_id, r.y0, r.y1 from
        (select section_id, region_id, y0, y1, i as tile from regions {d.series(d.floordiv('greatest(0, y0 - 200)', '140'), d.floordiv('y1', '140'), 'i')}) r
        join tiles t on r.section_id = t.section_id and r.tile = t.tile where r.y0 < t.y1 and r.y1 > t.y0"""


@op("B22_keep_by_zone")
def b22(d):
    return "select section_id, tile, region_id from tiled where (y0 + y1) / 2.0 >= keep0 and ((y0 + y1) / 2.0 < keep1 or last_)"


@op("B23_edge_touch")
def b23(d):
    return "select section_id, tile, region_id from tiled where (ty0 > 0 and y0 <= ty0 + 2) or (not last_ and y1 >= ty1 - 2)"


@op("B24_to_page")
def b24(d):
    return "select s.page_id, r.section_id, r.region_id, r.y0 + s.y0 as y0, r.y1 + s.y0 as y1 from regions r join sections s on r.section_id = s.section_id"


@op("B25_assign_by_center")
def b25(d):
    """Blocks, in page coordinates, to the section whose range holds their centre; pages are the equi key."""
    return """select b.page_id, b.section_id, b.block_id, s.section_id as home from (select s.page_id, b.section_id, b.block_id, s.y0 + (b.y0 + b.y1) / 2.0 as c from blocks b join sections s on b.section_id = s.section_id) b
        join sections s on s.page_id = b.page_id where b.c >= s.y0 and b.c < s.y1"""


@op("B26_premerge_units")
def b26(d):
    """Sections of a page whose last and first blocks lie close join one group."""
    return """with ends as (select s.page_id, s.section_id, s.idx, s.y0, max(b.y1) as bottom, min(b.y0) as top, max(b.font_h) as font from sections s join blocks b on s.section_id = b.section_id group by s.page_id, s.section_id, s.idx, s.y0),
        gaps as (select *, case when y0 + top - lag(y0 + bottom) over (partition by page_id order by idx) <= 0.5 * greatest(font, lag(font) over (partition by page_id order by idx)) then 0 else 1 end as opens from ends)
        select page_id, section_id, sum(opens) over (partition by page_id order by idx rows between unbounded preceding and current row) - 1 as unit from gaps"""


@op("B27_hint_boundaries")
def b27(d):
    return """select page_id, y, boundary from (select c.page_id, c.y, s.y0 as boundary, row_number() over (partition by c.page_id, c.y order by abs(s.y0 - c.y), s.y0) as r
        from (select page_id, y + 50 as y from cuts) c join sections s on c.page_id = s.page_id and abs(s.y0 - c.y) <= 100) q where r = 1"""


@op("B28_assemble_sections")
def b28(d):
    """Units from accepted starts; a page without an accepted one falls back to every fourth."""
    return """with starts as (select page_id, idx, section_id % 5 = 0 as yes, idx % 4 = 0 as hint from sections),
        used as (select *, count(case when yes then 1 end) over (partition by page_id) > 0 as answered from starts),
        groups_ as (select page_id, idx, sum(case when idx = 0 or (answered and yes) or (not answered and hint) then 1 else 0 end) over (partition by page_id order by idx rows between unbounded preceding and current row) as g from used)
        select page_id, g, min(idx) as first_idx, max(idx) as last_idx, count(*) as n from groups_ group by page_id, g"""
