"""Views over the base tables: pages, sections, regions, blocks, calls and raters.

The base tables hold no boxes. Lines of a document become rows of boxes with integer
geometry that follows from text lengths only, so it is the same on every engine.
A page is twenty documents, which bounds the windows over pages.
"""

from __future__ import annotations

from pagegrain.plans.registry import kept, view


@view
def lines(d):
    return f"select doc_id, cast(line_no as bigint) as line_no, line from documents {d.split('text', chr(92) + 'n', 'line', 'line_no')} where text is not null"


@view
def line_boxes(d):
    return """select doc_id, line_no, line, 12 + (length(line) % 5) * 6 as h,
        cast(coalesce(sum(16 + (length(line) % 5) * 6 + (length(line) % 4) * 6) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as y0
        from lines"""


@view
def pieces(d):
    return f"select doc_id, line_no, h, y0, cast(pos as bigint) as pos, piece from line_boxes {d.split('line', '[.] ', 'piece', 'pos', 'p')}"


@kept
def regions(d):
    """Boxes of a line differ in height and top; a few overlap the next one, and some leave a wide gap behind."""
    gap = "(case length(piece) % 7 when 3 then 90 when 5 then -10 else 12 end)"
    return f"""select doc_id as section_id, row_number() over (partition by doc_id order by line_no, pos) - 1 as region_id,
        x0, y0 + length(piece) % 3 * 2 as y0, x0 + 8 * length(piece) as x1, y0 + length(piece) % 3 * 2 + h + (case when length(piece) % 4 = 1 then 10 else 0 end) as y1, piece as text, (length(piece) % 100) / 100 as score, line_no
        from (select *, cast(coalesce(sum(8 * length(piece) + {gap}) over (partition by doc_id, line_no order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as x0 from pieces) q"""


@view
def regions_b(d):
    """A second reading of the same sections: some regions missing, others a little off."""
    return "select section_id, region_id, x0 + (region_id % 3) * 4 as x0, y0 + (region_id % 2) * 3 as y0, x1 + (region_id % 3) * 4 as x1, y1 + (region_id % 2) * 3 as y1, text, score from regions where score >= 0.05"


@view
def blocks(d):
    return """select doc_id as section_id, line_no + 1 as block_id, cast(0 as bigint) as x0, y0, cast(8 * length(line) as bigint) as x1, cast(y0 + h as bigint) as y1,
        line as text, cast(h as bigint) as font_h, cast(1 as bigint) as n_lines, (length(line) % 11 = 0) as is_label from line_boxes"""


@view
def blocks_b(d):
    return "select * from blocks where length(text) % 7 <> 3"


@view
def sections(d):
    return f"""select {d.floordiv('doc_id', 20)} as page_id, doc_id as section_id, row_number() over (partition by {d.floordiv('doc_id', 20)} order by doc_id) - 1 as idx,
        cast(coalesce(sum(n_chars) over (partition by {d.floordiv('doc_id', 20)} order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as y0,
        cast(sum(n_chars) over (partition by {d.floordiv('doc_id', 20)} order by doc_id rows between unbounded preceding and current row) as bigint) as y1, n_chars from documents"""


@view
def calls(d):
    return f"select event_id, event_type as variant, user_id as unit_id, value as sec, {d.json_int('props', 'k')} as tok_in, event_id % 4 = 0 as cached from events"


@view
def scores(d):
    return "select d.doc_id as seg_id, d.lang as target, 5 + l.quality * 4 - l.toxic * 3 as judge_a, 10 - (d.n_chars % 6) as judge_b, 1 + d.n_chars % 10 as axis_b from documents d join labels l on d.doc_id = l.doc_id"


@view
def segments(d):
    """Source lines with two outputs each: one replaces a word, the other leaves some out."""
    return f"""select doc_id, line_no, doc_id * 100000 + line_no as seg_id, line as source, case when k = 0 then 'a' else 'b' end as target,
        case when k = 0 then replace(line, ' the ', ' that ') when length(line) % 5 = 0 then null else line end as translation
        from lines {d.series('0', '1', 'k')} where length(trim(line)) >= 2"""


@view
def pixels(d):
    """Rows of grey values from embeddings, 200 vectors to a page by their id, in bands of five rows of one brightness."""
    return f"""select page_id, y, cast(x as bigint) as x, cast(floor(80 + 100 * cast(v as double)) as bigint) + 45 * ({d.floordiv('y', '5')} % 3) as gray
        from (select {d.floordiv('vec_id', '200')} as page_id, vec_id % 200 as y, embedding from embeddings) e {d.array_rows('embedding', 'v', 'x')}"""


@view
def grades(d):
    return """select doc_id as unit_id, case when n_chars % 10 < 5 then 'A' when n_chars % 10 < 8 then 'B' when n_chars % 10 < 9 then 'C' else '-' end as grade,
        cast(n_chars % 3 as bigint) as split_err, cast(n_chars % 2 as bigint) as over_err, cast(1 + n_chars % 40 as bigint) as n_blocks, cast(n_chars % 4 as bigint) as n_labels, lang as variant from documents"""


@view
def pages_of_lengths(d):
    """Row profiles: the length of each line stands for the texture of a row."""
    return "select doc_id as page_id, line_no as y, length(line) as v from lines"


@view
def cuts(d):
    return "select page_id, y0 as y from sections where idx > 0"


@view
def brands(d):
    return "select distinct p_brand as brand, lower(replace(p_brand, '#', '')) as brand_key from part"


@view
def lengths(d):
    """Outputs against their sources: box, em, width ratio and the scale that would fit."""
    return f"""select seg_id, doc_id, target, 8 * length(source) as box_w, length(source) as n_src, length(translation) as n_out, length(source) % 5 as role,
        length(translation) / greatest(1, length(source)) as ratio, greatest(0.3, least(1.0, greatest(1, length(source)) / greatest(1, length(translation)))) as need_scale,
        (length(translation) > length(source)) as overflow from segments where translation is not null"""


@view
def dets(d):
    """Detections: regions with their score, their kind by text length, and whether they are true."""
    return f"select section_id, region_id, x0, y0, x1, y1, score, y1 - y0 as h, length(text) % 3 as logo, region_id % 4 = 0 as is_true from regions"
