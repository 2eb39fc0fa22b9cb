"""Requests, answers, costs and times of model calls."""

from pagegrain.plans.registry import op, view

PRICES = ("('click', 0.15e0, 0.60e0)", "('view', 0.30e0, 2.50e0)", "('purchase', 1.00e0, 4.00e0)", "('signup', 0.05e0, 0.40e0)")


@view
def prices(d):
    return d.values("p", "variant, price_in, price_out", PRICES)[1:-1]


@view
def fingerprints(d):
    key = d.sha("concat(cast(unit_id as string), chr(0), cast(tok_in as string))").replace("string", "string" if d.name == "spark" else "varchar")
    return f"select event_id, unit_id, variant, cached, sec, tok_in, substr({key}, 1, 16) as fp from calls"


@op("J1_fingerprint")
def j1(d):
    return "select event_id, fp from fingerprints"


@op("J2_split_cached")
def j2(d):
    return "select r.event_id, c.fp is not null as reused from fingerprints r left join (select distinct unit_id, fp from fingerprints where cached) c on r.unit_id = c.unit_id and r.fp = c.fp where not r.cached"


@op("J3_build_requests")
def j3(d):
    """The payload of a section: its blocks in order."""
    row = "concat(cast(block_id as string), ':', cast(font_h as string), ':', text)".replace("string", "string" if d.name == "spark" else "varchar")
    return f"select section_id, {d.sha(d.joined(row, '|', 'block_id'))} as payload_sha, count(*) as n from blocks group by section_id"


@op("J4_context_text")
def j4(d):
    """The first 15 blocks of a section, clipped to 30 characters, in order."""
    return f"""select section_id, {d.joined('substr(text, 1, 30)', '/', 'block_id')} as context from
        (select *, row_number() over (partition by section_id order by block_id) as r from blocks) q where r <= 15 group by section_id"""


@op("J5_parse_answers")
def j5(d):
    raw = "concat('answer: ', props, ' end')" if d.name == "spark" else "concat('answer: ', cast(props as varchar), ' end')"
    inner = d.extract(f"case when event_id % 9 = 0 then 'none' else {raw} end", "[{].*[}]")
    return f"select event_id, {d.json_int('nullif(j, ' + chr(39) * 2 + ')', 'k')} as k, j = '' as parse_error from (select event_id, {inner} as j from events) q"


@op("J6_require_complete")
def j6(d):
    return "select b.section_id, count(*) as missing from blocks b left join blocks_b x on b.section_id = x.section_id and b.block_id = x.block_id where x.block_id is null group by b.section_id"


@op("J7_validate_items")
def j7(d):
    """Answers with an unknown item are dropped, odd states become 'ambiguous', blocks out of range are errors."""
    return """select q.section_id, q.item, case when q.state in ('applies', 'ambiguous') then q.state else 'ambiguous' end as state, q.block_id between 1 and n.n as in_range
        from (select seg_id as section_id, case when seg_id % 3 = 0 then 'review' when seg_id % 3 = 1 then 'contact' else 'other' end as item,
        case when seg_id % 5 = 0 then 'maybe' else 'applies' end as state, 1 + seg_id % 12 as block_id from scores) q
        join (select section_id, count(*) as n from blocks group by section_id) n on n.section_id = q.section_id where q.item <> 'other'"""


@op("J8_apply_picks")
def j8(d):
    return "select b.section_id, b.block_id, coalesce(p.keep, true) as keep, p.block_id is null as missing from blocks b left join (select section_id, block_id, length(text) % 2 = 0 as keep from blocks_b) p on b.section_id = p.section_id and b.block_id = p.block_id"


@view
def costs(d):
    return """select c.variant, count(*) as n, sum(c.tok_in) as tok_in, sum(c.sec) as sec, sum(c.tok_in * p.price_in + 2 * c.tok_in * p.price_out) / 1000000 as usd,
        sum(case when c.cached then 0 else c.tok_in * p.price_in end) / 1000000 as live_usd, sum(case when c.cached then 0 else c.sec end) as live_sec from calls c join prices p on c.variant = p.variant group by c.variant"""


@op("J9_cost_ledger")
def j9(d):
    return f"select variant, n, cast(tok_in as bigint) as tok_in, {d.bround('usd', 9)} as usd from costs"


@op("J10_estimate_cost")
def j10(d):
    """0.9 tokens a character in, twice as many out, for each model; sums first, then models."""
    return f"""select p.variant, s.tok, {d.bround('s.tok * (p.price_in + 2 * p.price_out) / 1000000', 6)} as usd
        from (select cast(sum(cast(floor(n_chars * 0.9) as bigint)) as bigint) as tok, 1 as one from documents) s join (select *, 1 as one from prices) p on s.one = p.one"""


@op("J11_calibrate")
def j11(d):
    ratio = "judge_b / greatest(1e0, judge_a)"
    return f"select target, {d.bround('sum(judge_b) / sum(judge_a)', 6)} as total, {d.bround(f'min({ratio})', 6)} as low, {d.bround(f'max({ratio})', 6)} as high from scores group by target"


@op("J12_dry_run_plan")
def j12(d):
    return "select event_id, unit_id, tok_in from fingerprints where not cached order by tok_in desc nulls last, event_id limit 5"


@op("J13_live_cost")
def j13(d):
    return f"select variant, {d.bround('live_usd', 6)} as live_usd, {d.bround('live_sec', 4)} as live_sec, {d.bround('sec', 4)} as all_sec from costs"


@op("J14_repeat_timing")
def j14(d):
    return f"select variant, unit_id, {d.bround('median(sec)', 6)} as median_sec, count(*) as n from calls group by variant, unit_id"


@op("J15_apportion_time")
def j15(d):
    """A batch's seconds over its units by their number; mean, upper median and maximum of units."""
    return f"""with per as (select variant, unit_id, sum(sec) / count(*) as s from calls group by variant, unit_id),
        r as (select *, row_number() over (partition by variant order by s, unit_id) as k, count(*) over (partition by variant) as n from per)
        select variant, {d.bround('avg(s)', 6)} as mean_s, {d.bround('max(case when k = cast(floor(n / 2) as bigint) + 1 then s end)', 6)} as median_s, {d.bround('max(s)', 6)} as max_s from r group by variant"""
