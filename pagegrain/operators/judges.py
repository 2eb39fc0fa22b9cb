"""Blind judges and graded reports."""

from pagegrain.plans.registry import op, view


@view
def axes(d):
    """A row for each score of a segment: the scores are read once."""
    pick = lambda *xs: "case k " + " ".join(f"when {i} then {x}" for i, x in enumerate(xs)) + " end"
    return f"select target, {pick(*(chr(39) + a + chr(39) for a in ('judge_a', 'judge_b', 'axis_b')))} as axis, {pick('judge_a', 'judge_b', 'axis_b')} as v from scores {d.series('0', '2', 'k')}"


@op("I1_blind_pairs")
def i1(d):
    return "select seg_id, source, translation from segments where translation is not null and translation <> '' and target = 'a'"


@op("I2_axis_stats")
def i2(d):
    return f"select target, axis, {d.bround('avg(v)', 6)} as mean, min(v) as low, count(case when v <= 7 then 1 end) as n_low, count(*) as n from axes group by target, axis"


@op("I3_compliance_counts")
def i3(d):
    return """select s.target, count(case when s.judge_a >= 8 then 1 end) as justified, count(case when s.judge_a < 8 then 1 end) as unjustified from scores s
        left join (select unit_id from grades where grade = 'C') e on s.seg_id = e.unit_id where e.unit_id is null group by s.target"""


@op("I4_judge_agreement")
def i4(d):
    return f"select target, {d.bround('avg(case when (judge_a <= 7) = (least(judge_b, axis_b) <= 7) then 1e0 else 0e0 end)', 6)} as agreement, count(case when (judge_a <= 7) = (least(judge_b, axis_b) <= 7) then 1 end) >= 0.7 * count(*) as usable from scores group by target"


@op("I5_low_lists")
def i5(d):
    return "select seg_id, target, case when judge_a <= 7 and judge_b <= 7 then 'both' else 'one' end as low from scores where judge_a <= 7 or judge_b <= 7"


@op("I6_finals")
def i6(d):
    return f"""select target, {d.bround('(avg(judge_a) + avg(judge_b)) / 2', 6)} as mean, count(case when judge_a <= 7 and judge_b <= 7 then 1 end) as both_low,
        count(case when (judge_a <= 7) <> (judge_b <= 7) then 1 end) as one_low, count(*) as n from scores group by target order by both_low, target"""


@op("I7_judge_gap")
def i7(d):
    return f"select target, {d.bround('abs(avg(judge_a) - avg(judge_b))', 6)} as gap, least(min(judge_a), min(judge_b)) as low from scores group by target"


@op("F7_ab_ratio")
def f7(d):
    return f"""select variant, {d.bround("count(case when grade in ('A', 'B') then 1 end) / cast(nullif(count(case when grade <> '-' then 1 end), 0) as double)", 6)} as ratio,
        count(case when grade <> '-' then 1 end) as graded, count(*) as total from grades group by variant"""


@op("G12_axis_tally")
def g12(d):
    return "select axis, count(case when v >= 9 then 1 end) as a, count(case when v in (7, 8) then 1 end) as b, count(case when v < 7 then 1 end) as c from axes group by axis"


@op("G13_bucket_score")
def g13(d):
    """Upper median score by length of text, over one row for each score of a bucket."""
    return """with c as (select bucket, score, count(*) as c from (select score, case when length(text) < 20 then 'short' when length(text) < 60 then 'middle' else 'long' end as bucket from regions) r group by bucket, score),
        u as (select bucket, score, sum(c) over (partition by bucket order by score) as upto, sum(c) over (partition by bucket) as n from c)
        select bucket, min(case when upto > cast(floor(n / 2) as bigint) then score end) as median_score, cast(max(n) as bigint) as n from u group by bucket"""


@op("M5_ox_tally")
def m5(d):
    return "select target, count(case when judge_a >= 8 then 1 end) as o, count(case when judge_a < 8 then 1 end) as x, count(case when judge_a is null then 1 end) as none_ from scores group by target"


@op("D5_vote_split")
def d5(d):
    return "select seg_id, case when (judge_a > 7) and (judge_b > 7) and (axis_b > 7) then 'all' when (judge_a <= 7) and (judge_b <= 7) and (axis_b <= 7) then 'none' else 'split' end as vote from scores"


@op("D6_miss_false_tally")
def d6(d):
    return """select s.target, count(case when l.quality = 1 and judge_b <= 7 then 1 end) as missed, count(case when l.quality = 0 and judge_b > 7 then 1 end) as false_,
        count(case when l.quality = 1 and judge_b <= 7 then 1 end) = 0 as gate from scores s join labels l on s.seg_id = l.doc_id group by s.target"""


@op("D7_build_truth")
def d7(d):
    """(predicted minus false) plus missed, with the contract's two checks."""
    return """select section_id, block_id, predicted, false_, missed, (predicted and not false_) or missed as truth, not (missed and predicted) and (predicted or not false_) as valid from
        (select section_id, block_id, is_label as predicted, is_label and length(text) % 2 = 0 as false_, not is_label and length(text) % 13 = 0 as missed from blocks) q"""


@op("D8_bucket_miss")
def d8(d):
    return """select case when least(x1 - x0, y1 - y0) < 15 then 'small' when least(x1 - x0, y1 - y0) < 30 then 'middle' else 'large' end as bucket, count(*) as n, count(case when not is_label and length(text) % 13 = 0 then 1 end) as missed
        from blocks group by case when least(x1 - x0, y1 - y0) < 15 then 'small' when least(x1 - x0, y1 - y0) < 30 then 'middle' else 'large' end"""


@op("D9_tag_counts")
def d9(d):
    return f"select trim(tag) as tag, count(*) as n from (select concat(lang, ',', source, ', ', lang) as tags from documents) t {d.split('tags', ',', 'tag', 'pos', 'x')} group by trim(tag)"


@op("D10_label_rate")
def d10(d):
    return f"select section_id, {d.bround('avg(case when is_label then 1e0 else 0e0 end)', 6)} as rate_a, {d.bround('avg(case when is_label and length(text) % 7 <> 3 then 1e0 else 0e0 end)', 6)} as rate_b from blocks group by section_id"


@op("D4_apply_flags")
def d4(d):
    """Answers must have every block once; sections that fail come out as errors."""
    return "select b.section_id, count(*) as blocks, count(x.block_id) as answered, count(*) = count(x.block_id) as accepted from blocks b left join blocks_b x on b.section_id = x.section_id and b.block_id = x.block_id group by b.section_id"
