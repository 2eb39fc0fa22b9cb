"""Section compliance: keyword tags, decisions per policy, comparisons of variants."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.plans.registry import direct, op, view

#: item, label, pattern over the lower-cased text without white space
KEYWORDS = (
    ("promise", "never", "never|always"), ("promise", "best", "best|thatthe"),
    ("origin", "from", "from|with"), ("origin", "made", "ering|ation"),
    ("review", "said", "idiot|scum"), ("review", "was", "disgusting|pathetic"),
    ("contact", "mail", "@[a-z0-9]+[.]"), ("contact", "number", "[0-9]{3}"),
)
BEFORE, AFTER = "before|tion|keit", "after|ering|mente"
POLICIES = (("all", "promise"), ("all", "origin"), ("all", "review"), ("all", "contact"), ("all", "cooccur"), ("review_ban", "review"))


@op("L1_with_neighbours")
def l1(d):
    return "select page_id, section_id, idx, lag(section_id) over (partition by page_id order by idx) as prev_id, lead(section_id) over (partition by page_id order by idx) as next_id from sections"


@view
def tags(d):
    """Patterns are literals of one projection: blocks are read once, and there is no join with the dictionary."""
    plain = d.replace_all("lower(text)", "[ \\t\\r\\n]+", "")
    hits = d.array(*(f"case when {d.matches('t', pattern)} then {k} end" for k, (_, _, pattern) in enumerate(KEYWORDS)))
    name = lambda of: "case k " + " ".join(f"when {k} then '{row[of]}'" for k, row in enumerate(KEYWORDS)) + " end"
    return f"""select section_id, block_id, {name(0)} as item, {name(1)} as label from
        (select section_id, block_id, {hits} as hits from (select section_id, block_id, {plain} as t from blocks) p) q {d.array_rows('hits', 'k', 'x')} where k is not null"""


@op("L2_tag_items")
def l2(d):
    return "select section_id, item, count(distinct label) as n_labels, count(distinct block_id) as n_blocks, min(block_id) as first_block from tags group by section_id, item"


@view
def cooccur(d):
    plain = d.replace_all("lower(text)", "[ \\t\\r\\n]+", "")
    return f"""select section_id, count(case when b or a then 1 end) as n_blocks from
        (select section_id, {d.matches('t', BEFORE)} as b, {d.matches('t', AFTER)} as a from (select section_id, {plain} as t from blocks) p) q
        group by section_id having count(case when b then 1 end) > 0 and count(case when a then 1 end) > 0"""


@op("L3_tag_cooccur")
def l3(d):
    return "select section_id, n_blocks from cooccur"


@view
def item_hits(d):
    return """select section_id, item, case when count(distinct label) >= 2 then 2 else 1 end as rank_ from tags group by section_id, item
        union all select section_id, 'cooccur' as item, 2 as rank_ from cooccur"""


def found(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs; alternatives without signs are looked for as they are."""
    if not re.fullmatch("[a-z|]+", pattern):
        return F.rlike(text, F.lit(pattern))
    some = [F.contains(text, F.lit(x)) for x in pattern.split("|")]
    return F.greatest(*some) if len(some) > 1 else some[0]


@direct("item_hits", "documents")
def item_hits_of(docs: DataFrame) -> DataFrame:
    """Whether some line has a pattern is asked of the whole text: only white space within lines goes, and no pattern matches over the end of a line."""
    plain = F.lower("text")
    for c in " \t\r":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    asked = [p for _, _, p in KEYWORDS] + [BEFORE, AFTER]
    rows = docs.where("text is not null").select(F.col("doc_id").alias("section_id"), plain.alias("t"))
    rows = rows.select("section_id", *(found(F.col("t"), p).alias(f"p{k}") for k, p in enumerate(asked)))
    rows = rows.groupBy("section_id").agg(*(F.bool_or(f"p{k}").cast("int").alias(f"p{k}") for k in range(len(asked))))
    labels: dict[str, dict[str, list[str]]] = {}
    for k, (item, label, _) in enumerate(KEYWORDS):
        labels.setdefault(item, {}).setdefault(label, []).append(f"p{k}")
    any_of = lambda of: F.greatest(*map(F.col, of)) if len(of) > 1 else F.col(of[0])
    n = {item: sum((any_of(of) for of in those.values()), F.lit(0)) for item, those in labels.items()}
    ranks = {item: F.least(x, F.lit(2)) for item, x in n.items()} | {"cooccur": 2 * F.col(f"p{len(asked) - 2}") * F.col(f"p{len(asked) - 1}")}
    ranked = F.array(*(F.struct(F.lit(item).alias("item"), rank.alias("rank_")) for item, rank in ranks.items()))
    return rows.select("section_id", F.inline(ranked)).where("rank_ > 0")


@op("L4_item_decision")
def l4(d):
    return "select section_id, item, case rank_ when 2 then 'exclude' else 'review' end as decision from item_hits"


@view
def decisions(d):
    rows = [f"('{p}', '{i}')" for p, i in POLICIES]
    return f"""select n.section_id, n.policy, coalesce(h.r, 0) as rank_, case coalesce(h.r, 0) when 2 then 'exclude' when 1 then 'review' else 'keep' end as decision
        from (select section_id, case when k = 0 then 'all' else 'review_ban' end as policy from sections {d.series('0', '1', 'k')}) n
        left join (select h.section_id, p.policy, max(h.rank_) as r from item_hits h join {d.values('pol', 'policy, item', rows)} p on h.item = p.item group by h.section_id, p.policy) h
        on h.section_id = n.section_id and h.policy = n.policy"""


@op("L5_decide")
def l5(d):
    return "select section_id, policy, decision from decisions"


@op("L6_policy_counts")
def l6(d):
    return "select policy, count(case when decision = 'keep' then 1 end) as keep, count(case when decision = 'review' then 1 end) as review, count(case when decision = 'exclude' then 1 end) as exclude from decisions group by policy"


@op("L7_item_counts")
def l7(d):
    return "select item, count(case when rank_ = 1 then 1 end) as review, count(case when rank_ = 2 then 1 end) as exclude from item_hits group by item"


@op("L8_transitions")
def l8(d):
    return """select a.decision as before_, b.decision as after_, count(*) as n from decisions a join decisions b on a.section_id = b.section_id
        where a.policy = 'all' and b.policy = 'review_ban' and a.decision <> b.decision group by a.decision, b.decision"""


@op("L9_evidence")
def l9(d):
    return """select b.section_id, b.block_id, substr(b.text, 1, 80) as evidence, n.no_text from blocks b join (select distinct section_id, block_id from tags) t on b.section_id = t.section_id and b.block_id = t.block_id
        join (select section_id, count(case when trim(text) <> '' then 1 end) = 0 as no_text from blocks group by section_id) n on n.section_id = b.section_id"""


@op("L10_score_items")
def l10(d):
    """Items of the rules against the rater's: a labelled toxic document has the item review."""
    return """select coalesce(p.item, t.item) as item, count(case when p.section_id is not null and t.section_id is not null then 1 end) as hit,
        count(case when p.section_id is null then 1 end) as missed, count(case when t.section_id is null then 1 end) as false_
        from (select distinct section_id, item from item_hits where item in ('review', 'contact')) p
        full outer join (select doc_id as section_id, case when toxic = 1 then 'review' else 'contact' end as item from labels) t on p.section_id = t.section_id and p.item = t.item
        group by coalesce(p.item, t.item)"""


@op("L11_prune_sections")
def l11(d):
    return "select s.section_id, s.page_id from sections s left join (select section_id from decisions where policy = 'all' and decision = 'exclude') x on s.section_id = x.section_id where x.section_id is null"
