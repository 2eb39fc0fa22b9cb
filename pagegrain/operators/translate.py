"""Translation checks: forms, verdicts, numbers, residue, completeness."""

from pagegrain.plans.registry import op, view

#: banned word, what replaces it, its literal form, what is expected
RULES = ("('the', 'that', 'the', 'replace')", "('with', 'along', 'with', 'retain')", "('for', 'pro', 'for', 'either')")


#: control characters, blanks and signs of ASCII
ASCII_GAP = "[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+"


@view
def rules(d):
    return d.values("r", "banned, by_, literal, expected", RULES)[1:-1]


@view
def outputs(d):
    """Source and output words with a space on both sides, so that a phrase is a run of whole words."""
    plain = lambda c: f"concat(' ', {d.replace_all(f'lower({c})', '[^a-z0-9]+', ' ')}, ' ')"
    return f"select seg_id, doc_id, line_no, target, source, translation, {plain('source')} as s, {plain('translation')} as t from segments"


@view
def verdicts(d):
    """Whole-word tests with the few rules as literals of one projection a rule."""
    one = lambda b, r, li, e: f"""select seg_id, target, '{b}' as banned, '{e}' as expected, translation is null as not_run, t like '% {r} %' as replaced, t like '% {li} %' as literal
        from outputs where s like '% {b} %'"""  # noqa: E731
    parts = [one(*(x.strip(" ()'") for x in r.split(","))) for r in RULES]
    return f"""select seg_id, target, banned, expected, case when not_run then '-' when replaced = literal then '?' when expected = 'either' then 'O'
        when (expected = 'replace') = replaced then 'O' else 'X' end as verdict from ({' union all '.join(parts)}) q"""


@op("H1_build_evalset")
def h1(d):
    return f"select seg_id, source, count(*) over (partition by doc_id) as page_lines from segments where target = 'a' and {d.matches('source', '[a-z]')}"


@op("H3_src_text")
def h3(d):
    return "select seg_id, coalesce(nullif(case when seg_id % 4 = 0 then 'fixed' when seg_id % 4 = 1 then '' end, ''), source) as src from segments where target = 'a'"


@op("H4_stem_tokens")
def h4(d):
    """Word endings: -ing, -ed, -es and -s go where three letters or more remain, then a last e of four or more.

    Only words of ASCII letters alone have endings; other letters stay part of their word.
    """
    return f"""select w, case when ends = 1 and length(cut) > 3 and cut like '%e' then substr(cut, 1, length(cut) - 1) else cut end as stem from
        (select w, case when {d.matches('w', '^[a-z]+$')} then 1 else 0 end as ends, case when not {d.matches('w', '^[a-z]+$')} then w when w like '%ing' and length(w) > 5 then substr(w, 1, length(w) - 3)
        when w like '%ed' and length(w) > 4 then substr(w, 1, length(w) - 2) when w like '%es' and length(w) > 4 then substr(w, 1, length(w) - 2) when w like '%s' and length(w) > 3 then substr(w, 1, length(w) - 1) else w end as cut
        from (select distinct w from (select {d.replace_all('lower(line)', ASCII_GAP, ' ')} as l from lines) x {d.split('l', ' ', 'w', 'pos')}) q where w <> '') z"""


@op("H5_has_phrase")
def h5(d):
    return "select seg_id, target, s like '% of the %' as in_source, coalesce(t like '% of that %', false) as in_output from outputs"


@op("H6_form_collisions")
def h6(d):
    """Brands whose key occurs inside the name of a part, and those that never do."""
    return f"select p.p_brand as brand, count(w.p_partkey) as n from (select distinct p_brand, lower(p_brand) as k from part) p left join (select p_partkey, piece from part {d.split('lower(p_name)', ' ', 'piece', 'pos')}) w on w.piece = p.k group by p.p_brand"


@op("H7_flag_pairs")
def h7(d):
    return "select seg_id, banned from verdicts where target = 'a'"


@op("H8_trap_verdict")
def h8(d):
    return "select seg_id, target, banned, verdict from verdicts"


@op("H9_apply_confirmed")
def h9(d):
    """A human's word replaces an open verdict only; on others it is stale."""
    return """select v.seg_id, v.target, v.banned, case when v.verdict = '?' and c.seg_id is not null then c.word else v.verdict end as verdict, c.seg_id is not null and v.verdict <> '?' as stale
        from verdicts v left join (select distinct seg_id, case when seg_id % 2 = 0 then 'O' else 'X' end as word from segments where seg_id % 3 = 0) c on v.seg_id = c.seg_id"""


@op("H10_trap_accuracy")
def h10(d):
    return f"""select target, {d.bround("count(case when verdict = 'O' then 1 end) / cast(nullif(count(case when verdict in ('O', 'X') then 1 end), 0) as double)", 6)} as accuracy,
        count(case when verdict = '?' then 1 end) as unknown_, count(case when verdict = '-' then 1 end) as not_run from verdicts group by target"""


@op("H11_accuracy_by_kind")
def h11(d):
    acc = lambda t: d.bround(f"count(case when target = '{t}' and verdict = 'O' then 1 end) / cast(nullif(count(case when target = '{t}' and verdict in ('O', 'X') then 1 end), 0) as double)", 6)
    return f"select expected, {acc('a')} as a, {acc('b')} as b from verdicts group by expected"


@op("H12_either_policy")
def h12(d):
    return """select target, case when count(case when r then 1 end) = count(*) then 'replacing' when count(case when r then 1 end) = 0 then 'retaining' else 'mixed' end as policy
        from (select target, coalesce(t like '% pro %', false) as r from outputs where s like '% for %') q group by target"""


@op("H13_term_accuracy")
def h13(d):
    return f"select target, {d.bround('avg(case when t like ' + chr(39) + '% that %' + chr(39) + ' or t like ' + chr(39) + '% the %' + chr(39) + ' then 1e0 else 0e0 end)', 6)} as accuracy from outputs where s like '% the %' group by target"


@view
def numbers(d):
    """Digit runs of source and output."""
    def one(c, side):
        digits = d.replace_all(c, "[^0-9]+", " ")
        return f"select seg_id, target, '{side}' as side, n from (select seg_id, target, {digits} as l from segments) x {d.split('l', ' ', 'n', 'pos')} where n <> ''"

    return f"{one('source', 's')} union all {one('coalesce(translation, ' + chr(39) * 2 + ')', 't')}"


@op("H14_numbers_of")
def h14(d):
    return "select seg_id, n, count(*) as times from numbers where side = 's' and target = 'a' group by seg_id, n"


@op("H15_numeric_fidelity")
def h15(d):
    """Multiset inclusion of the source's numbers in the output."""
    return """select target, sum(least(cs, ct)) as kept, sum(cs - least(cs, ct)) as lost from (select seg_id, target, n, count(case when side = 's' then 1 end) as cs, count(case when side = 't' then 1 end) as ct
        from numbers group by seg_id, target, n) q group by target""".replace("sum(least(cs, ct))", "cast(sum(least(cs, ct)) as bigint)").replace("sum(cs - least(cs, ct))", "cast(sum(cs - least(cs, ct)) as bigint)")


@op("H16_residual_source")
def h16(d):
    return f"select seg_id, target from outputs where translation is not null and {d.matches(d.replace_all('translation', '(the|that)', ''), '[àâçéèêëîïôûùüÿñæœäöß]')}"


@op("H17_char_ratio")
def h17(d):
    return f"select target, {d.bround('sum(length(translation)) / cast(sum(length(source)) as double)', 2)} as ratio from segments where translation is not null group by target"


@view
def completes(d):
    return "select target, count(*) as n, count(case when translation is null then 1 end) as missing from segments group by target"


@op("H18_completeness")
def h18(d):
    return f"select target, missing, {d.bround('(n - missing) / cast(n as double)', 6)} as rate from completes"


@op("H19_qualify")
def h19(d):
    return "select c.target, c.missing = 0 and v.n = 0 as qualified from completes c join (select target, count(case when verdict = 'X' then 1 end) as n from verdicts group by target) v on c.target = v.target"


@op("H20_pivot_targets")
def h20(d):
    return "select seg_id, banned, max(case when target = 'a' then verdict end) as a, max(case when target = 'b' then verdict end) as b from verdicts group by seg_id, banned"


@op("H21_review_lists")
def h21(d):
    return "select v.seg_id, v.target, v.banned, r.by_, v.verdict, substr(s.source, 1, 40) as source from verdicts v join rules r on v.banned = r.banned join segments s on s.seg_id = v.seg_id and s.target = v.target where v.verdict in ('?', 'X')"


@op("H22_exclude_reference_only")
def h22(d):
    return "select c.target, c.n from completes c left join (select 'b' as target) x on c.target = x.target where x.target is null"


@op("H23_prefix_check")
def h23(d):
    return "select seg_id, target, coalesce(substr(lower(translation), 1, 5) = substr(lower(source), 1, 5), false) as has_prefix from segments where length(source) >= 5"


@op("H24_fill_report")
def h24(d):
    return "select doc_id, target, count(*) as n, count(case when translation is null then 1 end) as without, count(case when trim(translation) = '' then 1 end) as blank from segments group by doc_id, target"
