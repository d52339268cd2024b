"""DuckDB SQL twins of the column operators, for the correctness oracle.

Each helper returns a SQL expression string.  Patterns go through
``to_re2`` so RE2 gives Python's answer (Unicode ``\\w``/``\\s``/``\\b``).
DuckDB has no NFKC or HTML unescape; ``sql_normalize`` uses ``nfc_normalize``,
which equals NFKC on the driver's document and conversation text (checked),
and is not used for HTML pages.
"""

from __future__ import annotations

from vellum.functions import text as T
from vellum.functions.regex import SPACE_RE2, alternation, sql_str, to_re2
from vellum.packs import Pack

WS = f"[{SPACE_RE2}]"


def s(x: str) -> str:
    return sql_str(x)


def coalesce(e: str) -> str:
    return f"coalesce({e}, '')"


def match_any(e: str, patterns, flags: str = "is") -> str:
    if not patterns:
        return "FALSE"
    return f"regexp_matches({coalesce(e)}, {s(to_re2(alternation(list(patterns)), flags))})"


def strip(e: str) -> str:
    return f"regexp_replace({coalesce(e)}, {s('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def rstrip(e: str) -> str:
    return f"regexp_replace({coalesce(e)}, {s(WS + '+$')}, '')"


def compact(e: str) -> str:
    return f"regexp_replace(translate(lower({e}), {s(T.LEET_FROM)}, {s(T.LEET_TO)}), '[^a-z0-9]+', '', 'g')"


def normalize(e: str, max_chars: int | None = None) -> str:
    t = f"nfc_normalize({coalesce(e)})"
    t = f"replace({t}, chr(3661) || chr(3634), chr(3635))"
    t = f"regexp_replace({t}, '[\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]', '', 'g')"
    t = f"regexp_replace({t}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', ' ', 'g')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = strip(t)
    if max_chars is None:
        return t
    return f"(CASE WHEN length({t}) > {max_chars} THEN {rstrip(f'substr({t}, 1, {max_chars})')} ELSE {t} END)"


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def nonnull(items: list[str]) -> str:
    if not items:
        return "[]::VARCHAR[]"
    return f"list_filter([{', '.join(items)}]::VARCHAR[], lambda x: x IS NOT NULL)"


def hits(e: str, groups) -> list[str]:
    return [f"CASE WHEN {match_any(e, pats)} THEN {s(cat)} END" for cat, pats in groups]


def rule_lists(t: str, tc: str, pack: Pack) -> dict[str, str]:
    """SQL for the unsafe list, sensitive list and jailbreak flag of a normalized text."""
    unsafe = ordered_distinct(f"list_concat({nonnull(hits(t, pack.category_groups('unsafe', 'raw')))}, "
                              f"{nonnull(hits(tc, pack.category_groups('unsafe', 'compact')))})")
    sens = ordered_distinct(f"list_concat({nonnull(hits(t, pack.category_groups('sensitive', 'raw')))}, "
                            f"{nonnull(hits(tc, pack.category_groups('sensitive', 'compact')))})")
    jb = f"({match_any(t, pack.patterns('jailbreak', 'raw'))} OR {match_any(tc, pack.patterns('jailbreak', 'compact'))})"
    return {"u": unsafe, "sv": sens, "jb": jb}


def inspect_from_lists(u: str = "u", sv: str = "sv", jb: str = "jb") -> dict[str, str]:
    return {
        "severity": f"CASE WHEN len({u}) > 0 THEN 'unsafe' WHEN len({sv}) > 0 OR {jb} THEN 'controversial' ELSE 'safe' END",
        "categories": (f"CASE WHEN len({u}) > 0 THEN {ordered_distinct(f'list_concat({u}, {sv})')} "
                       f"WHEN len({sv}) > 0 THEN {sv} WHEN {jb} THEN ['jailbreak'] ELSE []::VARCHAR[] END"),
        "looks_like_jailbreak": jb,
        "reason": (f"CASE WHEN len({u}) > 0 THEN 'direct unsafe request pattern' WHEN len({sv}) > 0 "
                   f"THEN 'sensitive topic pattern' WHEN {jb} THEN 'jailbreak-like wording' ELSE 'no rule hit' END"),
    }


def route_from(severity: str, categories: str, jb: str, tokens: dict) -> dict[str, str]:
    joined = f"array_to_string({categories}, ', ')"
    unsafe = f"({severity} = 'unsafe')"
    sens = f"({severity} = 'controversial' OR {jb})"
    return {
        "route_name": f"CASE WHEN {unsafe} THEN 'UNSAFE' WHEN {sens} THEN 'SAFE_SENSITIVE' ELSE 'SAFE_DIRECT' END",
        "max_tokens": (f"CASE WHEN {unsafe} THEN {tokens['UNSAFE']} WHEN {sens} THEN {tokens['SAFE_SENSITIVE']} "
                       f"ELSE {tokens['SAFE_DIRECT']} END"),
        "route_reason": (f"CASE WHEN {unsafe} THEN 'unsafe categories: ' || {joined} WHEN {sens} THEN "
                         f"'sensitive categories: ' || (CASE WHEN {joined} = '' THEN 'jailbreak' ELSE {joined} END) "
                         f"ELSE 'safe direct answer' END"),
    }


def has_any(e: str, keywords) -> str:
    if not keywords:
        return "FALSE"
    return "(" + " OR ".join(f"contains(lower({e}), {s(k.lower())})" for k in keywords) + ")"


def count_hits(e: str, keywords) -> str:
    if not keywords:
        return "0"
    return "(" + " + ".join(f"CAST(contains(lower({e}), {s(k.lower())}) AS INTEGER)" for k in keywords) + ")"


def overlaps(cats: str, names) -> str:
    if not names:
        return "FALSE"
    return f"coalesce(list_has_any({cats}, [{', '.join(s(n) for n in names)}]), FALSE)"


# ------------------------------------------------------------ quality twins
def han_list(e: str) -> str:
    return f"regexp_extract_all({coalesce(e)}, {s(to_re2(T.HAN_CLASS, ''))}, 0)"


def unexpected_script(resp: str, query: str) -> str:
    return f"(len(list_filter({han_list(resp)}, lambda ch: NOT list_contains({han_list(query)}, ch))) > 0)"


ACRONYM_RE2 = r"(?:^|[^A-Za-z0-9])([A-Z][A-Z0-9&.\-]{1,9})(?:$|[^A-Za-z0-9])"


def acronyms(e: str) -> str:
    # Separators are doubled so that one copy can end a match and the next copy
    # can start the following one (RE2 has no lookaround).
    doubled = f"regexp_replace({coalesce(e)}, '([^A-Za-z0-9&.\\-])', '\\1\\1', 'g')"
    allow = ", ".join(s(a) for a in T.ACRONYM_ALLOWLIST)
    return (f"list_distinct(list_filter(regexp_extract_all({doubled}, {s(ACRONYM_RE2)}, 1), "
            f"lambda a: NOT list_contains([{allow}], a)))")


def entity_issue(query: str, resp: str) -> str:
    req, up = acronyms(query), f"replace(upper({coalesce(resp)}), 'ß', 'SS')"
    missing = f"list_filter({req}, lambda a: NOT contains({up}, a))"
    introduced = f"list_filter({acronyms(resp)}, lambda a: NOT list_contains({req}, a))"
    proper = f"regexp_matches({coalesce(resp)}, {s(to_re2(T.PROPER_NAME_PATTERN, ''))})"
    return f"(len({req}) > 0 AND len({missing}) > 0 AND (len({introduced}) > 0 OR {proper}))"


def delimiter_stack(sx: str) -> str:
    return (f"list_reduce(regexp_extract_all({sx}, '[()\\[\\]{{}}]', 0), lambda acc, x: CASE "
            f"WHEN x IN ('(', '[', '{{') THEN list_append(acc, x) "
            f"WHEN len(acc) > 0 AND acc[-1] = (CASE x WHEN ')' THEN '(' WHEN ']' THEN '[' ELSE '{{' END) "
            f"THEN acc[1:len(acc) - 1] ELSE acc END, []::VARCHAR[])")


def unclosed(sx: str) -> str:
    """B11 boolean on an already right-stripped text column ``sx``."""
    url = f"regexp_extract({sx}, {s(to_re2(T.TRAILING_URL_PATTERN, 'i'))}, 0)"
    bad_url = f"({url} <> '' AND NOT regexp_matches({url}, {s(to_re2(T.URL_TLD_TAIL_PATTERN, 'i'))}))"
    fences = f"((length({sx}) - length(replace({sx}, '```', ''))) // 3)"
    return f"({sx} <> '' AND (len({delimiter_stack(sx)}) > 0 OR {fences} % 2 = 1 OR {bad_url}))"


def incomplete(sx: str) -> str:
    """B12 on an already right-stripped text column ``sx``."""
    return (f"({sx} = '' OR regexp_matches({sx}, {s(to_re2(T.DANGLING_LIST_PATTERN, ''))}) "
            f"OR regexp_matches({sx}, {s(to_re2(T.DANGLING_HEADING_PATTERN, ''))}) "
            f"OR regexp_matches({sx}, {s(to_re2(T.CONNECTOR_PATTERN, 'i'))}) OR {unclosed(sx)})")


def over_refusal(e: str, pack: Pack, direct: str | None = None) -> str:
    st = strip(e)
    hit = match_any(st, pack.nonanswer_patterns)
    if direct is None:
        return f"({hit})"
    return f"({hit} OR (({direct}) AND regexp_matches({st}, {s(to_re2(T.DIRECT_REFUSAL_PATTERN, 'is'))})))"


def topics(norm: str, pack: Pack) -> str:
    return nonnull([f"CASE WHEN {has_any(norm, kws)} THEN {s(t)} END" for t, kws in pack.topics])


def response_rule(resp: str, query: str, pack: Pack) -> tuple[str, str, str]:
    """C5 -> (severity, category, reason) SQL."""
    sev, cat, why = ["CASE"], ["CASE"], ["CASE"]
    for category, reason, pat, not_pat, query_pat, strip_resp in pack.response_rules:
        target = strip(resp) if strip_resp else coalesce(resp)
        cond = match_any(target, [pat])
        if not_pat:
            cond += f" AND NOT {match_any(resp, [not_pat])}"
        if query_pat:
            cond = f"{match_any(query, [query_pat])} AND {cond}"
        sev.append(f"WHEN {cond} THEN 'unsafe'")
        cat.append(f"WHEN {cond} THEN {s(category)}")
        why.append(f"WHEN {cond} THEN {s(reason)}")
    return (" ".join(sev) + " ELSE 'safe' END", " ".join(cat) + " ELSE '' END",
            " ".join(why) + " ELSE 'no response rule hit' END")


def relevant(cand: str, cand_norm: str, query_norm: str, cats: str, pack: Pack) -> str:
    qt, rt = topics(query_norm, pack), topics(cand_norm, pack)
    parts = [f"{coalesce(cand)} <> ''", f"NOT {over_refusal(cand, pack)}",
             f"NOT (len({qt}) > 0 AND len({rt}) > 0 AND NOT list_has_any({qt}, {rt}))"]
    for mode, query_any, response_any, head, min_hits, if_cat, unless_cat, refusal_fails in pack.relevance_rules:
        applies = has_any(query_norm, query_any)
        if if_cat:
            applies += f" AND {overlaps(cats, if_cat)}"
        if unless_cat:
            applies += f" AND NOT {overlaps(cats, unless_cat)}"
        target = f"substr({cand_norm}, 1, {head})" if head else cand_norm
        if mode == "forbid":
            bad = has_any(target, response_any)
        else:
            bad = f"({count_hits(target, response_any)} < {min_hits})"
            if refusal_fails:
                bad = f"({bad} OR {over_refusal(cand, pack, 'TRUE')})"
        parts.append(f"NOT ({applies} AND {bad})")
    return "(" + " AND ".join(parts) + ")"


def priority(route: str, cats: str, pack: Pack) -> str:
    return (f"(CASE WHEN {route} = 'UNSAFE' THEN {overlaps(cats, pack.priority_unsafe)} "
            f"ELSE {overlaps(cats, pack.priority)} END)")


def direct(route: str, cats: str, pack: Pack) -> str:
    return (f"(CASE WHEN {route} = 'UNSAFE' THEN {overlaps(cats, pack.direct_unsafe)} "
            f"ELSE {overlaps(cats, pack.direct)} END)")


def clean_stages(src: str, col: str, out: str) -> list[str]:
    """CTE definitions computing B5 of ``col`` (from ``src``) into column ``out``."""
    think = s(to_re2(T.THINK_PATTERN, "is"))
    unclosed_think = s(r"(?is)<think>.*\z")
    role = s(to_re2(T.ROLE_PREFIX_PATTERN, "i"))
    fence = s(to_re2(T.FENCE_PATTERN, "s"))
    a, b, c, d = (f"{out}_{x}" for x in "abcd")
    squeeze = (f"regexp_replace(regexp_replace(replace({c}, chr(65279), ''), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), "
               f"'\\n{{3,}}', chr(10) || chr(10), 'g')")
    return [
        f"{out}_1 AS (SELECT *, regexp_replace(regexp_replace({coalesce(col)}, {think}, '', 'g'), {unclosed_think}, '') AS {a} FROM {src})",
        f"{out}_2 AS (SELECT *, {strip(f'regexp_replace({a}, {role}, {chr(39)}{chr(39)})')} AS {b} FROM {out}_1)",
        f"{out}_3 AS (SELECT *, CASE WHEN regexp_matches({b}, {fence}) THEN {strip(f'regexp_extract({b}, {fence}, 1)')} ELSE {b} END AS {c} FROM {out}_2)",
        f"{out}_4 AS (SELECT *, {strip(squeeze)} AS {d} FROM {out}_3)",
        f"{out}_5 AS (SELECT * EXCLUDE ({a}, {b}, {c}, {d}), {d} AS {out} FROM {out}_4)",
    ]


# ------------------------------------------------------------ guard twins
def tokens(e: str) -> str:
    return f"list_filter(regexp_split_to_array({coalesce(e)}, {s(WS + '+')}), lambda tk: tk <> '')"


def head_tail(a: str, lim: str) -> str:
    tail = f"greatest(1, ({lim}) // 4)"
    return (f"(CASE WHEN ({lim}) <= 0 THEN []::VARCHAR[] WHEN len({a}) <= ({lim}) THEN {a} "
            f"WHEN ({lim}) = 1 THEN {a}[1:1] "
            f"ELSE list_concat({a}[1:({lim}) - {tail}], {a}[len({a}) - {tail} + 1:len({a})]) END)")


def budget(qlen: str, rlen: str, b: int, reserve: int) -> tuple[str, str]:
    r0 = f"least({rlen}, {reserve}, {b})"
    q0 = f"least({qlen}, {b} - {r0})"
    rem = f"({b} - {r0} - {q0})"
    rx = f"least(greatest(0, {rlen} - {r0}), {rem})"
    return f"({q0} + least(greatest(0, {qlen} - {q0}), {rem} - {rx}))", f"({r0} + {rx})"


def accept(resp, query, route, cats, qn, rn, label, prob, pack: Pack, rs: str, incomplete: str | None = None,
           reject_meta: bool = False, threshold: float = 0.5) -> tuple[str, str]:
    """F1 twin -> (accepted, reason) SQL; ``rs`` is rstrip(resp)."""
    from vellum.operators import accept as A
    sev, _, why = response_rule(resp, query, pack)
    lab = f"lower(coalesce({label}, 'unknown'))"
    inc = f"({'coalesce(' + incomplete + ', FALSE) OR ' if incomplete else ''}{incomplete_fn(rs)})"
    steps = [
        (f"{strip(resp)} = ''", "FALSE", s(A.R_EMPTY)),
        (inc, "FALSE", s(A.R_INCOMPLETE)),
        (unexpected_script(resp, query), "FALSE", s(A.R_HAN)),
        (entity_issue(query, resp), "FALSE", s(A.R_ENTITY)),
    ]
    if reject_meta:
        steps.append((match_any(resp, pack.rewrite_meta_patterns), "FALSE", s(A.R_META)))
    steps += [
        (over_refusal(resp, pack, direct(route, cats, pack)), "FALSE", s(A.R_REFUSAL)),
        (f"{priority(route, cats, pack)} AND NOT {relevant(resp, rn, qn, cats, pack)}", "FALSE", s(A.R_OFF_TOPIC)),
        (f"({sev}) = 'unsafe'", "FALSE", why),
        (f"{lab} = 'unknown'", "FALSE", s(A.R_UNKNOWN)),
        (f"{lab} = 'harmful' OR coalesce({prob}, 1.0) >= {threshold}", "FALSE", s(A.R_HARMFUL)),
    ]
    ok = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v, _ in steps) + " ELSE TRUE END"
    reason = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, _, r in steps) + f" ELSE {s(A.R_ACCEPTED)} END"
    return ok, reason


incomplete_fn = incomplete


def repair_stages(src: str, col: str, finish: str, out: str) -> list[str]:
    """CTE definitions for B13 of ``col`` (already cleaned) into ``out``_text/_repaired/_incomplete."""
    lst, head = s(to_re2(T.DANGLING_LIST_PATTERN, "")), s(to_re2(T.DANGLING_HEADING_PATTERN, ""))
    url_re, tld = s(to_re2(T.TRAILING_URL_PATTERN, "i")), s(to_re2(T.URL_TLD_TAIL_PATTERN, "i"))
    term = s(to_re2(T.TERMINAL_PATTERN, ""))
    bound_re = s(to_re2("^(.*" + T.SENTENCE_BOUNDARY_PATTERN + ")", "s"))
    o = out

    def tod(p):
        return f"(CASE WHEN regexp_matches({p}, {term}) THEN {p} ELSE {p} || '.' END)"

    stack = (f"list_reduce(list_filter(list_transform(regexp_extract_all({o}_s, '(?s).', 0), "
             f"lambda ch, i: {{'c': ch, 'i': i - 1}}), lambda d: d.c IN ('(', ')', '[', ']', '{{', '}}')), "
             f"lambda acc, x: CASE WHEN x.c IN ('(', '[', '{{') THEN list_append(acc, x) "
             f"WHEN len(acc) > 0 AND acc[-1].c = (CASE x.c WHEN ')' THEN '(' WHEN ']' THEN '[' ELSE '{{' END) "
             f"THEN acc[1:len(acc) - 1] ELSE acc END, []::STRUCT(c VARCHAR, i INTEGER)[])")
    fences = f"((length({o}_s) - length(replace({o}_s, '```', ''))) // 3)"
    return [
        f"{o}_r1 AS (SELECT *, coalesce({col}, '') AS {o}_t, coalesce({finish}, 'unknown') AS {o}_fr, "
        f"{rstrip(col)} AS {o}_s FROM {src})",
        f"{o}_r2 AS (SELECT *, {stack} AS {o}_stack, regexp_extract({o}_s, {url_re}, 0) AS {o}_url FROM {o}_r1)",
        f"{o}_r3 AS (SELECT *, CASE WHEN len({o}_stack) > 0 THEN {o}_stack[-1].i WHEN {fences} % 2 = 1 "
        f"THEN length({o}_s) - strpos(reverse({o}_s), '```') - 2 END AS {o}_k FROM {o}_r2)",
        f"{o}_r4 AS (SELECT *, {rstrip(f'substr({o}_s, 1, {o}_k)')} AS {o}_prek, "
        f"regexp_replace(substr({o}_s, 1, length({o}_s) - length({o}_url)), '[ (\\[:]+$', '') AS {o}_preu, "
        f"({o}_url <> '' AND NOT regexp_matches({o}_url, {tld})) AS {o}_badurl FROM {o}_r3)",
        f"{o}_r5 AS (SELECT *, CASE WHEN regexp_matches({o}_s, {lst}) THEN {rstrip(f'regexp_replace({o}_s, {lst}, {chr(39)}{chr(39)})')} "
        f"WHEN regexp_matches({o}_s, {head}) THEN {rstrip(f'regexp_replace({o}_s, {head}, {chr(39)}{chr(39)})')} "
        f"WHEN {o}_k IS NOT NULL AND {o}_prek <> '' THEN {tod(f'{o}_prek')} "
        f"WHEN {o}_badurl AND {o}_preu <> '' THEN {tod(f'{o}_preu')} ELSE {o}_s END AS {o}_cut FROM {o}_r4)",
        f"{o}_r6 AS (SELECT *, CASE WHEN {o}_cut <> {o}_s THEN {o}_cut ELSE {o}_t END AS {o}_x, "
        f"{rstrip(f'{o}_cut')} AS {o}_cuts FROM {o}_r5)",
        f"{o}_r7 AS (SELECT *, {rstrip(f'{o}_x')} AS {o}_xs, length({o}_x) AS {o}_n, "
        f"length(regexp_extract({o}_x, {bound_re}, 1)) AS {o}_bound, strpos(reverse({o}_x), chr(10)) AS {o}_nlr FROM {o}_r6)",
        f"{o}_r8 AS (SELECT *, CASE WHEN {o}_nlr > 0 THEN {o}_n - {o}_nlr ELSE -1 END AS {o}_nl, "
        f"{incomplete(f'{o}_xs')} AS {o}_inc, {incomplete(f'{o}_cuts')} AS {o}_cutinc FROM {o}_r7)",
        f"{o}_r9 AS (SELECT *, CASE WHEN {o}_t = '' THEN {{'text': '', 'rep': FALSE, 'inc': TRUE}} "
        f"WHEN {o}_cut <> {o}_s AND {o}_cut <> '' AND NOT {o}_cutinc THEN {{'text': {o}_cut, 'rep': TRUE, 'inc': FALSE}} "
        f"WHEN {o}_fr <> 'length' AND NOT {o}_inc THEN {{'text': {o}_x, 'rep': FALSE, 'inc': FALSE}} "
        f"WHEN regexp_matches({o}_x, {term}) AND NOT {o}_inc THEN {{'text': {o}_x, 'rep': FALSE, 'inc': FALSE}} "
        f"WHEN {o}_bound > 0 AND {o}_bound >= greatest(40, {o}_n // 3) THEN "
        f"{{'text': {rstrip(f'substr({o}_x, 1, {o}_bound)')}, 'rep': TRUE, 'inc': FALSE}} "
        f"WHEN {o}_nl >= greatest(40, {o}_n // 2) THEN {{'text': {rstrip(f'substr({o}_x, 1, {o}_nl)')}, 'rep': TRUE, 'inc': FALSE}} "
        f"ELSE {{'text': {o}_x, 'rep': FALSE, 'inc': TRUE}} END AS {o}_res FROM {o}_r8)",
        f"{o}_r10 AS (SELECT *, {o}_res.text AS {o}_text, {o}_res.rep AS {o}_repaired, "
        f"({o}_res.inc OR {incomplete(rstrip(f'{o}_res.text'))}) AS {o}_incomplete FROM {o}_r9)",
    ]
